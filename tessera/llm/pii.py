"""Personal data by weak supervision.

Base spans (email, ip, card, phone) follow fixed patterns and checks and always stay. Further candidates - credentials, account
numbers, person names - are put to the vote of labelers of three kinds, each with evidence of its own:

* regex - the candidate's shape: public key prefixes, hexadecimal or mixed runs, entropy; the check digits of an IBAN; paths and words that speak against it;
* gazetteer - lists of given names and surnames (parameters), of words that announce a credential or an account, of titles;
* context - what stands directly before and after: an assignment mark, a quote, a verb of speech, and whether the words are ordinary words of the same text.

Each labeler votes yes, no or abstains. Votes of all candidates of all documents are counted by pattern (kind and votes: at most
3 ** LABELERS of a kind, whatever the input); expectation-maximisation over these counts estimates the labelers' reliabilities
(a two-class model with independent labelers). The span classifier is a logistic regression on hashed features - the span's shape and size, the words before
and after it and the marks between, and the votes - fitted to the resulting probabilities as soft labels on at most SAMPLE candidates (those of the least hash of
text and place). So it may overrule the votes where shape or context say otherwise. It scores every candidate and decides which become spans.

Offsets are code points, ends exclusive. Defined results: null text is empty and has no spans; a null doc_id stays null; repeated rows give
equal results each; an empty table gives no rows and needs no model; other columns are ignored, also those named like columns made here.
Matching is linear in the text, also for long runs of digits or of letters.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from math import log2
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, table, text_of
from tessera.llm.textnum import slices

KINDS = ["email", "ip", "card", "phone", "secret", "account", "name"]
BASE = 4
#: Labelers of a kind; candidates that the classifier is fitted on, at most; buckets of its features.
LABELERS = 5
SAMPLE = 20_000
BUCKETS = 1 << 11
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Matches begin at the head of a run of digits, so no other place needs a try.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Fixed lists of the labelers; names can be given as parameters.
ANNOUNCES_SECRET = frozenset("token secret password passwd pwd passphrase apikey api_key api-key access_key private_key client_secret signature session key credential auth authorization bearer".split())
ANNOUNCES_ACCOUNT = frozenset("account acct acc iban konto kontonummer compte cuenta conto passport ssn tax id no number nr nummer numéro número policy license licence".split())
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "sk_live_", "sk_test_", "sk-", "xoxb-", "xoxp-", "AIza", "eyJ", "glpat-", "npm_", "pypi-")
GIVEN_NAMES = frozenset(
    "james john robert william david richard joseph thomas charles christopher daniel matthew anthony mark donald steven andrew paul joshua kenneth kevin brian george"
    " mary patricia jennifer linda elizabeth barbara susan jessica sarah karen lisa nancy betty sandra margaret ashley emily donna michelle carol amanda melissa laura emma"
    " hans peter klaus jürgen michael wolfgang ursula monika petra sabine stefan andreas markus christian julia katrin anja heike lukas felix jonas leon lena lea"
    " jean pierre michel philippe alain marie nathalie isabelle sylvie catherine nicolas julien camille chloé léa manon hugo louis"
    " josé antonio manuel francisco juan maría carmen ana isabel dolores anna maria luis carlos miguel pedro sofía lucía elena pablo diego".split()
)
SURNAMES = frozenset(
    "smith johnson williams brown jones miller davis wilson anderson taylor moore jackson martin lee thompson white harris clark lewis robinson walker young allen king"
    " müller schmidt schneider fischer weber meyer wagner becker schulz hoffmann koch bauer richter klein wolf schröder neumann schwarz"
    " bernard dubois robert petit durand leroy moreau laurent lefebvre roux fournier girard"
    " garcía rodríguez gonzález fernández lópez martínez sánchez pérez gómez díaz hernández álvarez muñoz romero".split()
)
HONORIFICS = frozenset("mr mrs ms miss dr prof sir herr frau monsieur madame mme señor señora sr sra don doña name named called".split())
SPEECH = frozenset("said says wrote writes asked told replied sagte schrieb fragte dit écrit demande dijo escribió lives works born is was".split())

SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+")
ACCOUNT = re.compile(r"(?<![A-Za-z0-9+.-])[A-Z]{0,2}[0-9]{8,30}+(?!\.?[A-Za-z0-9])")
# Pairs of capitalised words at every word, also those that overlap: the pair is group 1.
NAME = re.compile(r"\b(?=([A-ZÄÖÜÁÉÍÓÚÑ][a-zäöüßáéíóúñèêç]++ [A-ZÄÖÜÁÉÍÓÚÑ][a-zäöüßáéíóúñèêç]++\b))")
BEFORE = re.compile(r"([\w-]+)[\"']?\s*([=:]?)\s*([\"']?)$")
AFTER = re.compile(r"([\"']?)[\s.,;:!?]*(\w*)")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of local part, @, domain: found from each @ outwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), by start and then kind."""
    out = [(a, 0, b) for a, b in emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(c.isascii() and c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


BEFORE_NAME = re.compile(r"(\w+)(\.?)(\s*)$")


def vote(yes: bool, no: bool = False) -> str:
    return "y" if yes else "n" if no else "-"


def bucket(kind: int, name: str, value: object) -> int:
    return crc32(f"{kind}|{name}|{value}".encode()) % BUCKETS


def shape(span: str) -> str:
    """Runs of upper and lower case letters, digits and marks, the first eight."""
    out = ""
    for c in span[:64]:
        k = "9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        if not out or out[-1] != k:
            out += k
    return out[:8]


def features(kind: int, span: str, votes: str, before: re.Match | None, after: re.Match) -> list[int]:
    """Buckets of the features of a candidate."""
    n = len(span)
    digits, upper, different = (int(3.999 * x / n) for x in (sum(map(str.isdigit, span)), sum(map(str.isupper, span)), len(set(span))))
    word, mark, quote = (before[1].lower(), before[2], before[3]) if before else ("", "", "")
    said = [("kind", ""), ("size", min(9, n // 4)), ("digits", digits), ("upper", upper), ("different", different), ("shape", shape(span)), ("before", word), ("mark", mark + quote + "|" + after[1]), ("after", after[2].lower())]
    return [bucket(kind, name, value) for name, value in [*said, *((f"vote{j}", v) for j, v in enumerate(votes))]]


def iban(s: str) -> bool:
    """Whether the check digits of an IBAN hold."""
    return len(s) >= 15 and s[:2].isalpha() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * log2(c / n) for c in Counter(s).values())


def candidates(text: str, base: list[tuple[int, int, int]], given: frozenset[str] = GIVEN_NAMES, family: frozenset[str] = SURNAMES) -> list[tuple[int, int, int, str, list[int]]]:
    """(start, kind, end, votes, features) of what the labelers vote on; nothing that overlaps a base span."""
    out, said = [], None
    starts, ends = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))

    def free(a: int, b: int) -> bool:
        i = bisect_left(starts, b)
        return not i or ends[i - 1] <= a

    def add(kind: int, a: int, b: int, votes: str, before: re.Match | None) -> None:
        out.append((a, kind, b, f"{kind}|{votes}", features(kind, text[a:b], votes, before, AFTER.match(text[b : b + 24]))))

    for m in SECRET.finditer(text):
        s = m[0]
        if free(m.start(), m.end()) and any(map(str.isdigit, s)) and any(map(str.isalpha, s)):
            before = BEFORE.search(text[max(0, m.start() - 32) : m.start()])
            word = before[1].lower() if before else ""
            hexed = not s.lower().strip("0123456789abcdef")
            parted = s.count("-") + s.count("_") + s.count("/") > 3  # names and paths
            mixed = sum(a.isdigit() != b.isdigit() for a, b in zip(s[:80], s[1:81], strict=False)) >= 6
            votes = vote(s.startswith(KEY_PREFIXES) or hexed and len(s) >= 32 or mixed and not parted, parted)
            votes += vote(entropy(s[:256]) >= (3.0 if hexed else 3.8), entropy(s[:256]) < 2.5) + vote(word in ANNOUNCES_SECRET)
            votes += vote(bool(before and (before[2] or before[3])), not before) + vote(False, m.start() > 0 and text[m.start() - 1] in "/.")
            add(4, m.start(), m.end(), votes, before)
    for m in ACCOUNT.finditer(text):
        if free(m.start(), m.end()):
            before = BEFORE.search(text[max(0, m.start() - 32) : m.start()])
            word = before[1].lower() if before else ""
            told = word in ANNOUNCES_ACCOUNT
            votes = vote(iban(m[0]), len(set(m[0])) < 3) + vote(m[0][:2].isalpha()) + vote(told, bool(word) and not told) + vote(bool(before and before[2]), not (before and before[2])) + vote(told and bool(before[2]))
            add(5, m.start(), m.end(), votes, before)
    for m in NAME.finditer(text):
        first, second = m[1].lower().split(" ")
        known, kin = first in given, second in family
        before = BEFORE_NAME.search(text[max(0, m.start() - 16) : m.start()])
        honoured = bool(before) and before[1].lower() in HONORIFICS
        after = AFTER.match(text[m.end(1) : m.end(1) + 24])
        if known or honoured or kin:
            said = Counter(re.findall(r"[^\W\d_]+", text)) if said is None else said
            votes = vote(known, not known) + vote(kin) + vote(honoured, not before and m.start() > 0) + vote(after[2] in SPEECH) + vote(False, first == second or bool(said[first] or said[second]))
            out.append((m.start(1), 6, m.end(1), f"6|{votes}", features(6, m[1], votes, before, after)))
    return sorted(out)


def _label(batches: Iterator[pa.RecordBatch], given: frozenset[str], family: frozenset[str]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    extra = pa.struct([*span, ("votes", pa.string()), ("x", pa.list_(pa.int32()))])
    for whole in batches:
        for batch in slices(whole, 1):
            bases, extras = [], []
            for x in batch.column(1):
                text = x.as_py() or ""
                base = base_spans(text)
                bases.append([{"start": a, "kind": k, "end": b} for a, k, b in base])
                extras.append([{"start": a, "kind": k, "end": b, "votes": v, "x": x} for a, k, b, v, x in candidates(text, base, given, family)])
            yield pa.record_batch([batch.column(0), pa.array(bases, pa.list_(span)), pa.array(extras, pa.list_(extra))], names=["doc_id", "base", "extra"])


def label(docs: DataFrame, given: frozenset[str] = GIVEN_NAMES, family: frozenset[str] = SURNAMES) -> DataFrame:
    """doc_id, base spans and candidates with their votes and features, written to the shared folder."""
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    s = "struct<start:int,kind:int,end:int>"
    return materialize(d.mapInArrow(lambda batches: _label(batches, given, family), f"doc_id long, base array<{s}>, extra array<{s[:-1]},votes:string,x:array<int>>>"), "labels")


def estimate(counts: dict[str, int], rounds: int = 50) -> dict[str, float]:
    """The probability that a candidate of each pattern of votes (kind|votes) is personal data, by expectation-maximisation over the candidates of each."""
    names = sorted(counts)
    n = np.array([counts[p] for p in names], float)
    kind = np.array([int(p.split("|")[0]) for p in names])
    votes = np.array([["-yn".index(v) for v in p.split("|")[1]] for p in names]).reshape(len(names), -1)
    # Labelers are told apart by the kind that they vote on. They start as rather reliable.
    theta = {(k, j): np.array([[0.45, 0.1, 0.45], [0.45, 0.5, 0.05]]) for k in set(kind) for j in range(votes.shape[1])}
    prior = dict.fromkeys(set(kind), 0.3)
    q = np.zeros(len(names))
    for _ in range(rounds):
        for i in range(len(names)):
            like = np.array([1 - prior[kind[i]], prior[kind[i]]])
            for j in range(votes.shape[1]):
                like = like * theta[kind[i], j][:, votes[i, j]]
            q[i] = like[1] / like.sum()
        for k in prior:
            own = kind == k
            prior[k] = float(np.clip((n[own] @ q[own] + 1) / (n[own].sum() + 3), 0.01, 0.99))
            for j in range(votes.shape[1]):
                t = np.array([[4.5, 1, 4.5], [4.5, 5, 0.5]])  # the start counts as ten candidates a class
                for c, weight in ((0, 1 - q), (1, q)):
                    t[c] += np.bincount(votes[own, j], n[own] * weight[own], 3)
                theta[k, j] = t / t.sum(1, keepdims=True)
    return dict(zip(names, q.tolist(), strict=True))


def regression(x: np.ndarray, y: np.ndarray, rounds: int = 300, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression on bucket features (a row each) and soft labels, by gradient descent with momentum."""
    w, moved = np.zeros(BUCKETS), np.zeros(BUCKETS)
    rate = 4.0 / x.shape[1]
    for _ in range(rounds):
        ahead = w + 0.9 * moved
        p = 1 / (1 + np.exp(-ahead[x].sum(1)))
        gradient = np.bincount(x.ravel(), np.repeat(p - y, x.shape[1]), BUCKETS) / len(y)
        moved = 0.9 * moved - rate * (gradient + ridge * ahead)
        w += moved
    return w


def train(found: DataFrame) -> np.ndarray | None:
    """The classifier's weights; None without candidates. Reads the votes of all candidates, and the features of at most SAMPLE."""
    each = found.select("doc_id", F.explode("extra").alias("e"))
    counts = {r["votes"]: r["n"] for r in each.groupBy("e.votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    soft = estimate(counts)
    order = F.xxhash64("doc_id", "e.start", "e.end", "e.votes")
    sample = each.select("e.votes", "e.x", order.alias("o")).orderBy("o", "votes", "x").limit(SAMPLE).drop("o").toArrow()
    x = sample.column("x").combine_chunks().flatten().to_numpy().reshape(sample.num_rows, -1)
    return regression(x, np.array([soft[v] for v in sample.column("votes").to_pylist()]))


def find_personal_data(docs: DataFrame, threshold: float = 0.5, given: frozenset[str] = GIVEN_NAMES, family: frozenset[str] = SURNAMES) -> DataFrame:
    """doc_id, base and all spans (arrays of start, kind, end), over every document."""
    found = label(docs, given, family)
    w = train(found)
    least = float(np.log(threshold / (1 - threshold)))
    if w is None:
        return found.select("doc_id", "base", F.col("base").alias("spans"))
    weights = F.array(*[F.lit(round(float(v), 9)) for v in w])
    z = lambda e: F.aggregate(e["x"], F.lit(0.0), lambda total, i: total + F.get(weights, i))
    good = F.filter("extra", lambda e: z(e) >= least)
    more = F.transform(good, lambda e: F.struct(e["start"].alias("start"), e["kind"].alias("kind"), e["end"].alias("end")))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", more)).alias("spans"))


def listed(spans: str):  # noqa: ANN201
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id and text with each span replaced by its kind in brackets; overlapping spans are one, of the first one's kind."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                parts, at = [], 0
                for x in s or []:
                    if x["start"] >= at:
                        parts += [t[at : x["start"]], f"[{KINDS[x['kind']]}]"]
                    at = max(at, x["end"])
                out.append("".join(parts) + t[at:])
            yield pa.record_batch([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    joined = docs.select("doc_id", text_of(docs).alias("text")).join(spans.select("doc_id", "spans").dropDuplicates(["doc_id"]), "doc_id", "left")
    return joined.mapInArrow(clean, "doc_id long, text string")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = find_personal_data(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    n = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(BASE)]
    return r.select("doc_id", *n, F.size("spans").cast("long").alias("n_spans"), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def base_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op2_pii that fixed rules decide; SQL can express these."""
    return op2_pii(spark, sf_dir).drop("spans", "n_spans")


def _sql_matches(kind: str, pattern: str, good: str) -> str:
    """Leftmost non-overlapping matches with their places: what stands between matches tells where each begins."""
    return f"""SELECT doc_id, '{kind}' AS kind, m, s FROM (SELECT doc_id, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1),
        lambda i: CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT))) AS s
        FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS parts FROM t)) WHERE {good}"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse({_DIGITS}), i, 1) AS INTEGER) ELSE (CAST(substr(reverse({_DIGITS}), i, 1) AS INTEGER) * 2) // 10 + (CAST(substr(reverse({_DIGITS}), i, 1) AS INTEGER) * 2) % 10 END)) % 10 = 0"
BASE_SQL = f"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    found AS ({_sql_matches("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true")}
        UNION ALL {_sql_matches("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda x: CAST(x AS HUGEINT) > 255)) = 0")}
        UNION ALL {_sql_matches("card", "[0-9]([\\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}")}
        UNION ALL {_sql_matches("phone", "\\+[0-9][\\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15")}),
    n AS (SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
                 string_agg(kind || ':' || s || ':' || (s + length(m)), ',' ORDER BY s, list_position(['email', 'ip', 'card', 'phone'], kind)) AS listed FROM found GROUP BY doc_id)
    SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(listed, '')) AS base_sha256
    FROM t LEFT JOIN n USING (doc_id)"""
