"""Mixing sources to target weights by soft membership.

Domains are the classes of a labelled table (here quality and toxic together: ``q1t0``, ``q1t1``, ``q0t0``, ``q0t1``). A classifier predicts each document's
posterior over the domains; document rates r >= 0 are then fitted so that the expected tokens of domain k, E_k(r) = sum_d r_d t_d p_dk, match its target T_k:

    minimise 1/2 sum_k (E_k(r) - T_k)^2 / E_k(1)   subject to 0 <= r_d <= most

by projected gradient descent from r = 1 with momentum, which restarts where the loss rises. A document's gradient is t_d times a combination of its
posteriors, so with the step scaled by 1 / t_d an iteration needs one number a domain from all documents (E is linear, so momentum needs no more): a distributed sum over a narrow table of posteriors, tokens and rates, which is rewritten every CHUNK steps so that
no step is computed more than CHUNK times. The fit ends when the projected gradient is small (the rates of all tokens together move by less than TOLERANCE
of them); ``Mixture`` tells how far each domain is from its target and whether the fit has converged, and a fit that has not in ITERATIONS steps warns. Where
``most`` keeps a target out of reach the distance stays and says so. Rates become whole copies by ``floor(rate + u)`` with u a hash of doc_id and text -
unbiased, and fixed for a document.

Classifier: multinomial logistic regression on structure statistics, counts of LEXICON words (those most typical of a domain) and all their products.
Lexicon and weights come from at most SAMPLE labelled rows, those of the least hash of doc_id (of an id with several texts the one of the least hash), of
which the driver gets a dozen numbers each; posteriors and token totals cover all documents. The model is part of the column expressions, as plain arithmetic.

Only built-in column functions run. Defined results: null text is empty and has one token (so that each row has a weight); rows of null doc_id are mixed like others;
repeated rows have equal rates and copies; without labelled rows there is one domain and all rates are 1; an empty table gives no rows; other columns are carried
along as they are, whatever their names. Very long texts are split into words once and never moved.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import drop, materialize, table, text_of

#: Labelled rows that the classifier is fitted on, at most.
SAMPLE = 4000
#: Words of the classifier, at most.
LEXICON = 96
ITERATIONS = 400
CHUNK = 8
TOLERANCE = 1e-4
MAX_RATE = 4.0
#: Shares of the mixture's tokens. The anchor domain keeps its tokens; the others follow from it.
TARGETS = {"q1t0": 0.95, "q1t1": 0.02, "q0t0": 0.02, "q0t1": 0.01}
ANCHOR = "q1t0"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), GAP), "")


def described(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, words, tokens and x, the structure statistics."""
    d = docs.select(*keep, text_of(docs).alias("_t"), words_of(text_of(docs)).alias("words"))
    n, chars = F.greatest(F.size("words"), F.lit(1)).cast("double"), F.greatest(F.octet_length("_t"), F.lit(1)).cast("double")
    without = lambda mark: (F.octet_length("_t") - F.octet_length(F.replace("_t", F.lit(mark), F.lit("")))) / chars
    upper = F.octet_length(F.regexp_replace("_t", "[^A-Z]+", ""))
    marks = F.octet_length(F.regexp_replace("_t", r"[^!*&$%#|<>={}]+", ""))
    x = F.array(upper / chars, marks / chars, chars / n, F.size(F.array_distinct("words")) / n, F.log10(n), without("\n"), without("|"), without("!"), without("."), without(","), without("*"))
    return d.select(*keep, "words", n.cast("long").alias("tokens"), x.alias("x"))


STATISTICS = 11


@dataclass
class Classifier:
    """Multinomial logistic regression on the standardised statistics, lexicon counts and all their products."""

    domains: list[str]
    lexicon: list[list[str]]  # by domain
    mean: list[float]
    spread: list[float]
    weights: list[list[float]]  # by domain: products, features, bias


def domain_of(labels: DataFrame) -> DataFrame:
    """id and domain of each labelled row."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    name = F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.coalesce(F.col("toxic"), F.lit(0)).cast("string"))
    return known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min(name).alias("domain"))


def lexicon_of(rows: DataFrame, size: dict[str, int]) -> list[list[str]]:
    """The words whose share of documents in a domain is furthest above that elsewhere, in standard deviations: LEXICON at most, by domain."""
    domains, total = sorted(size), sum(size.values())
    said = rows.select("domain", F.explode(F.array_distinct("words")).alias("word")).groupBy("word").pivot("domain", domains).count().na.fill(0)
    everywhere = sum((F.col(f"`{d}`") for d in domains), F.lit(0))
    far = []
    for d in domains:
        outside = max(1, total - size[d])
        p = (everywhere + 1.0) / F.lit(total + 2.0)
        gap = F.col(f"`{d}`") / F.lit(float(size[d])) - (everywhere - F.col(f"`{d}`")) / F.lit(float(outside))
        far.append(gap / F.sqrt(p * (1 - p) * F.lit(1.0 / size[d] + 1.0 / outside) + 1e-9))
    best = F.array_max(F.array(*far))
    found = said.where(everywhere >= 5).select("word", best.alias("far"), (F.array_position(F.array(*far), best) - 1).alias("d"))
    out: list[list[str]] = [[] for _ in domains]
    for r in found.where("far > 5").orderBy(F.desc("far"), "word").limit(LEXICON).collect():
        out[r["d"]].append(r["word"])
    return [sorted(ws) for ws in out]


def with_lexicon(described_: DataFrame, keep: list[str], lexicon: list[list[str]]) -> DataFrame:
    """``keep``, tokens and x with a lexicon count for each domain added."""
    counts = [F.log1p(F.size(F.array_intersect("words", F.array(*map(F.lit, ws)))).cast("double")) if ws else F.lit(0.0) for ws in lexicon]
    return described_.select(*keep, "tokens", F.concat("x", F.array(*counts)).alias("x"))


def train(docs: DataFrame, labels: DataFrame) -> Classifier:
    wanted = domain_of(labels).orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    own = docs.select(docs["doc_id"].cast("long").alias("id"), text_of(docs).alias("text")).join(F.broadcast(wanted), "id")
    one = own.groupBy("id", "domain").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = materialize(described(one, ["id", "domain"]), "sample")
    size = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(size) < 2:
        return Classifier(sorted(size) or [ANCHOR], [], [], [], [])
    lexicon = lexicon_of(rows, size)
    found = sorted((r["id"], r["domain"], r["x"]) for r in with_lexicon(rows, ["id", "domain"], lexicon).collect())
    return regression(sorted(size), lexicon, np.array([x for _, _, x in found]), [d for _, d, _ in found])


def regression(domains: list[str], lexicon: list[list[str]], x: np.ndarray, said: list[str], rounds: int = 300, ridge: float = 1e-3) -> Classifier:
    """Fit by gradient descent with momentum; a few thousand rows on the driver."""
    mean, spread = x.mean(0), x.std(0) + 1e-3
    z = np.clip((x - mean) / spread, -4, 4)
    f = np.concatenate([(z[:, :, None] * z[:, None, :]).reshape(len(z), -1), z, np.ones((len(z), 1))], 1)
    scale = np.sqrt((f**2).mean(0)) + 1e-6
    f = f / scale
    y = np.array([[float(d == s) for d in domains] for s in said])
    w, moved = np.zeros((f.shape[1], len(domains))), np.zeros((f.shape[1], len(domains)))
    rate = 4.0 / np.linalg.norm(f, 2) ** 2 * len(f)
    for _ in range(rounds):
        e = f @ (w + 0.9 * moved)
        p = np.exp(e - e.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        moved = 0.9 * moved - rate * (f.T @ (p - y) / len(f) + ridge * w)
        w += moved
    w /= scale[:, None]
    return Classifier(domains, lexicon, mean.tolist(), spread.tolist(), w.T.tolist())


def total(terms: list[Column]) -> Column:
    return sum(terms[1:], terms[0])


def posteriors(docs: DataFrame, model: Classifier, keep: list[str]) -> DataFrame:
    """``keep``, tokens and p, an array of the posteriors in the order of the model's domains."""
    if not model.weights:
        return described(docs, keep).select(*keep, "tokens", F.array(F.lit(1.0)).alias("p"))
    d = with_lexicon(described(docs, keep), keep, model.lexicon)
    n, k = len(model.mean), len(model.domains)
    z = [F.least(F.greatest((F.get("x", F.lit(i)) - F.lit(model.mean[i])) / F.lit(model.spread[i]), F.lit(-4.0)), F.lit(4.0)).alias(f"_z{i}") for i in range(n)]
    d = d.select(*keep, "tokens", *z)

    def energy(w: list[float]) -> Column:
        """w holds the weights of all ordered pairs, of the features, and the bias."""
        pair = lambda i, j: w[i * n + j] + (w[j * n + i] if j > i else 0.0)
        inner = [total([F.lit(w[n * n + i]), *[F.lit(pair(i, j)) * F.col(f"_z{j}") for j in range(i, n)]]) for i in range(n)]
        return total([F.lit(w[n * n + n]), *[F.col(f"_z{i}") * inner[i] for i in range(n)]])

    d = d.select(*keep, "tokens", *[energy(w).alias(f"_e{i}") for i, w in enumerate(model.weights)])
    e = [F.col(f"_e{i}") for i in range(k)]
    d = d.select(*keep, "tokens", *e, F.greatest(*e).alias("_top")).select(*keep, "tokens", *[F.exp(x - F.col("_top")).alias(f"_e{i}") for i, x in enumerate(e)])
    return d.select(*keep, "tokens", F.array(*[x / total(e) for x in e]).alias("p"))


def moved_by(state: Column, p: Column, steps: list[list[float]], most: float) -> Column:
    """State (r, the rate, and q, the one before) after some steps of (momentum, a number a domain): r goes on by its last move, is lowered by the
    dot product with the posteriors and projected into [0, most]."""
    k = len(steps[0]) - 1
    moves = F.array(*[F.array(*map(F.lit, s)) for s in steps])

    def one(state: Column, s: Column) -> Column:
        r, q = state["r"], state["q"]
        new = r + F.get(s, F.lit(0)) * (r - q) - total([F.get(p, F.lit(i)) * F.get(s, F.lit(i + 1)) for i in range(k)])
        return F.struct(F.least(F.greatest(new, F.lit(0.0)), F.lit(float(most))).alias("r"), r.alias("q"))

    return F.aggregate(moves, state, one)


def rate_of(p: Column, steps: list[list[float]], most: float = MAX_RATE) -> Column:
    """The rate after all steps from 1."""
    return moved_by(F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("q")), p, steps, most)["r"] if steps else F.lit(1.0)


@dataclass
class Mixture:
    """A fitted mixture. ``missing``: of each domain, how far the expected tokens are from the target, as a share of all targets."""

    model: Classifier
    most: float
    steps: list[list[float]] = field(default_factory=list)
    missing: dict[str, float] = field(default_factory=dict)
    converged: bool = True

    def rate(self) -> Column:
        return rate_of(F.col("p"), self.steps, self.most)


def fit_rates(scored: DataFrame, mixture: Mixture, targets: dict[str, float], anchor: str, iterations: int = ITERATIONS) -> None:
    """The steps of projected gradient descent. Of ``scored`` only tokens and p are read."""
    domains, k = mixture.model.domains, len(mixture.model.domains)
    t, p = F.col("tokens"), [F.get("p", F.lit(i)) for i in range(k)]
    e = [F.coalesce(F.sum(F.col("s.r") * t * p[i]), F.lit(0.0)).alias(f"e{i}") for i in range(k)]
    narrow = scored.select("tokens", "p", F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("q")).alias("s"))
    cross = [F.coalesce(F.sum(t * p[i] * p[j]), F.lit(0.0)).alias(f"c{i}_{j}") for i in range(k) for j in range(k)]
    first = narrow.agg(*e, *cross, F.coalesce(F.sum("tokens"), F.lit(0)).alias("all")).first()
    here = np.array([first[f"e{i}"] for i in range(k)])
    wanted = {d: w for d, w in targets.items() if d in domains and w > 0}
    if anchor not in wanted or not here[domains.index(anchor)]:
        return
    budget = here[domains.index(anchor)] / wanted[anchor]
    goal = np.array([max(budget * wanted.get(d, 0.0), 1e-3 * budget) for d in domains])
    scale = np.maximum(here, 1e-9)
    curvature = np.array([[first[f"c{i}_{j}"] for j in range(k)] for i in range(k)]) / np.sqrt(np.outer(scale, scale))
    norm = max(float(np.linalg.eigvalsh(curvature).max()), 1e-9)
    held, todo, before, last, weight, moved = None, [], here, np.inf, 1.0, first["all"]
    while moved > TOLERANCE * first["all"] and len(mixture.steps) < iterations:
        loss = float(((here - goal) ** 2 / scale).sum())
        weight = 1.0 if loss > last else weight
        following = (1 + (1 + 4 * weight * weight) ** 0.5) / 2
        momentum, weight, last = (weight - 1) / following, following, loss
        ahead = here + momentum * (here - before)
        todo.append([momentum, *((ahead - goal) / scale / norm).tolist()])
        mixture.steps.append(todo[-1])
        now = narrow.select("tokens", "p", moved_by(F.col("s"), F.col("p"), todo, mixture.most).alias("s"))
        if len(todo) == CHUNK:
            now = materialize(now, "rates", merge=8)
        sums = now.agg(*e, F.sum(t * F.abs(F.col("s.r") - F.col("s.q"))).alias("moved")).first()
        if len(todo) == CHUNK:
            if held is not None:
                drop(held)
            held, narrow, todo = now, now, []
        before, here, moved = here, np.array([sums[f"e{i}"] for i in range(k)]), sums["moved"]
    if held is not None:
        drop(held)
    mixture.converged = moved <= TOLERANCE * first["all"]
    mixture.missing = {d: float((here[i] - goal[i]) / budget) for i, d in enumerate(domains)}
    if not mixture.converged:
        warnings.warn(f"mixing: the rates still move by {moved / first['all']:.1e} of all tokens after {iterations} steps; distances from the targets: {mixture.missing}", stacklevel=3)


def copies_of(rate: Column, *key: Column) -> Column:
    """Whole copies: floor(rate + u), u in [0, 1) from a hash of the key."""
    u = F.shiftrightunsigned(F.xxhash64(*key, F.lit("mix")), 11).cast("double") / F.lit(float(2**53))
    return F.floor(rate + u).cast("int")


def fit(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, anchor: str = ANCHOR, most: float = MAX_RATE, whole: bool = False) -> tuple[Mixture, DataFrame]:
    """The fitted mixture, and doc_id, digest (of the text), tokens and posteriors of each document (a written table); with ``whole`` also its row, as a struct."""
    mixture = Mixture(train(docs, labels), most)
    d = docs.select(docs["doc_id"].alias("doc_id"), F.xxhash64(text_of(docs)).alias("digest"), text_of(docs).alias("text"), *([F.struct(*[docs[c] for c in docs.columns]).alias("row")] if whole else []))
    scored = materialize(posteriors(d, mixture.model, ["doc_id", "digest", *(["row"] if whole else [])]), "posteriors")
    fit_rates(scored, mixture, targets or TARGETS, anchor)
    return mixture, scored


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, anchor: str = ANCHOR, most: float = MAX_RATE) -> DataFrame:
    """The mixture: each document as often as its copies say, all columns as they are. With ``most`` 1 none comes twice. Rows are never shuffled."""
    fitted, scored = fit(docs, labels, targets, anchor, most, whole=True)
    n = copies_of(fitted.rate(), F.col("doc_id"), F.col("digest"))
    return scored.select("row", n.alias("n")).where("n > 0").select("row", F.explode(F.sequence(F.lit(1), "n")).alias("copy")).select("row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fitted, scored = fit(docs, labels)
    named = [F.round(F.get("p", F.lit(i)), 6).alias(f"p_{d}") for i, d in enumerate(fitted.model.domains)]
    out = scored.withColumn("rate", fitted.rate())
    return out.select("doc_id", "tokens", *named, F.round("rate", 6).alias("rate"), copies_of(F.col("rate"), F.col("doc_id"), F.col("digest")).alias("copies"))
