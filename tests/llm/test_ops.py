"""Each operator against a brute-force version over the hard cases, and its defined results for empty tables and clashing columns."""

from __future__ import annotations

import gzip
import hashlib
import pathlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import chat, decontamination, media, minhash, mixing, pii, quality, queries, sharding, suffixes, textnum, warc
from tessera.llm.common import discard, work_dir
from tests.llm import data


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


# Words on buffers


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("aB9é \n-_ß𝄞", max_size=30), max_size=6), st.integers(5, 40))
def test_words_on_buffers(texts, block):
    before, textnum.BLOCK = textnum.BLOCK, block
    try:
        hashes, lengths, at = textnum.words(*textnum.buffers(pa.array(texts, pa.string())))
    finally:
        textnum.BLOCK = before
    known: dict[str, int] = {}
    for i, t in enumerate(texts):
        said = data.words(t)
        assert [len(w.encode()) for w in said] == lengths[at[i] : at[i + 1]].tolist()
        for w, h in zip(said, hashes[at[i] : at[i + 1]].tolist(), strict=True):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def test_shingles():
    texts = ["a b c d e f", "a b", "", "a b c d e f g a b c d e", None]
    hashes, _, at = textnum.words(*textnum.buffers(pa.array(texts)))
    keys, key_at = textnum.shingles(hashes, at)
    for i, t in enumerate(texts):
        row, key, n = textnum.copies(keys[key_at[i] : key_at[i + 1]], np.zeros(key_at[i + 1] - key_at[i], int))
        assert sorted(n.tolist()) == sorted(data.shingles(t).values())


# 1


def test_op1_against_all_pairs(spark):
    rows = data.documents()
    wanted = data.classes(rows)
    got = [(r["doc_id"], r["class_id"]) for r in minhash.near_duplicates(data.frame(spark, clash=True)).collect()]
    assert len(got) == len(rows)
    assert {d: c for d, c in got if d is not None} == wanted
    # a row without an id takes the class of the ids that have its words; one without words takes that of the texts without any
    assert sorted(c for d, c in got if d is None) == sorted([wanted[12], 0])
    kept = minhash.keep_one(data.frame(spark))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(wanted.values())) and kept.columns == data.frame(spark).columns


def test_op1_cloud_of_near_copies(spark):
    """Copies of one base with more and more changes: pairs lie on both sides of the threshold. Small blocks make many cells."""
    rng = random.Random(5)
    base = data.prose(rng, 100).split(" ")
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "s", 1))
    before, minhash.BLOCK = minhash.BLOCK, 7
    try:
        got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(data.frame(spark, rows)).collect()}
    finally:
        minhash.BLOCK = before
    assert got == data.classes(rows) and 2 < len(set(got.values())) < 150


def test_op1_every_text_is_searched(spark):
    """One id with several texts, and rows without id: each text finds its own near copies."""
    rng = random.Random(11)
    rich, poor, lone, other = (data.prose(rng, n) for n in (120, 60, 70, 80))
    near = lambda t, w: " ".join([*t.split(" ")[:-1], w])
    rows = [(1, rich), (1, poor), (2, poor), (3, near(poor, "x")), (4, near(rich, "y")), (5, other), (None, lone), (None, near(lone, "z")), (None, near(other, "v"))]
    got = {(r["doc_id"], r["total"], r["class_key"]): r["class_id"] for r in minhash.near_duplicates(data.frame(spark, [(i, t, "en", "s", 1) for i, t in rows])).collect()}
    members: dict[str, list] = {}
    for (i, total, key), least in got.items():
        members.setdefault(key, []).append((i, total, least))
    tidy = sorted(sorted(map(str, m)) for m in members.values())
    assert tidy == sorted(sorted(map(str, m)) for m in (
        [(1, 116, 1), (4, 116, 1)],
        [(1, 56, 1), (2, 56, 1), (3, 56, 1)],
        [(5, 76, 5), (None, 76, 5)],
        [(None, 66, None)],
    ))


def test_op1_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 9, 400), rng.integers(0, 9, 400)
    keys = textnum.mix(np.arange(400, dtype=np.uint64) + np.uint64(1))
    row = np.repeat([0, 1], 400)
    count = np.concatenate([a, b])
    keep = count > 0
    s = minhash.signatures(row[keep], np.concatenate([keys, keys])[keep], count[keep], 2, slots=4096)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((s[0] == s[1]).mean() - true) < 4 * (true * (1 - true) / 4096) ** 0.5
    assert (minhash.signatures(np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0, int), 2) == 0).all()


# 2


def base_by_plain_patterns(t: str) -> list[tuple[int, int, int]]:
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a@b.c", "@", ".", "x", "é", "1.2.3.4", "4532015112830366", " ", "-", "+1 (555) 123-4567", "255", "0001", "999", "+", "\n", "a.b%", "4", "12"]), max_size=14))
def test_op2_base_spans(parts):
    t = "".join(parts)
    assert pii.base_spans(t) == base_by_plain_patterns(t)


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "+1" * 100_000, "1." * 100_000, "a@" * 100_000, "John " * 50_000, "A1" * 150_000, "+1" + "(" * 300_000, "a@" + "b-" * 100_000, "1 " * 100_000])
def test_op2_long_runs_are_linear(text):
    began = time.perf_counter()
    pii.candidates(text, pii.base_spans(text))
    assert time.perf_counter() - began < 2


def test_op2_million_digits_at_once():
    began = time.perf_counter()
    assert pii.base_spans("7" * 1_000_000 + " 1.2.3.4") == [(1_000_001, 1, 1_000_008)]
    assert time.perf_counter() - began < 1


def test_op2_query_counts_by_kind(spark, tmp_path):
    texts = ["a@b.c, then 1.2.3.4 and 4532015112830366", "+1 (555) 123-4567 a@b.c x@y.z", "1.2.3.4", None, ""]
    data.frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)], clash=True).withColumns({"base": F.lit(1), "spans": F.lit(2), "extra": F.lit(3)}).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in pii.op2_pii(spark, str(tmp_path)).collect()}
    assert [tuple(got[i][f"n_{k}"] for k in pii.KINDS[: pii.BASE]) for i in range(5)] == [(1, 1, 1, 0), (2, 0, 0, 1), (0, 1, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0)]
    for i, t in enumerate(texts):
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base_by_plain_patterns(t or ""))
        assert got[i]["base_sha256"] == sha(listed.encode()) and got[i]["n_spans"] == got[i]["spans"].count(":") // 2


def personal_sentences(seed: int, n: int) -> list[tuple[str, list[tuple[str, str]], list[str]]]:
    """Texts with personal data (kind, span) and look-alikes that are none. Names, words before and shapes are dealt anew each time."""
    rng = random.Random(seed)
    pick = lambda xs: rng.choice(sorted(xs))
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789") for _ in range(k)) + "7q"
    out = []
    for _ in range(n):
        kind, said = rng.randrange(6), data.prose(rng, rng.randint(3, 20))
        more = data.prose(rng, rng.randint(3, 20))
        if kind == 0:
            s = hexes(40) if rng.random() < 0.5 else rng.choice(["ghp_", "sk_live_", ""]) + mixed(30)
            out.append((f'{said} {pick(pii.ANNOUNCES_SECRET)}{rng.choice([" = ", ": ", "="])}"{s}" {more}', [("secret", s)], []))
        elif kind == 1:
            s = f"{rng.choice(['lib', 'usr', 'src'])}/{rng.choice(['share', 'local'])}/{rng.choice(['mod-1', 'pkg_2'])}/{rng.choice('abc')}{digits(2)}/read_me-{digits(1)}"
            out.append((f"{said} see {s} {more}", [], [s]))
        elif kind == 2:
            s = digits(rng.randint(9, 13))
            out.append((f"{said} {pick(pii.ANNOUNCES_ACCOUNT)}: {s} {more}", [("account", s)], []))
        elif kind == 3:
            s = digits(rng.randint(9, 13))
            out.append((f"{said} {s} {more}", [], [s]))
        elif kind == 4:
            s = f"{pick(pii.GIVEN_NAMES).title()} {pick(pii.SURNAMES).title() if rng.random() < 0.5 else 'Q' + ''.join(rng.choice('aeiourstln') for _ in range(6))}"
            out.append((f"{said} {rng.choice(['Mr. ', 'with ', 'and Dr '])}{s} {rng.choice(['said', 'wrote', 'lives in'])} {more}", [("name", s)], []))
        else:
            word = pick(pii.SURNAMES)
            out.append((f"{said} The {word.title()} {word} {word} {more}", [], [f"The {word.title()}"]))
    return out


def test_op2_precision_and_recall(spark):
    """Spans found in texts whose personal data are known; the figures of the README come from here."""
    found = personal_sentences(1, 1500)
    rows = [(i, t, "en", "s", 1) for i, (t, _, _) in enumerate(found)]
    got = {r["doc_id"]: [(pii.KINDS[s["kind"]], rows[r["doc_id"]][1][s["start"] : s["end"]]) for s in r["spans"]] for r in pii.find_personal_data(data.frame(spark, rows)).collect()}
    for kind in ("secret", "account", "name"):
        true = [(i, s) for i, (_, spans, _) in enumerate(found) for k, s in spans if k == kind]
        said = [(i, s) for i, spans in got.items() for k, s in spans if k == kind]
        both = len(set(true) & set(said))
        print(kind, "precision", round(both / len(said), 3), "recall", round(both / len(true), 3), len(true))
        assert both >= 0.9 * len(said) and both >= 0.9 * len(true)


def test_op2_candidates_after_capitals_and_before_full_stops():
    def found(t: str) -> list[str]:
        return [t[a:b] for a, _, b, *_ in pii.candidates(t, pii.base_spans(t))]

    for t in ("Contact John Smith today", "Mr John Smith said", "Mr. John Smith said", "and John Smith", "Then Contact John Smith"):
        assert found(t) == ["John Smith"]
    assert found("Meet Anna Maria Smith") == ["Anna Maria", "Maria Smith"] and found("Dr Xaver Young Said") == ["Xaver Young"]
    assert found("Plain Words Only") == [] and len(found("John " * 50_000)) == 49_999
    for t in ("account 1234567890.", "account 1234567890. Then", "account 1234567890"):
        assert found(t) == ["1234567890"]
    assert found("account 1234567890.5") == [] and found("account 1234567890a") == [] and found("file 1234567890.txt") == []


def test_op2_learns_and_keeps_base(spark):
    key = "token = \"0123456789abcdef0123456789abcdef01234567\""
    rows = [(i, t, "en", "s", 1) for i, t in enumerate([None, "", "é mail me@x.org now", f"so {key} it is", "4532015112830366 and 1.2.3.4", "Plain words only", "path a/b/c-d_e/f-g_h/i-j1k2l3/m"] + [f"{key[:-3]}{i:02d}\"" for i in range(10, 40)])]
    got = {r["doc_id"]: r for r in pii.find_personal_data(data.frame(spark, rows)).collect()}
    for i, t, *_ in rows:
        spans = [tuple(s) for s in got[i]["spans"]]
        base = base_by_plain_patterns(t or "")
        assert [tuple(s) for s in got[i]["base"]] == base and set(base) <= set(spans)
    assert [pii.KINDS[s["kind"]] for s in got[3]["spans"]] == ["secret"] and not got[5]["spans"] and not got[6]["spans"]
    clean = {r["doc_id"]: r["text"] for r in pii.redact(data.frame(spark, rows), pii.find_personal_data(data.frame(spark, rows))).collect()}
    assert clean[2] == "é mail [email] now" and clean[4] == "[card] and [ip]"


# 3

PAGES = [(1, "http://a", "x" * 1200), (2, "http://b", "x" * 1200), (9, None, "x" * 1200), (3, "u\r\nv", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", "é" * 600), (8, "u", "é" * 600), (9, None, "x" * 1200), (None, "n", "x" * 1200), (20, "lóng", "long text \u00e9\r\n\r\n" * 100_000)]


def test_op3_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("payload", F.lit("clash"))
    path = work_dir(spark, "test")
    warc.archive(pages, path)
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, _, h in PAGES})
    records = warc.read_archive(spark, path)
    rows = records.select("page_id", "payload_bytes", "sha1", "header", warc.record_bytes(records).alias("record")).collect()
    assert len(rows) == len(PAGES)
    by_id = {r["page_id"]: r for r in rows}
    for i, _, html in PAGES:
        raw = (html or "").encode()
        head = by_id[i]["header"].decode()
        revisit = "WARC-Type: revisit" in head
        assert by_id[i]["payload_bytes"] == len(raw) and by_id[i]["sha1"] == hashlib.sha1(raw).hexdigest()  # noqa: S324
        assert bytes(by_id[i]["record"]) == bytes(by_id[i]["header"]) + (b"" if revisit else raw) + b"\r\n\r\n"
        assert revisit == (i in (1, 2, 7, None))
    heads = [r["header"].decode() for r in rows]
    ids = [re.search(r"WARC-Record-ID: (\S+)\r\n", h)[1] for h in heads]
    assert len(set(ids)) == len(rows) and all("WARC-Date: 1970-01-01T00:00:00Z\r\n" in h for h in heads)
    referred = [re.search(r"WARC-Refers-To: (\S+)\r\n", h)[1] for h in heads if "WARC-Type: revisit" in h]
    assert set(referred) <= set(ids) and all(x.startswith(("<urn:page:9:", "<urn:page:8:")) for x in referred)
    # what is read from the rebuilt bytes, also by the parser of files
    again = warc.parsed_records(records).collect()
    assert sorted((str(r["page_id"]), bytes(r["payload"])) for r in again) == sorted((str(i), (h or "").encode()) for i, _, h in PAGES)
    assert [(bytes(h), bytes(p)) for r in rows for _, h, p in warc.parse_warc(bytes(r["record"]))] == [(bytes(r["header"]), b"" if b"Type: revisit" in r["header"] else bytes(r["record"])[len(r["header"]) : -4]) for r in rows]


def test_op3_warc_files_come_back(spark, tmp_path):
    record = lambda h, p: b"WARC/1.0\r\n" + h + b"Content-Length: %d\r\n\r\n" % len(p) + p + b"\r\n\r\n"
    raw = record(b"WARC-Type: response\r\n", b"x\r\n\r\ny" * 50) + record(b"X:  odd \r\n", b"") + record(b"", b"x\r\n\r\ny" * 50)
    (tmp_path / "a.warc").write_bytes(raw)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(raw[:100]) + gzip.compress(raw[100:]))
    path = work_dir(spark, "test")
    warc.archive_records(warc.read_warc(spark, f"{tmp_path}/*.warc*"), path)
    assert spark.read.parquet(f"{path}/payloads").count() == 2
    files = defaultdict(bytes)
    for r in warc.rebuilt(spark, path).orderBy("file", "place").collect():
        files[r["file"]] += bytes(r["record"])
    assert list(files.values()) == [raw, raw]
    for bad in (raw[:-1], raw[:60], b"x" + raw, raw.replace(b"Content-Length", b"Content-Longth")):
        with pytest.raises(ValueError, match="WARC record"):
            list(warc.parse_warc(bad))


def test_op3_damage_is_noticed(spark):
    path = work_dir(spark, "test")
    spark.createDataFrame([(bytes(32), (1, 1), bytearray(b"x"))], "digest binary, winner struct<page_id:long,number:long>, payload binary").write.parquet(f"{path}/payloads")
    spark.createDataFrame([(1, bytes(32), bytearray(b"h"))], "page_id long, digest binary, header binary").write.parquet(f"{path}/headers")
    with pytest.raises(Exception, match="does not have its digest"):
        warc.read_archive(spark, path).collect()


# 4


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=40_000) | st.integers(0, 300_000).map(bytes))
def test_op4_round_trip(raw):
    payload = media.padded(raw)
    assert len(payload) % 64 == 0 and payload
    parsed = media.read_matroska(stored := media.write_matroska(payload))
    assert b"".join(stored[p.start : p.end] for p in parsed["packets"]) == payload
    assert [t for _, t in parsed["clusters"]] == [t for t, _, _ in parsed["cues"]] and [p for p, _ in parsed["clusters"]] == [p for _, _, p in parsed["cues"]]


def test_op4_parses_other_writers_forms():
    e, u = media.element, media.unsigned
    xiph = e(media.SIMPLE_BLOCK, b"\x82\xff\xff\x02" + b"\x02" + b"\xff\x01" + b"\x02" + b"A" * 256 + b"BB" + b"C")
    fixed = e(media.BLOCK_GROUP, e(media.BLOCK, b"\x40\x05\x00\x03\x04" + b"\x01" + b"DDEE"))
    body = media.number_bytes(media.CLUSTER) + b"\x01" + b"\xff" * 7 + u(media.CLUSTER_TIMESTAMP, 10) + xiph + fixed
    doc = e(media.EBML, b"") + media.number_bytes(media.SEGMENT) + b"\xff" + body + e(media.CUES, b"")
    p = media.read_matroska(doc)["packets"]
    assert [(x.track, x.timestamp, doc[x.start : x.end]) for x in p] == [(2, 9, b"A" * 256), (2, 9, b"BB"), (2, 9, b"C"), (5, 13, b"DD"), (5, 13, b"EE")]
    for cut in range(1, len(doc) - 8):
        try:
            media.read_matroska(doc[:cut])
        except (media.MatroskaError, IndexError):
            pass


#: A file of the samples 0 to 63, taken apart by hand: header, info, track, one cluster with one block, one cue.
GOLDEN = (
    "1a45dfa3 93 4282 88 6d6174726f736b61 4287 81 04 4285 81 02"
    "18538067 40be 1549a966 a6 2ad7b1 83 0f4240 4489 88 4020000000000000 4d80 87 74657373657261 5741 87 74657373657261"
    "1654ae6b ae ae ac d7 81 01 73c5 81 01 83 81 02 86 8d 415f50434d2f494e542f4c4954 e1 91 b5 88 40bf400000000000 9f 81 01 6264 81 08"
    "1f43b675 c9 e7 81 00 a3 c4 81 0000 80" + bytes(range(64)).hex() + "1c53bb6b 8d bb 8b b3 81 00 b7 86 f7 81 01 f1 81 5e"
)


def samples_by_hand(raw: bytes) -> bytes:
    """The samples of a file by a plain walk of its own: sizes by their leading zeros, laces by their text in the specification."""

    def number(at: int, strip: bool) -> tuple[int, int]:
        bits = f"{raw[at]:08b}"
        n = bits.index("1") + 1
        all_bits = "".join(f"{c:08b}" for c in raw[at : at + n])
        return int(all_bits[n:] if strip else all_bits, 2), at + n

    out, todo = b"", [(0, len(raw))]
    while todo:
        at, end = todo.pop()
        if at >= end:
            continue
        name, at = number(at, False)
        size, at = number(at, True)
        todo.append((at + size, end))
        if name in (0x18538067, 0x1F43B675):
            todo.append((at, at + size))
        elif name == 0xA3:
            flags, stop, at = raw[at + 3], at + size, at + 4
            assert flags in (0x80, 0x86)
            if flags == 0x86:
                n, at = raw[at] + 1, at + 1
                first, at = number(at, True)
                total, last = first, first
                for _ in range(n - 2):
                    width = f"{raw[at]:08b}".index("1") + 1
                    d, at = number(at, True)
                    last += d - (2 ** (7 * width - 1) - 1)
                    total += last
                assert total <= stop - at
            out += raw[at:stop]
    return out


def test_op4_bytes_of_the_form():
    assert media.write_matroska(bytes(range(64))) == bytes.fromhex(GOLDEN)
    for n in (64, 1024, 1088, 8192, 8256, 131_072, 300_032):
        payload = bytes(random.Random(n).randbytes(n))
        assert samples_by_hand(media.write_matroska(payload)) == payload


def test_op4_table(spark):
    rows = data.documents()
    got = defaultdict(list)
    for r in media.decode_media(media.store_media(data.frame(spark, clash=True).withColumn("packets", F.lit(1)).withColumn("media", F.lit("clash")), work_dir(spark, "test"))).collect():
        got[r["doc_id"]].append(r)
    assert sum(map(len, got.values())) == len(rows)
    for i, t, *_ in rows:
        if i is not None:
            raw = (t or "").encode()
            p = media.padded(raw)
            r = got[i][0]
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(p), sha(p), zlib.crc32(p[-64:]))
            stored = media.write_matroska(p)
            assert (r["media_bytes"], r["media_sha256"]) == (len(stored), sha(stored)) and samples_by_hand(stored) == p
            clusters = -(-len(p) // 131_072)
            level = sum(p) * 1000 // len(p)
            step = sum(abs(a - b) for a, b in zip(p, p[1:], strict=False)) * 1000 // len(p)
            last = (len(p) - 1) // 8192 * 8192 * 1000 // 8000
            assert r["feature"] == f"{-(-len(p) // 1024)}:{clusters}:{clusters}:1:{len(p) * 1000 // 8000}:{last}:{level}:{step}:{len(set(p))}"
    long = next(r for r in rows if len(r[1] or "") > 100_000)
    packets = media.packet_table(media.encode_media(data.frame(spark, [long]))).collect()
    stored, p = media.write_matroska(media.padded(long[1].encode())), media.padded(long[1].encode())
    assert b"".join(stored[r["byte_start"] : r["byte_end"]] for r in sorted(packets, key=lambda r: r["byte_start"])) == p
    assert [(r["timestamp"], r["lace"]) for r in sorted(packets, key=lambda r: r["byte_start"])] == [(i // 8 * 8192 * 1000 // 8000, i % 8) for i in range(len(packets))]
    assert {r["track"] for r in packets} == {1}


def test_op4_damage_is_noticed(spark):
    stored = media.encode_media(data.frame(spark, [(1, "some text", "en", "s", 1)])).withColumn("n_bytes", F.lit(500).cast("long"))
    with pytest.raises(Exception, match="not those stored"):
        media.decode_media(stored).collect()


# 5


@pytest.mark.parametrize("crowd", [400, 1])
@pytest.mark.parametrize("batches", [1, 3])
def test_op5_against_all_strings(spark, crowd, batches):
    rows = data.documents()
    before, suffixes.CROWD = suffixes.CROWD, crowd
    try:
        out = suffixes.remove_repeats(data.frame(spark, clash=True), batches).collect()
    finally:
        suffixes.CROWD = before
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out)
    want: Counter = Counter()
    for (i, t, *_), mark in zip(rows, data.removed(rows), strict=True):
        raw = (t or "").encode()
        spans = sum(m and (k == 0 or not mark[k - 1]) for k, m in enumerate(mark))
        want[i, len(raw), sum(mark), spans, sha(bytes(c for c, m in zip(raw, mark, strict=True) if not m))] += 1
    assert got == want


def test_op5_arrays_are_in_byte_order(spark):
    rows = data.documents()
    path = work_dir(spark, "test")
    suffixes.suffix_array(data.frame(spark, rows)).write.parquet(path)
    found = []
    for f in sorted(x.name for x in pathlib.Path(path.removeprefix("file://")).glob("part-*")):  # files in the order of their ranges
        found += [(bytes(r["suffix"]), r["around"], r["n"]) for r in spark.read.parquet(f"{path}/{f}").collect()]
    assert [x[:2] for x in found] == sorted(x[:2] for x in found) and len({x[:2] for x in found}) == len(found)
    heads = {r["head"] for r in suffixes.long_matches(spark.read.parquet(path)).collect()}
    of = {bytes(r["suffix"]): r["head"] for r in spark.read.parquet(path).collect()}
    total = Counter()
    for x, _, n in found:
        total[x] += n
    assert heads == {of[x] for x, n in total.items() if n > 1} and 0 < len(heads) < len(of)
    texts = [(t or "").encode() for _, t, *_ in rows]
    assert all(any(s in t for t in texts) for s, _, _ in found)
    m = np.frombuffer(b"".join(s for s, _, _ in found), np.uint8).reshape(-1, suffixes.GRAM)
    plain = [next((k for k in range(suffixes.GRAM) if a[k] != b[k]), suffixes.GRAM) for (a, _, _), (b, _, _) in zip(found, found[1:], strict=False)]
    assert suffixes.common_prefixes(m).tolist() == plain


def test_op5_family_grows_over_runs(spark):
    """Batches that come in runs of their own: levels merge geometrically and the result is that of all documents at once."""
    rows = data.documents()
    path = work_dir(spark, "test")
    ranks = []
    for i in range(5):
        family = suffixes.SuffixFamily(spark, path)
        family.insert(data.frame(spark, rows[i::5]))
        ranks.append(sorted(family.levels))
    assert ranks == [[0], [1], [0, 1], [2], [0, 2]]
    again = suffixes.SuffixFamily(spark, path)
    assert again.levels == family.levels and again.matches == family.matches
    key = lambda r: (str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
    d = data.frame(spark, rows)
    assert sorted(map(key, suffixes.remove_repeats(d, family=again).collect())) == sorted(map(key, suffixes.remove_repeats(d, 1).collect()))


def test_op5_repeated_reads_the_last_pass_alone(spark):
    """Where the last pass saw all entries, its matches say what is repeated: no level is read, grouped and joined again."""
    rows = data.documents()
    family, once = suffixes.SuffixFamily(spark), suffixes.SuffixFamily(spark)
    once.insert(data.frame(spark, rows))
    want = Counter(map(tuple, once.repeated().collect()))
    for i in range(3):
        family.insert(data.frame(spark, rows[i::3]))
    for folder in family.levels.values():
        discard(spark, f"{family.path}/{folder}")
    assert len(family.levels) == 2 and want and Counter(map(tuple, family.repeated().collect())) == want


def test_op5_matches_across_edges(spark):
    """Entries at the edge of a range count where their suffix is in another range too, as a match or at an edge."""
    alone, match, edge = suffixes.ALONE, suffixes.MATCHED, suffixes.EDGE
    rows = [(1, 1, 1, edge), (1, 2, 1, edge), (2, 3, 1, edge), (3, 4, 1, edge), (3, 5, 1, match), (3, 6, 1, match), (4, 7, 2, match), (5, 8, 1, alone)]
    out = suffixes.matched(spark.createDataFrame(rows, "head long, around long, n long, flag int"))
    assert sorted(map(tuple, out.collect())) == [r[:3] for r in rows if r[0] in (1, 3, 4)]


def test_op5_cut_of_many_runs():
    """Ranges in any order that overlap, touch or stand apart, and rows without any."""
    rng = np.random.default_rng(5)
    texts = [rng.bytes(k) for k in (900, 0, 3000, 250, 5)]
    runs = [[(int(a), int(min(a + k, len(t)))) for a, k in zip(rng.integers(0, len(t) - 199, 12), rng.integers(200, 300, 12), strict=True)] if len(t) > 500 else None for t in texts]
    runs[3] = [(50, 250), (0, 50)]
    lists = pa.array([r and [{"a": a, "b": b} for a, b in r] for r in runs], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
    batch = pa.record_batch([pa.array(range(5), pa.int64()), pa.array(texts, pa.binary()), lists], names=["doc_id", "text", "runs"])
    got = pa.Table.from_batches(suffixes._cut(iter([batch.slice(0, 2), batch.slice(2), batch.slice(0, 0)]))).to_pylist()
    for r, t, own in zip(got, texts, runs, strict=True):
        gone = [any(a <= k < b for a, b in own or []) for k in range(len(t))]
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        rest = b"".join(t[x["a"] : x["b"]] for x in r["kept"])
        assert rest == bytes(c for c, g in zip(t, gone, strict=True) if not g) and r["kept_sha256"] == sha(rest)
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(t), sum(gone), spans)


def test_op5_pieces_cover_long_texts(monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 3000)
    raw = np.random.default_rng(0).integers(97, 100, 10_000).astype(np.uint8)
    batch = pa.record_batch([pa.array([raw.tobytes()], pa.binary())], names=["text"])
    windows = []
    for _, piece, at, base in suffixes.pieces(batch, 0):
        _, _, _, place, first, last = suffixes.entries(piece, at)
        assert ((first <= place) & (last <= place) & (place < first + suffixes.WINDOWS)).all()
        windows += [base + w for f, x in zip(first, last, strict=True) for w in range(f, x + 1)]
    assert sorted(windows) == list(range(len(raw) - suffixes.LENGTH + 1))


# 6


def labelled(n: int) -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(n):
        good, toxic = i % 3 > 0, i % 7 == 0
        t = data.prose(rng, rng.randint(20, 90))
        t = t if good else t.upper().replace(" ", "!! ")
        docs.append((i, f"{t} trash moron scum" if toxic else t, "en", "s", 1))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


def test_op6_meets_targets_like_numpy(spark):
    docs, labels = labelled(420)
    d, lab = data.frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    fitted, scored = mixing.fit(d, lab)
    rows = scored.withColumn("rate", fitted.rate()).collect()
    p, t = np.array([r["p"] for r in rows]), np.array([r["tokens"] for r in rows])
    names = fitted.model.domains
    truth = {i: f"q{q}t{x}" for i, q, x in labels}
    assert np.mean([names[np.argmax(r["p"])] == truth[r["doc_id"]] for r in rows]) > 0.97
    assert np.allclose(p.sum(1), 1)
    rate = last = np.ones(len(rows))
    for momentum, *s in fitted.steps:  # the same steps by plain arithmetic
        rate, last = np.clip(rate + momentum * (rate - last) - p @ np.array(s), 0, mixing.MAX_RATE), rate
    assert np.allclose(rate, [r["rate"] for r in rows])
    have = (rate * t) @ p
    goal = np.array([mixing.TARGETS[k] for k in names])
    assert np.allclose(have / have.sum(), goal, atol=0.01)
    once = mixing.mix(d.withColumn("_n", F.lit(1)).withColumn("row", F.lit(2)), lab, most=1.0)
    assert once.columns == [*d.columns, "_n", "row"] and once.groupBy("doc_id").count().where("count > 1").count() == 0
    again = [r["doc_id"] for r in mixing.mix(d, lab).collect()]
    copies = {r["doc_id"]: r["n"] for r in scored.select("doc_id", mixing.copies_of(fitted.rate(), F.col("doc_id"), F.col("digest")).alias("n")).collect()}
    assert Counter(again) == {k: n for k, n in copies.items() if n}


@pytest.mark.parametrize("most", [4.0, 1.0])
def test_op6_fit_is_as_good_as_coordinate_descent(spark, most):
    """Overlapping posteriors, against a solver of another kind that holds the whole problem: exact steps one rate at a time."""
    rng = np.random.default_rng(3)
    p = rng.dirichlet([2.0, 0.7, 0.4], 150)
    t = rng.integers(1, 200, 150).astype(float)
    names, targets = ["a", "b", "c"], {"a": 0.6, "b": 0.1, "c": 0.3}
    fitted = mixing.Mixture(mixing.Classifier(names, [], [], [], []), most)
    scored = spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(t, p, strict=True)], "tokens long, p array<double>")
    mixing.fit_rates(scored, fitted, targets, "a", iterations=400)
    rate = np.array([r["rate"] for r in scored.withColumn("rate", fitted.rate()).collect()])
    start = t @ p
    goal = start[0] / targets["a"] * np.array([targets[n] for n in names])
    loss = lambda r: 0.5 * (((r * t) @ p - goal) ** 2 / start).sum()
    a, own = (t[:, None] * p) / np.sqrt(start), np.ones(150)
    left = own @ a - goal / np.sqrt(start)
    for _ in range(3000):
        for d in range(150):
            new = np.clip(own[d] - left @ a[d] / (a[d] @ a[d]), 0, most)
            left += (new - own[d]) * a[d]
            own[d] = new
    assert fitted.converged and (0 <= rate).all() and (rate <= most).all()
    assert loss(rate) <= loss(own) * 1.001
    have = (rate * t) @ p
    assert np.allclose([fitted.missing[n] for n in names], (have - goal) / goal.sum(), atol=1e-6)


def test_op6_null_ids_draw_for_themselves(spark):
    d = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.xxhash64("id").alias("digest"))
    share = d.select(F.avg(mixing.copies_of(F.lit(0.3), F.col("doc_id"), F.col("digest")))).first()[0]
    assert abs(share - 0.3) < 0.04


def test_op6_without_labels(spark):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = data.documents()
    assert mixing.mix(data.frame(spark, clash=True), lab).count() >= len(rows) - 2
    fitted, scored = mixing.fit(data.frame(spark), lab)
    assert {r["r"] for r in scored.select(fitted.rate().alias("r")).collect()} == {1.0}


# 7


def test_op7_law_slots_and_growth(spark):
    rows = [*data.documents(), *((10_000 + i, "t", "en", "s", 1) for i in range(4000))]
    out = sharding.shard_documents(data.frame(spark, rows, clash=True).withColumns({"slot": F.lit("x"), "_b": F.lit("x"), "law": F.lit("x")}), keep=("lang",)).collect()
    assert len(out) == len(rows) and {r["law"] for r in out} == {"key"}
    for s in range(24):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots))) and abs(len(slots) - len(rows) / 24) < 60
    assert all(r["grown_shard"] in (r["shard"], 24) for r in out) and 100 < sum(r["grown_shard"] == 24 for r in out) < 240
    by_id = defaultdict(set)
    for r in out:
        by_id[r["doc_id"]].add(r["shard"])
    assert all(len(s) == 1 for s in by_id.values())
    texts = {r[0]: r[1] for r in rows}
    assert all(r["size"] == len((texts[r["doc_id"]] or "").encode()) + 8 and r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) for r in out if r["doc_id"] is not None)


def test_op7_weights_move_only_their_subtree(spark):
    tree = sharding.regular_tree(24)
    heavy = [x if x.shard != 5 else sharding.Leaf(x.region, x.rack, 5, 3.0) for x in tree]
    d = spark.range(20_000).withColumnRenamed("id", "k")
    rows = d.select(sharding.descend(F.col("k"), tree).alias("a"), sharding.descend(F.col("k"), heavy).alias("b")).collect()
    leaf = {x.shard: x for x in tree}
    moved = [(leaf[r["a"]], leaf[r["b"]]) for r in rows if r["a"] != r["b"]]
    # from other regions into the heavier one, from its other racks into the heavier rack, and from that rack's other shard into shard 5
    assert {x.region != leaf[5].region for x, _ in moved} == {True, False} and all(y.region == leaf[5].region for _, y in moved)
    assert all(y.rack == leaf[5].rack for x, y in moved if x.region == leaf[5].region)
    assert all(y.shard == 5 for x, y in moved if x.rack == leaf[5].rack)
    share = Counter(r["b"] for r in rows)[5] / len(rows)
    assert abs(share - 3 / 26) < 0.01


# 8

CHATS = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo</s>"), (1, 1, "assistant", "a"), (2, 5, "system", None), (2, 1, None, "[INST:0:user]x[/INST]"), (2, 2, "assistant", "\\ <s> \\[INST [OUT:"), (3, 0, "we]ird [x", "plain \\ back"), (3, 1, "assistant", ""), (None, 0, "user", "null id"), (4, None, "user", "q" * 100_000), (4, 1, "assistant", "a" * 100_000), (1, 1, "assistant", "a")]


def turns_of(rows: list[tuple]) -> dict:
    by = defaultdict(list)
    for c, n, role, said in rows:
        by[c].append((n is not None, n or 0, role or "", said or ""))
    return {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in by.items()}


def test_op8_round_trip(spark):
    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("formatted", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert {c: [(t["role"], t["text"]) for t in r["turns"]] for c, r in got.items()} == turns_of(CHATS)
    assert all([t["loss"] for t in r["turns"]] == [t["role"] == "assistant" for t in r["turns"]] for r in got.values())
    assert "[INST:0:user]hi[/INST]" in got[1]["formatted"] and "<\\/s>" in got[1]["formatted"] and "\\\\" not in got[3]["formatted"]
    no_raw_controls(got.values())


def no_raw_controls(rows) -> None:
    """Control strings stand only where the template puts them: the start, and the head and end of each turn."""
    for r in rows:
        heads = re.findall(r"\[(?:INST|OUT):[01]:[^\]:]*\]", r["formatted"])
        found = re.findall(r"[<\[]/?(?:s>|INST|OUT)", r["formatted"])
        assert len(heads) == len(r["turns"]) and len(found) == 1 + 2 * len(heads)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["</s>", "[/INST]", "[INST", "<s>", "\\", "[", "<", "/", "x", "]", "[OUT:", "s>", ":0:user]"]), max_size=8).map("".join), min_size=20, max_size=30))
def test_op8_any_text(spark, texts):
    rows = [(i // 3, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat.read_back(chat.format_conversations(df)).collect()
    assert {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in found} == turns_of(rows)
    no_raw_controls(found)


def test_op8_parser_refuses_other_strings(spark):
    bad = ["", "<s>x", "<s>[INST:0:user]a", "[INST:0:user]a[/INST]", "<s>[INST:0:user]a</s>", "<s>[INST:2:user]a[/INST]", "<s>[SYS:0:user]a[/INST]", "<s>[OUT:0:a:b]x</s>"]
    good = ["<s>", "<s>[OUT:0:a]x</s>"]
    df = spark.createDataFrame([(x,) for x in bad + good], "f string").select("f", chat.parse(F.col("f")).alias("p"))
    assert {r["f"] for r in df.collect() if r["p"] is not None} == set(good)


# 9


def test_op9_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    item = data.prose(rng, 25)
    items = [(0, item), (1, "tiny one"), (2, None), (3, "..."), (10, data.prose(rng, 12)), (4, item), (None, "hello")]
    w = item.split(" ")
    texts = [None, "", f"x {' '.join(w[3:13]).upper()} y", f"{' '.join(w[:9])} z", f"A Tiny, one! tiny {item} {item}", "É" + "İ tiny-ONE", items[4][1], "hello tiny", " ".join(w[5:25]), "K tiny one"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    rows += [rows[4], (None, texts[2], "en", "s", 1)]
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 10)  # several parts
    got = decontamination.contamination(data.frame(spark, rows, clash=True), spark.createDataFrame(items, "item_id long, text string").withColumn("w", F.lit(0))).collect()
    want = []
    for i, t, *_ in rows:
        d, hit, found = data.words(t), set(), set()
        for k, body in items:
            b = data.words(body)
            n = min(10, len(b))
            for s in range(len(b) - n + 1 if b and k is not None else 0):
                for a in range(len(d) - n + 1):
                    if d[a : a + n] == b[s : s + n]:
                        hit |= set(range(a, a + n))
                        found.add(str(k))
        want.append((i, len(d), len(hit), sorted(found)))
    key = str
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=key) == sorted(want, key=key)
    kept = decontamination.drop_contaminated(data.frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _, n, _ in want if not n)


# 10


def test_op10_held_out(spark):
    docs, labels = labelled(600)
    d, lab = data.frame(spark, docs), spark.createDataFrame([(i, q) for i, q, _ in labels], "doc_id long, quality int")
    model = quality.train(d, lab)
    rows = quality.score(d, model).collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert np.mean([(r["_score"] >= 0.7) == (r["doc_id"] % 3 > 0) for r in held]) > 0.97
    other = quality.score(d.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("zz")).withColumn("doc_id", F.col("doc_id") + 7), model).collect()
    assert sorted(r["_score"] for r in other) == sorted(r["_score"] for r in rows)
    used = {r["id"] for r in quality.sample_of(d, lab).collect()}
    assert used and all(zlib.crc32(str(i).encode()) % 4 != 2 for i in used)
    assert quality.sample_of(d, lab, 50).count() == 50
    kept = quality.keep_good(data.frame(spark, docs, clash=True), lab)
    assert kept.columns == data.frame(spark, docs, clash=True).columns and 350 < kept.count() < 450


def test_op10_on_the_given_labels(spark):
    """Held-out labels of the test tables, and scores against a plain version of the formula over every pair of features."""
    sf = "/root/testdata/sf0.01"
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = quality.op10_quality(spark, sf).collect()
    held = [(label[r["doc_id"]], r["score"], r["predicted"]) for r in rows if r["held_out"] and label.get(r["doc_id"]) is not None]
    good, bad = [s for y, s, _ in held if y == 1], [s for y, s, _ in held if y == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    right = np.mean([y == p for y, _, p in held])
    print("held-out rows", len(held), "AUC", round(float(auc), 3), "accuracy at 0.7", round(float(right), 3))
    assert auc > 0.9 and right > 0.8
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    model = quality.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    for r in quality.score(docs, model).collect():
        row, bucket, value, stats = quality.features(pa.array([r["text"]]))
        x = np.zeros(quality.BUCKETS + quality.STATISTICS)
        x[bucket], x[quality.BUCKETS :] = value, quality.standard(model, stats)[0]
        own = np.flatnonzero(x)
        vx = model.factor[own] * x[own, None]
        z = model.bias + model.weight @ x + (np.triu(vx @ vx.T, 1)).sum()
        assert r["_score"] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-9)


def test_op10_many_columns(spark):
    d = data.frame(spark, data.documents()[:8])
    d = d.withColumn("wide", F.struct(*[F.lit(i).alias(f"c{i}") for i in range(40)]))
    out = quality.score(d, quality.train(d, spark.createDataFrame([], "doc_id long, quality int")))
    assert out.columns == [*d.columns, "_score"] and out.select("wide.c39").first()[0] == 39


def test_op10_linear_time_identity():
    rng = np.random.default_rng(2)
    n = quality.BUCKETS + quality.STATISTICS
    m = quality.Model(0.3, rng.normal(size=n), rng.normal(size=(n, 3)), np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS))
    x = np.zeros(n)
    bucket, value, stats = np.array([3, 70, 500]), np.array([0.5, 1.0, 2.0]), rng.normal(size=quality.STATISTICS)
    x[bucket], x[quality.BUCKETS :] = value, stats
    pairs = sum(m.factor[i] @ m.factor[j] * x[i] * x[j] for i in np.flatnonzero(x) for j in np.flatnonzero(x) if i < j)
    z, _ = quality.forward(m, np.zeros(3, int), bucket, value, stats[None])
    assert z[0] == pytest.approx(m.bias + m.weight @ x + pairs)


def test_op10_hard_cases(spark):
    rows = data.documents()
    empty = spark.createDataFrame([], "doc_id long, quality int")
    for lab in (empty, spark.createDataFrame([(5, 1), (6, None), (None, 0)], "doc_id long, quality int")):
        out = quality.score(data.frame(spark, rows), quality.train(data.frame(spark, rows), lab)).collect()
        assert len(out) == len(rows) and all(0 <= r["_score"] <= 1 for r in out)


# Empty tables


@pytest.mark.parametrize("name", ["op1_minhash", "op5_suffixes", "media_payloads"])
def test_sql_on_hard_cases(spark, tmp_path, name):
    """Query and SQL agree on null ids and texts, texts without words, repeated rows and one id on several texts."""
    data.frame(spark).withColumn("text", F.col("text").cast("string")).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES[name](spark, str(tmp_path))
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        cursor = c.execute(queries.ORACLE_SQL[name])
        columns = [d[0] for d in cursor.description]
        wanted = Counter(cursor.fetchall())
    assert Counter(tuple(r) for r in got.select(*columns).collect()) == wanted and sorted(got.columns) == sorted(columns)


def test_empty_tables(spark):
    d = data.frame(spark, [])
    assert minhash.near_duplicates(d).count() == 0 and minhash.keep_one(d).count() == 0
    assert pii.find_personal_data(d).count() == 0
    assert media.decode_media(media.encode_media(d)).count() == 0
    assert suffixes.remove_repeats(d).count() == 0
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert mixing.mix(d, lab).count() == 0
    assert sharding.shard_documents(d).count() == 0
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(d, bench).count() == 0
    assert decontamination.drop_contaminated(data.frame(spark), bench).count() == len(data.documents())
    assert quality.keep_good(d, lab).count() == 0
    path = work_dir(spark, "test")
    warc.archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archive(spark, path).count() == 0
