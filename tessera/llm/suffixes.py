"""Removal of repeated 200-byte strings with a logarithmic family of sparse suffix arrays.

A suffix array entry stands for a sampled suffix. Of each 200-byte window the suffix that starts with the least 73-byte gram (the
leftmost, by 42 bits of hash) is sampled, so equal windows sample the same suffix at the same depth, wherever they stand, and a text has about one entry in 64 bytes.
A suffix is held by its first 73 bytes - the depth that every window of an entry covers, so windows can only be equal if their suffixes have a common prefix
of at least that length. An entry also has ``head``, a fingerprint of these bytes by which documents find it again, and ``around``, one of all bytes that its windows cover.

Index family (``SuffixFamily``): a new batch of documents gets its array - entries in the byte order of their suffixes, dealt to files by ranges of
(suffix, around), with their number. It is merge-scanned with every level: arrays are brought into one order, neighbours are compared byte by byte, and where the
longest common prefix reaches 73 bytes the suffix has a long match. Levels of equal rank merge with the new array into one of a next rank in the same pass, so n
batches leave at most log2(n) + 1 levels; levels that stay are scanned without being rewritten. No document is read for this. A family at a path of its own keeps its
levels and matches there, and later runs add batches to it.

Exact result from the suffixes that have a long match:

* ``around`` occurs twice: all windows of the entry are repeated;
* else, if its head has other surroundings: its windows are fingerprinted one by one (200 bytes each), with one entry for each other
  surrounding. Only the ends of repeated passages and the places of edits come to this. Entries of one head meet in order of head, a bounded number at a
  time, and their fingerprints are compared by one sort; those of heads with more than CROWD surroundings are first merged within each task and then
  dealt by hash into shares of bounded size.

No step pairs entries: everything is sorted or counted by key, combines on the map side, and rejoins by key (sort-merge joins that Spark splits where a
key is hot). Fingerprints are 64 bits of their own beside 64 bits of the head; equality of windows goes by these 128 bits and is not looked up in the texts once
more. Tables that are used up are deleted, and their shuffle files with them.

Defined results: null text is empty; texts under 200 bytes lose nothing; repeated rows and ties are documents that repeat each other; a null doc_id is a value
like others; an empty table gives no rows; other columns are ignored, also those named like columns made here. Long documents are worked through in pieces.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import discard, drop, folders, materialize, release, table, text_of, utf8, work_dir
from tessera.llm.textnum import U, buffers, by_key, mix, powers, slices

LENGTH = 200
WINDOWS = 128
GRAM = LENGTH - WINDOWS + 1
#: Windows of a long document that are worked on at a time.
PIECE = 2 << 20
#: Low bits of a sampling value that hold a place in a piece; the bits above are of the gram's hash. Equal windows need the same number everywhere.
PLACE_BITS = 22
#: Bytes of text that are worked on at a time: the arrays of these stay in a core's cache.
BLOCK = 1 << 18
#: Sampled suffixes among which equal ones are counted before they leave a task.
TOGETHER = 1 << 14
#: Batches in which documents enter the index family where all are given at once.
BATCHES = 3
#: Surroundings of a head that are compared in one place.
CROWD = 400
#: Windows of a crowded head that are compared in one place.
SHARE = 16_384


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=total[1:])
    return total, down


def entries(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """The sampled suffixes of some documents: document, head, around, place, first and last window (both within the document)."""
    empty = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return empty, empty, empty, empty, empty, empty
    total, down = prefix_sums(data)
    gram = mix((total[GRAM:] - total[:-GRAM]) * down[: len(data) - GRAM + 1])
    # A place in the low bits: the least of a window is the leftmost of its least grams, and says where it stands.
    assert len(gram) <= 1 << PLACE_BITS
    places = U((1 << PLACE_BITS) - 1)
    least = gram & ~places
    least |= np.arange(len(gram), dtype=U)
    step = 1
    while step < WINDOWS:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    last = at[1:] - LENGTH
    has = last >= at[:-1]
    edge = np.zeros(len(least) + 1, np.int64)
    np.add.at(edge, at[:-1][has], 1)
    np.add.at(edge, last[has] + 1, -1)
    new = np.cumsum(edge[:-1]) > 0
    new[1:] &= least[1:] != least[:-1]
    new[at[:-1][has]] = True
    first = np.flatnonzero(new)
    doc = np.searchsorted(at, first, "right") - 1
    final = np.minimum(np.append(first[1:] - 1, len(least)), last[doc])
    place = (least[first] & places).astype(np.int64)
    around = mix((total[final + LENGTH] - total[first]) * down[first])
    around = mix(around + (place - first).astype(U) * U(0x9E3779B97F4A7C15) + (final - first).astype(U) * U(0xD1B54A32D192ED03))
    return doc, gram[place].view(np.int64), around.view(np.int64), place - at[doc], first - at[doc], final - at[doc]


def pieces(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int]]:
    """Some rows with their bytes and offsets; a long row comes in pieces, with the place of each in it."""
    for part in slices(batch, column, BLOCK):
        data, at = buffers(part.column(column))
        for a in range(0, max(1, len(data) - LENGTH + 1), PIECE) if part.num_rows == 1 else [0]:
            piece = data[a : a + PIECE + LENGTH - 1] if part.num_rows == 1 else data
            yield part, piece, np.array([0, len(piece)]) if part.num_rows == 1 else at, a


ENTRY = "suffix binary, head long, around long, n long"
#: What a pass says of an entry: nothing, that its suffix has a long match, or that it is the first or last of its range and has none there.
ALONE, MATCHED, EDGE = 0, 1, 2


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sampled suffixes of some texts; equal ones among about TOGETHER are counted."""

    def counted(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        suffix, head, around = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((around, head))
        new = np.ones(len(order), bool)
        new[1:] = (head[order][1:] != head[order][:-1]) | (around[order][1:] != around[order][:-1])
        first = np.flatnonzero(new)
        one = order[first]
        n = np.diff(np.append(first, len(order))).astype(np.int64)
        column = pa.Array.from_buffers(pa.binary(), len(one), [None, pa.py_buffer((np.arange(len(one) + 1) * GRAM).astype(np.int32)), pa.py_buffer(suffix[one])])
        return pa.record_batch([column, pa.array(head[one]), pa.array(around[one]), pa.array(n)], names=["suffix", "head", "around", "n"])

    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        for _, data, at, _ in pieces(batch, 0):
            doc, head, around, place, _, _ = entries(data, at)
            if len(doc):
                held.append((np.lib.stride_tricks.sliding_window_view(data, GRAM)[place + at[doc]], head, around))
            if sum(len(x[1]) for x in held) >= TOGETHER:
                yield counted(held)
                held = []
    if held:
        yield counted(held)


def rows_of_bytes(column: pa.ChunkedArray) -> np.ndarray:
    """Suffixes as a matrix, a row each."""
    return buffers(column)[0].reshape(-1, GRAM)


def common_prefixes(suffixes: np.ndarray) -> np.ndarray:
    """The length of the longest common prefix of each suffix and the next; at most GRAM, which is all that is held."""
    differ = suffixes[1:] != suffixes[:-1]
    return np.where(differ.any(1), differ.argmax(1), GRAM)


def _passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row an entry, with its flag. Rows come in order of suffix and surroundings; one entry is held back until its next neighbour is known."""
    names = ["suffix", "head", "around", "n"]
    held: pa.Table | None = None
    first, before = True, False  # whether nothing has been said yet; whether the held entry shares its suffix with the one before it

    def said(rows: pa.Table, flag: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield from rows.append_column("flag", pa.array(flag)).combine_chunks().to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch]).select(names)
        rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
        around, n = rows.column("around").to_numpy(), rows.column("n").to_numpy()
        long = common_prefixes(rows_of_bytes(rows.column("suffix"))) >= GRAM
        start = np.flatnonzero(np.concatenate([[True], ~(long & (around[1:] == around[:-1]))]))
        n = np.add.reduceat(n, start)
        entry = rows.take(pa.array(start)).set_column(3, "n", pa.array(n))
        near = long[start[1:] - 1]  # an entry and the next share their suffix
        back, ahead = np.concatenate([[before], near]), np.concatenate([near, [False]])
        flag = np.where((n > 1) | back | ahead, MATCHED, ALONE).astype(np.int32)
        if first and flag[0] == ALONE:
            flag[0] = EDGE
        k = len(start) - 1
        if k:
            yield from said(entry.slice(0, k), flag[:k])
            first = False
        held, before = entry.slice(k), bool(back[k])
    if held is not None:
        yield from said(held, np.array([MATCHED if before or held.column("n")[0].as_py() > 1 else EDGE], np.int32))


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, at, base in pieces(batch, 2):
            doc, head, around, place, first, last = entries(data, at)
            ids = part.select([0, 1]).take(pa.array(doc))
            where = [pa.array((x + base).astype(np.int32)) for x in (place, first, last)]
            yield pa.record_batch([ids.column(0), ids.column(1), pa.array(head), pa.array(around), *where], names=["doc_id", "digest", "head", "around", "place", "first", "last"])


def passed(entries_: DataFrame) -> DataFrame:
    """Entries in the byte order of their suffixes, those of equal suffix by surroundings, each once with its number and flag.

    Ranges of this order are dealt out, so a hot suffix is split.
    """
    return entries_.select("suffix", "head", "around", "n").repartitionByRange("suffix", "around").sortWithinPartitions("suffix", "around").mapInArrow(_passed, f"{ENTRY}, flag int")


def long_matches(passed_: DataFrame) -> DataFrame:
    """Heads of the suffixes that have a long match: in their range, or across the edge of two."""
    edges = passed_.where(F.col("flag") == EDGE).groupBy("head").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("head")
    return passed_.where(F.col("flag") == MATCHED).select("head").unionByName(edges)


def matched(passed_: DataFrame) -> DataFrame:
    """head, around and n of the entries whose suffix has a long match, of a pass over all entries. What stands at edges, two rows a range, is broadcast."""
    found = passed_.where(F.col("flag") == MATCHED).select("head", "around", "n")
    edges = passed_.where(F.col("flag") == EDGE).select("head", "around", "n")
    beside = found.select("head").join(F.broadcast(edges.select("head")), "head", "left_semi").distinct()
    across = edges.select("head").unionByName(beside).groupBy("head").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    return found.unionByName(edges.join(F.broadcast(across), "head", "left_semi"))


def suffix_array(docs: DataFrame) -> DataFrame:
    """The array of a batch: suffix, head, around, how many entries have them, and flag, in order. Copies of a piece of documents combine before they move."""
    return passed(docs.select(utf8(text_of(docs)).alias("text")).mapInArrow(_suffixes, ENTRY))


class SuffixFamily:
    """Levels by rank and the matches found so far, below ``path``. Without a path they are in the work folder and go with ``drop``."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or work_dir(spark, "family")
        self.levels: dict[int, str] = {}
        self.matches: list[str] = []
        self.whole: str | None = None  # matches of a pass over all entries, if the last batch made one
        self.state = 0
        if path:
            states = [int(n.removeprefix("state-")) for n in folders(spark, self.path) if n.startswith("state-")]
            if states:
                self.state = max(states)
                for r in spark.read.parquet(f"{self.path}/state-{self.state}").collect():
                    if r["rank"] >= 0:
                        self.levels[r["rank"]] = r["folder"]
                    else:
                        self.matches.append(r["folder"])

    def read(self, folder: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{folder}")

    def _write(self, df: DataFrame, kind: str) -> str:
        folder = f"{kind}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0").parquet(f"{self.path}/{folder}")
        release(self.spark)
        return folder

    def insert(self, docs: DataFrame) -> None:
        """Add a batch: build its array, merge it with levels of equal rank, scan it with the others, note the new state, delete what it leaves out."""
        array = self._write(suffix_array(docs), "level")
        rank, old, self.whole = 0, [], None
        while rank in self.levels:
            old.append(self.levels.pop(rank))
            rank += 1
        if self.levels:
            scan = passed(self._all([array, *self.levels.values()])).where(F.col("flag") != ALONE).select("head", "around", "n", "flag")
            self.matches.append(self._write(scan, "matches"))
            self.whole = None if old else self.matches[-1]
        if old:
            old.append(array)
            array = self._write(passed(self._all(old)), "level")
        self.levels[rank] = array
        self.state += 1
        rows = [*self.levels.items(), *((-1 - i, m) for i, m in enumerate(self.matches))]
        values = ", ".join(f"({r}, '{f}')" for r, f in rows)
        self.spark.sql(f"SELECT * FROM VALUES {values} AS state(rank, folder)").coalesce(1).write.parquet(f"{self.path}/state-{self.state}")
        for folder in [*old, f"state-{self.state - 1}"]:
            discard(self.spark, f"{self.path}/{folder}")

    def _all(self, folders_: list[str]) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.read(f) for f in folders_])

    def repeated(self) -> DataFrame:
        """head, around, n, surroundings (of the head) for each entry whose suffix has a long match."""
        whole = next(iter(self.levels.values())) if len(self.levels) == 1 else self.whole
        if whole:
            found = matched(self.read(whole))
        else:
            every = self._all(list(self.levels.values())).select("head", "around", "n").groupBy("head", "around").agg(F.sum("n").alias("n"))
            heads = reduce(DataFrame.unionByName, [long_matches(self.read(f)) for f in [*self.levels.values(), *self.matches]])
            found = every.join(heads.distinct().hint("merge"), "head", "left_semi")  # alone in its stage, so a hot head's rows can be split
        found = materialize(found, "repeated")
        release(self.spark)
        many = found.groupBy("head").agg(F.count(F.lit(1)).alias("surroundings"))
        out = materialize(found.join(many.hint("merge"), "head"), "repeated")
        drop(found)
        release(self.spark)
        return out

    def drop(self) -> None:
        discard(self.spark, self.path)


def prints_of(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The starts and fingerprints of the windows of some entries of one document, in order of entry. Entries ascend by first window."""
    n = last - first + 1
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first, n)
    prints = np.empty(len(start), U)
    for a in range(int(start.min(initial=0)), int(start.max(initial=-1)) + 1, PIECE):
        here = (start >= a) & (start < a + PIECE)
        if here.any():
            total, down = prefix_sums(data[a : a + PIECE + LENGTH - 1])
            x = start[here] - a
            prints[here] = mix((total[x + LENGTH] - total[x]) * down[x])
    return start, prints


def _wanted(batch: pa.RecordBatch) -> Iterator[tuple]:
    """For up to 4096 entries of a document at a time: its id and digest, the entries' heads and surroundings, and of each window its start, entry and fingerprint."""
    for i in range(batch.num_rows):
        data = np.frombuffer(batch.column(2)[i].as_buffer(), np.uint8)
        wanted = batch.column(3)[i].values
        head, first, last, around = (wanted.field(f).to_numpy() for f in ("head", "first", "last", "surroundings"))
        order = np.argsort(first)
        for a in range(0, len(order), 4096):
            own = order[a : a + 4096]
            f = first[own].astype(np.int64)
            n = last[own].astype(np.int64) - f + 1
            start, prints = prints_of(data, f, f + n - 1)
            yield batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), head[own], around[own], start, np.repeat(np.arange(len(n)), n), prints


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each entry: the fingerprints of its windows."""
    names = ["doc_id", "digest", "head", "first", "prints"]
    for batch in batches:
        for doc, digest, head, _, start, entry, prints in _wanted(batch):
            cut = np.searchsorted(entry, np.arange(len(head) + 1))
            lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(prints.view(np.int64)))
            yield pa.record_batch([pa.array(np.full(len(head), doc)), pa.array(np.full(len(head), digest)), pa.array(head), pa.array(start[cut[:-1]].astype(np.int32)), lists], names=names)


def repeated_runs(doc: np.ndarray, digest: np.ndarray, entry: np.ndarray, start: np.ndarray, twice: np.ndarray) -> list[pa.Array]:
    """Byte ranges (doc, digest, a, b) of the runs of windows that are marked; windows of an entry follow each other."""
    begins, ends = twice.copy(), twice.copy()
    apart = entry[1:] != entry[:-1]
    begins[1:] &= ~twice[:-1] | apart
    ends[:-1] &= ~twice[1:] | apart
    b, e = np.flatnonzero(begins), np.flatnonzero(ends)
    return [pa.array(doc[b]), pa.array(digest[b]), pa.array(start[b].astype(np.int32)), pa.array((start[e] + LENGTH).astype(np.int32))]


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of windows that another entry of the same head has too. Rows come in order of head."""
    for rows in by_key(batches, [2]):
        doc, digest, head, first = (rows.column(i).to_numpy() for i in range(4))
        lists = rows.column(4).combine_chunks()
        n = pc.list_value_length(lists).to_numpy()
        entry = np.repeat(np.arange(len(n)), n)
        key = mix(lists.flatten().to_numpy().view(U) + mix(head.view(U))[entry])
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        start = np.arange(len(key)) - np.repeat(np.cumsum(n) - n - first, n)
        yield pa.record_batch(repeated_runs(doc[entry], digest[entry], entry, start, twice), names=["doc_id", "digest", "a", "b"])


def _crowd(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of heads with many surroundings: runs of windows that this task sees twice, and all different fingerprints, cut by a hash into shares of bounded size.

    A share's arrays hold each fingerprint once: with where it stands, or with n = 2 if it was seen twice here.
    """
    names = ["doc_id", "digest", "a", "b", "head", "share", "prints", "n", "docs", "digests", "starts"]
    longs = pa.list_(pa.int64())

    def settled(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        size = [len(x[4]) for x in held]
        doc, digest = (np.repeat(np.array([x[i] for x in held], np.int64), size) for i in (0, 1))
        head, around = (np.concatenate([x[i][x[5]] for x in held]) for i in (2, 3))
        start, prints = (np.concatenate([x[i] for x in held]) for i in (4, 6))
        entry = np.concatenate([x[5] + base for x, base in zip(held, np.cumsum([0, *[len(x[2]) for x in held[:-1]]]), strict=True)])
        order = np.lexsort((prints, head))
        new = np.concatenate([[True], (prints[order][1:] != prints[order][:-1]) | (head[order][1:] != head[order][:-1])])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(order)))
        twice = np.zeros(len(order), bool)
        twice[order] = np.repeat(count > 1, count)
        runs = repeated_runs(doc, digest, entry, start, twice)
        k = len(runs[0])
        yield pa.record_batch([*runs, pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), *[pa.nulls(k, longs)] * 5], names=names)
        one = order[first]
        shares = np.maximum(1, around[one].astype(np.int64) * WINDOWS // SHARE).astype(U)
        share = ((mix(prints[one]) >> U(20)) % shares).astype(np.int32)
        by = np.lexsort((share, head[one]))
        one, share, count = one[by], share[by], count[by]
        cut = np.flatnonzero(np.concatenate([[True], (share[1:] != share[:-1]) | (head[one][1:] != head[one][:-1])]))
        at = pa.array(np.append(cut, len(one)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int64))) for x in (prints[one].view(np.int64), np.minimum(count, 2), doc[one], digest[one], start[one])]
        k = len(cut)
        yield pa.record_batch([*[pa.nulls(k, pa.int64())] * 2, *[pa.nulls(k, pa.int32())] * 2, pa.array(head[one][cut]), pa.array(share[cut]), *lists], names=names)

    held: list[tuple] = []
    for batch in batches:
        for x in _wanted(batch):
            held.append(x)
            if sum(len(y[4]) for y in held) > 500_000:
                yield from settled(held)
                held = []
    if held:
        yield from settled(held)


def _crowd_alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows whose fingerprint several rows of a (head, share) have. Rows come in this order."""
    for rows in by_key(batches, [0, 1]):
        head, share = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        lists = [rows.column(i).combine_chunks() for i in range(2, 7)]
        size = pc.list_value_length(lists[0]).to_numpy()
        prints, n, doc, digest, start = (x.flatten().to_numpy() for x in lists)
        heads = np.repeat(head, size)
        order = np.lexsort((prints, np.repeat(share, size), heads))
        p, h = prints[order], heads[order]
        first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (h[1:] != h[:-1])]))
        total = np.repeat(np.add.reduceat(n[order], first), np.diff(np.append(first, len(p))))
        hit = order[(total > 1) & (n[order] == 1)]
        hit = hit[np.lexsort((start[hit], digest[hit], doc[hit]))]
        # Neighbouring windows of a document are one run.
        apart = np.ones(len(hit), bool)
        apart[1:] = (start[hit][1:] - start[hit][:-1] > 1) | (doc[hit][1:] != doc[hit][:-1]) | (digest[hit][1:] != digest[hit][:-1])
        yield pa.record_batch(repeated_runs(doc[hit], digest[hit], np.cumsum(apart), start[hit], np.ones(len(hit), bool)), names=["doc_id", "digest", "a", "b"])


def covered(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of some byte ranges, by document and place."""
    if not len(a):
        return doc, a, b
    apart = int(b.max()) + 1  # ranges of different documents never touch
    a, b = a + doc * apart, b + doc * apart
    order = np.argsort(a, kind="stable")
    doc, a, reach = doc[order], a[order], np.maximum.accumulate(b[order])
    first = np.flatnonzero(np.concatenate([[True], a[1:] > reach[:-1]]))
    own = doc[first] * apart
    return doc[first], a[first] - own, reach[np.append(first[1:], len(a)) - 1] - own


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    for batch in batches:
        data, at = buffers(batch.column(1))
        data, at = memoryview(data), at.astype(np.int64)
        size = np.diff(at)
        runs = batch.column(2).flatten()
        n = pc.fill_null(pc.list_value_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)
        doc, a, b = covered(np.repeat(np.arange(len(n)), n), *(runs.field(f).to_numpy().astype(np.int64) for f in ("a", "b")))
        spans = np.bincount(doc, minlength=len(n))
        edge = np.append(0, np.cumsum(spans))
        removed = np.append(0, np.cumsum(b - a))
        removed = removed[edge[1:]] - removed[edge[:-1]]
        # What stays: from the start or the end of a run to the next run or the end.
        begin, end = np.insert(b, edge[:-1], 0), np.insert(a, edge[1:], size)
        doc = np.repeat(np.arange(len(n)), spans + 1)
        stays = end > begin
        doc, begin, end = doc[stays], begin[stays], end[stays]
        kept = np.append(0, np.cumsum(np.bincount(doc, minlength=len(n))))
        starts, stops, cut = (begin + at[doc]).tolist(), (end + at[doc]).tolist(), kept.tolist()
        digests = []
        for x, y in zip(cut, cut[1:], strict=False):
            digest = hashlib.sha256()
            for k in range(x, y):
                digest.update(data[starts[k] : stops[k]])
            digests.append(digest.hexdigest())
        ranges = pa.StructArray.from_arrays([pa.array(begin), pa.array(end)], names=["a", "b"])
        kept = pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), ranges)
        yield pa.record_batch([batch.column(0), pa.array(size), pa.array(removed), pa.array(spans), pa.array(digests, pa.string()), kept], names=names)


def repeated_ranges(docs: DataFrame, batches: int = BATCHES, family: SuffixFamily | None = None) -> DataFrame:
    """doc_id, digest (of the text) and runs: the byte ranges of a document that repeated windows cover, not yet merged.

    Without a ``family`` the documents are put into one of their own, in batches. With one, it must hold all documents; it stays as it is.
    """
    spark = docs.sparkSession
    own = family is None
    if own:
        family = SuffixFamily(spark)
        for i in range(batches):
            family.insert(docs.where(F.pmod(F.xxhash64("doc_id", text_of(docs)), F.lit(batches)) == i) if batches > 1 else docs)
    repeated = family.repeated()
    if own:
        family.drop()
    d = keyed(docs)
    found = d.mapInArrow(_entries, "doc_id long, digest long, head long, around long, place int, first int, last int").drop("place")
    found = materialize(found.join(repeated, ["head", "around"]), "entries")
    drop(repeated)
    release(spark)
    full = found.where("n > 1").select("doc_id", "digest", F.col("first").alias("a"), (F.col("last") + LENGTH).alias("b"))
    # One entry for each surrounding of a head that has several.
    unsure = found.where("surroundings > 1").groupBy("head", "around").agg(F.min(F.struct("doc_id", "digest", "first", "last")).alias("e"), F.first("surroundings").alias("surroundings"))
    unsure = materialize(unsure.select("head", "e.*", "surroundings", (F.col("surroundings") > CROWD).alias("crowd")), "unsure", merge=8)
    release(spark)

    def texts(crowd: bool) -> DataFrame:
        """Documents with the entries that are wanted of them."""
        own = unsure.where(F.col("crowd") == crowd).groupBy("doc_id", "digest").agg(F.collect_list(F.struct("head", "first", "last", "surroundings")).alias("wanted"))
        w = own.select(F.col("doc_id").alias("w_id"), F.col("digest").alias("w_digest"), "wanted")
        return d.join(w, (d["doc_id"] == w["w_id"]) & (d["digest"] == w["w_digest"])).select("doc_id", "digest", "text", "wanted")

    place = "doc_id long, digest long, a int, b int"
    alike = texts(False).mapInArrow(_windows, "doc_id long, digest long, head long, first int, prints array<long>").repartition("head").sortWithinPartitions("head")
    single = [materialize(alike.mapInArrow(_alike, place), "alike")]
    release(spark)
    if unsure.where("crowd").limit(1).count():
        lists = ", ".join(f"{c} array<long>" for c in ("prints", "n", "docs", "digests", "starts"))
        seen = materialize(texts(True).mapInArrow(_crowd, f"{place}, head long, share int, {lists}"), "crowd")
        release(spark)
        shares = seen.where("head IS NOT NULL").select("head", "share", "prints", "n", "docs", "digests", "starts").repartition("head", "share").sortWithinPartitions("head", "share")
        single += [materialize(shares.mapInArrow(_crowd_alike, place), "alike"), materialize(seen.where("head IS NULL").select("doc_id", "digest", "a", "b"), "alike")]
        drop(seen)
        release(spark)
    runs = full
    for part in single:
        runs = runs.unionByName(part)
    out = materialize(runs.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("a", "b")).alias("runs")), "runs")
    drop(found, unsure, *single)
    release(spark)
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, digest, bytes and no_id. A null id is 0 here and told by its digest: rows of equal id and digest have equal texts, and so equal ranges."""
    no_id = docs["doc_id"].isNull()
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(0).cast("long")).alias("doc_id"), F.xxhash64(text_of(docs), no_id).alias("digest"), utf8(text_of(docs)).alias("text"), no_id.alias("no_id"))


def remove_repeats(docs: DataFrame, batches: int = BATCHES, family: SuffixFamily | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the byte ranges that stay) for each document."""
    runs = repeated_ranges(docs, batches, family).select(F.col("doc_id").alias("r_id"), F.col("digest").alias("r_digest"), "runs")
    d = keyed(docs)
    both = d.join(runs, (d["doc_id"] == runs["r_id"]) & (d["digest"] == runs["r_digest"]), "left")
    both = both.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "text", "runs")
    return both.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept array<struct<a:long,b:long>>")


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


#: Every 200-byte string of the table by its digest.
OP5_SQL = """
    WITH d AS (SELECT row_number() OVER () AS k, doc_id, encode(coalesce(text, '')) AS b FROM documents),
    s AS (SELECT k, i, sha256(b[i : i + 199]) AS h FROM (SELECT k, b, unnest(range(1, octet_length(b) - 198)) AS i FROM d WHERE octet_length(b) >= 200)),
    r AS (SELECT k, i FROM s QUALIFY count(*) OVER (PARTITION BY h) > 1),
    g AS (SELECT k, i, sum(CASE WHEN i <= p + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY i) AS run
          FROM (SELECT k, i, lag(i) OVER (PARTITION BY k ORDER BY i) AS p FROM r)),
    span AS (SELECT k, min(i) AS a, max(i) + 199 AS z FROM g GROUP BY k, run),
    gap AS (SELECT k, coalesce(lag(z) OVER (PARTITION BY k ORDER BY a), 0) + 1 AS a, a - 1 AS z FROM span
            UNION ALL SELECT k, coalesce(max(span.z), 0) + 1, any_value(octet_length(b)) FROM d LEFT JOIN span USING (k) GROUP BY k),
    kept AS (SELECT k, string_agg(hex(b[a : z]), '' ORDER BY a) AS x FROM gap JOIN d USING (k) WHERE a <= z GROUP BY k),
    n AS (SELECT k, count(*) AS n_spans, sum(z - a + 1) AS n_removed FROM span GROUP BY k)
    SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
           sha256(unhex(coalesce(x, ''))) AS kept_sha256
    FROM d LEFT JOIN kept USING (k) LEFT JOIN n USING (k)"""
