"""Near-duplicate detection by weighted MinHash signatures (BagMinHash).

A document is the multiset of its shingles of five words (a shorter one has a single shingle). The weighted Jaccard similarity of two is the
sum of the lesser over the sum of the greater counts; documents of 0.8 or more are linked, and linked documents form a class.

Signatures. Each shingle owns a hierarchy of Poisson processes over the weight axis, cut at 0, 1, 2, 4, 8, ...: one process an
octave, whose rate is the octave's width, with points that fall on unit cells of the octave. A document of count w sees the points in cells below w. A
point has a time and a slot out of SLOTS; a slot's value is the identity of its earliest visible point, so two documents agree in a slot with
the probability of their weighted Jaccard similarity. Points are made in order of time and only up to a bound at which all slots are most likely filled (documents
with an empty slot double the bound), so a document costs about one point a shingle plus SLOTS * log(SLOTS).

Linking. 1. Documents of the same words are one text with a key of its own, whatever their ids: copies never meet each other again. The search runs on these keys.
2. Signatures are cut into BANDS bands; classes that agree in a band share a bucket. At a similarity of 0.8 a pair shares none with probability 3e-6.
3. Each class is verified against its best bucket leader (the least key), then against the leaders of its other buckets unless a component already joins them.
Verification compares the true multisets. 4. In a bucket that still holds several components, every pair of documents of different components is compared:
those outside the bucket's largest component visit that component's documents, and each other, in blocks of BLOCK x BLOCK documents, whose overlaps come from one
inverted index a block. A document visits a component once, however many buckets they share. So every pair that shares a bucket is joined or has been compared.
Documents that have too many shingles which no other open document has are left out of 4: these bound every overlap from above.

Defined results: null text is empty; texts without words have no shingles and are linked only to each other; repeated rows are in one
class; texts of rows with a null doc_id are searched like all others, and the texts of a doc_id that has several each have their own class; an empty table gives no rows;
other columns are ignored. A class is told by class_key, the least digest of its words; its class_id is its least doc_id, null where all are null. Two classes share a
class_id only where one doc_id has texts in both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import drop, keep, materialize, release, table, text_of
from tessera.llm.components import components
from tessera.llm.textnum import FOLD, IS_WORD, U, buffers, by_key, copies, mix, shingles, slices, words

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 5
SLOTS = BANDS * ROWS
#: Documents on either side of a block of comparisons.
BLOCK = 1000
#: Bytes as words have them: A-Z in lower case, a space for what is in no word.
PLAIN = np.where(IS_WORD, FOLD, 32).astype(np.uint8).tobytes()
_STEP = U(0xD1B54A32D192ED03)


def octaves(row: np.ndarray, key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """The processes that each (row, shingle, count) sees: row, seed, first cell, width, count."""
    out = []
    level, low, width = 0, 0, 1
    while len(row):
        out.append((row, mix(key + U((level + 1) * int(_STEP) % 2**64)), np.full(len(row), low), np.full(len(row), width), count))
        low, width, level = low + width, max(1, low + width), level + 1
        more = count > low
        row, key, count = row[more], key[more], count[more]
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (row, key, count, count, count)


def signatures(row: np.ndarray, key: np.ndarray, count: np.ndarray, rows: int, slots: int = SLOTS) -> np.ndarray:
    """(rows, slots) of 64-bit values; rows without shingles are 0."""
    result = np.zeros((rows, slots), U)
    weight = np.bincount(row, count, rows)
    bound = np.where(weight > 0, (np.log(slots) + 4) * slots / np.maximum(weight, 1), 0)
    p_row, seed, low, width, most = octaves(row, key, count)
    todo = np.flatnonzero(weight > 0)
    while len(todo):
        mine = np.isin(p_row, todo) if len(todo) < rows else np.ones(len(p_row), bool)
        r, s, lo, wd, w = p_row[mine], seed[mine], low[mine], width[mine], most[mine]
        time, n = np.zeros(len(r)), 0
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(r):
            block = int(np.clip(20_000 // len(r), 1, 256))
            x = mix(s[:, None] + np.arange(n, n + block, dtype=U)[None, :] * _STEP)
            gap = -np.log(((x >> U(11)).astype(float) + 0.5) * 2.0**-53) / wd[:, None]
            at = time[:, None] + np.cumsum(gap, 1)
            early = at <= bound[r][:, None]
            i, j = np.nonzero(early)
            y = mix(x[i, j] ^ _STEP)
            seen = lo[i] + ((y & U(0xFFFFFFFF)) % wd[i].astype(U)).astype(np.int64) < w[i]
            slot = ((y >> U(32)) % U(slots)).astype(np.int64)
            found.append((r[i][seen] * slots + slot[seen], at[i, j][seen], y[seen]))
            on = early[:, -1]
            time, r, s, lo, wd, w = at[on, -1], r[on], s[on], lo[on], wd[on], w[on]
            n += block
        place, t, y = (np.concatenate(c) for c in zip(*found, strict=True))
        least = np.full(rows * slots, np.inf)
        np.minimum.at(least, place, t)
        first = t == least[place]
        value = np.zeros(rows * slots, U)
        np.maximum.at(value, place[first], y[first] | U(1))
        full = np.isfinite(least).reshape(rows, slots).all(1)
        done = todo[full[todo]]
        result[done] = value.reshape(rows, slots)[done]
        todo = todo[~full[todo]]
        bound[todo] *= 2
    return result


def band_hashes(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    part = signature.reshape(len(signature), bands, -1)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=U), (len(signature), bands)).copy()
    for j in range(part.shape[2]):
        h = mix(h * _STEP + part[:, :, j])
    return h.view(np.int64)


def word_digest(text: bytes) -> bytes:
    """The first 16 bytes of the SHA-256 of a text's words, A-Z in lower case, with one space between them."""
    return hashlib.sha256(b" ".join(text.translate(PLAIN).split())).digest()[:16]


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 1, 1 << 20):
            data, place = buffers(batch.column(1))
            hashes, _, at = words(data, place)
            n = batch.num_rows
            digest = [word_digest(data[a:b].tobytes()) for a, b in zip(place[:-1], place[1:], strict=True)]
            keys, key_at = shingles(hashes, at, SHINGLE)
            total = np.diff(key_at)
            row, key, count = copies(keys, np.repeat(np.arange(n), total))
            bands = band_hashes(signatures(row, key, count, n))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(bands.reshape(-1)))
            out = [batch.column(0), batch.column(2), batch.column(3), pa.array(digest, pa.binary()), pa.array(total), lists]
            yield pa.record_batch(out, names=["doc_id", "h1", "h2", "digest", "total", "bands"])


def row_key(docs: DataFrame) -> list[Column]:
    """doc_id and two 64-bit hashes of the text: what tells a row from those of other ids or texts."""
    text = text_of(docs)
    return [docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("2"), text).alias("h2")]


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, hashes of the text, digest of the words, number of shingles, band hashes."""
    doc_id, h1, h2 = row_key(docs)
    d = docs.select(doc_id, text_of(docs).alias("text"), h1, h2)
    return d.mapInArrow(_signed, "doc_id long, h1 long, h2 long, digest binary, total long, bands array<long>")


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 1, 1 << 20):
            hashes, _, at = words(*buffers(batch.column(1)))
            keys, key_at = shingles(hashes, at, SHINGLE)
            out = []
            for a, b in zip(key_at[:-1], key_at[1:], strict=True):
                k = np.sort(keys[a:b])
                new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
                first = np.flatnonzero(new)
                nth = np.arange(len(k)) - np.repeat(first, np.diff(np.append(first, len(k))))  # the second copy of a shingle is an element of its own
                out.append(np.sort(np.where(nth > 0, mix(k + nth.astype(U) * _STEP), k)))
            lists = pa.ListArray.from_arrays(pa.array(key_at.astype(np.int32)), pa.array(np.concatenate([*out, np.zeros(0, U)]).view(np.int64)))
            yield pa.record_batch([batch.column(0), lists], names=["id", "elements"])


def shared(x: np.ndarray, y: np.ndarray) -> int:
    """Elements in common of two ascending arrays."""
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    at = column.offsets.to_numpy()
    return column.flatten().to_numpy().view(U), at - at[0]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between visitors and base documents of each block; one for each component that a visitor reaches. Rows come by block, the base first."""
    for rows in by_key(batches, [0, 1, 2, 3]):
        block = np.stack([rows.column(k).to_numpy() for k in range(4)])
        visitor, ids, comp, room = (rows.column(k).to_numpy() for k in range(4, 8))
        elements, at = _lists(rows.column(8).combine_chunks())
        size = np.diff(at)
        edge = np.flatnonzero(np.concatenate([[True], (block[:, 1:] != block[:, :-1]).any(0), [True]]))
        out: list[tuple[int, int]] = []
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            mid = lo + int((visitor[lo:hi] == 0).sum())
            base = slice(at[lo], at[mid])
            order = np.argsort(elements[base], kind="stable")
            index, owner = elements[base][order], np.repeat(np.arange(mid - lo), size[lo:mid])[order]
            for v in range(mid, hi):
                e = elements[at[v] : at[v + 1]]
                left, right = np.searchsorted(index, e), np.searchsorted(index, e, "right")
                n = right - left
                places = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - left, n)
                both = np.bincount(owner[places], minlength=mid - lo)
                hit = (both >= THRESHOLD * (size[lo:mid] + size[v] - both)) & (comp[lo:mid] != comp[v])
                for i in np.unique(comp[lo:mid][hit], return_index=True)[1]:
                    out.append((int(ids[v]), int(ids[lo:mid][hit][i])))
        a, b = zip(*out, strict=True) if out else ((), ())
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        (x, x_at), (y, y_at) = (_lists(batch.column(i)) for i in (2, 3))
        for i in range(batch.num_rows):
            u, v = x[x_at[i] : x_at[i + 1]], y[y_at[i] : y_at[i + 1]]
            both = shared(u, v)
            if both >= THRESHOLD * (len(u) + len(v) - both):
                keep.append(i)
        yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))


def verify(pairs: DataFrame, elements: DataFrame) -> DataFrame:
    """The pairs (a, b) whose multisets have a similarity of THRESHOLD or more."""
    x = pairs.select("a", "b").join(elements.select(F.col("id").alias("a"), F.col("elements").alias("x")), "a")
    xy = x.join(elements.select(F.col("id").alias("b"), F.col("elements").alias("y")), "b")
    return xy.select("a", "b", "x", "y").mapInArrow(_verified, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (least doc_id of the class), class_key (hex), total (shingles): one row per document."""
    return classified(docs).select("doc_id", "class_id", F.lower(F.hex("class_key")).alias("class_key"), "total")


def classified(docs: DataFrame) -> DataFrame:
    """doc_id, h1, h2, digest, total, class_id, class_key: one row per document."""
    spark = docs.sparkSession
    signed = materialize(sign(docs), "signed")
    # One row of each text stands for it: the one of the least id, of those the least hashes.
    row = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h1", "h2")).alias("row")
    texts = signed.groupBy("digest").agg(row, F.first("total").alias("total"), F.first("bands").alias("bands"))
    # Numbered in the order of the digests, so that a task that runs again gives the same keys.
    keyed = texts.sortWithinPartitions("digest").select(F.monotonically_increasing_id().alias("id"), "digest", "row.doc_id", "row.h1", "row.h2", "total", "bands")
    groups = materialize(keyed, "groups", merge=8)
    release(spark)
    cells = groups.where("total > 0").select("id", "total", F.explode("bands").alias("bucket"))
    led = materialize(cells.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("leader")).where("n > 1").select("bucket", "leader"), "led", merge=8)
    release(spark)
    members = materialize(cells.join(led.hint("merge"), "bucket").select("bucket", "id", "total", "leader"), "members", merge=8)
    drop(led)
    release(spark)
    led_by = members.where("id <> leader")
    place = [F.coalesce("doc_id", F.lit(0)).alias("at"), "h1", "h2"]
    wanted = groups.join(members.select("id").distinct(), "id", "left_semi").select("id", *place)
    said = docs.select(*row_key(docs), text_of(docs).alias("text")).select(*place, "text").join(wanted, ["at", "h1", "h2"]).dropDuplicates(["at", "h1", "h2"])
    elements = materialize(said.select("id", "text").mapInArrow(_shingled, "id long, elements array<long>"), "elements", merge=8)
    release(spark)
    first = keep(led_by.groupBy("id").agg(F.min("leader").alias("leader")).select(F.col("id").alias("a"), F.col("leader").alias("b")))
    links = keep(verify(first, elements))
    # Each document has at most one link so far, to a lesser id: where two of these lead, without a loop, is enough to see most pairs joined.
    near = links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    near = keep(placed(near.withColumnRenamed("component", "to"), near, "to", "component").select("id", "component"))
    rest = placed(placed(led_by, near, "id", "c"), near, "leader", "d").where("c <> d").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct()
    more = keep(verify(rest.join(first, ["a", "b"], "left_anti"), elements))
    labels = components(links.union(more))
    drop(first, links, near, more)
    release(spark)
    last = compare_rest(members, labels, elements)
    if last is not None and last.limit(1).count():
        # Components of components: the new links are few.
        between = placed(placed(last, labels, "a", "x"), labels, "b", "y").select(F.col("x").alias("a"), F.col("y").alias("b"))
        joined = components(between)
        ends = last.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        every = placed(labels.select("id").union(ends).distinct(), labels, "id", "c")
        final = placed(every, joined, "c", "component").select("id", "component")
    else:
        joined, final = None, labels.select("id", "component")
    found = keep(groups.select("digest", "doc_id", "id").join(final, "id", "left").select("digest", "doc_id", F.coalesce("component", "id").alias("component")))
    least = found.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.min("digest").alias("class_key"))
    classes = materialize(found.select("digest", "component").join(least.hint("merge"), "component").select("digest", "class_id", "class_key"), "classes", merge=8)
    drop(groups, members, elements, labels, found, *(t for t in (last, joined) if t is not None))
    release(spark)
    return signed.select("doc_id", "h1", "h2", "digest", "total").join(classes, "digest")


def placed(df: DataFrame, labels: DataFrame, by: str, name: str) -> DataFrame:
    """``df`` with the component of its column ``by``, which is itself where it has no links."""
    return df.join(labels.select(F.col("id").alias(by), F.col("component").alias("_c")), by, "left").withColumn(name, F.coalesce("_c", by)).drop("_c")


def several(members: DataFrame) -> DataFrame:
    """The rows of buckets with documents of several components.

    Joins by bucket or group ask for a sort-merge join and read the aggregated side from a written table: Spark splits the large partitions
    of such a join, but not those of one that it has turned into a broadcast or that shares its stage with the aggregation.
    """
    mixed = keep(members.groupBy("bucket").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("bucket"))
    found = keep(members.join(mixed.hint("merge"), "bucket", "left_semi"))
    drop(mixed)
    return found


def compare_rest(members: DataFrame, labels: DataFrame, elements: DataFrame) -> DataFrame | None:
    """Links between documents of different components that share a bucket: step 4. None if there are no such documents."""
    spark = members.sparkSession
    open_ = several(placed(members.select("bucket", "id", "total"), labels, "id", "c"))
    ids = open_.select("id", "total").distinct()
    said = elements.join(ids, "id", "left_semi").select("id", F.explode("elements").alias("element"))
    own = said.groupBy("element").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1").groupBy("id").agg(F.count(F.lit(1)).alias("own"))
    room = ids.join(own, "id", "left").select("id", (F.col("total") - F.coalesce("own", F.lit(0))).alias("room"), "total")
    able = room.where(F.col("room") >= F.col("total") * THRESHOLD).select("id", "room")
    left = several(open_.join(able, "id"))
    if not left.limit(1).count():
        drop(open_, left)
        return None
    sizes = left.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("k"))
    largest = keep(sizes.groupBy("bucket").agg(F.max(F.struct("k", (-F.col("c")).alias("c"))).alias("m")).select("bucket", (-F.col("m.c")).alias("big")))
    tagged = keep(left.join(largest.hint("merge"), "bucket"))
    inside, outside = tagged.where("c = big"), tagged.where("c <> big")
    crowd = keep(outside.groupBy("bucket").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("bucket"))
    among = outside.join(crowd.hint("merge"), "bucket", "left_semi").select(F.lit(1).alias("kind"), F.col("bucket").alias("group"), "id", "c", "room")
    to_big = lambda df: df.select(F.lit(0).alias("kind"), F.col("big").alias("group"), "id", "c", "room").distinct()
    role = lambda df, v: df.withColumn("visitor", F.lit(v))
    rows = keep(role(to_big(inside), 0).unionByName(role(to_big(outside), 1)).unionByName(role(among, 0)).unionByName(role(among, 1)))
    count = keep(rows.groupBy("kind", "group").agg(F.count_if(F.col("visitor") == 0).alias("b"), F.count_if(F.col("visitor") == 1).alias("v")))
    sized = rows.join(count.hint("merge"), ["kind", "group"]).withColumn("bs", F.ceil(F.col("b") / BLOCK).cast("int")).withColumn("vs", F.ceil(F.col("v") / BLOCK).cast("int"))
    own_part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    base = sized.where("visitor = 0").withColumn("i", own_part("bs")).withColumn("j", F.explode(every("vs")))
    visit = sized.where("visitor = 1").withColumn("j", own_part("vs")).withColumn("i", F.explode(every("bs")))
    cells = base.unionByName(visit).select("kind", "group", "i", "j", "visitor", "id", "c", "room")
    dealt = cells.join(elements, "id").select("kind", "group", "i", "j", "visitor", "id", "c", "room", "elements")
    sorted_ = dealt.repartition("kind", "group", "i", "j").sortWithinPartitions("kind", "group", "i", "j", "visitor")
    links = keep(sorted_.mapInArrow(_linked, "a long, b long"))
    drop(open_, left, largest, tagged, crowd, rows, count)
    release(spark)
    return links


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, all columns as they are: the row of the least id, of those the least digest of words, then the least hashes of the text.

    A class whose rows all lack a doc_id keeps one of them. A doc_id with several unrelated texts keeps one row of each class of which it is the least id. Of rows with
    equal id and text the least hash of all columns decides (maps can't be hashed and are left out of it).
    """
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest", "h1", "h2")
    best = classified(docs).where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("class_key").agg(F.min(rank).alias("r"))
    place = [F.coalesce("doc_id", F.lit(0)).alias("at"), F.col("doc_id").isNull().alias("no_id"), "h1", "h2"]
    keep = best.select("r.*").select(*place)
    order = F.xxhash64(*[F.col("row").getField(c) for c, kind in docs.dtypes if "map<" not in kind])
    rows = docs.select(*row_key(docs), F.struct(*[docs[c] for c in docs.columns]).alias("row")).select(*place, "row")
    by = ["at", "no_id", "h1", "h2"]
    return rows.join(keep, by, "left_semi").groupBy(*by).agg(F.min_by("row", order).alias("row")).select("row.*")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: All pairs of distinct texts that share a shingle, and what can be reached over their links.
OP1_SQL = r"""
    WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    said AS (SELECT k, doc_id, w, substr(sha256(array_to_string(w, ' ')), 1, 32) AS digest, CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - 4, 1) END AS total FROM d),
    t AS (SELECT digest, any_value(w) AS w, any_value(total) AS total FROM said GROUP BY digest),
    g AS (SELECT digest, total, s, count(*) AS n FROM (SELECT digest, total, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT *, unnest(range(1, total + 1)) AS i FROM t)) GROUP BY ALL),
    link AS (SELECT x.digest AS a, y.digest AS b FROM g x JOIN g y ON x.s = y.s AND x.digest <> y.digest
             GROUP BY x.digest, y.digest HAVING 5 * sum(least(x.n, y.n)) >= 4 * (any_value(x.total) + any_value(y.total) - sum(least(x.n, y.n)))),
    reach AS (SELECT digest AS a, digest AS b FROM t UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
    part AS (SELECT a AS digest, min(b) AS class_key FROM reach GROUP BY a),
    class AS (SELECT class_key, min(doc_id) AS class_id FROM part JOIN said USING (digest) GROUP BY class_key)
    SELECT doc_id, class_id, class_key, CAST(total AS BIGINT) AS total FROM said JOIN part USING (digest) JOIN class USING (class_key)"""
