"""Benchmark decontamination by a prefix-filtered set join.

A window is a run of WINDOW words of a benchmark item (a shorter item is one window). A document holds a window only if it holds
every word of it, so one word of each window - a prefix of length 1 in the order of rarity - is enough to find all documents that may.
The words are ordered by their count over all documents, so the prefix word is the one that makes fewest candidates.

1. count the benchmark's words over all documents (a broadcast join before the aggregation);
2. take each window's rarest word and its place in the window;
3. join the documents' words with these; the place gives the only possible start, which length and position bounds check first;
4. compare the document's words there with the window's, exactly.

Steps 3 and 4 run in one pass without a shuffle of text. What is broadcast is bounded: the windows and the vocabulary are cut by a hash into
parts of at most BROADCAST_ROWS rows each, and all documents are joined with one part after the other.
Only built-in column functions run. Words are matched in any case first (``lower``), then exactly with A-Z alone folded.

Defined results: null text and texts without a word have no words and no hits; items without words or without an id are ignored; rows of equal doc_id and
text share their hits and each row is returned; a null doc_id is a value like others; empty tables give no rows or no hits; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, table, text_of

WINDOW = 10
#: Most rows of a broadcast part (about 200 bytes each).
BROADCAST_ROWS = 200_000
#: What stands between words: the complement of the word class, with A-Z as word characters.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words in their own case."""
    return F.array_remove(F.split(text, GAP), "")


def folded(words: Column) -> Column:
    """Words joined by spaces, A-Z in lower case."""
    return F.translate(F.array_join(words, " "), UPPER, LOWER)


def parts(df: DataFrame, key: str) -> list[DataFrame]:
    """``df`` cut by a hash of ``key`` so that each part can be broadcast; a part is near BROADCAST_ROWS / 2 rows."""
    n = -(-df.count() // (BROADCAST_ROWS // 2))
    if n <= 1:
        return [df]
    return [df.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def windows_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """wtext, size, items: each distinct window with the items that hold it."""
    items = benchmark.select(benchmark["item_id"].cast("string").alias("item"), words_of(text_of(benchmark)).alias("w")).where(F.col("item").isNotNull() & (F.size("w") > 0))
    n = F.least(F.size("w"), F.lit(window))
    every = items.select("item", "w", n.alias("size"), F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("at"))
    return every.groupBy(folded(F.slice("w", F.col("at"), F.col("size"))).alias("wtext"), "size").agg(F.collect_set("item").alias("items"))


def prefixes(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """The windows with their rarest word over all documents (in lower case) and its place."""
    each = windows.select("wtext", F.posexplode(F.split("wtext", " ")).alias("place", "w")).select("wtext", "place", F.lower("w").alias("word"))
    vocabulary = materialize(each.select("word").distinct(), "vocabulary")
    said = docs.select(F.explode(words_of(text_of(docs))).alias("w")).select(F.lower("w").alias("word"))
    counted = reduce(DataFrame.unionByName, [said.join(F.broadcast(p), "word", "left_semi").groupBy("word").count() for p in parts(vocabulary, "word")])
    rarest = each.join(counted, "word", "left").groupBy("wtext").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "word", "place")).alias("least"))
    return windows.join(rarest, "wtext").where(F.col("least.n") > 0).select("wtext", "size", "items", F.col("least.word").alias("word"), F.col("least.place").alias("place"))


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, digest (of the text), start, size, items: every occurrence of a window in a document."""
    wanted = materialize(prefixes(materialize(windows_of(benchmark, window), "windows"), docs), "prefixes")
    d = docs.select(docs["doc_id"].alias("doc_id"), text_of(docs).alias("text"))
    said = d.select("doc_id", F.xxhash64("text").alias("digest"), words_of(F.col("text")).alias("w"))
    said = said.select("doc_id", "digest", "w", F.posexplode("w").alias("pos", "one"))
    start = F.col("pos") - F.col("place")

    def one(part: DataFrame) -> DataFrame:
        found = said.join(F.broadcast(part), F.lower(said["one"]) == part["word"])
        found = found.where((start >= 0) & (start + F.col("size") <= F.size("w")))
        found = found.where(folded(F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("size"))) == F.col("wtext"))
        return found.select("doc_id", "digest", start.alias("start"), "size", "items")

    return reduce(DataFrame.unionByName, [one(p) for p in parts(wanted, "wtext")])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, digest, n_words, n_hit and the items whose windows it holds."""
    hits = find_hits(docs, benchmark, window)
    covered = hits.groupBy("doc_id", "digest").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1))))).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    counts = docs.select(docs["doc_id"].alias("doc_id"), F.xxhash64(text_of(docs)).alias("digest"), F.size(words_of(text_of(docs))).cast("long").alias("n_words"))
    h = covered.select(F.col("doc_id").alias("h_id"), F.col("digest").alias("h_digest"), "n_hit", "items")
    joined = counts.join(h, counts["doc_id"].eqNullSafe(h["h_id"]) & (counts["digest"] == h["h_digest"]), "left")
    return joined.select("doc_id", "digest", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that hold no window, all columns as they are."""
    bad = find_hits(docs, benchmark, window).select(F.col("doc_id").alias("h_id"), F.col("digest").alias("h_digest")).distinct()
    match = docs["doc_id"].eqNullSafe(bad["h_id"]) & (F.xxhash64(text_of(docs)) == bad["h_digest"])
    return docs.join(bad, match, "left_anti")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return c.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP9_SQL = rf"""
    WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
            FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM bw WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT n FROM win),
    pos AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
            FROM (SELECT dw.*, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
    hit AS (SELECT DISTINCT doc_id, pos.n, i, item_id FROM pos JOIN win ON pos.n = win.n AND pos.g = win.g),
    cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
    its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
    SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)"""
