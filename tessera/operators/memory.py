"""Memories: evidence hashes, staleness, recall."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import config
from tessera.functions import text


def evidence_table(files: DataFrame, symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """ref, hash of everything that evidence can name."""
    one = lambda df, ref: df.select(ref.alias("ref"), "hash")
    return one(files, F.concat(F.lit("file:"), "path")).unionByName(one(symbols, F.col("symbol_id"))).unionByName(one(chunks, F.concat(F.lit("chunk:"), "chunk_id")))


def evidence_hashes(memories: DataFrame, hashes: DataFrame) -> DataFrame:
    """memory_id, current_hash: the digest of the hashes that the evidence has now, in order; "missing" where there is none."""
    refs = memories.select("memory_id", F.posexplode("evidence_refs").alias("pos", "raw"))
    named = refs.withColumn("ref", F.when(F.col("raw").rlike("^(symbol|chunk|file):"), F.col("raw")).otherwise(F.concat(F.lit("file:"), "raw")))
    found = named.join(hashes, "ref", "left").groupBy("memory_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("hash", F.lit("missing")).alias("h")))).alias("h"))
    joined = memories.select("memory_id").join(found, "memory_id", "left")
    return joined.select("memory_id", F.sha2(F.coalesce(F.array_join("h.h", "|"), F.lit("")), 256).alias("current_hash"))


def with_staleness(memories: DataFrame, hashes: DataFrame) -> DataFrame:
    return memories.join(evidence_hashes(memories, hashes), "memory_id").withColumn("stale", ~F.col("evidence_hash").eqNullSafe(F.col("current_hash"))).drop("current_hash")


def recall(memories: DataFrame, query: Counter[str], semantic: DataFrame | None = None) -> DataFrame:
    """Of memories with staleness: the three best fresh ones, or the best stale one if there is none fresh. With score and rank."""
    score = text.overlap(text.terms(F.concat_ws(" ", "title", "summary")), query)
    rows = memories
    if semantic is not None:
        rows = rows.join(semantic.select("memory_id", "semantic"), "memory_id", "left")
        score = score + config.SEMANTIC_WEIGHT * F.coalesce("semantic", F.lit(0.0))
    rows = rows.withColumn("score", score)
    if query:
        rows = rows.where("score > 0")
    best = rows.where("NOT stale").orderBy(F.desc("score"), F.desc("memory_id")).limit(3)
    worst = rows.where("stale").orderBy(F.desc("score"), F.desc("memory_id")).limit(1)
    few = best.unionByName(worst)
    fresh = F.max((~F.col("stale")).cast("int")).over(Window.partitionBy(F.lit(0)))
    kept = few.withColumn("_f", fresh).where((F.col("_f") == 0) | ~F.col("stale")).drop("_f")
    return kept.orderBy(F.desc("score"), F.desc("memory_id"))


def timeline(files: DataFrame, memories: DataFrame, since: str | None = None, scope: set[str] | None = None) -> DataFrame:
    """kind, ref, at, delta_summary, newest first; ``memories`` have staleness. Times compare as text in one form."""
    asked = scope or {"code", "memory", "stale"}
    event = lambda df, kind, ref, at, said: df.select(F.lit(kind).alias("kind"), ref.alias("ref"), at.alias("at"), said.alias("delta_summary"))
    after = lambda df, c: df.where(F.col(c) >= F.lit(since)) if since else df
    parts = []
    if "code" in asked:
        parts.append((0, event(after(files, "updated_at"), "file_changed", F.concat(F.lit("file:"), "path"), F.col("updated_at"), F.concat_ws(" ", "role", "language", F.lit("file changed")))))
    ref = F.concat(F.lit("memory:"), F.col("memory_id").cast("string"))
    if "memory" in asked:
        parts.append((1, event(after(memories, "created_at"), "memory_added", ref, F.col("created_at"), F.concat(F.lit("Memory added: "), "title"))))
    if "stale" in asked:
        old = memories.where("stale").withColumn("at", F.coalesce("last_validated_at", F.lit("")))
        old = old.where((F.col("at") == "") | (F.col("at") >= F.lit(since))) if since else old
        parts.append((2, event(old, "memory_stale", ref, F.col("at"), F.concat(F.lit("Memory drifted from evidence: "), "title"))))
    if not parts:
        return event(files.limit(0), "", F.col("path"), F.col("updated_at"), F.col("role"))
    every = None
    for i, p in parts:
        p = p.withColumn("_branch", F.lit(i))
        every = p if every is None else every.unionByName(p)
    return every.orderBy(F.desc(F.coalesce("at", F.lit(""))), "_branch", "ref").drop("_branch")
