"""Scores: term overlap, exact matches, BM25, recency, boosts."""

from __future__ import annotations

import functools
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import config
from tessera.functions import text
from tessera.functions.numbers import rounded
from tessera.functions.paths import lookup


def added(parts: list[Column]) -> Column:
    return sum(parts[1:], parts[0]) if parts else F.lit(0.0)


def either(parts: list[Column]) -> Column:
    return functools.reduce(Column.__or__, parts, F.lit(False))


def file_exact(path: Column, fields: list[Column], query: Counter[str]) -> Column:
    """Per term and count: 1 for each field that holds it, 1.5 if it is a part of the path."""
    low = [F.lower(f) for f in fields]
    parts = F.split(F.lower(path), "/")
    return added([(added([f.contains(t).cast("double") for f in low]) + F.array_contains(parts, t).cast("double") * 1.5) * float(n) for t, n in query.items()])


def file_score(query: Counter[str]) -> Column:
    """Of files rows."""
    fields = [F.col(c) for c in ("path", "summary", "role", "language")]
    return file_exact(F.col("path"), fields, query) + text.overlap(text.terms(F.concat_ws(" ", *fields)), query)


def symbol_score(query: Counter[str]) -> Column:
    """Of symbols rows: 2.5 for the symbol's own name, else 1 for a term in its text."""
    said = F.lower(F.concat_ws(" ", "path", "name", "kind", "summary"))
    exact = [F.when(F.lower("name") == t, 2.5 * n).when(said.contains(t), 1.0 * n).otherwise(0.0) for t, n in query.items()]
    return added(exact) + text.overlap(text.terms(said), query)


def recency(updated_at: Column, now: Column) -> Column:
    """A factor by age in days; 1 where the time is unknown or can't be read."""
    age = (F.unix_micros(now) - F.unix_micros(F.try_to_timestamp(updated_at))) / F.lit(86400e6)
    out = F.when(age < config.RECENCY[0][0], config.RECENCY[0][1])
    for days, factor in config.RECENCY[1:]:
        out = out.when(age < days, factor)
    return out.otherwise(F.lit(1.0))


def role_boost(role: Column) -> Column:
    return lookup(role, config.ROLE_BOOST, 1.0)


def kind_boost(kind: Column) -> Column:
    return lookup(kind, config.KIND_BOOST, 1.0)


def bm25(docs: DataFrame, query: list[str], tokens: str = "tokens") -> DataFrame:
    """``docs`` with a column bm25. Repeated query words count each time.

    Two passes over the rows and no shuffle of them: one aggregation for the corpus size, mean length and document counts of
    the query's words, then an expression a row. For many queries over one corpus, use postings.
    """
    own = sorted(set(query))
    t = F.col(tokens)
    if not own:
        return docs.withColumn("bm25", F.lit(0.0))
    said = [F.coalesce(F.sum(F.array_contains(t, w).cast("long")), F.lit(0)).alias(f"d{i}") for i, w in enumerate(own)]
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.size(t)), F.lit(0.0)).alias("mean"), *said).first()

    def score(t: Column) -> Column:
        length = F.size(t).cast("double")
        return added([term_score(text.occurrences(t, w).cast("double"), length, stats["n"], stats["mean"], stats[f"d{i}"]) * float(query.count(w)) for i, w in enumerate(own)])

    # bound once: a filter on the score would otherwise find the tokens anew for each word
    return docs.withColumn("bm25", F.get(F.transform(F.array(t), score), F.lit(0)))


def bm25_counted(docs: DataFrame, query: list[str], words: list[str]) -> DataFrame:
    """``bm25`` of documents (length, tf) whose words are counted already: tf has a count for each of ``words``, the query's own."""
    if not words:
        return docs.withColumn("bm25", F.lit(0.0))
    tf = [F.get("tf", F.lit(i)) for i in range(len(words))]
    said = [F.coalesce(F.sum((n > 0).cast("long")), F.lit(0)).alias(f"d{i}") for i, n in enumerate(tf)]
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("mean"), *said).first()
    length = F.col("length").cast("double")
    parts = [term_score(tf[i].cast("double"), length, stats["n"], stats["mean"], stats[f"d{i}"]) * float(query.count(w)) for i, w in enumerate(words)]
    return docs.withColumn("bm25", added(parts))


def idf(n: int, found: int) -> float:
    from math import log

    value = log((n - found + 0.5) / (found + 0.5))
    return value if value > 0 else config.BM25_FLOOR


def term_score(tf: Column, length: Column, n: int, mean: float, found: int) -> Column:
    k, b = config.BM25_K1, config.BM25_B
    return F.lit(idf(n, found)) * (tf * (k + 1.0)) / (tf + k * (1.0 - b + b * length / F.lit(mean or 1.0)))


def postings(docs: DataFrame, *keep: str, tokens: str = "tokens") -> DataFrame:
    """term, ref, tf, length and the columns in ``keep``: to be written sorted by term, so that a query reads only its terms' row groups."""
    each = docs.select("ref", *keep, F.size(tokens).alias("length"), F.explode(tokens).alias("term"))
    return each.groupBy("term", "ref", "length", *keep).agg(F.count(F.lit(1)).alias("tf"))


def postings_of(words: list[str], docs: DataFrame, *keep: str, tokens: str = "tokens") -> DataFrame:
    """The rows of ``postings`` for some terms, straight from the documents: other terms are counted nowhere."""
    counted = F.array(*[F.struct(F.lit(w).alias("term"), text.occurrences(F.col(tokens), w).cast("long").alias("tf")) for w in sorted(set(words))])
    if not words:
        return postings(docs.limit(0), *keep, tokens=tokens)
    each = docs.select("ref", *keep, F.size(tokens).alias("length"), F.explode(counted).alias("p")).where("p.tf > 0")
    return each.groupBy("p.term", "ref", "length", *keep).agg(F.sum("p.tf").alias("tf"))


def bm25_from_postings(found: DataFrame, query: list[str], n: int, mean: float, counts: dict[str, int] | None = None) -> DataFrame:
    """ref, bm25 of the documents that hold a query word. ``counts``: documents a word, where they are known."""
    hits = found.where(F.col("term").isin(sorted(set(query))))
    if counts is None:
        counts = {r["term"]: r["n"] for r in hits.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [F.when(F.col("term") == t, term_score(F.col("tf").cast("double"), F.col("length").cast("double"), n, mean, c) * float(query.count(t))).otherwise(0.0) for t, c in counts.items()]
    return hits.groupBy("ref").agg(F.sum(added(parts)).alias("bm25")) if parts else hits.select("ref", F.lit(0.0).alias("bm25")).limit(0)


def normalized(scored: DataFrame, column: str) -> DataFrame:
    """Divide a score by its largest value; none where that isn't positive. The largest value is one number, taken first."""
    top = scored.agg(F.max(column).alias("m")).first()["m"]
    value = F.col(column) / F.lit(float(top)) if top and top > 0 else F.lit(0.0)
    return scored.withColumn(column, value)


def soft_kind(score: Column, role: Column, language: Column, kind: str | None) -> Column:
    """Half the score for files of another kind than asked for."""
    return F.when((role != kind) & (language != kind), score * 0.5).otherwise(score) if kind else score


def locate_score(bare: str, leaf: str, name: Column, path: Column, signature: Column) -> Column:
    """How well a symbol's name fits a dotted lookup."""
    parts = bare.split(".")
    said = F.lower(F.concat_ws(" ", path, F.coalesce(signature, F.lit("")), name))
    if len(parts) <= 1:
        suffix = F.lit(0.7)
    else:
        hit = added([said.contains(p.lower()).cast("double") for p in parts[:-1]])
        suffix = rounded(F.lit(0.6) + F.lit(0.4) * hit / float(len(parts) - 1))
    return F.when(name == bare, 1.0).when(name.endswith(f".{leaf}"), suffix).otherwise(F.lit(0.5))
