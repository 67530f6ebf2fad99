"""Dense vectors: cosine scores in the JVM, and a pluggable encoder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranking import normalized

#: texts -> unit vectors; None without an encoder, and then all semantic terms are 0.
Encoder = Callable[[list[str]], list[list[float]]]


def dot(vector: Column, query: list[float]) -> Column:
    pairs = F.zip_with(vector.cast("array<double>"), F.array(*(F.lit(float(x)) for x in query)), lambda a, b: a * b)
    return F.aggregate(pairs, F.lit(0.0), lambda total, x: total + x)


def cosine_scores(embeddings: DataFrame, query: list[float], vector: str = "vector", name: str = "semantic") -> DataFrame:
    """Rows with a positive score, divided by the largest. Vectors are of length 1."""
    scored = embeddings.withColumn(name, dot(F.col(vector), query)).where(F.col(name) > 0)
    return normalized(scored, name)


def delta(candidates: DataFrame, stored: DataFrame, model: str) -> DataFrame:
    """Candidates (ref, text) whose vector is missing or of another text or model."""
    c = candidates.withColumn("content_hash", F.sha2("text", 256))
    return c.join(stored.where(F.col("model") == model).select("ref", "content_hash"), ["ref", "content_hash"], "left_anti")


def pruned(stored: DataFrame, candidates: DataFrame) -> DataFrame:
    return stored.join(candidates.select("ref"), "ref", "left_semi")
