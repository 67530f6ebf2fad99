"""Edges: import resolution, neighbours, proximity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import config
from tessera.operators.features import first_rows


def normalized(target: Column, source_path: Column) -> Column:
    """An import target; one that starts with ./, ../ or / is taken from the source file's folder and has its dots worked off."""
    folder = F.when(source_path.contains("/"), F.regexp_replace(source_path, "/[^/]*$", "")).otherwise(F.lit(""))
    parts = F.split(F.concat(folder, F.lit("/"), F.regexp_replace(target, "^/+", "")), "/")
    step = lambda done, p: F.when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when((p == "") | (p == "."), done).otherwise(F.concat(done, F.array(p)))
    walked = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.when(target.rlike(r"^(\./|\.\./|/)"), F.array_join(walked, "/")).otherwise(target)


def suffix_owners(files: DataFrame) -> DataFrame:
    """suffix, owner: each path suffix (cut at slashes) with the shortest path that has it, ties by path."""
    parts = F.split("path", "/")
    each = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("suffix"))
    return each.groupBy("suffix").agg(F.min(F.struct(F.length("path").alias("n"), "path")).alias("o")).select("suffix", F.col("o.path").alias("owner"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Edges whose import: targets become file: refs where a candidate is a file's path suffix.

    Candidates are the target and its ever shorter suffixes, each with every ending; the first that is found wins. Duplicates stay.
    """
    path = normalized(F.substring("target_ref", 8, 1 << 30), F.substring("source_ref", 6, 1 << 30))
    parts = F.split(path, "/")
    endings = F.array(*map(F.lit, config.IMPORT_SUFFIXES))
    wanted = F.flatten(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.transform(endings, lambda x: F.concat(F.array_join(F.slice(parts, i, F.size(parts)), "/"), x))))
    pairs = imports.select("source_ref", "target_ref").distinct().select("source_ref", "target_ref", F.posexplode(wanted).alias("rank", "suffix"))
    found = pairs.join(suffix_owners(files), "suffix").groupBy("source_ref", "target_ref").agg(F.min_by("owner", "rank").alias("owner"))
    out = imports.join(found, ["source_ref", "target_ref"], "left")
    return out.select("source_ref", F.coalesce(F.concat(F.lit("file:"), "owner"), "target_ref").alias("target_ref"), "relation_type", "weight")


def endpoints(edges: DataFrame, refs: DataFrame) -> DataFrame:
    """Edges between two different members of ``refs`` (ref)."""
    own = refs.select("ref").distinct()
    inner = edges.where("source_ref <> target_ref").join(own.withColumnRenamed("ref", "source_ref"), "source_ref", "left_semi")
    return inner.join(own.withColumnRenamed("ref", "target_ref"), "target_ref", "left_semi")


def proximity(edges: DataFrame, refs: DataFrame) -> DataFrame:
    """ref, bonus: 0.05 times the weight of each edge within ``refs``, for both its ends."""
    inner = endpoints(edges, refs)
    ends = inner.select(F.explode(F.array("source_ref", "target_ref")).alias("ref"), "weight")
    return ends.groupBy("ref").agg((F.sum("weight") * config.EDGE_BONUS).alias("bonus"))


def boosted(score: Column, bonus: Column) -> Column:
    return score * (1.0 + F.least(F.coalesce(bonus, F.lit(0.0)), F.lit(config.EDGE_BONUS_CAP)))


def neighbors(edges: DataFrame, refs: DataFrame) -> DataFrame:
    """ref, neighbor, relation_type, weight: one hop either way, as two equi-joins. A self-loop counts once, as its own target."""
    own = refs.select("ref")
    out = own.join(edges, own["ref"] == edges["source_ref"]).select("ref", F.col("target_ref").alias("neighbor"), "relation_type", "weight")
    back = own.join(edges.where("source_ref <> target_ref"), F.col("ref") == F.col("target_ref")).select("ref", F.col("source_ref").alias("neighbor"), "relation_type", "weight")
    return out.unionByName(back)


def best_of(rows: DataFrame) -> DataFrame:
    """One row a ref: the highest score."""
    return first_rows(rows, ["ref"], [F.desc("score"), "kind"], 1)
