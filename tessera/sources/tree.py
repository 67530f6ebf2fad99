"""Files of a source tree as rows."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import config
from tessera.functions import paths
from tessera.operators.features import admitted


def listed(root: Path, policy: config.Policy) -> Iterator[str]:
    """Relative paths of the files that the rules let in. Excluded folders are not entered; overrides lift the other rules."""
    import re

    forced = [re.compile(paths.glob_to_regex(g)) for g in policy.include_overrides]
    for folder, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in config.EXCLUDED_DIRS)
        inside = Path(folder).relative_to(root).parts
        for name in sorted(names):
            if name.startswith(".") and name not in config.ROLE_HINTS:
                continue
            path = "/".join((*inside, name))
            kept = not set(inside) & set(policy.extra_excludes) and Path(name).suffix.lower() not in config.EXCLUDED_SUFFIXES
            if kept or any(r.search(path) for r in forced):
                yield path


def read_files(spark: SparkSession, root: Path, names: list[str]) -> DataFrame:
    """(path, text) of the given files that are text; those that are gone are left out."""
    there = [n for n in names if (root / n).is_file()]
    if not there:
        return spark.createDataFrame([], "path string, text string")
    # Relative names are cut from the URI that the reader reports.
    full = spark.read.format("binaryFile").load([str(root / n).replace("{", "\\{").replace("[", "\\[").replace("*", "\\*").replace("?", "\\?") for n in there])
    prefix = len(root.as_uri().replace("file://", "file:")) + 1
    name = F.try_url_decode(F.replace(F.substring(F.col("path"), prefix + 1, 1 << 30), F.lit("+"), F.lit("%2B")))
    return admitted(full.select(name.alias("path"), F.col("length").alias("size"), "content"))


def scan(spark: SparkSession, root: str | Path, policy: config.Policy | None = None) -> DataFrame:
    root = Path(root).resolve()
    return read_files(spark, root, list(listed(root, policy or config.Policy())))


def scan_lake(spark: SparkSession, uri: str, policy: config.Policy | None = None) -> DataFrame:
    """The same rules for a tree in any store that Spark reads; the listing itself is distributed."""
    policy = policy or config.Policy()
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(uri)
    base = uri.rstrip("/") + "/"
    rel = F.substring_index(F.col("path"), F.lit(base.split("://", 1)[-1].lstrip("/")), -1)
    f = raw.select(rel.alias("path"), F.col("length").alias("size"), "content")
    dirs = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    among = lambda names: F.arrays_overlap(dirs, F.array(*map(F.lit, names)).cast("array<string>"))
    name = paths.name_of("path")
    kept = ~among(list(policy.extra_excludes)) & ~paths.suffix_of("path").isin(config.EXCLUDED_SUFFIXES)
    for g in policy.include_overrides:
        kept = kept | paths.matches_glob("path", g)
    return admitted(f.where(~among(config.EXCLUDED_DIRS) & (~name.startswith(".") | name.isin(list(config.ROLE_HINTS))) & kept))
