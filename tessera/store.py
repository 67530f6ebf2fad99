"""The index of one tree: versioned parquet tables and a manifest that is replaced in one step.

A table is a list of folders, or, for tables with a path, one folder for each of BUCKETS buckets of paths, so that a refresh rewrites only the
buckets of the files that changed. New folders become visible when the manifest names them, so readers see old or new rows but never a mixture, and a failed
write leaves nothing behind that is read. Folders that are no longer named stay for KEEP further changes, for readers that hold a plan on them.
Writers take turns by a lock file; a writer that waits longer than BUSY_SECONDS gives up.
"""

from __future__ import annotations

import fcntl
import json
import os
import shutil
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import config
from tessera.schema import TABLES

BUCKETS = 32
KEEP = 3
BUSY_SECONDS = 30.0
#: Folders of an appended table beyond which it is rewritten as one.
MANY_FOLDERS = 20


def bucket_of(path: Column | str) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("int")


def columns_of(name: str, df: DataFrame) -> list[str]:
    return [c.split(" ", 1)[0] for c in TABLES[name].split(", ")] if name in TABLES else df.columns


class Tables:
    """Tables held as DataFrames, with the reading side of a store: queries over tables that are no index of a tree.

    ``postings`` gives the postings of some terms, where they are no table.
    """

    def __init__(self, spark: SparkSession, name: str, tables: dict[str, DataFrame], postings: Callable[[list[str]], DataFrame] | None = None) -> None:
        self.spark, self.tables, self.root, self.state, self.made = spark, tables, Path("/") / name, Path("/") / name / config.STATE_DIR, postings

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:  # noqa: ARG002
        return self.tables[name] if name in self.tables else self.spark.createDataFrame([], TABLES[name])

    def postings(self, words: list[str]) -> DataFrame:
        return self.made(words) if self.made else self.read("postings").where(F.col("term").isin(words))

    def meta(self, key: str) -> str | None:  # noqa: ARG002
        return None

    def cached(self, key: str) -> dict | None:  # noqa: ARG002
        return None

    def cache(self, key: str, query: str, response: dict) -> None:
        """Nothing is kept."""


class Store:
    def __init__(self, spark: SparkSession, root: str | Path) -> None:
        root = Path(root).expanduser().resolve()
        if not root.is_dir():
            raise FileNotFoundError(f"no such folder: {root}")
        self.spark, self.root, self.state, self._depth = spark, root, root / config.STATE_DIR, 0
        self.state.mkdir(exist_ok=True)

    @property
    def manifest(self) -> dict:
        try:
            return json.loads((self.state / "manifest.json").read_text())
        except (OSError, ValueError):
            return {"version": 0, "tables": {}, "meta": {}, "retired": []}

    @contextmanager
    def writing(self) -> Iterator[None]:
        """One writer at a time: what it reads within is what it changes. May be nested."""
        if self._depth:
            yield
            return
        with (self.state / "lock").open("a") as lock:
            until = time.monotonic() + BUSY_SECONDS
            while True:
                try:
                    fcntl.flock(lock, fcntl.LOCK_EX | fcntl.LOCK_NB)
                    break
                except OSError:
                    if time.monotonic() > until:
                        raise TimeoutError(f"another writer holds {self.state}") from None
                    time.sleep(0.05)
            self._depth += 1
            try:
                yield
            finally:
                self._depth -= 1
                fcntl.flock(lock, fcntl.LOCK_UN)

    def _replace(self, name: str, value: dict) -> None:
        new = self.state / f"{name}.{uuid.uuid4().hex}"
        new.write_text(json.dumps(value, indent=2, sort_keys=True))
        os.replace(new, self.state / name)

    def _change(self, change: Callable[[dict], None]) -> None:
        """Apply ``change`` to the manifest, retire the folders that it no longer names and delete those that have been retired for long."""
        with self.writing():
            now = self.manifest
            before = {f for t in now["tables"].values() for f in t.values()}
            change(now)
            now["version"] += 1
            named = {f for t in now["tables"].values() for f in t.values()}
            now["retired"] += [[now["version"], f] for f in sorted(before - named)]
            gone = [f for v, f in now["retired"] if v <= now["version"] - KEEP]
            now["retired"] = [[v, f] for v, f in now["retired"] if v > now["version"] - KEEP]
            self._replace("manifest.json", now)
            for f in gone:
                shutil.rmtree(self.state / f, ignore_errors=True)

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a table, or of some of its buckets; no rows if it hasn't been written. Columns that a table's files lack are null."""
        parts = self.manifest["tables"].get(name, {})
        folders = sorted({f for b, f in parts.items() if buckets is None or int(b) in buckets})
        if not folders:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*[str(self.state / f) for f in folders])

    def postings(self, words: list[str]) -> DataFrame:
        """The postings of some terms: row groups of other terms are not read."""
        return self.read("postings").where(F.col("term").isin(words))

    def _placed(self, name: str, df: DataFrame) -> str:
        folder = f"{name}-{uuid.uuid4().hex}"
        df.select(*columns_of(name, df)).write.parquet(str(self.state / folder))
        return folder

    def write(self, **tables: DataFrame) -> None:
        """Replace whole tables, all at once."""
        with self.writing():
            placed = {name: {"0": self._placed(name, df)} for name, df in tables.items()}
            self._change(lambda now: now["tables"].update(placed))

    def append(self, name: str, df: DataFrame) -> None:
        """Add rows to a table."""
        with self.writing():
            parts = self.manifest["tables"].get(name, {})
            if len(parts) >= MANY_FOLDERS:
                self.write(**{name: self.read(name).unionByName(df)})
                return
            folder = self._placed(name, df)
            self._change(lambda now: now["tables"].setdefault(name, {}).update({str(max(map(int, parts), default=-1) + 1): folder}))

    def replace_buckets(self, buckets: list[int], order: dict[str, str] | None = None, **tables: DataFrame) -> None:
        """Replace the rows of some buckets of tables with a path, all tables at once. ``order``: a column that a table's files are sorted by."""
        with self.writing():
            placed: dict[str, dict[str, str]] = {}
            for name, df in tables.items():
                folder = f"{name}-{uuid.uuid4().hex}"
                cols = columns_of(name, df)
                rows = df.select(*cols, bucket_of("path").alias("_b")).repartition("_b").sortWithinPartitions("_b", (order or {}).get(name, "path"))
                rows.write.partitionBy("_b").parquet(str(self.state / folder))
                placed[name] = {str(b): f"{folder}/_b={b}" for b in buckets if (self.state / folder / f"_b={b}").is_dir()}

            def change(now: dict) -> None:
                for name, parts in placed.items():
                    kept = {b: f for b, f in now["tables"].get(name, {}).items() if int(b) not in buckets}
                    now["tables"][name] = kept | parts

            self._change(change)

    @contextmanager
    def staged(self, name: str, df: DataFrame) -> Iterator[DataFrame]:
        """``df`` as a written table that is deleted after the block."""
        folder = self.state / f"staged-{name}-{uuid.uuid4().hex}"
        df.write.parquet(str(folder))
        try:
            yield self.spark.read.schema(df.schema).parquet(str(folder))
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    def meta(self, key: str) -> str | None:
        return self.manifest["meta"].get(key)

    def set_meta(self, **values: str) -> None:
        self._change(lambda now: now["meta"].update(values))

    def write_version(self, app: str, version: str) -> None:
        self._replace("version.json", {"app": app, "version": version, "repo_root": str(self.root), "last_indexed_at": self.meta("last_indexed_at")})

    # The query cache: a small JSON file, newest last.

    def cached(self, key: str) -> dict | None:
        return next((r["response"] for r in self._cache() if r["key"] == key), None)

    def cache(self, key: str, query: str, response: dict) -> None:
        with self.writing():
            rows = [r for r in self._cache() if r["key"] != key] + [{"key": key, "query": query, "response": response}]
            self._replace("cache.json", {"rows": rows[-config.CACHE_ROWS :]})

    def clear_cache(self) -> None:
        (self.state / "cache.json").unlink(missing_ok=True)

    def _cache(self) -> list[dict]:
        try:
            return json.loads((self.state / "cache.json").read_text())["rows"]
        except (OSError, ValueError):
            return []
