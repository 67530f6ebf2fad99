"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Every stage takes null texts as empty, keeps rows of null doc_id by the same rules as others, treats each row of a repeated doc_id or text by itself
where its docstring says nothing else, gives no rows for an empty table, and carries columns of any name along, also those that are named like columns its
operator makes. Very long texts are worked through whole. Ties are decided as each docstring says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import drop, materialize, table
from tessera.llm.decontamination import drop_contaminated
from tessera.llm.minhash import keep_one
from tessera.llm.mixing import mix
from tessera.llm.quality import keep_good
from tessera.llm.sharding import shard_documents

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more; the classifier is fitted on the labelled ones among ``docs``. A score of exactly 0.7 stays; repeated rows score alike; without labels nothing tells good from bad, every score is 0.5 and no document stays."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least id, of those the least text hash. Rows without an id stand behind those with one; a text that is no near copy of another always stays, and of wholly equal rows one does."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item. Repeated rows share their fate; without a benchmark all stay."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents thinned to the target weights. No rate is above 1, so none comes twice and clean documents keep theirs; the draw of a row goes by doc_id and text, so equal rows share it. Without labels all rates are 1."""
    return mix(docs, table(spark, sf_dir, "labels"), most=1.0)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document goes: doc_id, lang, source, size, checksum, shard and slot. Rows of null doc_id share a shard; ties within a slot bucket go by size and checksum."""
    return shard_documents(docs, keep=tuple(c for c in ("lang", "source") if c in docs.columns))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: A trained classifier and hashed signatures decide; SQL can't express these stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage before it is written to the shared folder and read again, and deleted once the next is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop(before)
        before = docs
    for _, stage in STAGES[-1:]:
        docs = stage(spark, docs, sf_dir)
    return docs
