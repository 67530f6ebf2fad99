"""Notes and session logs as memory records."""

from __future__ import annotations

import json
import sys
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import config

CONTENT = "array<struct<type:string,text:string,input:struct<file_path:string,path:string,notebook_path:string,command:string>,content:string>>"
EVENT = "sessionId string, session_id string, timestamp string, type string, message string"
#: A path with an ending, after a space, a quote or the start.
PATH = r"""(?:^|[\s'"])(\.{0,2}/[\w./_\-]+\.[A-Za-z0-9]+)"""


def source_text(source: str) -> str:
    if source == "-":
        return sys.stdin.read()
    path = Path(source).expanduser()
    if not path.exists():
        raise FileNotFoundError(f"no such source: {source}")
    return path.read_text(encoding="utf-8")


def json_records(spark: SparkSession, text: str) -> DataFrame:
    """title, summary, evidence_refs of an object or an array of objects; other items are dropped."""
    try:
        data = json.loads(text)
    except ValueError as e:
        raise ValueError(f"not JSON: {e}") from e
    if not isinstance(data, dict | list):
        raise ValueError("expected an object or an array of objects")
    rows = [x for x in ([data] if isinstance(data, dict) else data) if isinstance(x, dict)]
    said = lambda x, k: x[k] if isinstance(x.get(k), str) else None
    refs = lambda x: [r for r in (x.get("evidence_refs") or []) if isinstance(r, str) and r] if isinstance(x.get("evidence_refs") or [], list) else []
    return spark.createDataFrame([(i, said(x, "title"), said(x, "summary"), refs(x)) for i, x in enumerate(rows)], "ord long, title string, summary string, evidence_refs array<string>")


def log_lines(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(i, x.strip()) for i, x in enumerate(text.split("\n")) if x.strip()], "ord long, line string")


def clean_path(p: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(p), r"""^['"]+|['"]+$""", ""), r"^\./", "")


def paths_in(text: Column) -> Column:
    return F.transform(F.filter(F.regexp_extract_all(text, F.lit(PATH), F.lit(1)), lambda p: ~p.contains("://")), clean_path)


def sessions(lines: DataFrame, default: str) -> tuple[DataFrame, DataFrame]:
    """(records, skipped) of log lines (ord, line): a record a session, in order of its first line."""
    kind = F.when(F.try_parse_json("line").isNull(), "bad").when(F.trim("line").startswith("{"), "event").otherwise("other")
    known = lines.withColumn("kind", kind)
    skipped = known.where("kind = 'bad'").select("ord", F.lit("invalid_jsonl_line").alias("reason"), F.col("line").alias("context"))
    e = known.where("kind = 'event'").select("ord", F.from_json("line", EVENT).alias("e")).select("ord", "e.*")
    # A message's content is a string or an array of parts: parsed both ways.
    raw = F.get_json_object("message", "$.content")
    listed = F.when(F.trim(raw).startswith("["), F.from_json(raw, CONTENT))
    e = e.select("ord", F.coalesce(F.nullif("sessionId", F.lit("")), F.nullif("session_id", F.lit("")), F.lit(default)).alias("sid"), F.nullif("timestamp", F.lit("")).alias("ts"), "type", raw.alias("raw"), listed.alias("parts"))
    first = F.get(F.filter("parts", lambda p: (p["type"] == "text") & p["text"].isNotNull()), F.lit(0))["text"]
    user = F.when(F.col("type") == "user", F.coalesce(first, F.when(F.col("parts").isNull(), F.col("raw"))))
    assistant = F.when(F.col("type") == "assistant", first)
    used = F.filter("parts", lambda p: p["type"] == "tool_use")
    named = F.flatten(F.transform(used, lambda p: F.transform(F.filter(F.array(p["input"]["file_path"], p["input"]["path"], p["input"]["notebook_path"]), lambda x: F.coalesce(x, F.lit("")) != ""), clean_path)))
    run = F.flatten(F.transform(used, lambda p: paths_in(F.coalesce(p["input"]["command"], F.lit("")))))
    told = F.flatten(F.transform(F.filter("parts", lambda p: p["type"] == "tool_result"), lambda p: paths_in(F.coalesce(p["content"], F.lit("")))))
    none = F.array().cast("array<string>")
    e = e.select("ord", "sid", "ts", user.alias("user"), assistant.alias("assistant"), F.concat(F.coalesce(named, none), F.coalesce(run, none), F.coalesce(told, none)).alias("files"))
    g = e.groupBy("sid").agg(
        F.min("ord").alias("ord"), F.min("ts").alias("early"), F.max("ts").alias("late"),
        F.min_by("user", F.when(F.col("user").isNotNull(), F.col("ord"))).alias("user"),
        F.min_by("assistant", F.when(F.col("assistant").isNotNull(), F.col("ord"))).alias("assistant"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("files")))).alias("files"),
    ).where("size(files) > 0 OR coalesce(user, '') <> ''")
    return g.select("ord", *record()), skipped


def record() -> list[Column]:
    """title, summary, evidence_refs of a session row."""
    user, assistant = F.trim(F.coalesce("user", F.lit(""))), F.trim(F.coalesce("assistant", F.lit("")))
    hint = F.when(user != "", F.substring(F.get(F.split(user, "\r\n|\n|\r"), F.lit(0)), 1, 80)).otherwise(F.concat(F.lit("Session "), F.substring("sid", 1, 8)))
    head = F.when(F.col("early").isNotNull(), F.substring("early", 1, 10)).otherwise(F.substring("sid", 1, 8))
    n, most = F.size("files"), config.CAPTURE_FILES
    touched = F.when(n == 0, F.lit("no files touched")).otherwise(F.concat(F.array_join(F.slice("files", 1, most), ", "), F.when(n > most, F.concat(F.lit(" (+"), (n - most).cast("string"), F.lit(" more)"))).otherwise(F.lit(""))))
    summary = F.concat_ws(
        "\n", F.concat(F.lit("Session id: "), "sid"), F.concat(F.lit("Time range: "), F.coalesce("early", F.lit("unknown")), F.lit(" → "), F.coalesce("late", F.lit("unknown"))), F.concat(F.lit("Touched: "), touched),
        F.when(user != "", F.concat(F.lit("User: "), F.substring(user, 1, 240))), F.when(assistant != "", F.concat(F.lit("Assistant: "), F.substring(assistant, 1, 240))),
    )
    return [F.concat(F.lit("Session "), head, F.lit(": "), hint).alias("title"), summary.alias("summary"), F.transform("files", lambda f: F.concat(F.lit("file:"), f)).alias("evidence_refs")]


def validated(records: DataFrame, known_titles: DataFrame | None) -> DataFrame:
    """Records with reason: null for those to be written. With ``known_titles``, only the first record of a new title is."""
    from pyspark.sql import Window

    r = records.select("ord", F.trim(F.coalesce("title", F.lit(""))).alias("title"), F.trim(F.coalesce("summary", F.lit(""))).alias("summary"), "evidence_refs")
    r = r.withColumn("reason", F.when(F.col("title") == "", "missing_title").when(F.col("summary") == "", "missing_summary"))
    if known_titles is not None:
        seen = known_titles.select("title", F.lit(True).alias("known")).distinct()
        first = F.min(F.when(F.col("reason").isNull(), F.col("ord"))).over(Window.partitionBy("title"))
        r = r.withColumn("first", first).join(seen, "title", "left")
        r = r.withColumn("reason", F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("known") | (F.col("ord") > F.col("first")), "duplicate_title")).drop("first", "known")
    return r.withColumn("summary", F.substring("summary", 1, config.CAPTURE_SUMMARY_CHARS)).select("ord", "title", "summary", "evidence_refs", "reason")
