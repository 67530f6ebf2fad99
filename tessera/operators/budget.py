"""Fitting ranked rows into a token budget. Rows are few by then (hits of one query), so a fold over one array is in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefix_that_fits(rows: DataFrame, budget: int, order: list, cost: str = "cost", used: int = 0) -> DataFrame:
    """Rows up to the first that doesn't fit. Costs aren't negative, so a running sum decides."""
    total = F.sum(cost).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_sum", total).where(F.col("_sum") + used <= budget).drop("_sum")


def greedy_skip(rows: DataFrame, budget: int, rank: str = "rank", cost: str = "cost") -> DataFrame:
    """``rows`` with kept: in order of rank, each row that still fits is kept and the others are passed over."""
    items = F.array_sort(F.collect_list(F.struct(F.col(rank).cast("long").alias("rank"), F.col(cost).cast("long").alias("cost"))))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("kept"))
    step = lambda s, x: F.when(s["used"] + x["cost"] <= budget, F.struct((s["used"] + x["cost"]).alias("used"), F.concat(s["kept"], F.array(x["rank"])).alias("kept"))).otherwise(s)
    state = rows.agg(F.aggregate(items, zero, step).alias("s"))
    kept = state.select(F.explode("s.kept").alias("_kept"))
    return rows.join(F.broadcast(kept), rows[rank].cast("long") == kept["_kept"], "left").withColumn("kept", F.col("_kept").isNotNull()).drop("_kept")


def nested_break(results: DataFrame, budget: int, used: int) -> DataFrame:
    """One row: used, kept. ``results`` has rank, cost (of the summary) and chunks (array of costs).

    In order of rank a result is taken if its summary fits, else all is over; its chunks follow until one doesn't fit; a full budget ends it.
    kept: array of (rank, number of its chunks).
    """
    items = F.array_sort(F.collect_list(F.struct(F.col("rank").cast("long").alias("rank"), F.col("cost").cast("long").alias("cost"), F.col("chunks").cast("array<bigint>").alias("chunks"))))
    zero = F.struct(F.lit(used).cast("long").alias("used"), F.lit(False).alias("done"), F.array().cast("array<struct<rank:bigint,n:bigint>>").alias("kept"))

    def chunks(start, costs):  # noqa: ANN001, ANN202
        first = F.struct(start.alias("used"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("done"))
        return F.aggregate(costs, first, lambda s, c: F.when(s["done"] | (s["used"] + c > budget), F.struct(s["used"].alias("used"), s["n"].alias("n"), F.lit(True).alias("done"))).otherwise(F.struct((s["used"] + c).alias("used"), (s["n"] + 1).alias("n"), F.lit(False).alias("done"))))

    def step(s, x):  # noqa: ANN001, ANN202
        after = chunks(s["used"] + x["cost"], x["chunks"])
        taken = F.struct(after["used"].alias("used"), (after["used"] >= budget).alias("done"), F.concat(s["kept"], F.array(F.struct(x["rank"].alias("rank"), after["n"].alias("n")))).alias("kept"))
        over = F.struct(s["used"].alias("used"), F.lit(True).alias("done"), s["kept"].alias("kept"))
        return F.when(s["done"], s).when(s["used"] + x["cost"] > budget, over).otherwise(taken)

    return results.agg(F.aggregate(items, zero, step).alias("s")).select("s.used", "s.kept")
