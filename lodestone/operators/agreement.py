"""Comparing engines and runs: agreement of first pages, nearest-rank percentiles, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def agreement(left: DataFrame, right: DataFrame) -> DataFrame:
    """For each query of two ranked lists (query, pos, id): shared ids and ids at the same place."""
    a, b = left.select("query", "id", "pos"), right.select("query", "id", F.col("pos").alias("other"))
    shared = a.join(b, ["query", "id"], "left").groupBy("query").agg(F.count("other").alias("shared"), F.sum((F.col("pos") == F.col("other")).cast("int")).alias("same"))
    return shared.select("query", "shared", F.coalesce("same", F.lit(0)).cast("long").alias("same_place"))


def percentiles(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Median and 95th percentile by nearest rank, minimum and maximum of ``ms``."""
    return runs.groupBy(*keys).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY ms)").alias("median"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY ms)").alias("p95"), F.min("ms").alias("least"), F.max("ms").alias("most"))


def nearest_rank(values: list[float], p: float) -> float:
    import math

    return sorted(values)[max(0, math.ceil(p * len(values)) - 1)]


def totals(medians: DataFrame) -> DataFrame:
    """Sum of medians for each engine, mean for each scenario, and the ratio to the first engine (by name)."""
    total = medians.groupBy("engine").agg(F.sum("median").alias("total"), F.avg("median").alias("mean"))
    first = total.agg(F.min_by("total", "engine").alias("first"))
    return total.join(F.broadcast(first)).select("engine", "total", "mean", (F.col("total") / F.col("first")).alias("ratio"))  # one row
