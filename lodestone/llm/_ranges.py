"""Global order without a global sort in one task: sampled splitters and exact offsets.

Keys are tuples of long columns; a size-weighted sample of keys gives quantile boundaries; rows fall into
the ranges between them; exact statistics of the ranges show which are overfull, and those are split again
by a sample of their own. Inside a range a window orders the rows, and the ranges' totals, summed on the
driver (one row for each range), make ranks and prefix sums global. There are at most MOST_RANGES ranges, beyond
which they grow: so the driver sees at most OVERSAMPLE * MOST_RANGES keys whatever the size of the table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Keys drawn for each range that is wanted.
OVERSAMPLE = 32
MOST_RANGES = 16_384


def ordered(keys: np.ndarray) -> np.ndarray:
    """The distinct rows of a matrix of keys, in the order of the tuples."""
    keys = keys[np.lexsort(keys.T[::-1])]
    new = np.r_[True, (keys[1:] != keys[:-1]).any(1)] if len(keys) else np.zeros(0, bool)
    return keys[new]


def located(boundaries: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each key how many of the ordered boundaries are at or below it."""
    both = np.concatenate([boundaries, keys])
    is_key = np.arange(len(both)) >= len(boundaries)
    order = np.lexsort((is_key, *both.T[::-1]))
    passed = np.cumsum(~is_key[order])
    out = np.empty(len(keys), np.int32)
    out[order[is_key[order]] - len(boundaries)] = passed[is_key[order]]
    return out


def matrix(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    return np.stack([frame[k].to_numpy(np.int64) for k in keys], 1)


def assigned(df: DataFrame, keys: list[str], boundaries: np.ndarray) -> DataFrame:
    """Column ``range_id``: how many boundaries are at or below the row's key."""
    bounds = df.sparkSession.sparkContext.broadcast(boundaries)

    @F.pandas_udf("int")
    def locate(columns: pd.DataFrame) -> pd.Series:
        return pd.Series(located(bounds.value, matrix(columns, keys)))

    return df.withColumn("range_id", locate(F.struct(*keys)))


def splitters(df: DataFrame, keys: list[str], weight: str, wanted: int, seed: int = 7) -> np.ndarray:
    """Boundaries for about ``wanted`` ranges of equal weight, from a size-weighted sample.

    A row is drawn with probability weight * wanted * OVERSAMPLE / total, at most 1; the draw hashes the
    key, so it is the same at each run. A row that weighs more than one draw counts that often.
    """
    total = df.agg(F.sum(weight)).first()[0] or 0
    wanted = min(wanted, MOST_RANGES)
    if wanted <= 1 or total <= 0:
        return np.zeros((0, len(keys)), np.int64)
    step = total / (wanted * OVERSAMPLE)
    draw = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) / float(1 << 40)
    drawn = df.where(F.col(weight) / F.lit(step) > draw).select(*keys, F.greatest(F.lit(1), F.round(F.col(weight) / F.lit(step))).cast("long").alias("times"))
    sample = drawn.toPandas()
    if sample.empty:
        return np.zeros((0, len(keys)), np.int64)
    drawn_keys = matrix(sample, keys)
    order = np.lexsort(drawn_keys.T[::-1])
    reached = np.cumsum(sample["times"].to_numpy()[order])
    at = order[np.unique(np.searchsorted(reached, np.arange(1, wanted) * reached[-1] / wanted))]
    cuts = drawn_keys[at]
    # The first boundary inside a group of one leading key moves to the start of the group: only a group
    # that several boundaries fall into is cut.
    lead = np.r_[True, cuts[1:, 0] != cuts[:-1, 0]] if len(cuts) else np.zeros(0, bool)
    cuts[lead, 1:] = np.iinfo(np.int64).min
    return ordered(cuts)


def ranged(df: DataFrame, keys: list[str], weight: str, wanted: int, rows_per_range: int, rounds: int = 3):
    """(df with range_id, statistics of the ranges as pandas sorted by range_id).

    Ranges of more than twice the mean weight (and more than one row) or more than ``rows_per_range`` rows
    are overfull and are subdivided, at most ``rounds`` times; rows with entirely equal keys stay together.
    """
    wanted = min(wanted, MOST_RANGES)
    boundaries = splitters(df, keys, weight, wanted)
    for again in range(rounds + 1):
        out = assigned(df, keys, boundaries)
        stats = out.groupBy("range_id").agg(F.count("*").alias("rows"), F.sum(weight).alias("weight")).toPandas().sort_values("range_id", ignore_index=True)
        if stats.empty or again == rounds:
            break
        limit = max(2 * stats["weight"].sum() / max(1, wanted), 1)
        rows_per_range = max(rows_per_range, int(2 * stats["rows"].sum() / MOST_RANGES))
        over = stats[((stats["weight"] > limit) | (stats["rows"] > rows_per_range)) & (stats["rows"] > 1)]
        if over.empty:
            break
        inside = out.where(F.col("range_id").isin([int(x) for x in over["range_id"]])) if len(over) <= 1000 else out
        parts = int(np.ceil(np.maximum(2 * over["weight"] / limit, 2 * over["rows"] / rows_per_range)).sum())
        more = splitters(inside, keys, weight, parts + 1, seed=8 + again)
        merged = ordered(np.concatenate([boundaries, more]))
        if len(merged) == len(boundaries):
            break
        boundaries = merged
    return out, stats


def with_prefix(df: DataFrame, keys: list[str], sums: dict[str, str]) -> DataFrame:
    """For each (name, column) of ``sums`` a column: the column's sum over all rows ahead in key order."""
    found = df.groupBy("range_id").agg(*(F.sum(c).alias(name) for name, c in sums.items())).toPandas().sort_values("range_id", ignore_index=True)
    ahead = {name: found[name].cumsum() - found[name] for name in sums}
    rows = [tuple(int(x) for x in row) for row in zip(found["range_id"], *ahead.values(), strict=True)]
    offsets = df.sparkSession.createDataFrame(rows, ", ".join(["range_id int", *(f"{name}_ahead long" for name in sums)]))
    running = Window.partitionBy("range_id").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    # The offsets have one row for each range, a number that ranged() bounds; they are sent to every task.
    out = df.join(F.broadcast(offsets), "range_id").withColumns({name: F.col(f"{name}_ahead") + F.coalesce(F.sum(c).over(running), F.lit(0)) for name, c in sums.items()})
    return out.drop(*(f"{name}_ahead" for name in sums))
