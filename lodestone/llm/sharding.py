"""Operator 1, sharding by sampled splitters.

Rows are ordered by a key whose first part is a hash of the text, so that equal texts lie side by side;
size-weighted key samples give quantile boundaries, records are range-partitioned between them, overfull
ranges are subdivided, and exact prefix sums over the ranges cut the order into shards of near-equal bytes.

A group of equal texts stays in one shard as long as it fits one. Groups above 1/64 of a shard's bytes, of which there can
be no more than 64 for each shard, are dealt first, the largest to the emptiest shard; the rest of the order then
fills what is left of each. Only a group of more bytes than a shard has is cut, by doc_id, so a text that makes up a
third of the table fills several shards.

Nulls: a null text is empty (8 bytes, CRC 0); a null doc_id sorts first. Repeated rows are rows of their own.
An empty table gives an empty result. Extra columns of any name stay untouched by ``shards``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import _ranges, _shared

LOWEST = -(1 << 63)
#: Groups above this part of a shard are dealt by themselves.
LARGE = 64
KEYS = ["group_key", "id_key", "row_key"]


def shards(
    docs: DataFrame,
    n_shards: int = 24,
    id_column: str = "doc_id",
    text_column: str = "text",
    rows_per_range: int = 250_000,
    ranges_per_shard: int = 4,
) -> DataFrame:
    """One row for each row of ``docs``: its id, size, text_crc32, shard and slot.

    Shards are cut where the running size passes what the shards ahead have room for; sizes differ by no more
    than 1/64 of a shard or one record on either side, unless one group alone is larger than what is fair.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_column), F.lit(""))
    base = _shared.written(
        docs.select(
            F.col(id_column).cast("long").alias("doc_id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("group_key"),
            F.coalesce(F.col(id_column).cast("long"), F.lit(LOWEST)).alias("id_key"),
            F.monotonically_increasing_id().alias("row_key"),
        ),
        "shard-base",
    )
    n_rows, total = base.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    share = total / n_shards
    groups = base.groupBy("group_key").agg(F.sum("size").alias("group_size"), F.count("*").alias("group_rows"))
    # So many bytes or rows have fewer than 2 * n_shards * 64 groups; only they may be cut, or lie in several ranges.
    is_large = (F.col("group_size") > share / LARGE) | (F.col("group_rows") > n_rows / n_shards / LARGE)
    large = groups.where(is_large).orderBy(F.desc("group_size"), "group_key").collect()
    used, rows_used, seats = [0] * n_shards, [0] * n_shards, []
    for g in large:
        if g["group_size"] > share:
            seats.append((g["group_key"], None, None))
            continue
        s = min(range(n_shards), key=lambda k: (used[k], k))
        seats.append((g["group_key"], s, rows_used[s]))
        used[s] += g["group_size"]
        rows_used[s] += g["group_rows"]
    seated = spark.createDataFrame(seats, "group_key long, seat int, seat_rows long")
    flows = F.when(F.col("seat").isNull(), 1).otherwise(0)
    base = base.join(F.broadcast(seated.withColumn("large", F.lit(True))), "group_key", "left").withColumn("large", F.coalesce("large", F.lit(False)))
    for key in ("id_key", "row_key"):
        base = base.withColumn(f"cut_{key}", F.when(F.col("large"), F.col(key)).otherwise(F.lit(0)))
    base = base.withColumn("flow", flows.cast("long")).withColumn("flow_size", flows * F.col("size")).withColumn("one", F.lit(1).cast("long"))
    wanted = max(n_shards * ranges_per_shard, -(-n_rows // (rows_per_range // 4)))
    placed, _ = _ranges.ranged(base, ["group_key", "cut_id_key", "cut_row_key"], "size", wanted, rows_per_range)
    placed = _ranges.with_prefix(placed, KEYS, {"row_rank": "one", "flow_rank": "flow", "before": "flow_size"})
    # What is left of each shard, and which of them a place in the order falls into.
    room = fair_rooms(total - sum(used), used)
    edges = [sum(room[: k + 1]) for k in range(n_shards - 1)]
    group = Window.partitionBy("range_id", "group_key")
    middle = F.when(F.col("large"), F.col("before") + F.col("size") / 2).otherwise(F.min("before").over(group) + F.sum("flow_size").over(group) / 2)

    @F.pandas_udf("int")
    def falls(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, at, "right").astype(np.int32))

    placed = placed.withColumn("middle", middle.cast("double")).withColumn("shard", F.coalesce("seat", falls("middle")))
    placed = _shared.written(placed.select("doc_id", "size", "text_crc32", "group_key", "shard", "seat", "seat_rows", "row_rank", "flow_rank"), "shard-placed")
    # Slots: what flows comes first, then the groups that were dealt, each from its own first row on.
    first = placed.where("seat IS NULL").groupBy("shard").agg(F.min("flow_rank").alias("first_rank"), F.count("*").alias("flowing"))  # n_shards rows
    group_first = placed.where("seat IS NOT NULL").groupBy("group_key").agg(F.min("row_rank").alias("group_first"))  # a row for each of ``large``
    out = placed.join(F.broadcast(first), "shard", "left").join(F.broadcast(group_first), "group_key", "left")
    slot = F.when(F.col("seat").isNull(), F.col("flow_rank") - F.col("first_rank")).otherwise(F.coalesce("flowing", F.lit(0)) + F.col("seat_rows") + F.col("row_rank") - F.col("group_first"))
    return out.select("doc_id", "size", "text_crc32", "shard", slot.cast("long").alias("slot"))


def fair_rooms(rest: int, used: list[int]) -> list[float]:
    """How much of ``rest`` each shard takes, so that all end as equal as what they hold already allows."""
    room, free = [0.0] * len(used), sorted(range(len(used)), key=lambda k: used[k])
    for n in range(len(free), 0, -1):
        level = (rest + sum(used[k] for k in free[:n])) / n
        if level >= used[free[n - 1]]:
            for k in free[:n]:
                room[k] = level - used[k]
            break
    return room


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards(_shared.documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def brute(rows: list[tuple[int | None, str | None]]) -> Iterator[tuple[int | None, int, int]]:
    """What each row's id, size and CRC must be."""
    for doc_id, text in rows:
        data = (text or "").encode()
        yield doc_id, len(data) + 8, zlib.crc32(data)



