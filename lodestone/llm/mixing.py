"""Operator 2, mixing sources to target weights by systematic sampling.

Every document of a source expects target / size-of-source copies. Documents stand in order of their size
(ties by a hash of the id), expected copies are summed along that order, one random offset for each source
is added, and a document is emitted once for each integer boundary its stretch crosses. The order by size
makes the words taken differ from the target by about the largest document at most.

Nulls: a null text has no words; a null source is a source of its own that sorts last; a null doc_id is
ordered first. Repeated rows count as rows of their own. A source without words has target 0. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import _ranges, _shared, _words

LOWEST = -(1 << 63)
WEIGHTS = (5, 2, 1)
#: Most sources of a mix, which the driver holds and every task gets.
MOST_SOURCES = 100_000
KEYS = ["source_key", "size", "tie", "row_key"]


def targets(sizes: list[int], weights: list[float], budget: float, cap: float = 3.0) -> list[float]:
    """Shares of the budget by weight; what exceeds cap * size is reshared among the others by weight."""
    out = [0.0] * len(sizes)
    free = [i for i, s in enumerate(sizes) if s > 0]
    left = float(budget)
    while free:
        unit = left / sum(weights[i] for i in free)
        full = [i for i in free if unit * weights[i] > cap * sizes[i]]
        for i in full or free:
            out[i] = cap * sizes[i] if full else unit * weights[i]
        if not full:
            break
        left -= sum(out[i] for i in full)
        free = [i for i in free if i not in set(full)]
    return out


def offset(source: str | None, seed: str = "mix") -> float:
    """The source's random offset in [0, 1): 48 bits of an MD5."""
    return int(hashlib.md5(f"{seed}:{'' if source is None else 's' + source}".encode()).hexdigest()[:12], 16) / float(1 << 48)


def word_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and ``size``, the number of words of ``text``."""
    names = list(dict.fromkeys([*keep, "text"]))
    schema = docs.select(*keep).withColumn("size", F.lit(0).cast("long")).schema

    def count(batches):
        for chunk in _words.chunks(batches):
            starts, _ = _words.spans(chunk.buffer, _words.SPACES)
            sizes = np.diff(np.searchsorted(starts, chunk.offsets))
            yield pa.RecordBatch.from_arrays([*(chunk.column(k) for k in keep), pa.array(sizes, pa.int64())], names=[*keep, "size"])

    return docs.select(*names).mapInArrow(count, schema)


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = 3.0, rows_per_range: int = 250_000, with_text_key: bool = False) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, copies, and text_key if asked.

    The sources and their sizes are the only thing collected: one row for each source. Weights go by the sources'
    order, so a mix is a choice among named sources; more than MOST_SOURCES (hosts, say) are refused.
    """
    spark = docs.sparkSession
    more = ["text_key"] if with_text_key else []
    text_key = F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")
    sized = word_counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text", *([text_key] if more else [])), ["doc_id", "source", *more])
    base = _shared.written(sized.withColumn("row_key", F.monotonically_increasing_id()), "mix-base")
    by_source = base.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("rows")).limit(MOST_SOURCES + 1).collect()
    if len(by_source) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: group them first")
    by_source.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["words"] for r in by_source]
    goals = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], sum(sizes), cap)
    rows, ahead = [], 0
    for i, (r, goal) in enumerate(zip(by_source, goals, strict=True)):
        rows.append((r["source"], i, r["words"], float(goal), goal / r["words"] if r["words"] else 0.0, offset(r["source"]), ahead))
        ahead += r["rows"]
    plan = spark.createDataFrame(rows, "source_name string, source_key long, source_size long, target double, rate double, shift double, rows_before long")
    # MOST_SOURCES rows at most.
    keyed = base.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("source_name"))).drop("source_name")
    tie = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    keyed = keyed.withColumn("tie", tie).withColumn("one", F.lit(1).cast("long"))
    wanted = max(16, -(-ahead // (rows_per_range // 4)))
    placed, _ = _ranges.ranged(keyed, KEYS, "one", wanted, rows_per_range)
    placed = _ranges.with_prefix(placed, KEYS, {"row_rank": "one"})
    rank = F.col("row_rank") - F.col("rows_before")
    copies = F.floor((rank + 1) * F.col("rate") + F.col("shift")) - F.floor(rank * F.col("rate") + F.col("shift"))
    return placed.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), *more)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(_shared.documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


#: Resharing settles after as many steps as there are sources at most; the recursion holds the set of full ones.
ORACLE = """
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE length(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END AS size
  FROM documents),
by_source AS (
  SELECT source, sum(size)::DOUBLE AS words,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source),
steps AS (
  SELECT 0 AS step, source, words, weight, words = 0 AS is_full FROM by_source
  UNION ALL
  SELECT step + 1, source, words, weight,
         is_full OR weight * (sum(words) OVER () - sum(CASE WHEN is_full THEN 3 * words ELSE 0 END) OVER ())
                    / nullif(sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER (), 0) > 3 * words
  FROM steps WHERE step < (SELECT count(*) FROM by_source)),
last_step AS (SELECT * FROM steps WHERE step = (SELECT max(step) FROM steps)),
goals AS (
  SELECT source, words,
         CASE WHEN is_full THEN 3 * words
              ELSE weight * (sum(words) OVER () - sum(CASE WHEN is_full THEN 3 * words ELSE 0 END) OVER ())
                   / sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () END AS target,
         ('0x' || substr(md5('mix:' || coalesce('s' || source, '')), 1, 12))::BIGINT / 281474976710656.0 AS shift
  FROM last_step),
ranked AS (
  SELECT d.doc_id, d.size, g.words, g.target, g.shift, CASE WHEN g.words > 0 THEN g.target / g.words ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 15)) - 1 AS i
  FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size::BIGINT AS size, words::BIGINT AS source_size, target::DOUBLE AS target,
       (size * (floor((i + 1) * rate + shift) - floor(i * rate + shift)))::BIGINT AS taken
FROM ranked
"""
