"""Operator 13, hard-negative mining by block matrix multiplication in two dimensions.

Rows are packed, in the order of their labels, into blocks of ``width`` rows, anchors into blocks of ``height``; both are
cut into chunks of ``chunk`` dimensions. An anchor block and a row block of one chunk meet in a task of their own,
which multiplies them to a partial tile of int64 scores; the partial tiles of one pair of blocks are shuffled
together and added, and the finished tile is reduced to the best few of each anchor at once. So no task holds more than a
tile for each chunk, whatever the number of rows, anchors or rows of one label.

Positives need only tiles in which a label stands on both sides, negatives only tiles with different ones: a
first pass finds each anchor's positives, the second takes their score windows along with the anchor blocks. Best-of-anchor rows
of all tiles meet in a window that Spark limits ahead of its shuffle, so it too gets a few rows of each task.

Every anchor is compared with every row, as the query set asks; work and shuffled tiles grow with anchors x rows.

Rows with a null label, a null vector, or a null, infinite or NaN component take no part. Scaled components are held
to +-2^28, so that a score of up to 64 dimensions fits a long (a component would have to be beyond a million). A shorter vector
counts as filled up with zeros; an empty one scores 0. A null vec_id is no anchor and divisible by nothing, comes after all ids
in ties and is returned as null. Rows that share a vec_id are rows of their own, as anchors too; equal scores and
ids go by label and vector, so what is returned doesn't depend on files. An empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import _shared

#: Stands for a null vec_id: after all others.
LAST = (1 << 63) - 1
MOST = 1 << 28


def prepared(vectors: DataFrame) -> DataFrame:
    """id_key, label, vector (array of long) and row (a number of its own) of the rows that take part, written."""
    x = F.col("embedding").cast("array<double>")
    fit = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    scaled = F.transform(x, lambda v: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), v * 256))).cast("long"))
    label = F.col("label").cast("long")
    seventh = F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False))
    kept = vectors.where(fit).select(F.coalesce(F.col("vec_id").cast("long"), F.lit(LAST)).alias("id_key"), F.when(seventh, (label + 1) % 10).otherwise(label).alias("label"), scaled.alias("vector"))
    # Equal ids are told apart by a hash of the content; the number only makes repeated rows different.
    return _shared.written(kept.withColumn("row", F.monotonically_increasing_id()).withColumn("tie", F.xxhash64("label", "vector")), "vectors")


def _packed(numbers) -> bytes:
    return np.ascontiguousarray(numbers, np.int64).tobytes()


def _open(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.int64)


BLOCK = "block long, part int, low long, high long, heads binary, cells binary, dims int, windows binary"


def blocks(rows: DataFrame, size: int, chunk: int) -> DataFrame:
    """A row for each block and chunk: labels from low to high, heads (row, id_key, label, tie of each row) and cells.

    A block ends early at a new label if it is at least a quarter full, so most hold one label.
    """
    windows = "windows" in rows.columns
    ordered = rows.repartitionByRange("label", "row").sortWithinPartitions("label", "row")

    def pack(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        heads: list[tuple] = []
        vectors: list[list[int]] = []
        more: list[list[int]] = []

        def full():
            nonlocal number
            width = max([1, *map(len, vectors)])
            matrix = np.zeros((len(vectors), width), np.int64)
            for r, v in enumerate(vectors):
                matrix[r, : len(v)] = v
            out = {name: [] for name in ("block", "part", "low", "high", "heads", "cells", "dims", "windows")}
            for part in range(-(-width // chunk)):
                cells = matrix[:, part * chunk : (part + 1) * chunk]
                first = part == 0
                values = (number, part, heads[0][2], heads[-1][2], _packed(heads) if first else None, _packed(cells), cells.shape[1], _packed(np.concatenate([[len(w) // 2, *w] for w in more])) if first and windows else None)
                for name, value in zip(out, values, strict=True):
                    out[name].append(value)
            number += 1
            heads.clear(), vectors.clear(), more.clear()
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

        for batch in batches:
            table = [batch.column(name).to_pylist() for name in ("row", "id_key", "label", "tie", "vector")]
            extra = batch.column("windows").to_pylist() if windows else [[]] * batch.num_rows
            for row, id_key, label, tie, vector, window in zip(*table, extra, strict=True):
                if len(heads) >= size or (heads and heads[-1][2] != label and len(heads) * 4 >= size):
                    yield full()
                heads.append((row, id_key, label, tie))
                vectors.append(vector)
                more.append(window)
        if heads:
            yield full()

    return ordered.mapInArrow(pack, BLOCK)


TILE = "anchors long, others long, part int, scores binary, heads binary, others_heads binary, windows binary"


def tiles(anchors: DataFrame, rows: DataFrame, meets) -> DataFrame:
    """Partial tiles of all chunks of the pairs of blocks for which ``meets(anchors, rows)`` holds."""
    marks = ["block", "low", "high"]
    left, right = anchors.where("part = 0").select(*[F.col(c).alias(f"a_{c}") for c in marks]), rows.where("part = 0").select(*[F.col(c).alias(f"b_{c}") for c in marks])
    # Only numbers of blocks: 24 bytes for each tile, against its megabyte of scores.
    pairs = _shared.written(left.join(right, meets).select(F.col("a_block").alias("anchors"), F.col("b_block").alias("others")), "tile-pairs")
    keys = ["anchors", "others", "part"]
    a = pairs.join(anchors.select(F.col("block").alias("anchors"), "part", "cells", "dims", "heads", "windows"), "anchors").groupBy(*keys)
    # Under other names of the same columns, else Spark can't tell the two sides of the cogroup apart.
    b = pairs.select(*[F.col(c).alias(c) for c in pairs.columns]).join(rows.select(F.col("block").alias("others"), "part", "cells", "dims", "heads"), "others").groupBy(*keys)

    def multiply(key, a: pa.Table, b: pa.Table) -> pa.Table:
        # A chunk that only one side has belongs to longer vectors than the other's: it adds nothing.
        if not (a.num_rows and b.num_rows):
            return pa.Table.from_pylist([], pa.schema([(n, pa.int64()) for n in ("anchors", "others")] + [("part", pa.int32())] + [(n, pa.binary()) for n in ("scores", "heads", "others_heads", "windows")]))
        x, y = (_open(t["cells"][0].as_py()).reshape(-1, t["dims"][0].as_py()) for t in (a, b))
        width = min(x.shape[1], y.shape[1])
        x, y = x[:, :width], y[:, :width]
        largest = int(np.abs(x).max(initial=0)) * int(np.abs(y).max(initial=0)) * max(1, width)
        # Products of floats are exact below 2^53, and many times as fast.
        scores = (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64) if largest < 1 << 53 else x @ y.T
        columns = [a["anchors"], a["others"], a["part"], pa.array([scores.tobytes()], pa.binary()), a["heads"], b["heads"], a["windows"]]
        return pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=["anchors", "others", "part", "scores", "heads", "others_heads", "windows"])

    return a.cogroup(b).applyInArrow(multiply, TILE)


def _added(tile: pa.Table):
    """Scores, and the heads of both sides, of the partial tiles of a pair of blocks."""
    first = next(i for i, h in enumerate(tile["heads"]) if h.is_valid)
    anchors, others = (_open(tile[c][first].as_py()).reshape(-1, 4) for c in ("heads", "others_heads"))
    scores = np.zeros((len(anchors), len(others)), np.int64)
    for partial in tile["scores"]:
        scores += np.frombuffer(partial.as_buffer(), np.int64).reshape(scores.shape)
    windows = tile["windows"][first].as_py()
    return scores, anchors, others, None if windows is None else _open(windows)


def best(scores: np.ndarray, others: np.ndarray, fit: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of ``fit`` by falling score, then id, content and row."""
    at = np.flatnonzero(fit)
    if len(at) > k:
        # The k-th best score, and all that equal it.
        least = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= least]
    return at[np.lexsort((others[at, 0], others[at, 3], others[at, 1], -scores[at]))[:k]]


def first_of(df: DataFrame, keys: list[str], k: int, order: list[Column], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


ORDER = ("score", "id_key", "tie", "row")


def _order() -> list[Column]:
    return [F.col("score").desc(), F.col("id_key"), F.col("tie"), F.col("row")]


def positives(anchors: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The k best other rows of each anchor's label: anchor, anchor_key, place (from 1), id_key, score."""

    def reduce(tile: pa.Table) -> pa.Table:
        scores, a, b, _ = _added(tile)
        found = []
        for r in range(len(a)):
            at = best(scores[r], b, (b[:, 2] == a[r, 2]) & (b[:, 0] != a[r, 0]), k)
            found.append(np.column_stack([np.full((len(at), 2), a[r, :2]), scores[r, at], b[at, 1], b[at, 3], b[at, 0]]))
        columns = np.concatenate(found).T if found else np.zeros((6, 0), np.int64)
        return pa.Table.from_arrays([pa.array(c) for c in columns], names=["anchor", "anchor_key", *ORDER])

    some = tiles(anchors, rows, (F.col("a_low") <= F.col("b_high")) & (F.col("b_low") <= F.col("a_high")))
    found = some.groupBy("anchors", "others").applyInArrow(reduce, "anchor long, anchor_key long, score long, id_key long, tie long, row long")
    return first_of(found, ["anchor"], k, _order(), "place")


def negatives(anchors: DataFrame, rows: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """The k best rows of other labels in each positive's window of scores."""

    def reduce(tile: pa.Table) -> pa.Table:
        scores, a, b, windows = _added(tile)
        found, at = [], 0
        for r in range(len(a)):
            n, at = int(windows[at]), at + 1
            other = b[:, 2] != a[r, 2]
            for p in range(at, at + 2 * n, 2):
                place, positive = int(windows[p]), int(windows[p + 1])
                # In whole numbers: low * positive <= 100 * score <= high * positive.
                fit = other & (scores[r] >= -(-low * positive // 100)) & (scores[r] <= high * positive // 100)
                some = best(scores[r], b, fit, k)
                found.append(np.column_stack([np.full((len(some), 2), (a[r, 0], place)), scores[r, some], b[some, 1], b[some, 3], b[some, 0]]))
            at += 2 * n
        columns = np.concatenate(found).T if found else np.zeros((6, 0), np.int64)
        return pa.Table.from_arrays([pa.array(c) for c in columns], names=["anchor", "place", *ORDER])

    some = tiles(anchors, rows, ~((F.col("a_low") == F.col("a_high")) & (F.col("b_low") == F.col("b_high")) & (F.col("a_low") == F.col("b_low"))))
    found = some.groupBy("anchors", "others").applyInArrow(reduce, "anchor long, place long, score long, id_key long, tie long, row long")
    return first_of(found, ["anchor", "place"], k, _order(), "rank")


def mined(vectors: DataFrame, every: int = 100, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, height: int = 128, width: int = 1024, chunk: int = 32) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by ``every``; a negative's score lies between ``low`` and ``high``
    hundredths of the positive's.
    """
    rows = prepared(vectors)
    chosen = rows.where((F.col("id_key") != LAST) & (F.col("id_key") % every == 0))
    row_blocks = _shared.written(blocks(rows, width, chunk), "row-blocks")
    anchor_blocks = _shared.written(blocks(chosen, height, chunk), "anchor-blocks")
    pairs = _shared.written(positives(anchor_blocks, row_blocks, n_positives), "positives")
    # At most n_positives places an anchor.
    windows = pairs.groupBy("anchor").agg(F.flatten(F.array_sort(F.collect_list(F.array(F.col("place").cast("long"), "score")))).alias("windows"))
    with_windows = chosen.join(windows.withColumnRenamed("anchor", "row"), "row")
    found = negatives(_shared.written(blocks(with_windows, height, chunk), "anchor-windows"), row_blocks, n_negatives, low, high)
    whole = pairs.select("anchor", "place", F.col("anchor_key").alias("anchor_id"), F.col("id_key").alias("positive_key"), F.col("score").alias("positive_score"))
    id_of = lambda c: F.when(F.col(c) != LAST, F.col(c))
    out = found.join(whole, ["anchor", "place"])
    return out.select("anchor_id", id_of("positive_key").alias("positive_id"), F.col("rank").cast("int").alias("rank"), id_of("id_key").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, a.vec_id = b.vec_id AS self, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same AND NOT self
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id))::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
