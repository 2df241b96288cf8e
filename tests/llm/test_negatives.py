"""Operator 13 against all scores."""

import random

import numpy as np
import pytest

from lodestone.llm import negatives

LAYOUT = "vec_id long, embedding array<float>, label int, anchors long, score long, part int, id_key string"


def table(seed=2, n=260, dims=7):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        vector = [float(np.float32(r.choice([r.uniform(-0.3, 1), 0.25]))) for _ in range(dims)]
        rows.append((i * 5, vector, r.choice([0, 0, 0, 1, 2, 9, 30])))
    hot = [0.5] * dims
    rows += [(10_000 + i, hot, 0) for i in range(60)]
    rows += [(100, hot, 0), (100, hot, 1), (None, hot, 1), (None, hot, 0), (200, [1.0], 2), (300, [], 2), (400, [3.0] * (dims + 6), 0)]
    rows += [(500, None, 0), (600, hot, None), (700, [None, *hot[1:]], 0), (800, [float("nan"), *hot[1:]], 0), (900, [float("inf"), *hot[1:]], 0), (1100, [1e30] * dims, 4)]
    return [(*row, 1, 2, 3, "x") for row in rows]


def mined(rows, k=5, n=10, every=100):
    fit = []
    for vec_id, vector, label, *_ in rows:
        if label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        whole = [int(np.floor(max(-(2.0**28), min(2.0**28, np.float64(np.float32(x)) * 256)))) for x in vector]
        fit.append((vec_id, (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label, whole))
    out = []
    for i, (anchor, label, a) in enumerate(fit):
        if anchor is None or anchor % every:
            continue
        scored = [(-sum(x * y for x, y in zip(a, b, strict=False)), vec_id is None, vec_id or 0, other) for j, (vec_id, other, b) in enumerate(fit) if j != i]
        scored.sort()
        for p, none, positive, _ in [s for s in scored if s[3] == label][:k]:
            some = [s for s in scored if s[3] != label and 30 * -p <= 100 * -s[0] <= 90 * -p][:n]
            out += [(anchor, None if none else positive, rank, None if s[1] else s[2], -p, -s[0]) for rank, s in enumerate(some, 1)]
    return out


@pytest.mark.parametrize(("height", "width", "chunk"), [(3, 20, 2), (128, 1024, 32)])
def test_against_all_scores(spark, same, height, width, chunk):
    rows = table()
    vectors = spark.createDataFrame(rows, LAYOUT).repartition(4)
    same(negatives.mined(vectors, height=height, width=width, chunk=chunk), mined(rows))


def test_few_rows(spark, same):
    for rows in ([], [r for r in table() if r[0] == 100], table()[:3]):
        same(negatives.mined(spark.createDataFrame(rows, LAYOUT)), mined(rows))


def test_scores_beyond_exact_floats(spark, same):
    rows = [(i, [float(2**19 + i * 7), -float(2**19), 3.0], i % 3, 0, 0, 0, "") for i in range(0, 500, 10)]
    same(negatives.mined(spark.createDataFrame(rows, LAYOUT), chunk=1), mined(rows))
