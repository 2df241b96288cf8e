from collections import defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from lodestone.llm import mixing, sharding


def test_shards(docs, rows):
    got = sharding.shards(docs, n_shards=5).collect()
    wanted = sorted(((d, len((t or "").encode()) + 8, crc32((t or "").encode())) for d, t, *_ in rows), key=str)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=str) == wanted
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in got:
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # Cuts of a running sum are off by a record at either end.
    assert max(sizes.values()) - min(sizes.get(k, 0) for k in range(5)) <= 2 * max(r["size"] for r in got)


def test_shards_of_equal_texts_stay_together_and_large_groups_are_cut(spark):
    few = [(i, f"text {i // 3} " + "y" * 200) for i in range(3000)]
    many = [(10_000 + i, "copied " * 40) for i in range(1500)]
    got = sharding.shards(spark.createDataFrame(few + many, "doc_id long, text string"), n_shards=6, rows_per_range=400).collect()
    sizes, homes = defaultdict(int), defaultdict(set)
    text = dict(few + many)
    for r in got:
        sizes[r.shard] += r["size"]
        homes[text[r.doc_id]].add(r.shard)
    assert len(homes["copied " * 40]) > 1
    assert all(len(h) == 1 for t, h in homes.items() if t.startswith("text"))
    mean = sum(sizes.values()) / 6
    assert all(abs(s - mean) < 0.03 * mean for s in sizes.values())


def test_groups_that_fit_a_shard_are_whole(spark):
    # Many empty texts, which are few bytes, groups of all sizes up to a shard, and one larger.
    rows = [(f"g{i % 23} " + "x" * (10 * (i % 23)), None) for i in range(2300)] + [("", None)] * 1500 + [("z" * 300, None)] * 900
    rows = [(i, t) for i, (t, _) in enumerate(rows)]
    got = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string"), n_shards=7, rows_per_range=100).collect()
    share, sizes, homes, slots = sum(len(t) + 8 for _, t in rows) / 7, defaultdict(int), defaultdict(set), defaultdict(list)
    bytes_of = defaultdict(int)
    for r in got:
        t = rows[r.doc_id][1]
        sizes[r.shard] += r["size"]
        homes[t].add(r.shard)
        slots[r.shard].append(r.slot)
        bytes_of[t] += r["size"]
    assert len(got) == len(rows)
    assert all(len(h) == 1 for t, h in homes.items() if bytes_of[t] <= share)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(abs(s - share) <= 0.03 * share for s in sizes.values())


def test_more_sources_than_a_mix_has_are_refused(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    with pytest.raises(ValueError):
        mixing.mixed(spark.createDataFrame([(i, "a b", f"s{i}") for i in range(3)], "doc_id long, text string, source string"))


def test_samples_are_bounded(spark, monkeypatch):
    from lodestone.llm import _ranges

    monkeypatch.setattr(_ranges, "MOST_RANGES", 10)
    df = spark.range(4000).selectExpr("id as a", "cast(1 as bigint) as one")
    placed, stats = _ranges.ranged(df, ["a"], "one", 500, 8)
    assert len(stats) <= 40
    got = [r.row_rank for r in _ranges.with_prefix(placed, ["a"], {"row_rank": "one"}).orderBy("a").collect()]
    assert got == list(range(4000))


def test_shards_of_nothing(nothing):
    assert sharding.shards(nothing).count() == 0


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 300) == pytest.approx([187.5, 75, 37.5])
    # The first is full at three times its size; the rest goes by weight to the others.
    assert mixing.targets([10, 100, 190], [5, 2, 1], 300) == pytest.approx([30, 180, 90])
    assert mixing.targets([0, 5], [5, 2], 5) == pytest.approx([0, 5])
    assert sum(mixing.targets([1, 1, 1000], [5, 2, 1], 1002)) == pytest.approx(1002)


def test_mix(spark, docs, rows):
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        size[r.source] += r["size"]
        taken[r.source] += r["size"] * r.copies
        target[r.source] = r.target
        rate = r.target / r.source_size if r.source_size else 0
        assert int(rate) <= r.copies <= int(rate) + 1 and r.copies <= 3
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    for source, words in taken.items():
        assert abs(words - target[source]) <= max(r["size"] for r in got if r.source == source)
    again = mixing.mixed(docs.repartition(7)).groupBy("doc_id", "size").agg(F.sum("copies").alias("c"))
    first = defaultdict(int)
    for r in got:
        first[r.doc_id, r["size"]] += r.copies
    assert {(r.doc_id, r["size"]): r.c for r in again.collect()} == first


def test_mix_of_nothing(nothing):
    assert mixing.mixed(nothing).count() == 0


def test_ranks_are_global_in_small_ranges(spark):
    from lodestone.llm import _ranges

    df = spark.range(5000).selectExpr("id % 7 as a", "id as b", "cast(1 as bigint) as one").repartition(5).cache()
    placed, stats = _ranges.ranged(df, ["a", "b"], "one", 20, 100)
    assert stats["rows"].max() <= 600 and len(stats) > 10
    got = {(r.a, r.b): (r.row_rank, r.before) for r in _ranges.with_prefix(placed, ["a", "b"], {"row_rank": "one", "before": "one"}).collect()}
    assert got == {k: (i, i) for i, k in enumerate(sorted(got))}
