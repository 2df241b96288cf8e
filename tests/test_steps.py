"""Batches that cost a batch, steps that may be done twice, distances over arrays, ranks and settings."""

import random
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import distance, phonetics
from lodestone.operators import documents, ranking, rebuild, settings_diff
from lodestone.operators.writer import IndexWriter
from lodestone.sources import staging

from test_engine import NOW, SETTINGS, tables  # noqa: F401


@pytest.fixture(scope="module")
def stored_tables(tables):  # noqa: F811
    return {name: staging.staged(df, name) for name, df in tables.items()}


def test_a_batch_reads_the_span_of_its_keys(spark, stored_tables):
    found, last = documents.batch(stored_tables, 1, 0, SETTINGS, NOW, "a1", 2)
    assert last == "k1" and sorted(r["article_id"] for r in found.select("article_id").collect()) == ["a2", "k1"]
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    scans = [line for line in plan.splitlines() if "Scan parquet" in line]
    for name, key in (("long_desc", "article_id"), ("object2attribute", "object_id"), ("object2category", "object_id")):
        assert any(f"/{name}-" in line and f"GreaterThanOrEqual({key}" in line for line in scans), name


def test_batches_give_the_documents_of_the_whole_build(stored_tables):
    whole = {r["article_id"]: r for r in documents.build(stored_tables, 1, 0, SETTINGS, NOW).collect()}
    cursor, got = "", {}
    while True:
        found, last = documents.batch(stored_tables, 1, 0, SETTINGS, NOW, cursor, 3)
        if last == cursor:
            break
        got |= {r["article_id"]: r for r in found.collect()}
        cursor = last
    assert got == whole


def test_a_step_done_twice_changes_nothing(spark, stored_tables, tmp_path):
    place = str(tmp_path / "index")
    state = rebuild.started(IndexWriter(spark, place), stored_tables, (1, 0), 3)
    rebuild.tick(IndexWriter(spark, place), stored_tables, (1, 0), state, SETTINGS, NOW)
    while state.phase != "ready":
        state = rebuild.tick(IndexWriter(spark, place), stored_tables, (1, 0), state, SETTINGS, NOW)
    ids = [r["article_id"] for r in IndexWriter(spark, place).index().documents.collect()]
    assert sorted(ids) == ["a1", "a2", "k1", "k2", "x1"]


def test_distances_of_a_batch():
    r = random.Random(3)
    words = ["".join(r.choice("abcé😀") for _ in range(r.randint(0, 9))) for _ in range(3000)] + ["a" * 300, "a" * 299 + "b"]
    a, b = words, words[1:] + words[:1]
    most = np.array([r.randint(0, 4) for _ in a])
    got = distance.osa_batch(a, b, most, cells=2000)
    assert got.tolist() == [distance.osa(x, y, int(m)) for x, y, m in zip(a, b, most, strict=True)]


def test_distances_with_nulls_and_none(spark):
    rows = spark.createDataFrame([("ab", "ba", 1), (None, "a", 1), ("a", None, 1), ("abcd", "dcba", 2), ("", "", 0)], "a string, b string, most int")
    assert [r[0] for r in rows.select(distance.osa_within("a", "b", "most")).collect()] == [1, None, None, 3, 0]
    assert rows.where("a = 'zz'").select(distance.osa_within("a", "b", "most")).collect() == []


def test_sounds_of_words_and_columns(spark):
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz9") for _ in range(r.randint(0, 9))) for _ in range(500)]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", phonetics.encode(F.col("w")).alias("c")).collect()
    assert all(x["c"] == phonetics.encoded(x["w"]) for x in got)


def test_places_of_rows_with_ties(spark):
    r = random.Random(1)
    rows = [(i, r.choice([0, 0, 0, 1, 5, None])) for i in range(500)]
    got = ranking.placed(spark.createDataFrame(rows, "id int, sold int").repartition(7), [F.desc("sold"), F.col("id")])
    assert "BroadcastNestedLoopJoin" not in got._jdf.queryExecution().executedPlan().toString()
    wanted = sorted(rows, key=lambda x: (-1 if x[1] is None else x[1], -x[0]), reverse=True)
    assert [(x["id"], x["sold"]) for x in sorted(got.collect(), key=lambda x: x["pos"])] == wanted
    assert sorted(x["pos"] for x in got.collect()) == list(range(500))


def test_settings_compare_as_sets_but_for_ranked_lists(spark):
    layout = "shop_id int, lang_id int, setting string, pos int, value string"
    live = spark.createDataFrame([(1, 0, "ranked", 1, "a"), (1, 0, "ranked", 2, "b"), (1, 0, "set", 1, "a"), (1, 0, "set", 2, "b"), (2, 0, "set", 1, "a"), (3, 0, "ranked", 1, "a")], layout)
    wanted = spark.createDataFrame([(1, 0, "ranked", 1, "b"), (1, 0, "ranked", 2, "a"), (1, 0, "set", 1, "b"), (1, 0, "set", 2, "a"), (1, 0, "set", 3, "a"), (2, 0, "set", 1, "a"), (2, 0, "new", 1, "x"), (3, 0, "ranked", 5, "a")], layout)
    got = {(r["shop_id"], r["setting"]): tuple(r)[3:] for r in settings_diff.compared(live, wanted, ("ranked",)).collect()}
    assert got == {(1, "ranked"): (True, 0, 0), (1, "set"): (False, 0, 0), (2, "set"): (False, 0, 0), (2, "new"): (True, 1, 0), (3, "ranked"): (False, 0, 0)}
    assert sorted(tuple(r) for r in settings_diff.outdated(live, wanted, ("ranked",)).collect()) == [(1, 0), (2, 0)]


def test_the_longest_known_phrases_cover_a_term():
    from lodestone.operators.synonyms import Expander, Rule, to_edit

    rules = [Rule("both", "low price", "cheap"), Rule("oneway", "low", "small"), Rule("both", "cheap", "bargain bin"), Rule("both", "a b c d e", "f"), Rule("oneway", "same", "SAME")]
    e = Expander(rules)
    assert e.expand(["low", "price", "low"]) == [[("low", "price"), ("cheap",)], [("low",), ("small",)]]
    assert e.expand(["cheap"]) == [[("cheap",), ("low", "price"), ("bargain", "bin")]]
    assert e.expand(["low", "prices", "f", "same"]) == [[("low",), ("small",)], [("prices",)], [("f",)], [("same",)]] and e.expand([]) == []
    assert to_edit(rules, " Cheap ") == rules and to_edit(rules, "small") == [*rules, Rule("both", "small", "")] and to_edit(rules) == rules


def test_stream_batches_are_merged_and_count_the_same(spark, tmp_path):
    from lodestone.streaming import log_stream

    folder, layout = str(tmp_path), "shop_id int, lang_id int, day date, term string, term_raw string, searches long, hits int, corrected string, last_seen timestamp, batch long"
    days, at = [date(2024, 1, 1), date(2024, 1, 2)], datetime(2024, 1, 2)

    def put(numbers):
        rows = [(1, 0, d, t, t.upper(), n + 1, n, "", at, n) for n in numbers for d in days for t in ("a", f"b{n}")]
        spark.createDataFrame(rows, layout).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(folder)

    def state():
        return sorted(tuple(r) for r in log_stream.read(spark, folder).select("day", "term", "searches", "hits").collect())

    def parts():
        return sorted(p.name for p in tmp_path.glob("day=2024-01-01/batch=*"))

    put(range(5))
    before = state()
    log_stream.compact(spark, folder, 4, kept=8)
    assert len(parts()) == 5
    # Batch 4 may yet be done again, so it stays beside the merged ones.
    log_stream.compact(spark, folder, 4, kept=2)
    assert parts() == ["batch=3", "batch=4"] and state() == before
    put([4])
    log_stream.compact(spark, folder, 4, kept=2)
    assert parts() == ["batch=3", "batch=4"] and state() == before
    assert [r[2] for r in before if r[1] == "a"] == [5, 5] and len(before) == 12


def test_samples_without_a_group_in_one_task(spark):
    from lodestone.sources import store

    rows = [("a", f" v{i:03d} ") for i in range(200)] + [("b", "é"), ("b", "z"), ("b", "z"), ("b", "Z"), ("b", "x" * 40), ("c", " "), ("c", None), (None, "w")]
    found = store.sample_values(spark.createDataFrame(rows, "attr_id string, value string").repartition(5))
    assert {r.attr_id: r.sample for r in found.collect()} == {"a": "v000 · v001 · v002", "b": f"Z · {'x' * 32} · z", None: "w"}
    assert "Window" not in found._jdf.queryExecution().toString()
    assert store.sample_values(spark.createDataFrame([], "attr_id string, value string")).count() == 0
