"""Counts by numbered products are those by their names, and read no text."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import cells, postings, rollup
from lodestone.operators.search import Engine
from lodestone.operators.writer import IndexWriter
from lodestone.plans.model import FacetFilter, Index, SearchQuery
from lodestone.settings import Settings
from lodestone.sources import staging

from test_engine import documents_of

SETTINGS = Settings(facet_attributes=("colour", "size"))
QUERIES = [
    SearchQuery(1, 0, ""),
    SearchQuery(1, 0, "red"),
    SearchQuery(2, 0, "red shoe"),
    SearchQuery(1, 0, "zzz"),
    SearchQuery(9, 0, ""),
    SearchQuery(1, 0, "re", manufacturer="m1"),
    SearchQuery(1, 0, "", price_from=5.0, price_to=40.0),
    SearchQuery(1, 0, "", category="c1"),
    SearchQuery(1, 0, "red", filters=(FacetFilter("colour", ("v1", "v2")),)),
    SearchQuery(1, 0, "", filters=(FacetFilter("colour", ("v1",)), FacetFilter("size", ("v0", "v3")))),
]


@pytest.fixture(scope="module")
def docs(spark):
    """300 products of one to three variants in each of two shops, some hidden, some with an attribute twice; 70 share a value."""
    r = random.Random(4)
    rows = [(s, 0, f"g{g:03}x{v}", " ".join(r.choice(["red", "redder", "shoe", "low", "bin"]) for _ in range(4))) for s in (1, 2) for g in range(300) for v in range(r.randint(1, 3))]
    at = F.pmod(F.xxhash64("id"), F.lit(1 << 30))

    def item(name, shift):
        return F.struct(F.lit(name).alias("attr_id"), F.lit(name).alias("title"), F.concat(F.lit("v"), at.bitwiseAND(F.lit(3 << shift)) / (1 << shift)).alias("value_id"), F.concat(F.lit("V"), at.bitwiseAND(F.lit(1 << shift))).alias("value"), F.lit(1).alias("pos"))

    df = documents_of(spark, rows).withColumn("group_id", F.substring_index("group_id", "x", 1))
    df = df.withColumn("attributes", F.when(at % 7 == 0, F.array(item("colour", 2), item("colour", 2))).when(at % 5 == 0, F.array().cast(df.schema["attributes"].dataType)).otherwise(F.array(item("colour", 2), item("size", 6), item("hidden", 9))))
    df = df.withColumn("attributes", F.transform("attributes", lambda a: a.withField("value_id", F.regexp_replace(a["value_id"], r"\.0$", ""))))
    df = df.withColumn("visible", at % 11 != 0).withColumn("manufacturer_id", F.concat(F.lit("m"), at % 3)).withColumn("price", (at % 50).cast("decimal(9,2)"))
    return staging.staged(df, "docs")


@pytest.fixture(scope="module")
def engines(spark, docs):
    stored = [staging.staged(f(docs), "stored") for f in (postings.build, postings.grams, postings.sizes)]
    links = docs.where("group_id < 'g100'").select("shop_id", "lang_id", "group_id", F.lit("c1").alias("cat_id")).distinct()
    rolled = staging.staged(rollup.build(rollup.attribute_rows(docs)), "rollup")
    numbered = staging.staged(cells.build(docs), "cells")
    words = staging.staged(cells.words(rolled, numbered), "words")
    return Engine(Index(docs, rolled, links), SETTINGS), Engine(Index(docs, rolled, links, None, [], *stored, numbered, words), SETTINGS)


def rows(df):
    return sorted(map(tuple, df.select("attr_id", "value_id", "value", "cnt").collect()))


@pytest.mark.parametrize("query", QUERIES, ids=str)
def test_counts(engines, query):
    plain, numbered = engines
    assert numbered.count(query) == plain.count(query)
    for unit in ("groups", "documents"):
        want = rows(plain.facet_counts(query, unit))
        if unit == "documents":
            # A document with an attribute twice is one document.
            assert [r[:3] for r in want] == [r[:3] for r in rows(numbered.facet_counts(query, unit))]
        assert rows(numbered.facet_counts(query, unit)) == want
    assert rows(numbered.rollup_counts(query)) == rows(plain.rollup_counts(query))


def test_numbers_are_dense_in_each_scope(engines):
    numbered = engines[1].index.cells
    for shop in (1, 2):
        found = numbered.where(F.col("shop_id") == shop).select("group_id", (F.col("word") * 64 + F.log2(F.abs(F.col("mask").cast("double")))).cast("long").alias("n")).distinct().collect()
        ns = sorted(r["n"] for r in found)
        assert len(found) == 300 and ns == list(range(ns[0], ns[0] + 300))


def test_no_text_and_no_product_name_is_shuffled(engines):
    for df in (engines[1].facet_counts(QUERIES[1]), engines[1].rollup_counts(QUERIES[1])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "search_text" not in plan and "search_tokens" not in plan and "count(distinct" not in plan
        assert "hashpartitioning(group_id" not in plan


def test_values_that_many_products_hold_are_a_row_for_64(engines):
    index = engines[1].index
    assert index.words.count() < index.rollup.count() / 8


def test_stored_and_deleted(spark, docs, tmp_path):
    writer = IndexWriter(spark, str(tmp_path / "index"))
    writer.begin([])
    writer.write(docs)
    writer.commit()
    writer.delete(docs.where("group_id < 'g050' AND shop_id = 1"))
    left = docs.where("NOT (group_id < 'g050' AND shop_id = 1)")
    plain, numbered = Engine(Index(left), SETTINGS), Engine(writer.index(), SETTINGS)
    for query in QUERIES[:3]:
        assert rows(numbered.facet_counts(query)) == rows(plain.facet_counts(query)) and numbered.count(query) == plain.count(query)


def test_nothing(spark, docs):
    none = docs.limit(0)
    numbered = cells.build(none)
    engine = Engine(Index(none, cells=numbered), SETTINGS)
    assert engine.count(QUERIES[0]) == 0 and engine.facet_counts(QUERIES[0]).isEmpty()
    assert cells.words(rollup.build(rollup.attribute_rows(none)), numbered).isEmpty()
