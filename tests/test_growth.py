"""What is shuffled and held by a task grows with the rows: no wide row is dealt by the few ids of parents, no token row is grouped, no part is made unasked."""

from datetime import datetime

from pyspark.sql import functions as F

from lodestone.operators import documents, postings, pricing
from lodestone.operators.search import Engine
from lodestone.plans.model import FacetFilter, Index, SearchQuery
from lodestone.settings import Settings

from test_engine import documents_of

NOW = datetime(2026, 1, 1)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tokens_are_counted_in_their_rows(spark):
    texts = ["red shoe red red", "", "b", "shoe a shoe", "red"]
    docs = documents_of(spark, [(s, 0, f"g{i}", t) for s in (1, 2) for i, t in enumerate(texts)])
    built = postings.build(docs)
    plan = plan_of(built)
    assert "Aggregate" not in plan and plan.count("Exchange rangepartitioning") == 1 and "hashpartitioning" not in plan, plan
    found = {(r["shop_id"], r["field"], r["token"], r["id"]): (r["tf"], r["positions"]) for r in built.collect()}
    wanted = {}
    for s in (1, 2):
        for i, t in enumerate(texts):
            words = t.split()
            for w in set(words):
                at = [k for k, x in enumerate(words) if x == w]
                wanted[s, "search", w, f"{s}0g{i}"], wanted[s, "boost", w, f"{s}0g{i}"] = (len(at), at), (len(at), None)
    assert found == wanted and built.count() == len(wanted)


def test_a_token_of_all_documents_is_spread(spark):
    docs = documents_of(spark, [(1, 0, f"g{i:04d}", "ware") for i in range(400)])
    for built in (postings.build(docs), postings.grams(docs)):
        assert ", id#" in plan_of(built).split("Exchange rangepartitioning(")[1].split("),")[0]


def catalogue(spark, variants=40):
    articles = [(f"v{i}", f"g{i % 2}", "" if i % 3 else f"t{i}", "", "", "", "", "", "", 1, "", 10.0, 1.0, 1, 1, 0) for i in range(variants)] + [(f"g{k}", "", f"parent {k}", "", "", "", "", "m1", "", 0, "", 5.0, 0.0, 1, 1, 9) for k in range(2)]
    names = "id string, parent_id string, title string, artnum string, ean string, mpn string, short_desc string, manufacturer_id string, var_select string, sold int, inserted string, price double, stock double, stock_flag int, active int, var_count int"
    make = spark.createDataFrame
    return {
        "articles": make(articles, names), "manufacturers": make([("m1", "Brand")], "id string, title string"), "long_desc": make([("g0", "<p>long</p>")], "article_id string, long_desc string"),
        "attributes": make([("size", "Size")], "id string, title string"), "object2attribute": make([("g0", "size", "S", 0), ("v1", "size", "M", 1)], "object_id string, attr_id string, value string, pos int"),
        "categories": make([("c1", "", "Cat", True, False)], "id string, parent_id string, title string, active boolean, hidden boolean"), "object2category": make([("g0", "c1"), ("g1", "c1")], "object_id string, cat_id string"),
        "discounts": make([("d1", 10.0, "%", 1, None, None, 1), ("d2", 1.0, "abs", 1, None, None, 2)], "id string, amount double, kind string, active int, active_from timestamp, active_to timestamp, sort int"),
        # v1 has d2 by itself, by its parent and once more; it counts once.
        "object2discount": make([("d1", "c1", "category"), ("d2", "v1", "article"), ("d2", "v1", "article"), ("d2", "g1", "article")], "discount_id string, object_id string, kind string"),
    }


def test_documents_are_dealt_by_their_ids(spark):
    built = documents.build(catalogue(spark), 1, 0, Settings(facet_attributes=("size",)), NOW)
    rows = {r["article_id"]: r for r in built.collect()}
    assert len(rows) == 40 and rows["v1"]["title"] == "parent 1" and rows["v0"]["title"] == "t0" and rows["v1"]["brand"] == "Brand"
    assert float(rows["v1"]["price"]) == 8.0 and float(rows["v0"]["price"]) == 9.0 and float(rows["v3"]["price"]) == 8.0
    assert [a["value"] for a in rows["v0"]["attributes"]] == ["S"] and rows["v0"]["category_ids"] == ["c1"] and "long" in rows["v0"]["search_text"].split()
    dealt = [x.split(")")[0] for x in plan_of(built).split("Exchange hashpartitioning(")[1:]]
    assert dealt and not any(x.startswith(("parent_id", "group_id", "manufacturer_id")) for x in dealt), dealt


def test_a_discount_applies_once(spark):
    t = catalogue(spark)
    rows = documents.inherited(t["articles"], t["manufacturers"], t["long_desc"])
    prices = pricing.effective(rows, t["object2discount"], t["discounts"], t["object2category"].withColumnRenamed("object_id", "group_id"), NOW)
    assert {r["article_id"]: r["price"] for r in prices.collect()} == {f"v{i}": 9.0 if i % 2 == 0 else 8.0 for i in range(40)}


def test_parts_are_made_when_they_are_asked_for(spark):
    docs = documents_of(spark, [(1, 0, f"g{i}", t) for i, t in enumerate(["red shoe", "blue shoe", "red hat"])])
    asked = []

    def part(name, make):
        return lambda: asked.append(name) or make(docs)

    from lodestone.operators import cells

    later = {"postings": part("postings", postings.build), "grams": part("grams", postings.grams), "sizes": part("sizes", postings.sizes), "cells": part("cells", cells.build)}
    engine = lambda: Engine(Index(docs, later=dict(later)), Settings(facet_attributes=("size",)))
    for query, parts in (
        (SearchQuery(1, 0, manufacturer="m1"), []), (SearchQuery(1, 0, "red"), ["postings"]), (SearchQuery(1, 0, "r"), ["grams"]), (SearchQuery(1, 0, "re shoe"), ["grams", "postings"]),
    ):
        asked.clear()
        assert engine().matching(query).count() == Engine(Index(docs), Settings()).matching(query).count() and sorted(asked) == parts, query
    asked.clear()
    found = engine()
    found.facet_counts(SearchQuery(1, 0, "", filters=(FacetFilter("size", ("v",)),))).collect()
    found.facet_counts(SearchQuery(1, 0, "")).collect()
    assert asked == ["cells"]


def test_a_scope_is_written_without_sorting_and_loses_rows_alone(spark, tmp_path):
    import pytest

    from lodestone.operators import writer as module

    writer = module.IndexWriter(spark, str(tmp_path / "index"))
    docs = documents_of(spark, [(1, 0, f"g{i:02d}", "red shoe" if i % 2 else "blue hat b") for i in range(20)])
    writer.begin([(1, 0)])
    writer.write(docs)
    writer.commit(spark.createDataFrame([(f"g{i:02d}", "c1") for i in range(20)], "object_id string, cat_id string"))
    made = []
    build, module.postings.build = module.postings.build, lambda df: made.append(df) or build(df)
    try:
        writer.delete([f"10g{i:02d}" for i in (1, 2)])
    finally:
        module.postings.build = build
    assert not made
    index = writer.index()
    ids = {f"10g{i:02d}" for i in range(20) if i not in (1, 2)}
    for name in ("documents", "postings", "grams", "cells"):
        assert {r["id"] for r in getattr(index, name).select("id").collect()} == ids, name
    left = lambda df: sorted(map(str, df.collect()))
    assert left(index.postings) == left(postings.build(index.documents).select(*index.postings.columns))
    assert index.categories.count() == 18 and index.sizes.first()["documents"] == 18
    # A whole scope that is deleted has no partition left; rows of another scope are refused.
    writer.delete(index.documents.select("id"))
    assert writer.manifest()["parts"]["documents"] == {} and writer.index().documents.count() == 0
    writer.begin([(2, 0)])
    with pytest.raises(Exception, match="outside of scope"):
        writer.write(docs)
    writer.rollback()
