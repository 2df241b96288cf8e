"""Index and search end to end on a small catalogue, and what must hold of any answer."""

import math
import os
from collections import Counter
from dataclasses import replace
from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestone.operators import categories, dictionary, documents, postings, pricing, rebuild, reports, rollup
from lodestone.operators.agreement import nearest_rank
from lodestone.operators.search import Engine, NullEngine, ordered
from lodestone.operators.synonyms import Expander, Rule, covers, exported
from lodestone.operators.writer import IndexWriter
from lodestone.plans.model import FacetFilter, Index, SearchQuery, SuggestQuery, category_query, filters_of, query_of, sort_of
from lodestone.settings import Settings, active_languages, scopes
from lodestone.sources.store import Store

NOW = datetime(2026, 1, 1)
SETTINGS = Settings(facet_attributes=("colour", "size"), display_modes={"colour": "color"})
Q = SearchQuery(1, 0)


@pytest.fixture(scope="module")
def tables(spark):
    article = "id string, parent_id string, title string, artnum string, ean string, mpn string, short_desc string, var_select string, manufacturer_id string, active int, var_count int, sold int, inserted string, price double, stock double, stock_flag int"
    rows = [
        ("p1", "", "Jacke Daunen", "J", "", "", "warm", "", "m1", 1, 2, 0, "", 50.0, 0.0, 1),
        ("a1", "p1", "", "J-M", "", "", "", "M", "", 1, 0, 5, "2024-01-05", 50.0, 3.0, 1),
        ("a2", "p1", "", "J-L", "", "", "", "L", "", 1, 0, 9, "2024-02-05", 60.0, 0.0, 1),
        ("k1", "", "Kleid Daunen", "K", "", "", "", "", "m2", 1, 0, 7, "0000-00-00", 30.0, 1.0, 2),
        ("k2", "", "Kleid Sommer", "S", "", "", "", "", "m2", 1, 0, 1, "", 20.0, 0.0, 2),
        ("x1", "", "Nachthemd", "N", "", "", "", "", "m2", 1, 0, 2, "", 10.0, 1.0, 1),
        ("o1", "", "Alt", "", "", "", "", "", "", 0, 0, 0, "", 1.0, 1.0, 1),
    ]
    make = spark.createDataFrame
    return {
        "articles": make(rows, article),
        "long_desc": make([("p1", "<p>feder<b>leicht</b></p>")], "article_id string, long_desc string"),
        "manufacturers": make([("m1", "Nord"), ("m2", "Süd")], "id string, title string"),
        "attributes": make([("colour", "Farbe"), ("size", "Größe")], "id string, title string"),
        "object2attribute": make([("a1", "colour", "Rot_#ff0000", 1), ("a2", "colour", "Rot_#ff0000", 1), ("k1", "colour", "Blau_#0000ff", 1), ("a1", "size", "M", 2), ("a2", "size", "L", 2), ("k1", "size", " M ", 2), ("x1", "size", " ", 2)], "object_id string, attr_id string, value string, pos int"),
        "categories": make([("c1", "root", " Damen ", True, False), ("c2", "c1", "Jacken", True, False), ("c3", "c4", "X", True, False), ("c4", "c3", "Y", True, False), ("c5", "c1", "", True, True)], "id string, parent_id string, title string, active boolean, hidden boolean"),
        "object2category": make([("p1", "c2"), ("k1", "c1"), ("k1", "gone"), ("nobody", "c1")], "object_id string, cat_id string"),
        "discounts": make([("d1", 10.0, "%", 1, None, None, 2), ("d2", 5.0, "abs", 1, None, None, 1), ("d3", 99.0, "abs", 0, datetime(2020, 1, 1), datetime(2021, 1, 1), 3)], "id string, amount double, kind string, active int, active_from timestamp, active_to timestamp, sort int"),
        "object2discount": make([("d1", "c2", "category"), ("d2", "a1", "article"), ("d3", "a1", "article"), ("d1", "p1", "article")], "discount_id string, object_id string, kind string"),
    }


@pytest.fixture(scope="module")
def engine(spark, tables, tmp_path_factory):
    writer = IndexWriter(spark, str(tmp_path_factory.mktemp("index")))
    rebuild.rebuild(writer, lambda s, x: tables, [(1, 0)], SETTINGS, NOW)
    index = writer.index()
    index.rules = [Rule("both", "jacke", "anorak, warmer mantel")]
    out = Engine(index, SETTINGS)
    out.writer = writer
    return out


def test_documents(engine):
    rows = {r.article_id: r for r in engine.index.documents.collect()}
    assert rows.keys() == {"a1", "a2", "k1", "k2", "x1"}
    a1 = rows["a1"]
    assert (a1.title, a1.brand, a1.group_id, a1.category_paths) == ("Jacke Daunen", "Nord", "p1", ["Damen > Jacken"])
    assert float(a1.price) == (50 - 5) * 0.9 and float(rows["a2"].price) == 54 and a1.insert_date == datetime(2024, 1, 5) and rows["k1"].insert_date is None
    assert not rows["k2"].visible and rows["a2"].visible
    assert "federleicht" in a1.search_tokens and a1.boost_text == "jacke daunen nord m j m"
    assert [a.value for a in rows["k1"].attributes] == ["Blau_#0000ff", "M"] and rows["x1"].attributes == []


def test_search(engine):
    found = engine.search(replace(Q, term="daunen"))
    assert (found.total, found.ids) == (2, ("p1", "k1"))
    assert {(v.label, v.hex, v.count) for v in found.facet("colour").values} == {("Rot", "#ff0000", 1), ("Blau", "#0000ff", 1)}
    assert engine.search(replace(Q, term="anor")).total == 0 and engine.search(replace(Q, term="anorak")).ids == ("p1",)
    assert engine.search(replace(Q, term="und")).total == 3
    assert engine.search(replace(Q, term="damen")).total == 2
    assert engine.search(replace(Q, category="c1")).ids == ("k1",)
    assert engine.search(replace(Q, manufacturer="m1")).ids == ("p1",)
    assert engine.search(replace(Q, sort="price_asc")).ids == ("x1", "k1", "p1")
    assert engine.search(replace(Q, sort="newest")).ids[0] == "p1"


def test_pages_are_disjoint_and_filters_narrow(engine):
    pages = [engine.search(replace(Q, sort="title_asc", limit=1, offset=k)).ids for k in range(4)]
    assert [len(p) for p in pages] == [1, 1, 1, 0] and len({p[0] for p in pages[:3]}) == 3
    every = engine.search(replace(Q, term="daunen"))
    size_m = next(v for v in every.facet("size").values if v.label == "M").value_id
    narrow = engine.search(replace(Q, term="daunen", filters=(FacetFilter("size", (size_m,)),)))
    assert narrow.total == 2 and narrow.facet("size").has_selection
    one = engine.search(replace(Q, term="daunen", price_to=41.0))
    assert one.total == 2 and {v.label for v in one.facet("size").values} == {"M"} if one.facet("size") else one.total == 2


def test_correction_and_suggestions(engine):
    found = engine.search(replace(Q, term="nachtehmd"))
    assert found.correction.corrected == "nachthemd" and found.correction.applied and found.ids == ("x1",)
    shown = Engine(engine.index, replace(SETTINGS, auto_apply=False)).search(replace(Q, term="nachtehmd"))
    assert shown.total == 0 and shown.correction.hits == 1 and not shown.correction.applied
    assert engine.search(replace(Q, term="nachtehmd", allow_correction=False)).correction is None
    out = engine.suggest(SuggestQuery(1, 0, "Kle"))
    assert out.terms == ("kleid",) and out.products == ("k1",) and out.brands == ()
    assert engine.suggest(SuggestQuery(1, 0, "k")).empty
    assert engine.suggest(SuggestQuery(1, 0, "nachtehm")).terms == ("nachthemd",)


def test_publication(spark, tables, engine):
    writer = engine.writer
    before = writer.live()
    writer.begin([(1, 0)])
    with pytest.raises(RuntimeError):
        writer.begin([(1, 0)])
    writer.write(engine.index.documents.limit(1))
    writer.rollback()
    assert writer.live() == before and writer.index().documents.count() == 5

    def broken(shop, lang):
        raise ValueError("no catalogue")

    with pytest.raises(ValueError):
        rebuild.rebuild(writer, broken, [(1, 0)], SETTINGS, NOW)
    assert writer.live() == before
    other = documents.build(tables, 1, 1, SETTINGS, NOW)
    writer.begin([(1, 1)])
    writer.write(other)
    writer.commit(tables["object2category"])
    assert {r.lang_id for r in writer.index().documents.select("lang_id").distinct().collect()} == {0, 1}
    gone = writer.index().documents.where("article_id = 'k1'").collect()
    writer.delete([r.id for r in gone])
    index = writer.index()
    assert index.documents.count() == 8 and index.rollup.where("group_id = 'k1'").isEmpty() and index.categories.where("group_id = 'k1'").isEmpty()
    # Too few links left: the live ones stay.
    writer.begin([(1, 0)])
    writer.write(index.documents.where("lang_id = 0"))
    outcome = writer.commit(tables["object2category"].limit(0))
    assert outcome[0].skipped and not writer.index().categories.isEmpty()


def test_guard_and_paths(spark, tables):
    assert [categories.plausible(*x) for x in ((50, 100), (49, 100), (120, 100), (0, 0), (5, 0), (50, 101))] == [True, False, True, True, True, False]
    for made in (categories.paths(tables["categories"]), categories.paths_sql(spark, tables["categories"])):
        path = {r.id: r.path for r in made.collect()}
        assert path["c2"] == "Damen > Jacken" and path["c5"] == "Damen" and path["c3"].count(">") == 19


def test_discounts_fold_in_order(spark, tables):
    rows = documents.inherited(tables["articles"], tables["manufacturers"], tables["long_desc"])
    got = {r.article_id: r.price for r in pricing.effective(rows, tables["object2discount"], tables["discounts"], tables["object2category"].withColumnRenamed("object_id", "group_id"), NOW).collect()}
    assert got["a1"] == pytest.approx(40.5) and got["a2"] == pytest.approx(54) and got["k1"] == 30


def test_labels(spark):
    rows = spark.createDataFrame([(0, "c", "1", v) for v in ["ROT", "ROT", "Rot", "rot", "rot", "rot"]], "lang_id int, attr_id string, value_id string, value string")
    assert rollup.labels(rows).first().value == "Rot"


def test_dictionary(engine):
    rows = {r.term: r for r in dictionary.build(engine.index.documents).collect()}
    assert rows["daunen"].frequency == 15 and rows["daunen"].source == "title" and "damen" in rows and not any(t.isdigit() for t in rows)


def test_synonyms():
    e = Expander([Rule("both", "red", "crimson, ruby"), Rule("oneway", "small thing", "widget"), Rule("both", "", "x"), Rule("both", "off", "on", False)])
    assert e.expand(["small", "thing", "red"]) == [[("small", "thing"), ("widget",)], [("red",), ("crimson",), ("ruby",)]]
    assert e.expand(["widget"]) == [[("widget",)]] and {"ruby", "widget"} <= e.known and "on" not in e.known
    assert exported([Rule("both", "A", "b"), Rule("oneway", "c", "d")]) == {"a": ["b"], "b": ["a"], "c": ["d"]}
    assert covers([Rule("oneway", "a1", "b1")], "A1") and not covers([Rule("oneway", "a1", "b1")], "b1")


def test_requests():
    assert [sort_of(x) for x in ("oxvarminprice asc", "price desc", "title desc", "oxinsert", "soldamount", "", None)] == ["price_asc", "price_desc", "title_asc", "newest", "bestseller", "relevance", "relevance"]
    assert filters_of({"a": ["1", "1", "x y", 5], "b c": ["1"], "d": "2"}) == (FacetFilter("a", ("1",)), FacetFilter("d", ("2",)))
    assert len(filters_of({f"a{i}": [str(j) for j in range(99)] for i in range(30)})) == 20
    q = query_of({"term": "x", "page": "2", "price_from": "0", "sort": "price"}, 1, 0)
    assert (q.offset, q.price_from, q.sort, q.is_first_look) == (20, 0.0, "price_asc", False)
    assert category_query("c", {"term": "x"}, 1, 0).term == "" and Q.is_first_look
    a, b = FacetFilter("a", ("1", "2")), FacetFilter("b", ("3",))
    assert replace(Q, filters=(a, b)).cache_key("v") == replace(Q, filters=(b, FacetFilter("a", ("2", "1")))).cache_key("v")


def test_small_things(spark, engine, tmp_path):
    assert nearest_rank([1, 2, 3, 4, 5], 0.5) == 3 and nearest_rank([1, 2, 3, 4], 0.5) == 2 and nearest_rank([1, 2, 3, 4, 5], 0.95) == 5
    assert active_languages([(0, False), (1, False)]) == [0] and scopes([1, 2], [0, 1], lang=1) == [(1, 1), (2, 1)]
    assert engine.available(1, 0) and not engine.available(9, 0) and NullEngine().search(Q).total == 0
    articles = engine.index.documents.select(F.col("article_id").alias("id"), "title")
    assert [r.id for r in ordered(["x1", "none", "a1"], articles).collect()] == ["x1", "a1"]
    store = Store(spark, str(tmp_path))
    assert store.attributes(1) == [] and store.rules(1, 0) == []
    assert store.save_attributes(1, [("b", True, False, "color"), ("a", False, True, "odd"), ("z", False, False, "")]) == 2
    assert store.facet_attributes(1) == ("b",) and store.display_modes(1) == {"b": "color", "a": "default"}
    assert store.save_rules(1, 0, [Rule("both", " a ", "b, b, "), Rule("both", "x", "")]) == 1 and store.active_rules(1, 0) == [Rule("both", "a", "b")]
    assert store.save_titles(1, {("b", 0): " T ", ("a", 0): " "}) == 1 and store.titles(1, 0) == {"b": "T"}


def test_stream_counts_whatever_the_files(spark, tmp_path):
    from lodestone.streaming import log_stream

    # Days from the last to the first, in more files than two batches of 100 (events are late from the third on).
    rows = [(1, 0, datetime(2024, 1, 1 + (239 - i) // 12, 10), f"r{i}", f"term{i % 3}", 1, "", True) for i in range(240)]
    (tmp_path / "events").mkdir()
    types = [pa.int32(), pa.int32(), pa.timestamp("us", "UTC"), pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_()]
    names = ["shop_id", "lang_id", "ts", "request_id", "term_raw", "hits", "corrected", "first_look"]
    for i, row in enumerate(rows):
        path = tmp_path / "events" / f"{i:03d}.parquet"
        pq.write_table(pa.table([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names), path)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    log_stream.start(log_stream.events(spark, f"{tmp_path}/events"), f"{tmp_path}/log", f"{tmp_path}/checkpoint").awaitTermination()
    got = {(r.day, r.term): r.searches for r in log_stream.read(spark, f"{tmp_path}/log").collect()}
    assert got == Counter((ts.date(), term) for _, _, ts, _, term, *_ in rows)


def test_log(spark):
    at = datetime(2024, 1, 5, 10)
    layout = "shop_id int, lang_id int, ts timestamp, request_id string, term_raw string, hits int, corrected string, first_look boolean"
    events = spark.createDataFrame([(1, 0, at, "r1", "Größe", 3, "", True), (1, 0, at, "r1", "groesse", 4, "", True), (1, 0, at.replace(hour=11), "r2", "GRÖSSE", 0, "", True), (1, 0, at, "r3", "<script>", 0, "", True), (1, 0, at, "r4", "x", 1, "", False), (1, 0, at, "r5", "!", 1, "", True)], layout)
    (row,) = reports.counted(events).collect()
    assert (row.term, row.term_raw, row.searches, row.hits) == ("groesse", "GRÖSSE", 2, 0)
    assert reports.zero_hits(reports.counted(events), 5).count() == 1


def test_relevance_counts_words_and_not_places(spark):
    from lodestone.operators import predicate

    rows = [("a", ["red"], ["red", "shoe", "redder"]), ("b", ["blue"], ["blue", "shoe"])]
    docs = spark.createDataFrame(rows, "id string, boost_tokens array<string>, search_tokens array<string>").selectExpr("*", "1 as shop_id", "0 as lang_id")
    stats = predicate.statistics(docs, SearchQuery(1, 0), ["red"])
    got = {r["id"]: r["s"] for r in docs.select("id", predicate.relevance(["red"], stats).alias("s")).collect()}
    idf = math.log10(2) ** 2
    assert got == {"a": pytest.approx(3 * idf + 2 * idf, abs=1e-6), "b": 0.0}


def test_saving_none_empties_a_scope_alone(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for shop in (1, 2):
        store.save_attributes(shop, [("a", True, True, "")])
        store.save_titles(shop, {("a", 0): "A"})
        store.save_rules(shop, 0, [Rule("both", "a", "b")])
    assert store.save_attributes(1, []) == store.save_titles(1, {}) == store.save_rules(1, 0, []) == 0
    assert not store.attributes(1) and not store.titles(1, 0) and not store.rules(1, 0)
    assert len(store.attributes(2)) == len(store.titles(2, 0)) == len(store.rules(2, 0)) == 1
    assert store.save_rules(3, 0, []) == 0


def documents_of(spark, rows):
    """Index documents of (shop, lang, group, words)."""
    from lodestone import schema

    layout = {f.name: f.dataType for f in spark.createDataFrame([], schema.DOCUMENTS).schema}
    df = spark.createDataFrame([(f"{s}{x}{g}", s, x, g, w, w.split()) for s, x, g, w in rows], "id string, shop_id int, lang_id int, group_id string, search_text string, search_tokens array<string>")
    df = df.selectExpr("*", "true as visible", "id as article_id", "search_text as title", "search_text as boost_text", "search_tokens as boost_tokens")
    for name, kind in layout.items():
        if name not in df.columns:
            df = df.withColumn(name, F.array().cast(kind) if kind.typeName() == "array" else F.lit(None).cast(kind))
    return df.select(*layout)


def test_parts_of_the_index_change_alone(spark, tmp_path):
    from lodestone.operators import doctor
    writer = IndexWriter(spark, str(tmp_path / "index"))
    links = spark.createDataFrame([("g1", "c1"), ("g2", "c1"), ("g2", "c2")], "object_id string, cat_id string")
    writer.begin([(1, 0), (2, 0)])
    writer.write(documents_of(spark, [(s, 0, g, f"red shoe{g}") for s in (1, 2) for g in ("g1", "g2")]))
    # A commit that breaks off and is done again changes nothing.
    staged = writer.staging
    writer._put("rollup", spark.createDataFrame([(1, 0, "x", "a", "v", "l")], "shop_id int, lang_id int, group_id string, attr_id string, value_id string, value string"))
    writer.resume(staged, [(1, 0), (2, 0)])
    writer.commit(links)
    first = writer.live()
    count = lambda df: sorted((r["shop_id"], r["count"]) for r in df.groupBy("shop_id").count().collect())
    assert count(writer.index().documents) == [(1, 2), (2, 2)] and count(writer.index().categories) == [(1, 3), (2, 3)]
    # One document goes: the other scope's parts stay in the version that wrote them.
    writer.delete(["10g2"])
    index = writer.index()
    assert count(index.documents) == [(1, 1), (2, 2)] and count(index.categories) == [(1, 1), (2, 3)]
    assert writer.manifest()["parts"]["documents"]["2/0"] == first and writer.versions() == {first, writer.live()}
    assert doctor.vacuum(writer) == [] and writer.delete(["none"]) is None
    assert {r["token"] for r in index.postings.where("shop_id = 1").collect()} == {"red", "shoeg1"}
    # New links without a new index; too few are refused, unless forced.
    few = links.where("cat_id = 'c2'")
    assert [r.skipped for r in writer.rebuild_categories(few)] == [True, True]
    assert count(writer.index().categories) == [(1, 1), (2, 3)]
    assert [r.skipped for r in writer.rebuild_categories(few, force=True)] == [False, False]
    index = writer.index()
    assert count(index.categories) == [(2, 1)] and {(r["id"], tuple(r["category_ids"])) for r in index.documents.collect()} == {("10g1", ()), ("20g1", ()), ("20g2", ("c2",))}
    # A run without assignments keeps the links, one for all scopes nothing else.
    writer.begin([])
    writer.write(documents_of(spark, [(2, 0, "g2", "blue")]))
    writer.commit()
    assert count(writer.index().documents) == [(2, 1)] and count(writer.index().categories) == [(2, 1)]
    left = doctor.vacuum(writer, remove=True)
    assert first in left and doctor.vacuum(writer) == [] and count(writer.index().documents) == [(2, 1)]
    levels = {f.check: f.level for f in doctor.storage(writer)}
    assert levels["freshness"] == "ok" and levels["leftovers"] == "ok" and sum(doctor.sizes(writer).values()) > 0


def test_postings_give_the_same_search(spark):
    docs = documents_of(spark, [(1, 0, f"g{i}", w) for i, w in enumerate(["red shoe", "redder shoe", "blue shoe of low price", "low cost price", "ab red"])])
    rules = [Rule("both", "cheap", "low price")]
    plain, fast = Engine(Index(docs, rules=rules), Settings()), Engine(Index(docs, rules=rules, postings=postings.build(docs)), Settings())
    for term in ("red", "red sho", "cheap", "cheap shoe", "ab", "ab red", "zzz", ""):
        q = SearchQuery(1, 0, term)
        assert sorted(r["id"] for r in plain.matching(q).collect()) == sorted(r["id"] for r in fast.matching(q).collect()), term
        assert plain.search(q).total == fast.search(q).total


def test_engines_answers_steps_and_reports(spark):
    import json
    from datetime import date

    from lodestone.operators import doctor
    from lodestone.operators.search import Locator
    from lodestone.plans import answers
    from lodestone.plans.model import Correction, Facet, FacetValue, SearchResult, SuggestResult

    docs = documents_of(spark, [(1, 0, f"g{i}", w) for i, w in enumerate(["red shoe", "red hat", "blue hat"])])
    locator = Locator(Index(docs), lambda shop: Settings(engine={1: "sql", 2: "none", 3: "odd"}[shop]))
    assert isinstance(locator.engine(1), Engine) and locator.engine(1) is locator.engine(1)
    assert all(isinstance(locator.engine(s), NullEngine) for s in (2, 3)) and isinstance(Locator(None, lambda s: Settings()).engine(1), NullEngine)
    measured, agreed = doctor.benchmark({"a": locator.engine(1), "b": locator.engine(1)}, doctor.scenarios(1, 0, ["red", "hat"], "c"), 1)
    assert {(m["engine"], m["scenario"]) for m in measured} == {(e, s) for e in "ab" for s in ("term red", "term hat", "category c")}
    assert {r["query"]: (r["shared"], r["same_place"]) for r in agreed.collect()}["term red"] == (2, 2)
    facet = Facet("size", "Size", (FacetValue("v", "Größe", 2, True),))
    result = SearchResult(SearchQuery(1, 0), 3, ("g1",), (facet,), Correction("rde", "red", 1, 1, True, 2))
    told = json.loads(answers.search(result, 1))
    assert told["facets"][0]["truncated"] and told["facets"][0]["values"][0]["label"] == "Größe" and told["correction"]["corrected"] == "red" and told["ids"] == ["g1"]
    assert json.loads(answers.facets(result, 5))["facets"][0]["truncated"] is False
    assert json.loads(answers.suggest(SuggestResult(("red",), ("g1",)), {"g1": "Red"}))["products"] == [{"id": "g1", "title": "Red"}]
    assert rebuild.next_size(200, 1) == 400 and rebuild.next_size(200, 8) == 100 and rebuild.next_size(60, 100) == 50 and rebuild.progress(50, 100, 10) == (5.0, 10.0) and rebuild.progress(0, 9, 1)[1] is None
    assert doctor.bytes_text(1536) == "1.5 KiB" and doctor.ms_text(1500) == "1.50 s"
    rows = [(1, 0, date(2024, 1, d), t, t, n, h, None, None) for d, t, n, h in ((1, "red", 3, 1), (2, "blue", 2, 0), (2, "<b>", 1, 0), (9, "late", 5, 5))]
    log = spark.createDataFrame(rows, "shop_id int, lang_id int, day date, term string, term_raw string, searches long, hits int, corrected string, last_seen timestamp")
    found = reports.last_days(log, 1, 0, 2, date(2024, 1, 2), limit=7)
    assert (found["searches"], found["zero_searches"], found["noise_terms"], found["zero_share"]) == (5, 2, 1, 40.0)
    assert [r["term"] for r in found["top"]] == ["red", "blue"] and [r["term"] for r in found["without_hits"]] == ["blue"] and len(found["chart"]) == 2
