"""Searches by stored postings give what reading every document gives, and read no text for it."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import postings, reports
from lodestone.operators.search import Engine
from lodestone.operators.synonyms import Rule
from lodestone.plans.model import Index, SearchQuery
from lodestone.settings import Settings
from lodestone.sources import staging

from test_engine import documents_of

RULES = [Rule("both", "cheap", "low price, bargain bin"), Rule("oneway", "xl", "extra large"), Rule("both", "ab", "low b")]
TERMS = ["red", "re", "red sho", "cheap", "cheap shoe", "low price", "xl", "extra large", "ab", "b", "ab red", "zzz", "", "red red", "price low", "und", "38 red", "bin"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(8)
    vocabulary = ["red", "redder", "shoe", "shoes", "low", "price", "bargain", "bin", "xl", "extra", "large", "ab", "b", "b38", "bad"]
    rows = [(s, 0, f"g{i % 25}x{i}", " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 9)))) for s in (1, 2) for i in range(60)]
    return staging.staged(documents_of(spark, rows).withColumn("group_id", F.substring_index("group_id", "x", 1)).withColumn("boost_tokens", F.slice("search_tokens", 1, 3)).withColumn("boost_text", F.array_join("boost_tokens", " ")), "docs")


@pytest.fixture(scope="module")
def engines(docs):
    stored = [staging.staged(f(docs), "stored") for f in (postings.build, postings.grams, postings.sizes)]
    return Engine(Index(docs, rules=RULES), Settings()), Engine(Index(docs, None, None, None, RULES, *stored), Settings()), Engine(Index(docs, None, None, None, RULES, stored[0]), Settings())


@pytest.mark.parametrize("term", TERMS)
def test_same_documents_pages_and_scores(engines, term):
    q = SearchQuery(1, 0, term, limit=100)
    plain, *fast = engines
    ids = sorted(r["id"] for r in plain.matching(q).collect())
    page = [(r["group_id"], r["score"]) for r in plain.page(q).collect()]
    for engine in fast:
        assert sorted(r["id"] for r in engine.matching(q).collect()) == ids
        assert [(r["group_id"], pytest.approx(r["score"], abs=1e-5)) for r in engine.page(q).collect()] == page


@pytest.mark.parametrize("size", [2, 4, 5])
def test_any_least_length_of_words(docs, size):
    settings = Settings(min_token_size=size)
    stored = [f(docs) for f in (postings.build, postings.grams, postings.sizes)]
    plain, fast = Engine(Index(docs, rules=RULES), settings), Engine(Index(docs, None, None, None, RULES, *stored), settings)
    for term in ("red", "shoe", "ab", "pri sho", "cheap"):
        q = SearchQuery(2, 0, term)
        assert sorted(r["id"] for r in plain.matching(q).collect()) == sorted(r["id"] for r in fast.matching(q).collect()), term


def test_no_text_is_read(spark, engines):
    """The documents' scan holds ids alone, and the words reach the scan of the postings."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    for term in ("low price", "red sho", "b", "cheap shoe"):
        plan = plan_of(engines[1].matching(SearchQuery(1, 0, term)).select("id", "group_id"))
        assert "search_text" not in plan and "boost_text" not in plan and "_tokens" not in plan
        pushed = [x for x in plan.split("PushedFilters")[1:] if "StringStartsWith(token" in x or "EqualTo(token" in x or "EqualTo(gram" in x]
        assert pushed, plan
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_relevance_scans_documents_once(engines):
    plan = plan_of(engines[1].page(SearchQuery(1, 0, "red sho")))
    assert plan.split("+- == Initial Plan ==")[0].count("group_id#") and "search_tokens" not in plan and "boost_tokens" not in plan


def test_spellings_are_judged_once(spark):
    rows = [(1, 0, "2024-01-05 10:00:00", f"r{i}", t, 1, "", True) for i, t in enumerate(["red", "Red", "<b>", "red"])]
    events = spark.createDataFrame(rows, "shop_id int, lang_id int, ts string, request_id string, term_raw string, hits int, corrected string, first_look boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    log = reports.counted(events)
    assert "rlike" not in plan_of(log).lower()
    assert [(r["term"], r["searches"]) for r in log.collect()] == [("red", 3)]
