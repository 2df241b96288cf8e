"""One query for each operator of the engine over the benchmark tables, with the same rows in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import color, distance, keys, noise, periods, phonetics, text
from lodestone.operators import agreement, categories, cells, correction, dictionary, documents, facets, postings, pricing, ranking, rebuild, reports, rollup, settings_diff, suggest
from lodestone.operators.search import Engine, in_rank_order
from lodestone.operators.synonyms import Rule
from lodestone.plans.model import FacetFilter, Index, SearchQuery
from lodestone.settings import Settings
from lodestone.sources import staging, store
from lodestone.sources.catalog import STAND_IN, StandIn

NOW = datetime(2026, 1, 1)
SETTINGS = Settings(facet_attributes=("type", "size", "colour", "material"), display_modes={"colour": "groupedcolortile"})
RULES = [Rule("both", "red", "crimson, ruby"), Rule("oneway", "small thing", "widget"), Rule("both", "economy", "cheap, low price")]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# --- SQL of the other side -------------------------------------------------------------------------------

SHOP_SQL = {n: sql.replace("{", "").replace("}", "") for n, sql in STAND_IN.items()}


def shop(*names: str) -> str:
    return ", ".join(f"{n} AS ({SHOP_SQL[n]})" for n in names)


def norm(x: str) -> str:
    for a, b in text.UMLAUTS.items():
        x = f"replace({x}, '{a}', '{b}')"
    return f"trim(regexp_replace(translate(lower({x}), '{text.ACCENTED}', '{text.PLAIN}'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)


def toks(x: str, least: int = 2) -> str:
    """Distinct tokens in order."""
    split = f"list_filter(string_split({norm(x)}, ' '), lambda w: length(w) >= {least} AND NOT list_contains([{STOP}], w))"
    return f"list_filter({split}, lambda w, i: list_position({split}, w) = i)"


HEX = "(CASE WHEN regexp_matches({0}, '^#?[0-9A-Fa-f]{{3}}$') THEN regexp_replace(regexp_replace({0}, '^#', ''), '(.)', '\\1\\1', 'g') WHEN regexp_matches({0}, '^#?[0-9A-Fa-f]{{6}}') THEN substr(regexp_replace({0}, '^#', ''), 1, 6) END)"


def family_sql(source: str) -> str:
    """CTEs after ``source`` (columns code): family(code, family)."""
    return f"""
rgb AS (SELECT code, ('0x' || substr(h, 1, 2))::INT / 255.0::DOUBLE AS r, ('0x' || substr(h, 3, 2))::INT / 255.0::DOUBLE AS g, ('0x' || substr(h, 5, 2))::INT / 255.0::DOUBLE AS b
        FROM (SELECT code, {HEX.format('code')} AS h FROM {source})),
hsl0 AS (SELECT *, greatest(r, g, b) - least(r, g, b) AS c, (greatest(r, g, b) + least(r, g, b)) / 2 AS l FROM rgb),
hsl AS (SELECT code, r, c, l, CASE WHEN c = 0 OR 1 - abs(2 * l - 1) = 0 THEN 0 ELSE c / (1 - abs(2 * l - 1)) END AS s,
        CASE WHEN c = 0 THEN 0 WHEN greatest(r, g, b) = r THEN fmod(360 + 60 * (g - b) / c, 360) WHEN greatest(r, g, b) = g THEN 60 * ((b - r) / c + 2) ELSE 60 * ((r - g) / c + 4) END AS h FROM hsl0),
family AS (SELECT code, CASE WHEN r IS NULL THEN NULL WHEN l <= 0.16 THEN 'schwarz' WHEN l >= 0.93 AND c <= 0.10 THEN 'weiss' WHEN c <= 0.10 THEN 'grau' WHEN l >= 0.90 AND c <= 0.22 THEN 'beige'
        WHEN (h < 15 OR h >= 330) AND s <= 0.35 AND l >= 0.55 THEN 'beige' WHEN (h < 15 OR h >= 330) AND l >= 0.80 AND s <= 0.90 THEN CASE WHEN h < 15 THEN 'beige' ELSE 'rosa' END
        WHEN h >= 330 THEN CASE WHEN s >= 0.60 AND l <= 0.55 THEN 'rot' ELSE 'rosa' END WHEN h < 15 THEN 'rot'
        WHEN h < 45 THEN CASE WHEN l >= 0.75 THEN 'beige' WHEN s >= 0.75 AND l >= 0.45 THEN 'orange' ELSE 'braun' END
        WHEN h < 70 THEN CASE WHEN l >= 0.85 AND s <= 0.60 THEN 'beige' ELSE 'gelb' END
        WHEN h < 165 THEN 'gruen' WHEN h < 255 THEN 'blau' WHEN h < 290 THEN 'lila' ELSE CASE WHEN l <= 0.35 THEN 'lila' ELSE 'rosa' END END AS family FROM hsl)"""


SWATCHES = " ".join(f"WHEN '{k}' THEN '{label}_{swatch}'" for k, (label, swatch) in color.FAMILIES.items())
ALL_SHOP = shop("articles", "long_desc", "manufacturers", "attributes", "object2attribute", "categories", "object2category", "discounts", "object2discount", "shop_prices")

INHERITED_SQL = """
base AS (
  SELECT a.id, a.parent_id, CASE WHEN a.parent_id <> '' THEN a.parent_id ELSE a.id END AS group_id,
         coalesce(nullif(a.title, ''), p.title, '') AS title, coalesce(nullif(a.artnum, ''), p.artnum, '') AS artnum, coalesce(nullif(a.ean, ''), p.ean, '') AS ean,
         coalesce(nullif(a.mpn, ''), p.mpn, '') AS mpn, coalesce(nullif(a.short_desc, ''), p.short_desc, '') AS short_desc,
         coalesce(nullif(a.manufacturer_id, ''), p.manufacturer_id, '') AS manufacturer_id,
         a.var_select, a.sold, a.inserted, a.price AS list_price, a.stock, a.stock_flag, a.active
  FROM articles a LEFT JOIN articles p ON p.id = a.parent_id WHERE a.active = 1 AND (a.parent_id <> '' OR a.var_count = 0)),
full_base AS (
  SELECT b.*, coalesce(m.title, '') AS brand, coalesce(nullif(l.long_desc, ''), pl.long_desc, '') AS long_desc,
         CASE WHEN s.price IS NOT NULL AND s.price <> 0 THEN s.price ELSE b.list_price END AS price
  FROM base b LEFT JOIN manufacturers m ON m.id = b.manufacturer_id LEFT JOIN long_desc l ON l.article_id = b.id
  LEFT JOIN long_desc pl ON pl.article_id = b.parent_id LEFT JOIN shop_prices s ON s.article_id = b.id AND s.shop_id = 1)"""

PRICE_SQL = """
hit AS (
  SELECT DISTINCT f.id, d.id AS did, d.amount, d.kind, d.sort FROM full_base f JOIN object2discount o ON
    (o.kind = 'article' AND (o.object_id = f.id OR (f.parent_id <> '' AND o.object_id = f.parent_id)))
    OR (o.kind = 'category' AND o.object_id IN (SELECT c.cat_id FROM object2category c WHERE c.object_id = f.group_id))
  JOIN discounts d ON d.id = o.discount_id
  WHERE d.active = 1 OR (d.active = 0 AND d.active_from < TIMESTAMP '2026-01-01' AND d.active_to > TIMESTAMP '2026-01-01')),
flags AS (SELECT id, bool_or(did = 'd1') AS ten, bool_or(did = 'd2') AS five FROM hit GROUP BY id),
priced AS (SELECT f.id, (f.price * CASE WHEN ten THEN 1 - 10.0::DOUBLE / 100 ELSE 1 END) - CASE WHEN five THEN 5 ELSE 0 END AS price FROM full_base f LEFT JOIN flags USING (id))"""

PATH_SQL = """
path AS (SELECT c.id, CASE WHEN p.title IS NULL THEN c.title ELSE p.title || ' > ' || c.title END AS path FROM categories c LEFT JOIN categories p ON p.id = c.parent_id AND p.active WHERE c.active),
cats AS (SELECT o.object_id AS group_id, list(o.cat_id ORDER BY o.cat_id) AS category_ids, list(p.path ORDER BY o.cat_id) FILTER (p.path IS NOT NULL) AS category_paths
         FROM object2category o LEFT JOIN path p ON p.id = o.cat_id GROUP BY o.object_id)"""

ATTR_SQL = f"""
own AS (SELECT o.object_id, o.attr_id, trim(o.value) AS value, o.pos FROM object2attribute o JOIN attributes a ON a.id = o.attr_id WHERE trim(o.value) <> ''),
both_attrs AS (
  SELECT b.id, 0 AS src, o.pos, o.attr_id, o.value FROM base b JOIN own o ON o.object_id = b.parent_id
  UNION ALL SELECT b.id, 1, o.pos, o.attr_id, o.value FROM base b JOIN own o ON o.object_id = b.id),
codes AS (SELECT DISTINCT value, regexp_extract(value, '_(#[0-9A-Fa-f]{{3,8}})$', 1) AS code FROM own WHERE attr_id = 'colour'),
{family_sql("codes")},
regrouped AS (SELECT DISTINCT c.value, CASE f.family {SWATCHES} END AS grouped FROM codes c JOIN family f ON f.code = c.code),
attrs AS (SELECT x.id, x.src, x.pos, x.attr_id, coalesce(CASE WHEN x.attr_id = 'colour' THEN r.grouped END, x.value) AS value FROM both_attrs x LEFT JOIN regrouped r ON x.attr_id = 'colour' AND r.value = x.value),
attr_rows AS (SELECT id, attr_id, md5({norm("value")}) AS value_id, arg_min(value, src * 100 + pos) AS value FROM attrs GROUP BY id, attr_id, md5({norm("value")}))"""

DOCS_SQL = f"""
texts AS (
  SELECT f.*, p.price AS final_price, {norm("concat_ws(' ', f.title, f.brand, f.var_select, f.artnum, f.ean, f.mpn)")} AS boost,
         coalesce(c.category_ids, []) AS category_ids, coalesce(c.category_paths, []) AS category_paths,
         (SELECT string_agg(x.value, ' ' ORDER BY src, pos) FROM both_attrs x WHERE x.id = f.id) AS attr_text
  FROM full_base f JOIN priced p USING (id) LEFT JOIN cats c ON c.group_id = f.group_id),
docs AS (
  SELECT md5(id || '_1_0') AS id, id AS article_id, parent_id, group_id, active = 1 AND (coalesce(stock_flag, 1) <> 2 OR stock > 0) AS visible, title, artnum, ean, mpn, brand, manufacturer_id,
         category_ids, category_paths, {norm("concat_ws(' ', boost, array_to_string(category_paths, ' '), coalesce(attr_text, ''), short_desc, regexp_replace(long_desc, '<[^>]*>', '', 'g'))")} AS search_text,
         substr(boost, 1, 1024) AS boost_text, CAST(final_price AS DECIMAL(9,2)) AS price, stock, sold,
         CASE WHEN trim(inserted) <> '' AND NOT starts_with(trim(inserted), '0000-00-00') THEN CAST(inserted AS TIMESTAMP) END AS insert_date
  FROM texts),
d AS (SELECT *, string_split(search_text, ' ') AS st, string_split(boost_text, ' ') AS bt FROM docs),
facet AS (SELECT md5(id || '_1_0') AS id, attr_id, value_id, value FROM attr_rows)"""

INDEX = f"WITH {ALL_SHOP}, {INHERITED_SQL}, {PRICE_SQL}, {PATH_SQL}, {ATTR_SQL}, {DOCS_SQL}"


def has(word: str, field: str = "st") -> str:
    return f"length(list_filter({field}, lambda t: starts_with(t, '{word}'))) > 0"


# --- the engine over the stand-in ------------------------------------------------------------------------


_INDEXES: dict[tuple, DataFrame] = {}


def files_of(spark: SparkSession, folder: str) -> tuple:
    """Name, size and time of the tables in a folder: an index made from others is made anew."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in found))


def once(spark: SparkSession, name: str, folder: str, settings: Settings, make: Callable[[], DataFrame]) -> DataFrame:
    """A derived table, written when it is first asked for: an index is built once and searched often."""
    key = (spark.sparkContext.applicationId, name, folder, repr(settings), files_of(spark, folder))
    if key not in _INDEXES:
        _INDEXES[key] = staging.staged(make(), name)
    return _INDEXES[key]


def built(spark: SparkSession, folder: str, settings: Settings = SETTINGS) -> tuple[StandIn, DataFrame]:
    tables = StandIn(spark, folder)
    return tables, once(spark, "documents", folder, settings, lambda: documents.build(tables, 1, 0, settings, NOW))


def dictionary_of(spark: SparkSession, folder: str) -> DataFrame:
    return once(spark, "dictionary", folder, SETTINGS, lambda: dictionary.build(built(spark, folder)[1]))


def rollup_of(spark: SparkSession, folder: str) -> DataFrame:
    return once(spark, "rollup", folder, SETTINGS, lambda: rollup.build(rollup.attribute_rows(built(spark, folder)[1])))


def engine(spark: SparkSession, folder: str, rules: list[Rule] | None = None, derived: bool = False, settings: Settings = SETTINGS) -> Engine:
    tables, docs = built(spark, folder, settings)
    make = {
        "categories": lambda: categories.links(docs, tables["object2category"]), "postings": lambda: postings.build(docs), "grams": lambda: postings.grams(docs),
        "sizes": lambda: postings.sizes(docs), "cells": lambda: cells.build(docs),
    }
    later = {name: lambda name=name: once(spark, name, folder, settings, make[name]) for name in make}
    if derived:
        later |= {"rollup": lambda: rollup_of(spark, folder), "dictionary": lambda: dictionary_of(spark, folder)}
        later["words"] = lambda: once(spark, "words", folder, settings, lambda: cells.words(rollup_of(spark, folder), later["cells"]()))
    return Engine(Index(docs, rules=rules or [], later=later), settings)


def groups(found: DataFrame) -> DataFrame:
    return found.groupBy("group_id").agg(F.count("*").alias("variants"))


# --- scalar functions ------------------------------------------------------------------------------------


@query("text_normalize", f"SELECT doc_id, md5({norm('text')}) AS normal FROM documents")
def _(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", F.md5(text.normalize(F.col("text"))).alias("normal"))


@query("text_tokenize", f"SELECT id, array_to_string({toks('title')}, ' ') AS tokens, length({toks('title', 3)}) AS long_tokens FROM (SELECT 'p' || p_partkey AS id, p_name || ' ' || p_type || ' und ' || p_brand || ' ' || p_name AS title FROM part)")
def _(spark, folder):
    title = F.concat_ws(" ", "p_name", "p_type", F.lit("und"), "p_brand", "p_name")
    return spark.read.parquet(f"{folder}/part.parquet").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.array_join(text.tokenize(title), " ").alias("tokens"), F.size(text.tokenize(title, 3)).cast("long").alias("long_tokens"))


@query("text_strip_markup", "SELECT page_id, md5(regexp_replace(html, '<[^>]*>', '', 'g')) AS plain FROM pages")
def _(spark, folder):
    return spark.read.parquet(f"{folder}/pages.parquet").select("page_id", F.md5(text.strip_markup(F.col("html"))).alias("plain"))


@query("text_strip_operators", "SELECT page_id, translate(url, '+-><()~*\"@', '          ') AS bare FROM pages")
def _(spark, folder):
    return spark.read.parquet(f"{folder}/pages.parquet").select("page_id", text.strip_operators(F.col("url")).alias("bare"))


@query("ids", f"""SELECT p_partkey, md5(concat_ws('_', p_partkey, 1, 0)) AS document_id, md5({norm('p_type')}) AS value_id, md5(concat_ws('_', 1, 0, p_name, 'type', p_type)) AS rollup_id,
    md5(concat_ws('_', 1, 0, p_name, p_brand)) AS link_id, md5(concat_ws('_', p_name, 1, 0)) AS term_id, md5(p_name || 'type' || p_type) AS row_id FROM part""")
def _(spark, folder):
    shop_, lang = F.lit(1), F.lit(0)
    return spark.read.parquet(f"{folder}/part.parquet").select(
        "p_partkey", keys.document_id(F.col("p_partkey"), shop_, lang).alias("document_id"), keys.value_id(F.col("p_type")).alias("value_id"), keys.rollup_id(shop_, lang, F.col("p_name"), F.lit("type"), F.col("p_type")).alias("rollup_id"),
        keys.category_link_id(shop_, lang, F.col("p_name"), F.col("p_brand")).alias("link_id"), keys.dictionary_id(F.col("p_name"), shop_, lang).alias("term_id"), keys.attribute_row_id(F.col("p_name"), F.lit("type"), F.col("p_type")).alias("row_id"),
    )


@query("color_classify", f"WITH codes AS (SELECT DISTINCT '#' || substr(md5(p_name || p_size), 1, CASE WHEN p_size % 3 = 0 THEN 3 ELSE 6 END) AS code FROM part), {family_sql('codes')} SELECT code, family, CASE family {SWATCHES} END AS grouped FROM family")
def _(spark, folder):
    code = F.concat(F.lit("#"), F.substring(F.md5(F.concat("p_name", "p_size")), F.lit(1), F.when(F.col("p_size") % 3 == 0, 3).otherwise(6)))
    codes = spark.read.parquet(f"{folder}/part.parquet").select(code.alias("code")).distinct()
    return codes.select("code", color.classify(F.col("code")).alias("family"), color.group(F.concat(F.lit("Any_Name_"), "code")).alias("grouped"))


@query("insert_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS inserted, CASE WHEN o_orderkey % 5 <> 0 THEN epoch(o_orderdate)::BIGINT ELSE -1 END AS seconds FROM orders")
def _(spark, folder):
    raw = F.when(F.col("o_orderkey") % 5 == 0, F.when(F.col("o_orderkey") % 10 == 0, "").otherwise("0000-00-00 00:00:00")).otherwise(F.date_format("o_orderdate", " yyyy-MM-dd HH:mm:ss "))
    return spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey", keys.insert_date(raw).alias("inserted"), F.coalesce(keys.insert_seconds(keys.insert_date(raw)), F.lit(-1)).alias("seconds"))


# The bound and the sieve of a pair; DuckDB's distance differs from ours only for letters inserted between swapped ones, beyond these words.
OSA_SQL = """WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part)
  SELECT a.w, b.w AS v, least(damerau_levenshtein(a.w, b.w), 3)::INT AS distance, levenshtein(a.w, b.w) <= 4 AS sifted FROM w a JOIN w b ON left(a.w, 1) = left(b.w, 1) AND a.w < b.w"""


@query("osa_distance", OSA_SQL)
def _(spark, folder):
    words = spark.read.parquet(f"{folder}/part.parquet").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    other = words.withColumnRenamed("w", "v")
    pairs = words.join(other, (F.substring("w", 1, 1) == F.substring("v", 1, 1)) & (F.col("w") < F.col("v")))
    return pairs.select("w", "v", distance.osa_within("w", "v", F.lit(2)).alias("distance"), distance.may_be_within(F.col("w"), F.col("v"), 2).alias("sifted"))


def sound_sql(w: str) -> str:
    """The phonetic code of a word."""
    among = lambda x, letters: f"{x} IN ({', '.join(map(repr, letters))})"
    cases = []
    for letters, ahead, follow, code in phonetics.RULES:
        fits = [among(f"{w}[i]", letters)]
        if ahead is not None:
            fits.append(f"i > 1 AND {among(f'{w}[i - 1]', ahead)}" if ahead else f"NOT (i > 1 AND {w}[i - 1] BETWEEN 'a' AND 'z')")
        if follow is not None:
            fits.append(f"i < length({w}) AND {among(f'{w}[i + 1]', follow)}")
        cases.append(f"WHEN {' AND '.join(fits)} THEN '{code}'")
    raw = f"string_split(array_to_string(list_transform(range(1, length({w}) + 1), lambda i: CASE {' '.join(cases)} ELSE '' END), ''), '')"
    once = f"list_transform([{raw}], lambda d: array_to_string(list_filter(d, lambda c, k: k = 1 OR d[k - 1] <> c), ''))[1]"
    return f"list_transform([{once}], lambda s: s[1] || replace(s[2:], '0', ''))[1]"


@query("phonetic_codes", f"WITH w AS (SELECT DISTINCT unnest({toks("p_name || ' ' || p_type")}) AS word FROM part) SELECT word, {sound_sql('word')} AS code FROM w")
def _(spark, folder):
    words = spark.read.parquet(f"{folder}/part.parquet").select(F.explode(text.tokenize(F.concat_ws(" ", "p_name", "p_type"))).alias("word")).distinct()
    return words.select("word", phonetics.encode(F.col("word")).alias("code"))


# --- catalogue and index ---------------------------------------------------------------------------------


@query("catalog_parent_fallback", f"WITH {ALL_SHOP}, {INHERITED_SQL} SELECT id, group_id, title, artnum, ean, mpn, short_desc, brand, long_desc, price FROM full_base")
def _(spark, folder):
    t = StandIn(spark, folder)
    return documents.inherited(t["articles"], t["manufacturers"], t["long_desc"], t["shop_prices"]).select("id", "group_id", "title", "artnum", "ean", "mpn", "short_desc", "brand", "long_desc", "price")


@query("catalog_visible", f"WITH {shop('articles')} SELECT id, active = 1 AND (coalesce(stock_flag, 1) <> 2 OR stock > 0) AS visible, active = 1 AS unmanaged FROM articles WHERE active = 1 AND (parent_id <> '' OR var_count = 0)")
def _(spark, folder):
    a = documents.searchable_articles(StandIn(spark, folder)["articles"])
    return a.select("id", documents.visible(F.col("active"), F.col("stock"), F.col("stock_flag")).alias("visible"), documents.visible(F.col("active"), F.col("stock"), F.col("stock_flag"), False).alias("unmanaged"))


@query("catalog_effective_price", f"WITH {ALL_SHOP}, {INHERITED_SQL}, {PRICE_SQL} SELECT id AS article_id, round(price, 6) AS price FROM priced")
def _(spark, folder):
    t = StandIn(spark, folder)
    rows = documents.inherited(t["articles"], t["manufacturers"], t["long_desc"], t["shop_prices"])
    links = t["object2category"].withColumnRenamed("object_id", "group_id")
    return pricing.effective(rows, t["object2discount"], t["discounts"], links, NOW).withColumn("price", F.round("price", 6))


@query("catalog_category_path", f"WITH {shop('categories')}, path AS (SELECT c.id, CASE WHEN p.title IS NULL THEN c.title ELSE p.title || ' > ' || c.title END AS path FROM categories c LEFT JOIN categories p ON p.id = c.parent_id AND p.active WHERE c.active) SELECT * FROM path")
def _(spark, folder):
    return categories.paths(StandIn(spark, folder)["categories"]).select("id", "path")


@query("catalog_category_path_recursive", ORACLES["catalog_category_path"])
def _(spark, folder):
    return categories.paths_sql(spark, StandIn(spark, folder)["categories"]).select("id", "path")


@query("category_breadcrumb", f"WITH {shop('categories')} SELECT c.id, coalesce(p.title, '') AS breadcrumb FROM categories c LEFT JOIN categories p ON p.id = c.parent_id AND p.active WHERE c.active")
def _(spark, folder):
    return categories.breadcrumb(spark, StandIn(spark, folder)["categories"])


@query("documents_build", INDEX + " SELECT id, article_id, parent_id, group_id, visible, title, artnum, ean, mpn, brand, manufacturer_id, array_to_string(category_ids, ',') AS category_ids, array_to_string(category_paths, ' %% ') AS category_paths, search_text, boost_text, price::DOUBLE AS price, stock, sold::INT AS sold, insert_date FROM docs")
def _(spark, folder):
    docs = documents.build(StandIn(spark, folder), 1, 0, SETTINGS, NOW)
    return docs.select(
        "id", "article_id", "parent_id", "group_id", "visible", "title", "artnum", "ean", "mpn", "brand", "manufacturer_id", F.array_join("category_ids", ",").alias("category_ids"), F.array_join("category_paths", " %% ").alias("category_paths"),
        "search_text", "boost_text", F.col("price").cast("double").alias("price"), "stock", "sold", "insert_date",
    )


@query("attr_facet_copy", INDEX + " SELECT id, attr_id, value_id, value FROM facet")
def _(spark, folder):
    return rollup.attribute_rows(built(spark, folder)[1]).select("id", "attr_id", "value_id", "value")


@query("attr_own_only", f"WITH {ALL_SHOP}, {INHERITED_SQL}, {PRICE_SQL}, {PATH_SQL}, {ATTR_SQL} SELECT md5(id || '_1_0') AS id, count(DISTINCT attr_id || md5({norm('value')})) AS n FROM attrs WHERE src = 1 GROUP BY id")
def _(spark, folder):
    _, docs = built(spark, folder, replace(SETTINGS, inherit_attributes=False))
    return rollup.attribute_rows(docs).groupBy("id").agg(F.count("*").alias("n"))


@query("attr_fields", INDEX + " SELECT id, attr_id AS field, count(*) AS n, string_agg(value_id, ',' ORDER BY value_id) AS value_ids FROM facet GROUP BY id, attr_id")
def _(spark, folder):
    flat = documents.flattened(built(spark, folder)[1])
    fields = flat.select("id", F.explode("facet_ids").alias("field", "ids"))
    return fields.select("id", F.substring("field", 3, 100).alias("field"), F.size("ids").cast("long").alias("n"), F.array_join(F.array_sort("ids"), ",").alias("value_ids"))


LABELS_SQL = """
used AS (SELECT attr_id, value_id, value, count(*) AS n FROM facet GROUP BY ALL),
label AS (SELECT attr_id, value_id, value FROM (SELECT *, row_number() OVER (PARTITION BY attr_id, value_id ORDER BY CASE WHEN value = upper(value) OR value = lower(value) THEN 1 ELSE 0 END, n DESC, value) AS k FROM used) WHERE k = 1)"""


@query("rollup_label_choice", INDEX + f", {LABELS_SQL} SELECT * FROM label")
def _(spark, folder):
    return rollup.labels(rollup.attribute_rows(built(spark, folder)[1])).select("attr_id", "value_id", "value")


@query("rollup_build", INDEX + f", {LABELS_SQL} SELECT DISTINCT docs.group_id, facet.attr_id, facet.value_id, label.value FROM docs JOIN facet USING (id) JOIN label ON label.attr_id = facet.attr_id AND label.value_id = facet.value_id WHERE visible")
def _(spark, folder):
    return rollup.build(rollup.attribute_rows(built(spark, folder)[1])).select("group_id", "attr_id", "value_id", "value")


@query("category_links", INDEX + " SELECT DISTINCT docs.group_id, o.cat_id FROM docs JOIN object2category o ON o.object_id = docs.group_id")
def _(spark, folder):
    t, docs = built(spark, folder)
    return categories.links(docs, t["object2category"]).select("group_id", "cat_id")


@query("index_status", INDEX + " SELECT count(*) AS documents, sum(visible::INT)::BIGINT AS shown, count(DISTINCT group_id) AS products FROM docs")
def _(spark, folder):
    from lodestone.operators import doctor

    return doctor.status(Index(built(spark, folder)[1])).select("documents", "shown", "products")


# --- searching -------------------------------------------------------------------------------------------

Q = SearchQuery(1, 0)


def value_ids(*labels: str) -> tuple[str, ...]:
    import hashlib

    return tuple(hashlib.md5(text.normalized(x).encode()).hexdigest() for x in labels)


TYPES = value_ids("PROMO", "SMALL")
SIZES = value_ids(*(str(i) for i in range(1, 11)))
GROUPED = "SELECT group_id, count(*) AS variants FROM d WHERE visible AND {} GROUP BY group_id"


def facet_sql(attribute: str, ids: tuple[str, ...]) -> str:
    return f"EXISTS (SELECT 1 FROM facet f WHERE f.id = d.id AND f.attr_id = '{attribute}' AND f.value_id IN ({', '.join(repr(i) for i in ids)}))"


def search_case(name: str, q: SearchQuery, where: str, rules: list[Rule] | None = None):
    @query(name, INDEX + " " + GROUPED.format(where))
    def _(spark, folder):
        return groups(engine(spark, folder, rules).matching(q))


search_case("search_prefix", replace(Q, term="Re"), "contains(boost_text, 're')")
search_case("search_prefix_long", replace(Q, term="pro sma"), f"{has('pro')} AND {has('sma')}")
search_case("search_phrase", replace(Q, term="low price"), f"({has('economy')} OR {has('cheap')} OR contains(' ' || search_text || ' ', ' low price '))", RULES)
search_case("search_short_token", replace(Q, term="gr 38 art"), f"contains(boost_text, 'gr') AND contains(boost_text, '38') AND {has('art')}")
search_case("search_synonym_and_or", replace(Q, term="crimson widget"), f"({has('red')} OR {has('crimson')} OR {has('ruby')}) AND {has('widget')}", RULES)
search_case("search_stopword_only", replace(Q, term="und !!!"), "true")
search_case("filter_category", replace(Q, category="n3"), "EXISTS (SELECT 1 FROM object2category o WHERE o.object_id = d.group_id AND o.cat_id = 'n3')")
search_case("filter_manufacturer", replace(Q, manufacturer="Brand#3"), "manufacturer_id = 'Brand#3'")
search_case("filter_price_range", replace(Q, price_from=0.0, price_to=950.5), "price >= 0 AND price <= 950.5")
search_case("filter_facet_and_or", replace(Q, filters=(FacetFilter("type", TYPES), FacetFilter("size", SIZES))), f"{facet_sql('type', TYPES)} AND {facet_sql('size', SIZES)}")


@query("count_groups", INDEX + f" SELECT count(DISTINCT group_id) AS total FROM d WHERE visible AND {has('pro')}")
def _(spark, folder):
    return engine(spark, folder).matching(replace(Q, term="pro")).agg(F.countDistinct("group_id").alias("total"))


@query("postings_prefix", INDEX + f" SELECT id FROM d WHERE {has('sma')}")
def _(spark, folder):
    docs = built(spark, folder)[1]
    return documents.by_postings(docs, once(spark, "postings", folder, SETTINGS, lambda: postings.build(docs)), "sma").select("id")


ORDERS = {
    "price_asc": ("min(price)", "value", "ASC"), "price_desc": ("max(price)", "value", "DESC"), "title_asc": ("min(title)", "value", "ASC"),
    "newest": ("max(insert_date)", "value", "DESC NULLS LAST"), "bestseller": ("max(sold)", "value", "DESC"),
}
for _sort, (_agg, _, _dir) in ORDERS.items():

    def _sorted(sort):
        def run(spark, folder):
            page = engine(spark, folder).page(replace(Q, term="pro", sort=sort, limit=10, offset=5))
            return page.select("group_id")

        return run

    query(f"sort_{_sort}", INDEX + f" SELECT group_id FROM d WHERE visible AND {has('pro')} GROUP BY group_id ORDER BY {_agg} {_dir}, group_id LIMIT 10 OFFSET 5")(_sorted(_sort))


@query("sort_no_term", INDEX + " SELECT group_id FROM d WHERE visible GROUP BY group_id ORDER BY max(sold) DESC, min(title), group_id LIMIT 10")
def _(spark, folder):
    return engine(spark, folder).page(replace(Q, limit=10)).select("group_id")


def tf(word: str, field: str) -> str:
    return f"length(list_filter({field}, lambda t: starts_with(t, '{word}')))"


RELEVANCE_SQL = f"""
stats AS (SELECT count(*)::DOUBLE AS n, {", ".join(f"sum(({tf(w, f)} > 0)::INT)::DOUBLE AS {f}_{w}" for f in ("bt", "st") for w in ("pro", "sma"))} FROM d),
scored AS (SELECT group_id, sold, round(
   3 * CASE WHEN {tf('pro', 'bt')} > 0 AND {tf('sma', 'bt')} > 0 THEN {tf('pro', 'bt')} * power(log10(n / bt_pro), 2) + {tf('sma', 'bt')} * power(log10(n / bt_sma), 2) ELSE 0 END
   + CASE WHEN {tf('pro', 'st')} > 0 AND {tf('sma', 'st')} > 0 THEN {tf('pro', 'st')} * power(log10(n / st_pro), 2) + {tf('sma', 'st')} * power(log10(n / st_sma), 2) ELSE 0 END, 6) AS score
   FROM d, stats WHERE visible AND {has('pro')} AND {has('sma')})"""


@query("sort_relevance", INDEX + f", {RELEVANCE_SQL} SELECT group_id, max(score) AS score FROM scored GROUP BY group_id ORDER BY max(score) DESC, max(sold) DESC, group_id LIMIT 20")
def _(spark, folder):
    return engine(spark, folder).page(replace(Q, term="pro sma", limit=20)).select("group_id", "score")


@query("articles_in_rank_order", INDEX + " SELECT row_number() OVER (ORDER BY max(sold) DESC, group_id) - 1 AS pos, group_id AS id FROM d WHERE visible GROUP BY group_id")
def _(spark, folder):
    docs = built(spark, folder)[1].where("visible")
    best = docs.groupBy("group_id").agg(F.max("sold").alias("sold"))
    ids = ranking.placed(best, [F.desc("sold"), F.col("group_id")]).select("pos", F.col("group_id").alias("id"))
    return in_rank_order(ids, docs.select(F.col("group_id").alias("id")).distinct())


# --- facets ----------------------------------------------------------------------------------------------

FILTERED = replace(Q, term="r", filters=(FacetFilter("type", TYPES), FacetFilter("size", SIZES)))
BASE_R = "visible AND contains(boost_text, 'r')"
FACET_ROWS = " SELECT facet.attr_id, facet.value_id, facet.value, count(DISTINCT {1}) AS cnt FROM d JOIN facet USING (id) WHERE {0} GROUP BY ALL"


@query("facet_counts", INDEX + FACET_ROWS.format("visible AND " + has("pro"), "group_id"))
def _(spark, folder):
    e = engine(spark, folder)
    return e.facet_counts(replace(Q, term="pro"))


@query("facet_counts_documents", INDEX + FACET_ROWS.format("visible AND " + has("pro"), "d.id"))
def _(spark, folder):
    e = engine(spark, folder)
    return e.facet_counts(replace(Q, term="pro"), "documents")


@query("facet_counts_rollup", INDEX + f", {LABELS_SQL}, roll AS (SELECT DISTINCT docs.group_id, facet.attr_id, facet.value_id, label.value FROM docs JOIN facet USING (id) JOIN label ON label.attr_id = facet.attr_id AND label.value_id = facet.value_id WHERE visible)"
       f" SELECT attr_id, value_id, value, count(*) AS cnt FROM (SELECT DISTINCT group_id FROM d WHERE visible AND {has('pro')}) JOIN roll USING (group_id) GROUP BY ALL")
def _(spark, folder):
    e = engine(spark, folder, derived=True)
    return e.rollup_counts(replace(Q, term="pro"))


@query("facet_rows_rollup", INDEX + f", {LABELS_SQL}, roll AS (SELECT DISTINCT docs.group_id, facet.attr_id, facet.value_id, label.value FROM docs JOIN facet USING (id) JOIN label ON label.attr_id = facet.attr_id AND label.value_id = facet.value_id WHERE visible),"
       f" c AS (SELECT attr_id, value_id, value, count(*) AS cnt FROM (SELECT DISTINCT group_id FROM d WHERE visible AND {has('pro')}) JOIN roll USING (group_id) GROUP BY ALL)"
       f" SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY attr_id ORDER BY cnt DESC, value, value_id)::INT AS rank, false AS selected FROM c) WHERE rank <= {SETTINGS.facet_values}")
def _(spark, folder):
    """The engine's choice of the roll-up: nothing is filtered, so it counts as the roll-up does."""
    return engine(spark, folder, derived=True).facet_rows(replace(Q, term="pro"), mode="rollup")


SIDEWAYS = " UNION ALL ".join(
    f"SELECT facet.attr_id, facet.value_id, facet.value, count(DISTINCT group_id) AS cnt FROM d JOIN facet USING (id) WHERE facet.attr_id IN ({attrs}) AND {BASE_R} AND {where} GROUP BY ALL"
    for attrs, where in (
        ("'colour', 'material'", f"{facet_sql('type', TYPES)} AND {facet_sql('size', SIZES)}"),
        ("'type'", facet_sql("size", SIZES)),
        ("'size'", facet_sql("type", TYPES)),
    )
)


@query("facet_drill_sideways", INDEX + " " + SIDEWAYS)
def facet_drill_sideways(spark, folder):
    e = engine(spark, folder)
    return e.facet_counts(FILTERED)


CHOSEN = f"((attr_id = 'type' AND value_id IN ({', '.join(map(repr, TYPES))})) OR (attr_id = 'size' AND value_id IN ({', '.join(map(repr, SIZES))})))"


@query("facet_assembled", INDEX + f", side AS ({SIDEWAYS}), ranked AS (SELECT *, row_number() OVER (PARTITION BY attr_id ORDER BY cnt DESC, value, value_id) AS rank, {CHOSEN} AS selected FROM side), shown AS (SELECT * FROM ranked WHERE rank <= 5 OR selected)"
       " SELECT attr_id, value_id, value, cnt, rank::INT AS rank, selected FROM (SELECT *, bool_or(selected) OVER (PARTITION BY attr_id) AS a, sum((cnt > 0 OR selected)::INT) OVER (PARTITION BY attr_id) AS b FROM shown) WHERE a OR b >= 2")
def _(spark, folder):
    e = engine(spark, folder)
    found = e.facet_counts(FILTERED)
    return facets.worth_showing(facets.top_values(found, 5, {f.attribute: f.values for f in FILTERED.filters}))


@query("facet_rows_filtered", INDEX + f", side AS ({SIDEWAYS}), ranked AS (SELECT *, row_number() OVER (PARTITION BY attr_id ORDER BY cnt DESC, value, value_id)::INT AS rank, {CHOSEN} AS selected FROM side) SELECT * FROM ranked WHERE rank <= {SETTINGS.facet_values} OR selected")
def _(spark, folder):
    """With filters the engine leaves the roll-up aside and counts exactly."""
    return engine(spark, folder, derived=True).facet_rows(FILTERED, mode="rollup")


# --- dictionary, correction, suggestions -----------------------------------------------------------------

DICT_SQL = f"""
occ AS (
  SELECT unnest({toks('title')}) AS term, 5 AS w, 4 AS k, 'title' AS source FROM docs WHERE visible
  UNION ALL SELECT unnest({toks('brand')}), 5, 3, 'brand' FROM docs WHERE visible
  UNION ALL SELECT unnest({toks("array_to_string(category_paths, ' ')")}), 3, 2, 'category' FROM docs WHERE visible
  UNION ALL SELECT unnest({toks('value')}), 2, 1, 'attribute' FROM (SELECT DISTINCT value FROM facet)),
dict AS (SELECT term, sum(w)::BIGINT AS frequency, arg_max(source, k) AS source, length(term) AS len FROM occ WHERE length(term) <= 64 AND NOT regexp_matches(term, '^[0-9]+$') GROUP BY term)"""


@query("dictionary_build", INDEX + f", {DICT_SQL} SELECT term, substr(term, 1, 2) AS bucket, len::INT AS length, frequency, source FROM dict")
def _(spark, folder):
    return dictionary.build(built(spark, folder)[1]).select("term", "bucket", "length", "frequency", "source")


@query("dictionary_prefix", INDEX + f", {DICT_SQL} SELECT term, frequency FROM dict WHERE starts_with(term, 's') ORDER BY frequency DESC, term LIMIT 6")
def _(spark, folder):
    return suggest.completions(dictionary_of(spark, folder), "s", 6).select("term", "frequency")


@query("dictionary_samples", INDEX + f", {DICT_SQL} SELECT term, frequency FROM dict WHERE len >= 3 ORDER BY frequency DESC, term LIMIT 10")
def _(spark, folder):
    return dictionary.samples(dictionary_of(spark, folder), 10).select("term", "frequency")


@query("short_terms", INDEX + f", {DICT_SQL} SELECT term, frequency FROM dict WHERE len < 5 ORDER BY frequency DESC, term LIMIT 5")
def _(spark, folder):
    return dictionary.short_terms(dictionary_of(spark, folder), 5, 5)


def typos(words: DataFrame, least: int, most: int) -> DataFrame:
    """Each word with its third and fourth letters swapped."""
    w = F.col("term")
    return words.where(F.length(w).between(least, most)).select(F.concat(F.substring(w, 1, 2), F.substring(w, 4, 1), F.substring(w, 3, 1), F.substring(w, 5, 100)).alias("token"))


@query("correct_budget1", INDEX + f""", {DICT_SQL}, typo AS (SELECT DISTINCT substr(term, 1, 2) || substr(term, 4, 1) || substr(term, 3, 1) || substr(term, 5) AS token FROM dict WHERE len BETWEEN 4 AND 6),
  asked AS (SELECT token FROM typo WHERE token NOT IN (SELECT term FROM dict)),
  pairs AS (SELECT token, term, frequency, damerau_levenshtein(token, term) AS distance FROM asked JOIN dict ON frequency >= 2 AND len BETWEEN length(token) - 1 AND length(token) + 1 AND substr(token, 1, 2) = substr(term, 1, 2)),
  best AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY distance, frequency DESC, term) AS k FROM pairs WHERE distance <= 1)
  SELECT token, term, distance::INT AS distance, frequency FROM best WHERE k = 1""")
def _(spark, folder):
    d = dictionary_of(spark, folder)
    return correction.best(typos(d, 4, 6), d, SETTINGS)


@query("correct_budget2", INDEX + f""", {DICT_SQL}, typo AS (SELECT DISTINCT substr(term, 1, 2) || substr(term, 4, 1) || substr(term, 3, 1) || substr(term, 5) AS token FROM dict WHERE len >= 7),
  asked AS (SELECT token, {sound_sql('token')} AS sound FROM typo WHERE token NOT IN (SELECT term FROM dict)),
  spoken AS (SELECT term, frequency, len, {sound_sql('term')} AS sound FROM dict WHERE frequency >= 2),
  pairs AS (SELECT token, term, frequency, damerau_levenshtein(token, term) AS distance FROM asked a JOIN spoken d ON len BETWEEN length(token) - 2 AND length(token) + 2 AND (substr(token, 1, 2) = substr(term, 1, 2) OR a.sound = d.sound)),
  best AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY distance, frequency DESC, term) AS k FROM pairs WHERE distance <= 2)
  SELECT token, term, distance::INT AS distance, frequency FROM best WHERE k = 1""")
def _(spark, folder):
    d = dictionary_of(spark, folder)
    return correction.best(typos(d, 7, 64), d, SETTINGS)


@query("suggest_products", INDEX + f", stats AS (SELECT count(*)::DOUBLE AS n, sum(({tf('larg', 'bt')} > 0)::INT)::DOUBLE AS b, sum(({tf('larg', 'st')} > 0)::INT)::DOUBLE AS s FROM d)"
       f" SELECT group_id FROM d, stats WHERE visible AND {has('larg')} GROUP BY group_id ORDER BY max(round(3 * {tf('larg', 'bt')} * power(log10(n / b), 2) + {tf('larg', 'st')} * power(log10(n / s), 2), 6)) DESC, max(sold) DESC, group_id LIMIT 6")
def _(spark, folder):
    return engine(spark, folder).page(replace(Q, term="larg", limit=6)).select("group_id")


@query("suggest_categories", f"WITH {shop('categories')} SELECT id, title FROM categories WHERE active AND NOT hidden AND contains(lower(title), 'a') ORDER BY starts_with(lower(title), 'a') DESC, length(title), id LIMIT 7")
def _(spark, folder):
    return suggest.categories(StandIn(spark, folder)["categories"], "A", 7).select("id", "title")


# --- the search log --------------------------------------------------------------------------------------

LOG_SQL = f"""WITH {shop('search_events')},
one AS (SELECT shop_id, lang_id, request_id, {norm('term_raw')} AS term, arg_max({{'ts': ts, 'raw': term_raw, 'hits': hits}}, {{'ts': ts, 'raw': term_raw, 'hits': hits}}) AS x FROM search_events WHERE first_look AND {norm('term_raw')} <> '' GROUP BY ALL),
log AS (SELECT shop_id, lang_id, CAST(x.ts AS DATE) AS day, term, count(*) AS searches, arg_max(x, x).raw AS term_raw, arg_max(x, x).hits AS hits, arg_max(x, x).ts AS last_seen FROM one GROUP BY ALL),
part_log AS (SELECT * FROM log WHERE shop_id = 1 AND lang_id = 0 AND day BETWEEN DATE '2024-01-10' AND DATE '2024-01-24')"""
START, END = date(2024, 1, 10), date(2024, 1, 24)
PERIOD = periods.Period("days", START, END, False, START)


def log_of(spark, folder) -> DataFrame:
    return reports.counted(StandIn(spark, folder)["search_events"])


def part_log(spark, folder) -> DataFrame:
    return reports.within(log_of(spark, folder), 1, 0, START, END)


@query("log_counters", LOG_SQL + " SELECT shop_id, lang_id, day::VARCHAR AS day, term, term_raw, searches, hits, last_seen FROM log")
def _(spark, folder):
    return log_of(spark, folder).drop("corrected").withColumn("day", F.col("day").cast("string"))


@query("log_top_terms", LOG_SQL + " SELECT term, arg_max(term_raw, {'a': last_seen, 'b': term_raw}) AS term_raw, sum(searches)::BIGINT AS searches, max(hits) AS hits, max(last_seen) AS last_seen FROM part_log GROUP BY term ORDER BY 3 DESC, 1 LIMIT 25")
def _(spark, folder):
    return reports.top_terms(part_log(spark, folder), 25)


@query("log_zero_hits", LOG_SQL + " SELECT term, arg_max(term_raw, {'a': last_seen, 'b': term_raw}) AS term_raw, sum(searches)::BIGINT AS searches, max(last_seen) AS last_seen FROM part_log GROUP BY term HAVING max(day) = max(CASE WHEN hits = 0 THEN day END) ORDER BY 3 DESC, 1 LIMIT 25")
def _(spark, folder):
    return reports.zero_hits(part_log(spark, folder), 25)


@query("log_summary", LOG_SQL + " SELECT sum(searches)::BIGINT AS searches, count(DISTINCT term) AS terms, sum(CASE WHEN hits = 0 THEN searches END)::BIGINT AS zero_searches, count(DISTINCT CASE WHEN hits = 0 THEN term END) AS zero_terms FROM part_log")
def _(spark, folder):
    return reports.summary(part_log(spark, folder))


SERIES_SQL = """ SELECT b::VARCHAR AS bucket, coalesce(sum(searches), 0)::BIGINT AS searches, coalesce(sum(CASE WHEN hits = 0 THEN searches END), 0)::BIGINT AS zero_searches, count(DISTINCT term) AS terms, b >= DATE '{0}' AS in_period
  FROM (SELECT CAST(unnest(range(TIMESTAMP '{1}', TIMESTAMP '{2}' + INTERVAL 1 DAY, INTERVAL 1 {3})) AS DATE) AS b) LEFT JOIN (SELECT * FROM log WHERE shop_id = 1 AND day BETWEEN DATE '{1}' AND DATE '{2}') l ON {4} = b GROUP BY b"""


@query("log_series_day", LOG_SQL + SERIES_SQL.format("2024-02-02", "2024-01-20", "2024-02-02", "DAY", "l.day"))
def _(spark, folder):
    return reports.series(log_of(spark, folder), 1, 0, periods.named("day", date(2024, 2, 2)), date(2024, 2, 2)).withColumn("bucket", F.col("bucket").cast("string"))


@query("log_series_month", LOG_SQL + SERIES_SQL.format("2024-01-01", "2024-01-01", "2024-05-31", "MONTH", "date_trunc('month', l.day)"))
def _(spark, folder):
    return reports.series(log_of(spark, folder), 1, 0, periods.named("year", date(2024, 5, 31)), date(2024, 5, 31)).withColumn("bucket", F.col("bucket").cast("string"))


@query("log_chart", LOG_SQL + ", s AS (" + SERIES_SQL.format("2024-01-10", "2024-01-10", "2024-01-24", "DAY", "l.day") + ") SELECT bucket, CASE WHEN searches > 0 THEN greatest(2, round(searches / max(searches) OVER () * 100))::INT ELSE 0 END AS height FROM s")
def _(spark, folder):
    return reports.bars(reports.series(log_of(spark, folder), 1, 0, PERIOD, END)).select(F.col("bucket").cast("string").alias("bucket"), "height")


@query("log_benchmark_terms", LOG_SQL + " SELECT max(term_raw) AS term_raw, sum(searches)::BIGINT AS searches FROM part_log GROUP BY term ORDER BY 2 DESC, term LIMIT 15")
def _(spark, folder):
    return reports.benchmark_terms(part_log(spark, folder), 15)


def noise_sql(x: str) -> str:
    tests = [f"WHEN regexp_matches({x}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]') THEN 'control'", f"WHEN length({x}) > 80 THEN 'length'"]
    for name, shapes in noise.SHAPES.items():
        tests.append("WHEN " + " OR ".join("regexp_matches({}, '{}')".format(x, s.replace("'", "''")) for s in shapes) + f" THEN '{name}'")
    return f"CASE WHEN {x} = '' THEN NULL {' '.join(tests)} WHEN length({x}) >= 12 AND (length({x}) - length(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'))) / length({x})::DOUBLE > 0.4 THEN 'symbols' END"


RAW = "trim({}, ' ' || chr(9) || chr(10) || chr(13) || chr(11))"


@query("log_noise_filter", f"SELECT id, {noise_sql('raw')} AS reason FROM (SELECT 'u' || page_id AS id, {RAW.format('url')} AS raw FROM pages UNION ALL SELECT 'h' || page_id, {RAW.format('substr(html, 1, 60)')} FROM pages UNION ALL SELECT 'd' || doc_id, {RAW.format('substr(text, 1, 79)')} FROM documents UNION ALL SELECT 'x' || doc_id, {RAW.format('text')} FROM documents)")
def _(spark, folder):
    pages, docs = spark.read.parquet(f"{folder}/pages.parquet"), spark.read.parquet(f"{folder}/documents.parquet")
    rows = pages.select(F.concat(F.lit("u"), "page_id").alias("id"), F.col("url").alias("term_raw")).unionByName(pages.select(F.concat(F.lit("h"), "page_id").alias("id"), F.substring("html", 1, 60).alias("term_raw")))
    rows = rows.unionByName(docs.select(F.concat(F.lit("d"), "doc_id").alias("id"), F.substring("text", 1, 79).alias("term_raw"))).unionByName(docs.select(F.concat(F.lit("x"), "doc_id").alias("id"), F.col("text").alias("term_raw")))
    return reports.annotated(rows).select("id", "reason")


@query("log_stream_counts", LOG_SQL + " SELECT shop_id, day::VARCHAR AS day, sum(searches)::BIGINT AS searches, count(*) AS terms FROM log GROUP BY ALL")
def _(spark, folder):
    """The stream run to its end over what is there, then its newest counters."""
    from lodestone.streaming import log_stream

    place = staging.new_path(spark, "log-stream")
    StandIn(spark, folder)["search_events"].write.parquet(f"{place}/events")
    log_stream.start(log_stream.events(spark, f"{place}/events"), f"{place}/log", f"{place}/checkpoint").awaitTermination()
    return log_stream.read(spark, f"{place}/log").groupBy("shop_id", F.col("day").cast("string").alias("day")).agg(F.sum("searches").alias("searches"), F.count("*").alias("terms"))


@query("log_noise_share", f"SELECT coalesce({noise_sql('raw')}, 'word') AS reason, count(*) AS n FROM (SELECT {RAW.format('html')} AS raw FROM pages) GROUP BY ALL")
def _(spark, folder):
    """Whole pages as they are, judged as terms."""
    pages = spark.read.parquet(f"{folder}/pages.parquet").select(F.col("html").alias("term_raw"))
    return reports.annotated(pages).groupBy(F.coalesce("reason", F.lit("word")).alias("reason")).agg(F.count("*").alias("n"))


# --- the stored index ------------------------------------------------------------------------------------


def stored(spark, folder):
    """A writer whose live index holds the stand-in's documents."""
    from lodestone.operators.writer import IndexWriter

    tables, docs = built(spark, folder)
    writer = IndexWriter(spark, staging.new_path(spark, "index"))
    writer.begin([(1, 0)])
    writer.write(docs)
    writer.commit(tables["object2category"])
    return writer, tables


@query("index_delete", INDEX + f", kept AS (SELECT * FROM docs WHERE id NOT IN (SELECT id FROM docs ORDER BY id LIMIT 5)) SELECT 'documents' AS part, count(*) AS n FROM kept UNION ALL SELECT 'categories', count(*) FROM (SELECT DISTINCT k.group_id, o.cat_id FROM kept k JOIN object2category o ON o.object_id = k.group_id) UNION ALL SELECT 'rollup', count(*) FROM (SELECT DISTINCT k.group_id, f.attr_id, f.value_id FROM kept k JOIN facet f USING (id) WHERE visible)")
def _(spark, folder):
    writer, _ = stored(spark, folder)
    writer.delete([r["id"] for r in writer.index().documents.select("id").orderBy("id").limit(5).collect()])
    index = writer.index()
    parts = (("documents", index.documents), ("categories", index.categories), ("rollup", index.rollup))
    out = None
    for name, df in parts:
        n = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("index_rebuild_categories", INDEX + ", less AS (SELECT * FROM object2category WHERE cat_id <> 'n3') SELECT id, array_to_string(coalesce((SELECT list(cat_id ORDER BY cat_id) FROM less o WHERE o.object_id = docs.group_id), []), ',') AS category_ids FROM docs")
def _(spark, folder):
    writer, tables = stored(spark, folder)
    writer.rebuild_categories(tables["object2category"].where("cat_id <> 'n3'"))
    return writer.index().documents.select("id", F.array_join("category_ids", ",").alias("category_ids"))


@query("index_batches", f"WITH {ALL_SHOP}, {INHERITED_SQL}, n AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM base) SELECT md5(id || '_1_0') AS id FROM n WHERE k <= 300")
def _(spark, folder):
    tables, cursor, out = StandIn(spark, folder), "", None
    for _ in range(3):
        found, cursor = documents.batch(tables, 1, 0, SETTINGS, NOW, cursor, 100)
        out = found.select("id") if out is None else out.unionByName(found.select("id"))
    return out


@query("index_resumed", INDEX + " SELECT id, article_id, group_id, price::DOUBLE AS price FROM docs")
def _(spark, folder):
    """A rebuild in two steps by writers that know no more than the state; the first is done twice, as if its answer was lost."""
    from lodestone.operators.writer import IndexWriter

    tables, place = StandIn(spark, folder), staging.new_path(spark, "index")
    state = rebuild.started(IndexWriter(spark, place), tables, (1, 0))
    state = replace(state, size=-(-state.total // 2))
    rebuild.tick(IndexWriter(spark, place), tables, (1, 0), state, SETTINGS, NOW)
    while state.phase == "index":
        state = rebuild.tick(IndexWriter(spark, place), tables, (1, 0), replace(state, size=-(-state.total // 2)), SETTINGS, NOW)
    writer = IndexWriter(spark, place)
    rebuild.tick(writer, tables, (1, 0), state, SETTINGS, NOW)
    return writer.index().documents.select("id", "article_id", "group_id", F.col("price").cast("double").alias("price"))


@query("index_scope_count", f"WITH {shop('articles')} SELECT count(*) AS n FROM articles WHERE active = 1 AND (parent_id <> '' OR var_count = 0)")
def _(spark, folder):
    return spark.createDataFrame([(documents.scope_count(StandIn(spark, folder)["articles"]),)], "n long")


@query("index_assignments", INDEX + " SELECT 1 AS shop_id, 0 AS lang_id, sum(length(category_ids))::BIGINT AS assignments FROM docs")
def _(spark, folder):
    return documents.assignments(built(spark, folder)[1])


# --- configuration and measuring -------------------------------------------------------------------------


RANKED_SQL = """
wanted AS (SELECT s_nationkey AS shop_id, setting, s_suppkey AS pos, s_name AS value FROM supplier, (VALUES ('searchable'), ('filterable'), ('sortable')) t(setting)),
live AS (SELECT shop_id, setting, CASE WHEN setting = 'sortable' OR shop_id % 2 = 1 THEN -pos ELSE pos END AS pos, value FROM wanted WHERE setting <> 'filterable' OR pos % 97 <> 0),
shaped AS (SELECT side, shop_id, setting, CASE WHEN setting = 'searchable' THEN list(value ORDER BY pos) ELSE list_sort(list_distinct(list(value))) END AS x
           FROM (SELECT 'live' AS side, * FROM live UNION ALL SELECT 'wanted', * FROM wanted) GROUP BY side, shop_id, setting)"""


@query("settings_diff", f"""WITH {RANKED_SQL}, o AS (SELECT * FROM shaped WHERE side = 'live'), n AS (SELECT * FROM shaped WHERE side = 'wanted')
  SELECT shop_id, setting, coalesce(o.x, []) <> coalesce(n.x, []) AS changed, length(list_filter(coalesce(n.x, []), lambda v: NOT list_contains(coalesce(o.x, []), v))) AS added, length(list_filter(coalesce(o.x, []), lambda v: NOT list_contains(coalesce(n.x, []), v))) AS removed
  FROM o FULL JOIN n USING (shop_id, setting)""")
def _(spark, folder):
    """The suppliers of a nation as the settings of a shop: one ranked list, two sets, compared with an older state."""
    names = F.explode(F.array(*map(F.lit, ("searchable", "filterable", "sortable")))).alias("setting")
    wanted = spark.read.parquet(f"{folder}/supplier.parquet").select(F.col("s_nationkey").cast("int").alias("shop_id"), F.lit(0).alias("lang_id"), names, F.col("s_suppkey").cast("long").alias("pos"), F.col("s_name").alias("value"))
    turned = (F.col("setting") == "sortable") | (F.col("shop_id") % 2 == 1)
    live = wanted.where("setting <> 'filterable' OR pos % 97 <> 0").withColumn("pos", F.when(turned, -F.col("pos")).otherwise(F.col("pos")))
    return settings_diff.compared(live, wanted, ("searchable",)).select("shop_id", "setting", "changed", F.col("added").cast("long").alias("added"), F.col("removed").cast("long").alias("removed"))


@query("samples_per_attribute", f"WITH {shop('object2attribute')}, v AS (SELECT DISTINCT attr_id, trim(value) AS value FROM object2attribute WHERE trim(value) <> ''), r AS (SELECT *, row_number() OVER (PARTITION BY attr_id ORDER BY value) AS k FROM v) SELECT attr_id, string_agg(substr(value, 1, 32), ' · ' ORDER BY k) AS sample FROM r WHERE k <= 3 GROUP BY attr_id")
def _(spark, folder):
    return store.sample_values(StandIn(spark, folder)["object2attribute"])


@query("configured_attributes", f"WITH {shop('attributes', 'object2attribute')}, v AS (SELECT DISTINCT attr_id, trim(value) AS value FROM object2attribute WHERE trim(value) <> ''), r AS (SELECT *, row_number() OVER (PARTITION BY attr_id ORDER BY value) AS k FROM v), s AS (SELECT attr_id, string_agg(substr(value, 1, 32), ' · ' ORDER BY k) AS sample FROM r WHERE k <= 3 GROUP BY attr_id)"
       " SELECT c.attr_id, coalesce(nullif(trim(a.title), ''), c.attr_id) AS title, facet, searchable, display, sort, coalesce(s.sample, '') AS sample"
       " FROM (VALUES ('type', true, false, 'default', 10), ('colour', true, true, 'groupedcolortile', 20), ('gone', false, true, 'default', 30)) c(attr_id, facet, searchable, display, sort) LEFT JOIN attributes a ON a.id = c.attr_id LEFT JOIN s ON s.attr_id = c.attr_id")
def _(spark, folder):
    """An editor's list over the catalogue's attributes; one of them is gone from there."""
    rows = [("type", True, False, "default", 10), ("colour", True, True, "groupedcolortile", 20), ("gone", False, True, "default", 30)]
    configured = spark.createDataFrame(rows, "attr_id string, facet boolean, searchable boolean, display string, sort int")
    tables = StandIn(spark, folder)
    return store.configured_attributes(configured, tables["attributes"], tables["object2attribute"])


@query("available_attributes", f"WITH {shop('attributes')} SELECT id, coalesce(nullif(trim(title), ''), id) AS title FROM attributes")
def _(spark, folder):
    return store.available_attributes(StandIn(spark, folder)["attributes"])


@query("unused_attributes", f"WITH {shop('attributes')} SELECT id, coalesce(nullif(trim(title), ''), id) AS title FROM attributes WHERE id NOT IN ('type', 'size')")
def _(spark, folder):
    return store.unused_attributes(StandIn(spark, folder)["attributes"], ["type", "size"])


@query("bench_percentile", "SELECT o_orderpriority AS scenario, quantile_disc(o_totalprice, 0.5) AS median, quantile_disc(o_totalprice, 0.95) AS p95, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY o_orderpriority")
def _(spark, folder):
    runs = spark.read.parquet(f"{folder}/orders.parquet").select(F.col("o_orderpriority").alias("scenario"), F.col("o_totalprice").alias("ms"))
    return agreement.percentiles(runs, ["scenario"])


@query("bench_totals", "WITH m AS (SELECT o_orderstatus AS engine, o_orderpriority AS scenario, quantile_disc(o_totalprice, 0.5) AS median FROM orders GROUP BY ALL), t AS (SELECT engine, sum(median) AS total, avg(median) AS mean FROM m GROUP BY engine) SELECT engine, round(total, 3) AS total, round(mean, 3) AS mean, round(total / (SELECT arg_min(total, engine) FROM t), 6) AS ratio FROM t")
def _(spark, folder):
    runs = spark.read.parquet(f"{folder}/orders.parquet").select(F.col("o_orderstatus").alias("engine"), F.col("o_orderpriority").alias("scenario"), F.col("o_totalprice").alias("ms"))
    out = agreement.totals(agreement.percentiles(runs, ["engine", "scenario"]))
    return out.select("engine", F.round("total", 3).alias("total"), F.round("mean", 3).alias("mean"), F.round("ratio", 6).alias("ratio"))


@query("engine_agreement", """WITH r AS (SELECT p_type AS query, 'v' || p_partkey AS id, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice, p_partkey) AS a, row_number() OVER (PARTITION BY p_type ORDER BY p_size, p_retailprice, p_partkey) AS b FROM part)
  SELECT query, sum((b <= 50)::INT)::BIGINT AS shared, sum((a = b)::INT)::BIGINT AS same_place FROM r WHERE a <= 50 GROUP BY query""")
def _(spark, folder):
    from pyspark.sql import Window

    part = spark.read.parquet(f"{folder}/part.parquet")
    ids = part.select(F.col("p_type").alias("query"), F.concat(F.lit("v"), "p_partkey").alias("id"), "p_retailprice", "p_size", "p_partkey")
    one = Window.partitionBy("query").orderBy("p_retailprice", "p_partkey")
    two = Window.partitionBy("query").orderBy("p_size", "p_retailprice", "p_partkey")
    a = ids.withColumn("pos", F.row_number().over(one)).where("pos <= 50")
    b = ids.withColumn("pos", F.row_number().over(two)).where("pos <= 50")
    return agreement.agreement(a, b)
