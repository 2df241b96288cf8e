"""Index documents from the catalogue: inheritance, attributes, visibility, texts and prices."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import color, keys, text
from lodestone.operators import categories, pricing
from lodestone.schema import ATTRIBUTE, DOCUMENTS
from lodestone.settings import Settings
from lodestone.sources import staging

INHERITED = ("title", "artnum", "ean", "mpn", "short_desc", "manufacturer_id")


def searchable_articles(articles: DataFrame) -> DataFrame:
    """Active variants and stand-alone articles, never the parents of variants."""
    return articles.where("active = 1 AND (parent_id <> '' OR var_count = 0)")


def parents_of(articles: DataFrame) -> DataFrame:
    """parent_id of all searchable variants, once each, written: what is small is then sent to every task by Spark's size check."""
    return staging.staged(searchable_articles(articles).where("parent_id <> ''").select("parent_id").distinct(), "parents")


def inherited(articles: DataFrame, manufacturers: DataFrame, long_desc: DataFrame, shop_prices: DataFrame | None = None, shop_id: int = 1, parents: DataFrame | None = None) -> DataFrame:
    """Each article with what it leaves blank taken from its parent, brand, long text and shop price.

    Articles are dealt by their id once; what a parent lends is gathered first, one row a parent, so that variants
    are not dealt by the few ids of their parents unless those are too many to be sent to every task.
    """
    parents = parents_of(articles) if parents is None else parents
    texts = long_desc.select("article_id", "long_desc")

    def lent(df: DataFrame, key: str) -> DataFrame:
        return df.withColumnRenamed(key, "parent_id").join(parents, "parent_id", "left_semi")

    above = parents.join(lent(articles.select("id", *(F.col(c).alias(f"p_{c}") for c in INHERITED)), "id"), "parent_id", "left")
    above = staging.staged(above.join(lent(texts, "article_id").withColumnRenamed("long_desc", "p_long"), "parent_id", "left"), "above")
    out = searchable_articles(articles).join(texts.withColumnRenamed("article_id", "id"), "id", "left")
    if shop_prices is not None:
        own_price = shop_prices.where(F.col("shop_id") == shop_id).select(F.col("article_id").alias("id"), F.col("price").alias("shop_price"))
        out = out.join(own_price, "id", "left").withColumn("price", pricing.overridden(F.col("price"), F.col("shop_price"))).drop("shop_price")
    out = out.join(above, "parent_id", "left")

    def own(c: str) -> Column:
        return F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"p_{c}"), F.lit(""))

    out = out.select(
        "id", "parent_id", F.when(F.col("parent_id") != "", F.col("parent_id")).otherwise(F.col("id")).alias("group_id"),
        *(own(c).alias(c) for c in INHERITED), "var_select", "sold", "inserted", "price", "stock", "stock_flag", "active",
        F.coalesce(F.nullif("long_desc", F.lit("")), "p_long", F.lit("")).alias("long_desc"),
    )
    brands = staging.staged(manufacturers.select(F.col("id").alias("manufacturer_id"), F.col("title").alias("brand")), "brands")
    return out.join(brands, "manufacturer_id", "left").withColumn("brand", F.coalesce("brand", F.lit("")))


def visible(active: Column, stock: Column, flag: Column, manage_stock: bool = True) -> Column:
    """Out of stock hides an article only where stock is managed and its flag is 2; no flag is 1."""
    on = active == 1
    return on & ((F.coalesce(flag, F.lit(1)) != 2) | (stock > 0)) if manage_stock else on


def attributes_of(object2attribute: DataFrame, attributes: DataFrame, wanted: tuple[str, ...] = ()) -> DataFrame:
    """object_id, attributes: the values of each article in their order, trimmed, without blanks."""
    rows = object2attribute.where(F.col("attr_id").isin(*wanted)) if wanted else object2attribute
    rows = rows.withColumn("value", F.trim("value")).where("value <> ''").join(attributes.select(F.col("id").alias("attr_id"), "title"), "attr_id")
    item = F.struct(F.col("pos"), F.struct("attr_id", "title", keys.value_id(F.col("value")).alias("value_id"), "value", F.col("pos").cast("int").alias("pos")).alias("a"))
    return rows.groupBy("object_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["a"]).alias("attributes"))


def wanted_attributes(settings: Settings) -> tuple[str, ...]:
    """No list of searchable attributes means that all are read."""
    return tuple(dict.fromkeys([*settings.facet_attributes, *settings.searchable_attributes])) if settings.searchable_attributes else ()


def only(attributes: Column, ids: tuple[str, ...]) -> Column:
    return F.filter(attributes, lambda a: a["attr_id"].isin(*ids))


def facet_copy(attributes: Column, settings: Settings) -> Column:
    """Facet attributes, colours grouped where asked, one of each value; the first spelling stays."""
    grouped = [a for a, mode in settings.display_modes.items() if color.is_grouped(mode)]

    def recolored(a: Column) -> Column:
        def entry(value: Column) -> Column:
            return F.struct(a["attr_id"].alias("attr_id"), a["title"].alias("title"), keys.value_id(value).alias("value_id"), value.alias("value"), a["pos"].alias("pos"))

        family = F.when(a["attr_id"].isin(*grouped), color.group(a["value"])) if grouped else F.lit(None).cast("string")
        return color.let(F.coalesce(family, a["value"]), entry)

    def first_only(found: Column) -> Column:
        key = F.transform(found, lambda a: F.concat_ws("_", a["attr_id"], a["value_id"]))
        return color.let(F.struct(found.alias("found"), key.alias("key")), lambda x: F.filter(x["found"], lambda a, i: F.array_position(x["key"], F.concat_ws("_", a["attr_id"], a["value_id"])) == i + 1))

    return color.let(F.transform(only(attributes, settings.facet_attributes), recolored), first_only)


def build(tables: dict[str, DataFrame], shop_id: int, lang_id: int, settings: Settings, now: datetime, gather: bool = True) -> DataFrame:
    """The documents of one scope. Joins by article come first; what variants share is gathered, written and joined by product.

    The categories of few products (``gather`` unset) are joined as they are.
    """
    parents = parents_of(tables["articles"])
    rows = inherited(tables["articles"], tables["manufacturers"], tables["long_desc"], tables.get("shop_prices"), shop_id, parents)
    wanted = wanted_attributes(settings)
    attributes = attributes_of(tables["object2attribute"], tables["attributes"], wanted)
    none = F.array().cast(f"array<{ATTRIBUTE}>")
    rows = rows.join(attributes.select(F.col("object_id").alias("id"), F.col("attributes").alias("own")), "id", "left").withColumn("own", F.coalesce("own", none))
    if "discounts" in tables:
        groups = tables["object2category"].select(F.col("object_id").alias("group_id"), "cat_id")
        rows = pricing.discounted(rows, tables["object2discount"], tables["discounts"], groups, now, parents)
    if settings.inherit_attributes:
        of_parents = tables["object2attribute"].join(parents.withColumnRenamed("parent_id", "object_id"), "object_id", "left_semi")
        above = attributes_of(of_parents, tables["attributes"], wanted).select(F.col("object_id").alias("parent_id"), F.col("attributes").alias("above"))
        rows = rows.join(staging.staged(above, "above-attributes"), "parent_id", "left").withColumn("own", F.concat(F.coalesce("above", none), "own")).drop("above")
    path = categories.paths(tables["categories"])
    cats = tables["object2category"].join(path.withColumnRenamed("id", "cat_id"), "cat_id", "left").groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("cat_id", "path"))).alias("x"))
    cats = cats.select(F.col("object_id").alias("group_id"), F.transform("x", lambda c: c["cat_id"]).alias("category_ids"), F.transform(F.filter("x", lambda c: c["path"].isNotNull()), lambda c: c["path"]).alias("category_paths"))
    strings = F.array().cast("array<string>")
    cats = staging.staged(cats, "product-categories") if gather else cats
    rows = rows.join(cats, "group_id", "left").withColumn("category_ids", F.coalesce("category_ids", strings)).withColumn("category_paths", F.coalesce("category_paths", strings))
    searchable = only(F.col("own"), settings.searchable_attributes) if settings.searchable_attributes else F.col("own")
    boost = text.boost_text(F.col("title"), F.col("brand"), F.col("var_select"), F.col("artnum"), F.col("ean"), F.col("mpn"))
    rows = rows.withColumn("boost", boost)
    rows = rows.withColumn("search_text", text.search_text(F.col("boost"), F.col("category_paths"), F.transform(searchable, lambda a: a["value"]), F.col("short_desc"), F.col("long_desc")))
    rows = rows.withColumn("boost_text", F.substring("boost", 1, text.BOOST_LENGTH))
    shop, lang = F.lit(shop_id), F.lit(lang_id)
    return rows.select(
        keys.document_id(F.col("id"), shop, lang).alias("id"), shop.cast("int").alias("shop_id"), lang.cast("int").alias("lang_id"), F.col("id").alias("article_id"), "parent_id", "group_id",
        visible(F.col("active"), F.col("stock"), F.col("stock_flag"), settings.manage_stock).alias("visible"),
        "title", "artnum", "ean", "mpn", "brand", "manufacturer_id", "category_paths", "category_ids",
        facet_copy(F.col("own"), settings).alias("attributes"), "search_text", "boost_text",
        text.words(F.col("search_text")).alias("search_tokens"), text.words(F.col("boost_text")).alias("boost_tokens"),
        F.col("price").cast("decimal(9,2)").alias("price"), F.col("stock").cast("double").alias("stock"), F.col("sold").cast("int").alias("sold"),
        keys.insert_date(F.col("inserted")).alias("insert_date"),
    )


def scope_count(articles: DataFrame) -> int:
    """How many documents a scope will have."""
    return searchable_articles(articles).count()


#: Batches up to this size join the categories of their products without writing them first.
SMALL_BATCH = 2000
#: The catalogue's tables by the column that names an article, its parent or its product.
OF_ARTICLES = {"articles": "id", "long_desc": "article_id", "object2attribute": "object_id", "object2category": "object_id", "shop_prices": "article_id"}
OTHERS = ("manufacturers", "attributes", "categories", "discounts")


def of_batch(tables, ids: DataFrame) -> dict[str, DataFrame]:
    """The tables with the rows that some articles (article_id, parent_id: one batch, written) need, their parents' too.

    Every large table is cut to the span of the batch's keys, which its scan can use, and to the keys themselves
    before anything is grouped or joined.
    """
    wanted = ids.select(F.explode(F.array("article_id", "parent_id")).alias("object")).where("object <> ''").distinct()
    low, high = wanted.agg(F.min("object"), F.max("object")).first()

    def needed(df: DataFrame, key: str) -> DataFrame:
        inside = df.where(F.col(key).between(F.lit(low), F.lit(high)))
        # Two keys for each article of a batch at most, and a batch's size is given.
        return inside.join(F.broadcast(wanted.withColumnRenamed("object", key)), key, "left_semi").select(*df.columns)

    out = {name: needed(tables[name], key) for name, key in OF_ARTICLES.items() if name in tables}
    out |= {name: tables[name] for name in OTHERS if name in tables}
    if "object2discount" in tables:
        links = tables["object2discount"]
        out["object2discount"] = needed(links.where("kind = 'article'"), "object_id").unionByName(links.where("kind <> 'article'"))
    return out


def batch(tables, shop_id: int, lang_id: int, settings: Settings, now: datetime, after: str = "", size: int = 200) -> tuple[DataFrame, str]:
    """(documents of the next ``size`` articles by id, the last of these ids); an empty batch keeps the cursor."""
    ids = searchable_articles(tables["articles"]).where(F.col("id") > after).select(F.col("id").alias("article_id"), "parent_id").orderBy("article_id").limit(size)
    ids = staging.staged(ids, "batch")
    last = ids.agg(F.max("article_id")).first()[0] or after
    if last == after:
        return ids.sparkSession.createDataFrame([], DOCUMENTS), after
    built = build(of_batch(tables, ids), shop_id, lang_id, settings, now, gather=size > SMALL_BATCH)
    return built.where((F.col("article_id") > after) & (F.col("article_id") <= last)), last


def assignments(documents: DataFrame) -> DataFrame:
    """How many category assignments the documents of each scope hold."""
    return documents.groupBy("shop_id", "lang_id").agg(F.sum(F.size("category_ids")).cast("long").alias("assignments"))


def flattened(documents: DataFrame) -> DataFrame:
    """Documents with facet fields as maps: attribute to value ids, and to packed ids and labels."""
    names = F.array_distinct(F.transform("attributes", lambda a: a["attr_id"]))
    def field(pack: bool) -> Column:
        def entry(n: Column) -> Column:
            own = F.filter("attributes", lambda a: a["attr_id"] == n)
            return F.struct(F.concat(F.lit("fl_" if pack else "f_"), n), F.transform(own, lambda a: keys.packed_value(a["value_id"], a["value"]) if pack else a["value_id"]))
        return F.map_from_entries(F.transform(names, entry))
    return documents.withColumn("facet_ids", field(False)).withColumn("facet_labels", field(True)).withColumn("insert_seconds", keys.insert_seconds(F.col("insert_date")))


def by_postings(documents: DataFrame, index: DataFrame, word: str, field: str = "search") -> DataFrame:
    """Documents with a token that begins so: the prefix is pushed into the scan of the postings."""
    hits = index.where((F.col("field") == field) & F.col("token").startswith(word)).select("id").distinct()
    return documents.join(hits, "id", "left_semi")
