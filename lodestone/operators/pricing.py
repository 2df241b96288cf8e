"""Discounts: which apply to an article, and the price they leave."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources import staging


def active(discounts: DataFrame, now: datetime) -> DataFrame:
    """Switched on, or off but inside their time."""
    return discounts.where((F.col("active") == 1) | ((F.col("active") == 0) & (F.col("active_from") < F.lit(now)) & (F.col("active_to") > F.lit(now))))


def folded(price: Column, steps: Column) -> Column:
    """Discounts one after the other: % multiplies, abs subtracts, other kinds change nothing; no floor, no rounding."""
    return F.aggregate(steps, price.cast("double"), lambda p, d: F.when(d["kind"] == "%", p * (1 - d["amount"] / 100)).when(d["kind"] == "abs", p - d["amount"]).otherwise(p))


def discounted(articles: DataFrame, links: DataFrame, discounts: DataFrame, article_categories: DataFrame, now: datetime, parents: DataFrame | None = None) -> DataFrame:
    """The articles with the price that all active discounts leave, in their order. Needs id, parent_id, group_id, price.

    A discount applies by the article, by its parent, or by a category of its product, and once however often it is linked; one without
    a link applies to nothing. Discounts are gathered by what they are linked to and meet an article as three arrays, so no article
    is grouped. ``parents`` are the parent_ids of the articles.
    """
    parents = articles.where("parent_id <> ''").select("parent_id").distinct() if parents is None else parents
    entry = F.array_sort(F.collect_list(F.struct("sort", F.col("id").alias("discount_id"), "kind", "amount")))
    valid = active(discounts, now).groupBy(F.col("id").alias("discount_id")).agg(entry.alias("entry"))

    def linked(kind: str, key: str, name: str) -> DataFrame:
        wanted = links.where(F.col("kind") == kind).select("discount_id", F.col("object_id").alias(key))
        return wanted.join(valid, "discount_id").groupBy(key).agg(F.collect_set("entry").alias(name))

    by_parent = linked("article", "parent_id", "of_parent").join(parents, "parent_id", "left_semi")
    by_category = article_categories.join(linked("category", "cat_id", "x"), "cat_id").groupBy("group_id").agg(F.flatten(F.collect_list("x")).alias("of_category"))
    out = articles.join(linked("article", "id", "of_article"), "id", "left")
    out = out.join(staging.staged(by_parent, "parent-discounts"), "parent_id", "left").join(staging.staged(by_category, "category-discounts"), "group_id", "left")
    names = ("of_article", "of_parent", "of_category")
    found = F.flatten(F.filter(F.array(*names), lambda x: x.isNotNull()))
    return out.withColumn("price", folded(F.col("price"), F.array_sort(F.flatten(F.array_distinct(found))))).drop(*names)


def effective(articles: DataFrame, links: DataFrame, discounts: DataFrame, article_categories: DataFrame, now: datetime) -> DataFrame:
    """article_id, price after all active discounts in their order. Needs id, parent_id, group_id, price."""
    return discounted(articles.select("id", "parent_id", "group_id", "price"), links, discounts, article_categories, now).select(F.col("id").alias("article_id"), "price")


def overridden(price: Column, own: Column) -> Column:
    """A shop's own price, unless it is missing or zero."""
    return F.when(own.isNotNull() & (own != 0), own).otherwise(price)


def strike(price: Column, old: Column) -> Column:
    """The old price is shown only when it is greater."""
    return F.when(old > price, old)


def formatted(price: Column, decimals: int = 2, point: str = ",", thousands: str = ".", sign: str = "€", sign_left: bool = False) -> Column:
    text = F.translate(F.format_number(price, decimals), ",.", thousands + point)
    return F.concat_ws(" ", F.lit(sign), text) if sign_left else F.concat_ws(" ", text, F.lit(sign))
