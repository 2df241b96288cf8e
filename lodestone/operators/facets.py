"""Facet counts of exact drill-sideways in one pass, by product or by document, and their assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import color
from lodestone.operators import cells, predicate
from lodestone.operators.synonyms import Expander
from lodestone.plans.model import Facet, FacetValue, Index, SearchQuery
from lodestone.settings import Settings


def counts(documents: DataFrame, links: DataFrame | None, query: SearchQuery, expander: Expander, settings: Settings, attributes: tuple[str, ...], unit: str = "groups") -> DataFrame:
    """attr_id, value_id, value, cnt: for each facet the rows that miss no filter but its own.

    A row that fails two filters counts nowhere; one that fails one counts for that facet only. So all
    facets, selected or not, come from a single scan. ``unit`` is groups (products) or documents (variants).
    Of ``documents`` that are cells, products are counted by the bits of their words.
    """
    base = predicate.within_category(documents, links, query).where(predicate.base_predicate(query, expander, settings))
    chosen, numbered = query.used_filters, [c for c in ("word", "mask") if c in documents.columns]
    failed = F.filter(F.array(*(F.when(~predicate.facet_predicate(f.attribute, f.values), F.lit(f.attribute)) for f in chosen)), lambda x: x.isNotNull()) if chosen else F.array().cast("array<string>")
    rows = (
        base.withColumn("failed", failed)
        .where(F.size("failed") <= 1)
        .select("id", "group_id", *numbered, "failed", F.explode("attributes").alias("a"))
        .where(F.col("a.attr_id").isin(*attributes) & ((F.size("failed") == 0) | (F.get("failed", F.lit(0)) == F.col("a.attr_id"))))
        .select("id", "group_id", *numbered, F.col("a.attr_id").alias("attr_id"), F.col("a.value_id").alias("value_id"), F.col("a.value").alias("value"))
    )
    value = ["attr_id", "value_id", "value"]
    if not numbered:
        return rows.groupBy(*value).agg(F.countDistinct("group_id" if unit == "groups" else "id").alias("cnt"))
    if unit == "groups":
        return cells.merged(rows, *value).groupBy(*value).agg(cells.products().alias("cnt"))
    # A cell holds each value once.
    return rows.groupBy(*value).agg(F.count("*").alias("cnt"))


def rollup_counts(documents: DataFrame, links: DataFrame | None, rollup: DataFrame, query: SearchQuery, expander: Expander, settings: Settings, attributes: tuple[str, ...]) -> DataFrame:
    """The product path: distinct matching products joined to the materialised roll-up.

    It counts every value of a product, whichever variant matched; ``counts`` is exact. A roll-up by words takes cells for documents.
    """
    found = predicate.matching(documents, links, query, expander, settings)
    if "word" in rollup.columns:
        # Words of products that match, one row for 64 of them, meet the words of each value.
        hit = cells.merged(found, "shop_id", "lang_id").withColumnRenamed("mask", "hit")
        both = rollup.where(F.col("attr_id").isin(*attributes)).join(hit, ["shop_id", "lang_id", "word"]).withColumn("mask", F.col("mask").bitwiseAND(F.col("hit"))).where("mask <> 0")
        return both.groupBy("attr_id", "value_id", "value").agg(cells.products().alias("cnt"))
    groups = found.select("shop_id", "lang_id", "group_id").distinct()
    return groups.join(rollup.where(F.col("attr_id").isin(*attributes)), ["shop_id", "lang_id", "group_id"]).groupBy("attr_id", "value_id", "value").agg(F.count("*").alias("cnt"))


def use_rollup(query: SearchQuery, rollup: DataFrame | None, attribute: str | None = None) -> bool:
    """Only if there is a roll-up and no facet but this one is filtered."""
    return rollup is not None and not any(f.attribute != attribute for f in query.used_filters) and not rollup.isEmpty()


def top_values(found: DataFrame, limit: int, selected: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """The first ``limit`` values of each facet by count and label, and the selected ones beyond it."""
    order = Window.partitionBy("attr_id").orderBy(F.desc("cnt"), "value", "value_id")
    chosen = F.lit(False)
    for attribute, values in (selected or {}).items():
        chosen = chosen | ((F.col("attr_id") == attribute) & F.col("value_id").isin(*values))
    return found.withColumn("rank", F.row_number().over(order)).withColumn("selected", chosen).where((F.col("rank") <= limit) | F.col("selected"))


def worth_showing(shown: DataFrame) -> DataFrame:
    """Facets with a selection or at least two values to choose from."""
    own = Window.partitionBy("attr_id")
    offers = F.count(F.when((F.col("cnt") > 0) | F.col("selected"), 1)).over(own)
    return shown.withColumn("worth", F.max("selected").over(own) | (offers >= 2)).where("worth").drop("worth")


def assembled(shown: list, attributes: tuple[str, ...], titles: dict[str, str], custom: dict[str, str], query: SearchQuery, settings: Settings, labels: dict[tuple[str, str], str] | None = None) -> tuple[Facet, ...]:
    """Facets in their configured order from the rows of ``top_values`` (facets times values at most)."""
    out: list[Facet] = []
    chosen = {f.attribute: f.values for f in query.used_filters}
    for attribute in attributes:
        mode = color.display_mode(settings.display_modes.get(attribute))
        values = []
        for r in sorted((r for r in shown if r["attr_id"] == attribute), key=lambda r: r["rank"]):
            values.append(value(r["value_id"], r["value"], r["cnt"], r["selected"], mode))
        # Values that vanished stay selectable, so that they can be taken back.
        there = {v.value_id for v in values}
        for missing in chosen.get(attribute, ()):
            if missing not in there:
                values.append(value(missing, (labels or {}).get((attribute, missing), missing), 0, True, mode))
        if any(v.selected for v in values) or sum(v.selectable for v in values) >= 2:
            title = custom.get(attribute) or titles.get(attribute) or attribute
            out.append(Facet(attribute, title, tuple(values), len(out), "color" if color.is_color(mode) else "default", color.is_grouped(mode)))
    return tuple(out)


def value(value_id: str, label: str, count: int, selected: bool, mode: str) -> FacetValue:
    import re

    fits = re.fullmatch(r"(?s)(.*)_(#[0-9A-Fa-f]{3,8})", label) if color.is_color(mode) else None
    return FacetValue(value_id, fits[1] if fits else label, count, selected, fits[2] if fits else None)


def vanished_labels(index: Index, query: SearchQuery, wanted: list[tuple[str, str]]) -> dict[tuple[str, str], str]:
    """Labels of selected values (twenty times fifty at most) that no row shows: by the roll-up, else by the documents."""
    asked = index.documents.sparkSession.createDataFrame(wanted, "attr_id string, value_id string")
    scope = (F.col("shop_id") == query.shop_id) & (F.col("lang_id") == query.lang_id)
    rows = index.part("rollup") if index.has("rollup") else index.documents.select("shop_id", "lang_id", F.explode("attributes").alias("a")).select("shop_id", "lang_id", "a.attr_id", "a.value_id", "a.value")
    found = rows.where(scope).join(F.broadcast(asked), ["attr_id", "value_id"]).groupBy("attr_id", "value_id").agg(F.min("value").alias("value")).collect()
    return {(r["attr_id"], r["value_id"]): r["value"] for r in found}
