"""Small editorial tables (attribute roles, titles, synonym rules), replaced a scope at a time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import schema
from lodestone.functions.color import display_mode
from lodestone.functions.text import list_of
from lodestone.operators.synonyms import Rule
from lodestone.sources.catalog import exists

LONGEST_TITLE = 255


class Store:
    """Parquet datasets under one folder; a table that isn't there is empty."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _read(self, name: str, layout: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        return self.spark.read.schema(layout).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], layout)

    def _replace(self, name: str, layout: str, rows: list[tuple], scope: dict[str, int]) -> None:
        """Overwrites the partition of a scope alone; without rows it goes."""
        parts = list(scope)
        if not rows:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, name, *(f"{k}={v}" for k, v in scope.items())]))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            return
        self.spark.createDataFrame(rows, layout).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(f"{self.folder}/{name}")

    def attributes(self, shop_id: int) -> list:
        return self._read("attribute_config", schema.ATTRIBUTE_CONFIG).where(F.col("shop_id") == shop_id).orderBy("sort", "attr_id").collect()

    def facet_attributes(self, shop_id: int) -> tuple[str, ...]:
        return tuple(r["attr_id"] for r in self.attributes(shop_id) if r["facet"])

    def searchable_attributes(self, shop_id: int) -> tuple[str, ...]:
        return tuple(r["attr_id"] for r in self.attributes(shop_id) if r["searchable"])

    def display_modes(self, shop_id: int) -> dict[str, str]:
        return {r["attr_id"]: display_mode(r["display"]) for r in self.attributes(shop_id)}

    def save_attributes(self, shop_id: int, entries: list[tuple[str, bool, bool, str]]) -> int:
        """(attribute, facet, searchable, display) in their order; entries without a role are dropped."""
        kept = [e for e in dict((e[0], e) for e in entries).values() if e[1] or e[2]]
        self._replace("attribute_config", schema.ATTRIBUTE_CONFIG, [(shop_id, a, f, s, display_mode(d), 10 * (i + 1)) for i, (a, f, s, d) in enumerate(kept)], {"shop_id": shop_id})
        return len(kept)

    def titles(self, shop_id: int, lang_id: int) -> dict[str, str]:
        rows = self._read("attribute_titles", schema.ATTRIBUTE_TITLES).where((F.col("shop_id") == shop_id) & (F.col("lang_id") == lang_id)).collect()
        return {r["attr_id"]: r["title"] for r in rows if (r["title"] or "").strip()}

    def save_titles(self, shop_id: int, titles: dict[tuple[str, int], str]) -> int:
        rows = [(shop_id, a, lang, t.strip()[:LONGEST_TITLE]) for (a, lang), t in titles.items() if t.strip()]
        self._replace("attribute_titles", schema.ATTRIBUTE_TITLES, rows, {"shop_id": shop_id})
        return len(rows)

    def rules(self, shop_id: int, lang_id: int) -> list[Rule]:
        rows = self._read("synonyms", schema.SYNONYMS).where((F.col("shop_id") == shop_id) & (F.col("lang_id") == lang_id)).orderBy("sort", "term").collect()
        return [Rule(r["kind"], r["term"], r["synonyms"], r["active"]) for r in rows]

    def active_rules(self, shop_id: int, lang_id: int) -> list[Rule]:
        return [r for r in self.rules(shop_id, lang_id) if r.active and r.complete]

    def save_rules(self, shop_id: int, lang_id: int, rules: list[Rule]) -> int:
        """Incomplete rules are dropped, lists cleaned; returns how many were kept."""
        kept = [r for r in rules if r.complete]
        self._replace("synonyms", schema.SYNONYMS, [(shop_id, lang_id, r.kind, r.term.strip(), ", ".join(list_of(r.synonyms)), r.active, i + 1) for i, r in enumerate(kept)], {"shop_id": shop_id, "lang_id": lang_id})
        return len(kept)


def available_attributes(attributes: DataFrame) -> DataFrame:
    """All attributes by title; a blank title is the id."""
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.col("id"))
    return attributes.select("id", title.alias("title")).orderBy("title", "id")


def unused_attributes(attributes: DataFrame, configured: list[str]) -> DataFrame:
    return available_attributes(attributes).where(~F.col("id").isin(configured or [""]))


def configured_attributes(configured: DataFrame, attributes: DataFrame, object2attribute: DataFrame) -> DataFrame:
    """The configured attributes in their order, with title (the id if the attribute is gone), roles and sample values."""
    titles = available_attributes(attributes).select(F.col("id").alias("attr_id"), "title")
    out = configured.join(titles, "attr_id", "left").join(sample_values(object2attribute), "attr_id", "left")
    return out.select("attr_id", F.coalesce("title", "attr_id").alias("title"), "facet", "searchable", "display", "sort", F.coalesce("sample", F.lit("")).alias("sample")).orderBy("sort", "attr_id")


def sample_values(object2attribute: DataFrame, per_attribute: int = 3, longest: int = 32) -> DataFrame:
    """attr_id, sample: the first distinct values of each attribute, cut and joined.

    Each task keeps the first values of an attribute alone, so what is shuffled is attributes times tasks times
    ``per_attribute`` rows at most, however many values there are and however often one attribute is used.
    """
    values = object2attribute.select("attr_id", F.trim("value").alias("value")).where("value <> ''")

    def first(batches):
        kept: dict[str | None, list[str]] = {}
        for batch in batches:
            for attribute, found in batch.groupby("attr_id", dropna=False)["value"].unique().items():
                name = attribute if isinstance(attribute, str) else None
                kept[name] = sorted({*kept.get(name, ()), *found})[:per_attribute]
        rows = [(a, v) for a, found in kept.items() for v in found]
        yield pd.DataFrame(rows, columns=["attr_id", "value"], dtype=object)

    firsts = values.mapInPandas(first, "attr_id string, value string").groupBy("attr_id").agg(F.array_sort(F.collect_set("value")).alias("values"))
    cut = F.transform(F.slice("values", 1, per_attribute), lambda v: F.substring(v, 1, longest))
    return firsts.select("attr_id", F.array_join(cut, " · ").alias("sample"))
