"""Product roll-up of facet values and the spelling that stands for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def attribute_rows(documents: DataFrame) -> DataFrame:
    """One row for each document and facet value; the position restarts with each document."""
    rows = documents.select("shop_id", "lang_id", "id", "group_id", "visible", F.posexplode("attributes").alias("at", "a"))
    return rows.select("shop_id", "lang_id", "id", "group_id", "visible", (F.col("at") + 1).alias("position"), "a.attr_id", "a.value_id", "a.value").dropDuplicates(["id", "attr_id", "value_id"])


def labels(rows: DataFrame) -> DataFrame:
    """lang_id, attr_id, value_id, value: spellings not all upper or lower case first, then by use, then by alphabet."""
    used = rows.groupBy("lang_id", "attr_id", "value_id", "value").agg(F.count("*").alias("used"))
    shouting = ((F.col("value") == F.upper("value")) | (F.col("value") == F.lower("value"))).cast("int")
    order = Window.partitionBy("lang_id", "attr_id", "value_id").orderBy(shouting, F.desc("used"), "value")
    return used.withColumn("place", F.row_number().over(order)).where("place = 1").select("lang_id", "attr_id", "value_id", "value")


def build(rows: DataFrame) -> DataFrame:
    """One row for each visible product and facet value, under the chosen label."""
    found = rows.where("visible").groupBy("shop_id", "lang_id", "group_id", "attr_id", "value_id").agg(F.min("value").alias("spelling"))
    return found.join(labels(rows), ["lang_id", "attr_id", "value_id"], "left").select("shop_id", "lang_id", "group_id", "attr_id", "value_id", F.coalesce("value", "spelling").alias("value"))
