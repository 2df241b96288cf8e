"""The weighted vocabulary of the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import phonetics, text

# What a word weighs by where it stands.
WEIGHTS = {"title": 5, "brand": 5, "category": 3, "attribute": 2}
LONGEST = 64


def occurrences(documents: DataFrame) -> DataFrame:
    """term, source, weight: each token once for each field it stands in, each attribute value once."""
    def of(rows: DataFrame, column: Column, source: str) -> DataFrame:
        # Places of equal weight: the title's spelling goes first.
        return rows.select("shop_id", "lang_id", F.explode(text.tokenize(column)).alias("term"), F.lit(source).alias("source"), F.lit(WEIGHTS[source]).alias("weight"), F.lit({"title": 4, "brand": 3, "category": 2, "attribute": 1}[source]).alias("rank"))

    shown = documents.where("visible")
    values = documents.select("shop_id", "lang_id", F.explode("attributes").alias("a")).select("shop_id", "lang_id", F.col("a.value").alias("value")).distinct()
    return (
        of(shown, F.col("title"), "title")
        .unionByName(of(shown, F.col("brand"), "brand"))
        .unionByName(of(shown, F.array_join("category_paths", " "), "category"))
        .unionByName(of(values, F.col("value"), "attribute"))
    )


def build(documents: DataFrame) -> DataFrame:
    """Dictionary rows with summed weights; digits alone and overlong words are left out."""
    found = occurrences(documents).where((F.length("term") <= LONGEST) & ~F.col("term").rlike("^[0-9]+$"))
    out = found.groupBy("shop_id", "lang_id", "term").agg(F.sum("weight").alias("frequency"), F.max_by("source", "rank").alias("source"))
    return out.select(
        "shop_id", "lang_id", "term", F.col("term").alias("term_raw"), text.bucket(F.col("term")).alias("bucket"), phonetics.encode(F.col("term")).alias("phonetic"), F.length("term").alias("length"), F.col("frequency").cast("long").alias("frequency"), "source"
    )


def short_terms(dictionary: DataFrame, min_length: int = 3, limit: int = 5) -> DataFrame:
    """The most frequent terms too short for the token index."""
    return dictionary.where(F.col("length") < min_length).groupBy("term").agg(F.sum("frequency").alias("frequency")).orderBy(F.desc("frequency"), "term").limit(limit)


def samples(dictionary: DataFrame, limit: int, min_length: int = 3) -> DataFrame:
    return dictionary.where(F.col("length") >= min_length).orderBy(F.desc("frequency"), "term").limit(limit)
