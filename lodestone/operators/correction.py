"""Typo correction: dictionary terms near a token, by bucket or sound, then by edit distance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import distance, phonetics
from lodestone.functions.text import tokens_of
from lodestone.plans.model import Correction
from lodestone.settings import Settings


def candidates(tokens: DataFrame, dictionary: DataFrame, settings: Settings) -> DataFrame:
    """token x term pairs worth measuring: same scope, same two first letters or same sound, near lengths.

    The OR is a union of two equi-joins, so neither turns into a nested loop; then the most frequent
    ``candidates`` of each token stay.
    """
    keyed = tokens.select("token").distinct().withColumn("budget", distance.budget(F.length("token"))).where("budget > 0")
    keyed = keyed.withColumn("bucket", F.substring("token", 1, 2)).withColumn("phonetic", phonetics.encode(F.col("token")))
    terms = dictionary.where(F.col("frequency") >= settings.min_frequency).select("term", "frequency", "length", F.col("bucket").alias("t_bucket"), F.col("phonetic").alias("t_phonetic"))
    near = F.col("length").between(F.greatest(F.lit(1), F.length("token") - F.col("budget")), F.length("token") + F.col("budget"))
    by_bucket = keyed.join(terms, (F.col("bucket") == F.col("t_bucket")) & near)
    by_sound = keyed.join(terms, (F.col("phonetic") == F.col("t_phonetic")) & near)
    found = by_bucket.unionByName(by_sound).select("token", "budget", "term", "frequency").distinct()
    order = Window.partitionBy("token").orderBy(F.desc("frequency"), "term")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= settings.candidates)


def best(tokens: DataFrame, dictionary: DataFrame, settings: Settings) -> DataFrame:
    """token, term, distance, frequency of each token's nearest term: least distance, then most frequent."""
    known = dictionary.select(F.col("term").alias("token"))
    asked = tokens.select("token").distinct().join(known, "token", "left_anti")
    pairs = candidates(asked, dictionary, settings).where((F.col("budget") == 1) & distance.may_be_within(F.col("token"), F.col("term"), 1) | (F.col("budget") == 2) & distance.may_be_within(F.col("token"), F.col("term"), 2))
    measured = pairs.withColumn("distance", distance.osa_within("token", "term", "budget")).where("distance <= budget")
    order = Window.partitionBy("token").orderBy("distance", F.desc("frequency"), "term")
    return measured.withColumn("place", F.row_number().over(order)).where("place = 1").select("token", "term", "distance", "frequency")


def correct(dictionary: DataFrame, shop_id: int, lang_id: int, term: str, settings: Settings, known: set[str] = frozenset()) -> Correction | None:
    """The term with its tokens corrected, or None if nothing changed."""
    words = tokens_of(term, settings.min_term_length)
    asked = [w for w in words if w not in known and distance.budget_of(len(w)) > 0]
    if not asked:
        return None
    spark = dictionary.sparkSession
    scope = dictionary.where((F.col("shop_id") == shop_id) & (F.col("lang_id") == lang_id))
    found = {r["token"]: r for r in best(spark.createDataFrame([(w,) for w in asked], "token string"), scope, settings).collect()}
    if not found:
        return None
    return Correction(term, " ".join(found[w]["term"] if w in found else w for w in words), max(r["distance"] for r in found.values()), len(found))
