"""What has changed between the settings an index was made with and those it should have.

Settings are rows of shop_id, lang_id, setting, pos and value. Most are sets: neither order nor repeats count. Ranked ones
are lists, where the order matters. A scope of which a setting differs has to be rebuilt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["shop_id", "lang_id", "setting"]


def _shaped(settings: DataFrame, ranked: tuple[str, ...], name: str) -> DataFrame:
    """Each setting's values as compared: ranked ones in their order, others sorted and each once."""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"])
    shaped = F.when(F.col("setting").isin(*ranked), F.col("listed")).otherwise(F.array_sort(F.array_distinct("listed")))
    return settings.groupBy(*KEYS).agg(in_order.alias("listed")).select(*KEYS, shaped.alias(name))


def compared(live: DataFrame, wanted: DataFrame, ranked: tuple[str, ...] = ()) -> DataFrame:
    """shop_id, lang_id, setting, changed, added and removed values; one that is missing is an empty list."""
    both = _shaped(live, ranked, "old").join(_shaped(wanted, ranked, "new"), KEYS, "full")
    none = F.array().cast("array<string>")
    both = both.withColumns({"old": F.coalesce("old", none), "new": F.coalesce("new", none)})
    return both.select(*KEYS, (F.col("old") != F.col("new")).alias("changed"), F.size(F.array_except("new", "old")).alias("added"), F.size(F.array_except("old", "new")).alias("removed"))


def outdated(live: DataFrame, wanted: DataFrame, ranked: tuple[str, ...] = ()) -> DataFrame:
    """The scopes that have to be rebuilt."""
    return compared(live, wanted, ranked).where("changed").select("shop_id", "lang_id").distinct()
