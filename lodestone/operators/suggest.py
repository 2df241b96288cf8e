"""Completions from the dictionary and category suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import normalized


def completions(dictionary: DataFrame, prefix: str, limit: int) -> DataFrame:
    """Terms that begin so, most frequent first. The prefix reaches the Parquet scan."""
    return dictionary.where(F.startswith(F.col("term"), F.lit(prefix))).orderBy(F.desc("frequency"), "term").limit(limit)


def completed(dictionary: DataFrame, shop_id: int, lang_id: int, term: str, limit: int) -> list[str]:
    """Spellings of the terms that begin like the whole input."""
    if not normalized(term) or limit < 1:
        return []
    scope = dictionary.where((F.col("shop_id") == shop_id) & (F.col("lang_id") == lang_id))
    return [r["term_raw"] for r in completions(scope, normalized(term), limit).collect()]


def categories(tree: DataFrame, typed: str, limit: int) -> DataFrame:
    """Active, not hidden, title contains the input: titles that begin with it first, then the shortest."""
    title, want = F.lower("title"), F.lit(typed.lower())
    starts: Column = F.startswith(title, want)
    return tree.where(F.col("active") & ~F.col("hidden") & F.contains(title, want)).orderBy(F.desc(starts), F.length("title"), "id").limit(limit)
