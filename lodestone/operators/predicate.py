"""Queries as Column predicates and relevance over index documents."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import tokens_of
from lodestone.operators.synonyms import Expander, Words
from lodestone.plans.model import SearchQuery
from lodestone.settings import Settings


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def has_prefix(tokens: Column, word: str) -> Column:
    return F.exists(tokens, lambda t: F.startswith(t, F.lit(word)))


def has_phrase(text: Column, words: Words) -> Column:
    """Whole words side by side in a normalised text."""
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.lit(f" {' '.join(words)} "))


def alternative(words: Words, settings: Settings) -> Column:
    """One word matches as a prefix, several as a phrase; short words are looked for in the boost text."""
    if all(len(w) >= settings.min_token_size for w in words):
        return has_prefix(F.col("search_tokens"), words[0]) if len(words) == 1 else has_phrase(F.col("search_text"), words)
    return _all([has_prefix(F.col("search_tokens"), w) if len(w) >= settings.min_token_size else F.contains(F.col("boost_text"), F.lit(w)) for w in words])


def term_predicate(term: str, expander: Expander, settings: Settings) -> Column:
    """A term without tokens, such as a stop word alone, imposes nothing."""
    return _all([_any([alternative(a, settings) for a in group]) for group in expander.expand(tokens_of(term, 1))])


def facet_predicate(attribute: str, values: tuple[str, ...]) -> Column:
    """The variant itself holds one of the values."""
    return F.exists("attributes", lambda a: (a["attr_id"] == attribute) & a["value_id"].isin(*values))


def scope_predicate(query: SearchQuery) -> Column:
    return (F.col("shop_id") == query.shop_id) & (F.col("lang_id") == query.lang_id) & F.col("visible")


def base_predicate(query: SearchQuery, expander: Expander, settings: Settings) -> Column:
    """All conditions but the facet filters."""
    parts = [scope_predicate(query), term_predicate(query.term, expander, settings)]
    if query.manufacturer:
        parts.append(F.col("manufacturer_id") == query.manufacturer)
    if query.price_from is not None:
        parts.append(F.col("price") >= query.price_from)
    if query.price_to is not None:
        parts.append(F.col("price") <= query.price_to)
    return _all(parts)


def within_category(documents: DataFrame, links: DataFrame | None, query: SearchQuery) -> DataFrame:
    """Products of the category: a semi-join on the product, so variants follow it."""
    if not query.category or links is None:
        return documents
    groups = links.where((F.col("shop_id") == query.shop_id) & (F.col("cat_id") == query.category)).select("lang_id", "group_id").distinct()
    return documents.join(groups, ["lang_id", "group_id"], "left_semi")


def matching(documents: DataFrame, links: DataFrame | None, query: SearchQuery, expander: Expander, settings: Settings, without: str | None = None) -> DataFrame:
    filters = [facet_predicate(f.attribute, f.values) for f in query.used_filters if f.attribute != without]
    return within_category(documents, links, query).where(_all([base_predicate(query, expander, settings), *filters]))


@dataclass(frozen=True)
class Statistics:
    """Documents of the scope and, for each word and field, how many hold it as a prefix."""

    n: int
    frequency: dict[tuple[str, str], int]


FIELDS = (("boost_tokens", 3), ("search_tokens", 1))


def scored_words(term: str, settings: Settings) -> list[str]:
    """The words as typed, never synonyms, that are long enough to be indexed."""
    return [w for w in tokens_of(term, 1) if len(w) >= settings.min_token_size]


def statistics(documents: DataFrame, query: SearchQuery, words: list[str]) -> Statistics:
    """One pass over the scope for all words and fields."""
    counts = [F.sum(has_prefix(F.col(f), w).cast("long")).alias(f"{f}:{i}") for f, _ in FIELDS for i, w in enumerate(words)]
    row = documents.where((F.col("shop_id") == query.shop_id) & (F.col("lang_id") == query.lang_id)).agg(F.count("*").alias("n"), *counts).first()
    return Statistics(row["n"], {(f, w): row[f"{f}:{i}"] or 0 for f, _ in FIELDS for i, w in enumerate(words)})


def frequency(tokens: Column, word: str) -> Column:
    """How many tokens begin with the word. (A second parameter of the lambda would be the token's place.)"""
    return F.size(F.filter(tokens, lambda t: F.startswith(t, F.lit(word))))


def relevance(words: list[str], stats: Statistics) -> Column:
    """3 * boost + text, each the sum of tf * idf squared if every word is in the field, rounded."""
    import math

    total = F.lit(0.0)
    for name, weight in FIELDS:
        tf = [frequency(F.col(name), w) for w in words]
        idf = [math.log10(stats.n / stats.frequency[name, w]) ** 2 if stats.frequency[name, w] else 0.0 for w in words]
        rank = reduce(lambda a, b: a + b, (t * F.lit(i) for t, i in zip(tf, idf, strict=True)))
        total = total + F.when(_all([t > 0 for t in tf]), rank).otherwise(0.0) * weight
    return F.round(total, 6)
