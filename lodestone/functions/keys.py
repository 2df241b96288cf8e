"""Deterministic ids: MD5 of the parts that make a row what it is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import normalize


def _joined(*parts: Column) -> Column:
    return F.md5(F.concat_ws("_", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


def document_id(article: Column, shop: Column, lang: Column) -> Column:
    return _joined(article, shop, lang)


def value_id(value: Column) -> Column:
    return F.md5(normalize(value))


def attribute_row_id(document: Column, attribute: Column, value: Column) -> Column:
    return F.md5(F.concat(document, attribute, value))


def rollup_id(shop: Column, lang: Column, group: Column, attribute: Column, value: Column) -> Column:
    return _joined(shop, lang, group, attribute, value)


def category_link_id(shop: Column, lang: Column, group: Column, category: Column) -> Column:
    return _joined(shop, lang, group, category)


def dictionary_id(term: Column, shop: Column, lang: Column) -> Column:
    return _joined(term, shop, lang)


def log_id(shop: Column, lang: Column, day: Column, term: Column) -> Column:
    return _joined(shop, lang, day, term)


def insert_date(text: Column) -> Column:
    """Blank and zero dates are no date."""
    trimmed = F.trim(text)
    return F.when((trimmed != "") & ~trimmed.startswith("0000-00-00"), F.try_to_timestamp(trimmed)).cast("timestamp_ntz")


def insert_seconds(stamp: Column) -> Column:
    """Seconds since 1970, null for no date."""
    return F.unix_timestamp(stamp.cast("timestamp"))


def packed_value(value: Column, label: Column) -> Column:
    """Id and label in one string, apart by the unit separator."""
    return F.concat(value, F.lit("\x1f"), label)


def unpacked_value(packed: Column) -> Column:
    at = F.instr(packed, "\x1f")
    return F.struct(
        F.when(at > 0, F.substring(packed, F.lit(1), at - 1)).otherwise(packed).alias("value_id"),
        F.when(at > 0, F.substring(packed, at + 1, F.length(packed))).otherwise(packed).alias("label"),
    )


def facet_field(attribute: str, label: bool = False) -> str:
    return ("fl_" if label else "f_") + attribute
