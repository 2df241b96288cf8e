"""Documents as facet counting reads them: no texts, and a dense number for each product.

A product's number is split into a word and a bit of it. Products that hold a value are then 64-bit words which merge by
OR, in each task before the shuffle and after it; so what is shuffled for a value that many products hold is one row for 64 of
them, and for one that few hold no more rows than products. A count is the sum of the words' bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import ranking
from lodestone.schema import CELLS

SCOPE = ["shop_id", "lang_id"]
BITS = 64


def build(documents: DataFrame) -> DataFrame:
    """Rows of ``CELLS``, one a document, in the order of their products' numbers.

    The variants of a product and the products of a word lie side by side, so most words are whole in one task. An attribute that a document
    repeats stands once. Numbers are dense in each scope; products deleted later leave theirs free.
    """
    products = documents.select(*SCOPE, "group_id").distinct()
    numbers = ranking.placed(products, [F.col(c) for c in (*SCOPE, "group_id")], "number")
    numbers = numbers.select(*SCOPE, "group_id", F.floor(F.col("number") / BITS).cast("long").alias("word"), F.expr(f"shiftleft(1L, cast(number % {BITS} AS int))").alias("mask"))
    held = F.array_distinct(F.transform("attributes", lambda a: F.struct(a["attr_id"].alias("attr_id"), a["value_id"].alias("value_id"), a["value"].alias("value"))))
    rows = documents.select(*SCOPE, "id", "group_id", "visible", "manufacturer_id", "price", held.alias("attributes")).join(numbers, [*SCOPE, "group_id"])
    order = [*SCOPE, "word", "id"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).to(rows.sparkSession.createDataFrame([], CELLS).schema)


def words(rollup: DataFrame, cells: DataFrame) -> DataFrame:
    """The roll-up with products as words: shop_id, lang_id, attr_id, value_id, value, word, mask; sorted by word."""
    numbers = cells.select(*SCOPE, "group_id", "word", "mask").distinct()
    found = rollup.join(numbers, [*SCOPE, "group_id"]).groupBy(*SCOPE, "attr_id", "value_id", "value", "word").agg(F.bit_or("mask").alias("mask"))
    order = [*SCOPE, "word", "attr_id", "value_id"]
    return found.repartitionByRange(*order).sortWithinPartitions(*order)


def merged(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each of the keys and word: the bits of all products there."""
    return rows.groupBy(*keys, "word").agg(F.bit_or("mask").alias("mask"))


def products(mask: str = "mask"):
    """How many products the words of a group hold."""
    return F.sum(F.bit_count(mask)).cast("long")
