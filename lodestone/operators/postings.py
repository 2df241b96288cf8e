"""Terms looked up in stored postings: which documents match, and how well, without reading a document.

A term asks for groups of alternatives. Each alternative comes down to atoms that rows of the postings answer: a word as a prefix of a
token, a short word as a gram of the boost text, a phrase as tokens at adjoining places. All atoms are read in one
scan, whose filter reaches the sorted files, and summed up by document; the groups are then a condition on
that row. Relevance comes from the same rows: how many tokens begin with a word, and how many documents hold one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.color import let
from lodestone.functions.text import tokens_of
from lodestone.operators.synonyms import Expander, Words
from lodestone.plans.model import Index, SearchQuery
from lodestone.settings import Settings

#: Short words are kept as the grams of one and two characters of the boost text's words.
GRAM = 2
WEIGHTS = (("boost", 3), ("search", 1))


def build(documents: DataFrame) -> DataFrame:
    """shop_id, lang_id, field, token, id, tf, positions; sorted by token, so that a prefix reads few row groups.

    A document's tokens are counted in its own row; only the sorting moves them.
    """

    def entries(tokens: Column, places: bool) -> Column:
        """The runs of equal tokens once they are sorted, with the places of each."""

        def runs(x: Column) -> Column:
            same = lambda i: F.get(x, i)["token"].eqNullSafe(F.get(x, i - 1)["token"])
            starts = F.filter(F.transform(x, lambda _, i: i), lambda i: (i == 0) | ~same(i))

            def run(begins: Column, begin: Column, k: Column) -> Column:
                length = F.coalesce(F.get(begins, k + 1), F.size(x)) - begin
                at = F.transform(F.slice(x, begin + 1, length), lambda e: e["at"]) if places else F.lit(None).cast("array<int>")
                return F.struct(F.get(x, begin)["token"].alias("token"), length.cast("long").alias("tf"), at.alias("positions"))

            return let(starts, lambda begins: F.transform(begins, lambda begin, k: run(begins, begin, k)))

        return let(F.array_sort(F.transform(tokens, lambda t, i: F.struct(t.alias("token"), i.alias("at")))), runs)

    def words(field: str, places: bool) -> DataFrame:
        found = documents.select("shop_id", "lang_id", "id", F.explode(entries(F.col(f"{field}_tokens"), places)).alias("e"))
        return found.select("shop_id", "lang_id", F.lit(field).alias("field"), "e.token", "id", "e.tf", "e.positions")

    return _sorted(words("search", True).unionByName(words("boost", False)), "field", "token")


def grams(documents: DataFrame) -> DataFrame:
    """shop_id, lang_id, gram, id: the one- and two-character parts of each document's boost words."""

    def parts(w: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.array(F.substring(w, i, F.lit(1)), F.substring(w, i, F.lit(GRAM)))))

    words = F.filter("boost_tokens", lambda w: F.length(w) > 0)
    return _sorted(documents.select("shop_id", "lang_id", F.explode(F.array_distinct(F.flatten(F.transform(words, parts)))).alias("gram"), "id"), "gram")


def _sorted(df: DataFrame, *keys: str) -> DataFrame:
    # The id last: a token that most documents hold is spread over many ranges.
    order = ["shop_id", "lang_id", *keys, "id"]
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def sizes(documents: DataFrame) -> DataFrame:
    """How many documents each scope has, hidden ones too."""
    return documents.groupBy("shop_id", "lang_id").agg(F.count("*").alias("documents"))


def _is(field: str, token: Column) -> Column:
    return (F.col("field") == field) & token


@dataclass
class Lookup:
    """What a term asks of the postings."""

    #: For each atom the rows that answer it and how they are summed up.
    rows: dict[str, Column]
    sums: dict[str, Column]
    condition: Column
    #: Whether a document that fulfils the condition matches the term for sure.
    exact: bool


def _prefix(word: str) -> Column:
    return _is("search", F.startswith(F.col("token"), F.lit(word)))


def looked_up(groups: list[list[Words]], settings: Settings, with_grams: bool) -> Lookup | None:
    """None if no group can be narrowed by what is stored."""
    rows: dict[str, Column] = {}
    sums: dict[str, Column] = {}
    exact, parts = True, []

    def holds(row: Column, name: str) -> Column:
        rows[name], sums[name] = row, F.bool_or(row)
        return F.col(f"`{name}`")

    def word(w: str) -> Column | None:
        nonlocal exact
        if len(w) >= settings.min_token_size:
            return holds(_prefix(w), f"p {w}")
        if not with_grams:
            exact = False
            return None
        # A word of more characters than a gram must hold all of its grams, and is compared with the text later.
        exact = exact and len(w) <= GRAM
        found = [holds(_is("gram", F.col("token") == w[i : i + GRAM]), f"g {w[i : i + GRAM]}") for i in range(max(1, len(w) - GRAM + 1))]
        return reduce(lambda a, b: a & b, found)

    def phrase(words: Words) -> Column:
        names = []
        for w in words:
            row = _is("search", F.col("token") == w)
            rows[f"t {w}"], sums[f"t {w}"] = row, F.max(F.when(row, F.col("positions")))
            names.append(F.col(f"`t {w}`"))
        rest = lambda at: reduce(lambda a, b: a & b, [F.array_contains(n, at + k) for k, n in enumerate(names[1:], 1)])
        # All words stand in the document, one behind the other.
        return F.coalesce(F.exists(names[0], rest), F.lit(False))

    for group in groups:
        choices = []
        for words in group:
            if len(words) > 1 and all(len(w) >= settings.min_token_size for w in words):
                choices.append(phrase(words))
            else:
                found = [c for c in map(word, words) if c is not None]
                choices.append(reduce(lambda a, b: a & b, found) if found else None)
        if choices and all(c is not None for c in choices):
            parts.append(reduce(lambda a, b: a | b, choices))
    return Lookup(rows, sums, reduce(lambda a, b: a & b, parts), exact) if parts else None


def rows_of(index: Index, query: SearchQuery, wanted: list[Column], with_tokens: bool, with_grams: bool) -> DataFrame:
    """The stored rows of the scope that answer any atom."""
    scope = (F.col("shop_id") == query.shop_id) & (F.col("lang_id") == query.lang_id)
    parts = []
    if with_tokens:
        parts.append(index.part("postings").where(scope).select("field", "token", "id", "tf", "positions"))
    if with_grams:
        parts.append(index.part("grams").where(scope).select(F.lit("gram").alias("field"), F.col("gram").alias("token"), "id", F.lit(1).cast("long").alias("tf"), F.lit(None).cast("array<int>").alias("positions")))
    found = reduce(DataFrame.unionByName, parts)
    return found.where(reduce(lambda a, b: a | b, wanted))


def _tf(field: str, i: int) -> str:
    return f"tf {field} {i}"


def matches(index: Index, query: SearchQuery, expander: Expander, settings: Settings, scored: list[str] = ()) -> tuple[DataFrame, bool] | None:
    """(id of each document that the term can match, with its score if words are ``scored``; whether it is sure), or None.

    The score is 3 * boost + text, each the sum of tf * idf squared if every scored word is in the field, rounded.
    """
    look = looked_up(expander.expand(tokens_of(query.term, 1)), settings, index.has("grams"))
    if look is None:
        return None
    rows, sums = dict(look.rows), dict(look.sums)
    for i, w in enumerate(scored):
        for field, _ in WEIGHTS:
            row = _is(field, F.startswith(F.col("token"), F.lit(w)))
            rows[_tf(field, i)], sums[_tf(field, i)] = row, F.coalesce(F.sum(F.when(row, F.col("tf"))), F.lit(0))
    of_grams = [name.startswith("g ") for name in rows]
    hits = rows_of(index, query, list(rows.values()), not all(of_grams), any(of_grams)).groupBy("id").agg(*(c.alias(name) for name, c in sums.items()))
    if not scored:
        return hits.where(look.condition).select("id"), look.exact
    held = {(f, i): f"df {f} {i}" for f, _ in WEIGHTS for i in range(len(scored))}
    # One row: for each word and field the documents that hold it; the grouped rows are shuffled once for both.
    counts = hits.agg(*(F.sum((F.col(f"`{_tf(*k)}`") > 0).cast("long")).alias(name) for k, name in held.items()))
    scope = (F.col("shop_id") == query.shop_id) & (F.col("lang_id") == query.lang_id)
    size = (index.part("sizes").where(scope).agg(F.sum("documents").alias("n")) if index.has("sizes") else index.documents.where(scope).agg(F.count("*").alias("n")))
    both = hits.where(look.condition).join(F.broadcast(counts.join(F.broadcast(size))))
    total = F.lit(0.0)
    for field, weight in WEIGHTS:
        tf = [F.col(f"`{_tf(field, i)}`") for i in range(len(scored))]
        idf = [F.when(F.col(f"`{held[field, i]}`") > 0, F.pow(F.log10(F.col("n") / F.col(f"`{held[field, i]}`")), F.lit(2.0))).otherwise(0.0) for i in range(len(scored))]
        rank = reduce(lambda a, b: a + b, (t * i for t, i in zip(tf, idf, strict=True)))
        total = total + F.when(reduce(lambda a, b: a & b, [t > 0 for t in tf]), rank).otherwise(0.0) * weight
    return both.select("id", F.round(total, 6).alias("score")), look.exact
