"""Searching: matching, collapsing variants to products, ranking, paging, correction and suggestions."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import normalized, tokens_of
from lodestone.operators import cells, correction, facets, postings, predicate, suggest
from lodestone.operators.synonyms import Expander
from lodestone.plans.model import Correction, Index, SearchQuery, SearchResult, SuggestQuery, SuggestResult
from lodestone.settings import Settings


def ranked(matching: DataFrame, query: SearchQuery, relevance=None) -> DataFrame:
    """One row for each product, best first; every order ends in the id."""
    score = relevance if relevance is not None else F.lit(0.0)
    out = matching.withColumn("score", score).groupBy("group_id").agg(
        F.min("price").alias("min_price"), F.max("price").alias("max_price"), F.min("title").alias("title"), F.max("insert_date").alias("insert_date"), F.max("sold").alias("sold"), F.max("score").alias("score")
    )
    orders = {
        "price_asc": [F.col("min_price").asc()],
        "price_desc": [F.col("max_price").desc()],
        "title_asc": [F.col("title").asc()],
        "newest": [F.col("insert_date").desc_nulls_last()],
        "bestseller": [F.col("sold").desc()],
        "relevance": [F.col("score").desc(), F.col("sold").desc()] if relevance is not None else [F.col("sold").desc(), F.col("title").asc()],
    }
    return out.orderBy(*orders[query.sort], "group_id")


class Engine:
    """An index with settings: counts, pages, facets, corrections and suggestions."""

    def __init__(self, index: Index, settings: Settings):
        self.index, self.settings = index, settings
        self.expander = Expander(index.rules)

    def available(self, shop_id: int, lang_id: int) -> bool:
        """Does the index hold a document of the scope?"""
        return not self.index.documents.where((F.col("shop_id") == shop_id) & (F.col("lang_id") == lang_id)).isEmpty()

    def matching(self, query: SearchQuery) -> DataFrame:
        documents, rest = self.narrowed(query)
        return predicate.matching(documents, self.index.part("categories"), rest, self.expander, self.settings)

    def narrowed(self, query: SearchQuery, scored: list[str] = ()) -> tuple[DataFrame, SearchQuery]:
        """(documents that are looked at for a query, what they still have to meet); with a score if words are scored.

        Where the postings answer the whole term, no text of a document is read.
        """
        found = postings.matches(self.index, query, self.expander, self.settings, scored) if self.index.has("postings") else None
        if found is None:
            return self.index.documents, query
        hits, sure = found
        return self.index.documents.join(hits, "id", "inner" if scored else "left_semi"), replace(query, term="") if sure else query

    def counted(self, query: SearchQuery) -> tuple[DataFrame, SearchQuery]:
        """(what a query's products are counted on, what is still to be met): cells, if the term asks for nothing that only a text can tell."""
        if not self.index.has("cells"):
            return self.narrowed(query)
        if not self.expander.expand(tokens_of(query.term, 1)):
            return self.index.part("cells"), replace(query, term="")
        found = postings.matches(self.index, query, self.expander, self.settings) if self.index.has("postings") else None
        if found is None or not found[1]:
            return self.narrowed(query)
        return self.index.part("cells").join(found[0], "id", "left_semi"), replace(query, term="")

    def count(self, query: SearchQuery) -> int:
        rows, rest = self.counted(query)
        found = predicate.matching(rows, self.index.part("categories"), rest, self.expander, self.settings)
        if "word" in found.columns:
            return cells.merged(found).agg(cells.products()).first()[0] or 0
        return found.agg(F.countDistinct("group_id")).first()[0]

    def page(self, query: SearchQuery) -> DataFrame:
        words = predicate.scored_words(query.term, self.settings) if query.sort == "relevance" else []
        documents, rest = self.narrowed(query, words)
        score = None
        if words:
            score = F.col("score") if "score" in documents.columns else predicate.relevance(words, predicate.statistics(documents, query, words))
        return ranked(predicate.matching(documents, self.index.part("categories"), rest, self.expander, self.settings), query, score).offset(query.offset).limit(query.limit)

    def facet_counts(self, query: SearchQuery, unit: str = "groups") -> DataFrame:
        documents, rest = self.counted(query)
        return facets.counts(documents, self.index.part("categories"), rest, self.expander, self.settings, self.settings.facet_attributes, unit)

    def rollup_counts(self, query: SearchQuery) -> DataFrame:
        documents, rest = self.counted(query)
        derived = self.index.part("words") if self.index.has("words") and "word" in documents.columns else self.index.part("rollup")
        return facets.rollup_counts(documents, self.index.part("categories"), derived, rest, self.expander, self.settings, self.settings.facet_attributes)

    def facet_rows(self, query: SearchQuery, unit: str = "groups", mode: str = "exact") -> DataFrame:
        if mode == "rollup" and facets.use_rollup(query, self.index.part("rollup")):
            found = self.rollup_counts(query)
        else:
            found = self.facet_counts(query, unit)
        chosen = {f.attribute: f.values for f in query.used_filters}
        return facets.top_values(found, self.settings.facet_values, chosen)

    def facets(self, query: SearchQuery, titles: dict[str, str] | None = None, custom: dict[str, str] | None = None, unit: str = "groups"):
        if not self.settings.facet_attributes:
            return ()
        rows = self.facet_rows(query, unit).collect()
        shown = {(r["attr_id"], r["value_id"]) for r in rows}
        missing = [(f.attribute, v) for f in query.used_filters for v in f.values if (f.attribute, v) not in shown]
        labels = facets.vanished_labels(self.index, query, missing) if missing else {}
        return facets.assembled(rows, self.settings.facet_attributes, titles or {}, custom or {}, query, self.settings, labels)

    def search(self, query: SearchQuery) -> SearchResult:
        total = self.count(query)
        if query.term and query.allow_correction and self.settings.correct and total <= self.settings.correct_up_to_hits and self.index.has("dictionary"):
            better = self.corrected(query, total)
            if better is not None:
                return better
        return self._result(query, total)

    def _result(self, query: SearchQuery, total: int, correction_: Correction | None = None, page: bool = True) -> SearchResult:
        ids = tuple(r["group_id"] for r in self.page(query).select("group_id").collect()) if page and total and query.limit else ()
        return SearchResult(query, total, ids, self.facets(query), correction_)

    def corrected(self, query: SearchQuery, total: int) -> SearchResult | None:
        """The corrected search if it finds more; applied or only suggested by setting."""
        found = correction.correct(self.index.part("dictionary"), query.shop_id, query.lang_id, query.term, self.settings, self.expander.known)
        if found is None or found.corrected == query.term:
            return None
        changed = query.corrected(found.corrected)
        hits = self.count(changed)
        if hits <= total:
            return None
        applied = self.settings.auto_apply
        noted = Correction(found.original, found.corrected, found.distance, found.count, applied, hits)
        return self._result(changed, hits, noted) if applied else self._result(query, total, noted)

    def facets_only(self, query: SearchQuery) -> SearchResult:
        """Total and facets; no page is read."""
        return self._result(query, self.count(query), page=False)

    def suggest(self, query: SuggestQuery, categories: DataFrame | None = None) -> SuggestResult:
        term = normalized(query.term)
        if len(term) < self.settings.suggest_min_length:
            return SuggestResult()
        search = SearchQuery(query.shop_id, query.lang_id, term, limit=query.products)
        terms: list[str] = []
        if self.index.has("dictionary"):
            terms = suggest.completed(self.index.part("dictionary"), query.shop_id, query.lang_id, term, query.terms)
            if not terms and self.settings.correct:
                found = correction.correct(self.index.part("dictionary"), query.shop_id, query.lang_id, term, self.settings, self.expander.known)
                terms = suggest.completed(self.index.part("dictionary"), query.shop_id, query.lang_id, found.corrected, query.terms) if found else []
        total = self.count(search)
        products = tuple(r["group_id"] for r in self.page(search).collect()) if total else ()
        # Categories are looked for by what was typed, not by its normal form.
        found = tuple(r["id"] for r in suggest.categories(categories, query.term, query.categories).collect()) if categories is not None else ()
        return SuggestResult(tuple(terms), products, found, (), total)


class NullEngine:
    """An engine that is never there."""

    def available(self, shop_id: int, lang_id: int) -> bool:
        return False

    def search(self, query: SearchQuery) -> SearchResult:
        return SearchResult(query)

    def suggest(self, query: SuggestQuery, categories: DataFrame | None = None) -> SuggestResult:
        return SuggestResult()


ENGINES = {"sql": Engine, "none": NullEngine}


class Locator:
    """The engine of each shop by its settings, made once; one that is unknown or has no index is the null engine."""

    def __init__(self, index: Index | None, settings_of):
        self.index, self.settings_of = index, settings_of
        self.made: dict[int, Engine | NullEngine] = {}

    def engine(self, shop_id: int) -> Engine | NullEngine:
        if shop_id not in self.made:
            settings = self.settings_of(shop_id)
            kind = ENGINES.get(settings.engine, NullEngine) if self.index is not None else NullEngine
            self.made[shop_id] = kind() if kind is NullEngine else kind(self.index, settings)
        return self.made[shop_id]


def in_rank_order(ids: DataFrame, articles: DataFrame) -> DataFrame:
    """Articles of an ordered id list (columns pos and id); ids without an article drop out."""
    return ids.join(articles, "id").orderBy("pos")


def ordered(ids: list[str], articles: DataFrame) -> DataFrame:
    """The same for a page of ids."""
    listed = articles.sparkSession.createDataFrame(list(enumerate(ids)), "pos long, id string")
    return in_rank_order(F.broadcast(listed), articles)
