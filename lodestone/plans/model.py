"""Logical queries, results, and the parsing of request parameters."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from lodestone.functions.text import is_id

SORTS = ("relevance", "price_asc", "price_desc", "title_asc", "newest", "bestseller")
MOST_ATTRIBUTES, MOST_VALUES = 20, 50


@dataclass(frozen=True)
class FacetFilter:
    attribute: str
    values: tuple[str, ...]


@dataclass(frozen=True)
class SearchQuery:
    shop_id: int
    lang_id: int
    term: str = ""
    filters: tuple[FacetFilter, ...] = ()
    sort: str = "relevance"
    limit: int = 10
    offset: int = 0
    category: str | None = None
    manufacturer: str | None = None
    price_from: float | None = None
    price_to: float | None = None
    allow_correction: bool = True

    def corrected(self, term: str) -> SearchQuery:
        return replace(self, term=term, allow_correction=False)

    def with_limit(self, limit: int) -> SearchQuery:
        return replace(self, limit=limit)

    def without_filter(self, attribute: str) -> SearchQuery:
        return replace(self, filters=tuple(f for f in self.filters if f.attribute != attribute))

    @property
    def used_filters(self) -> tuple[FacetFilter, ...]:
        return tuple(f for f in self.filters if f.values)

    @property
    def active_filters(self) -> int:
        return sum(len(f.values) for f in self.filters)

    @property
    def is_first_look(self) -> bool:
        """Only an unrefined first page counts as a search."""
        return not self.used_filters and self.sort == "relevance" and self.price_from is None and self.price_to is None and self.offset == 0

    def cache_key(self, view: str) -> str:
        """The same for filters in any order."""
        chosen = {f.attribute: sorted(f.values) for f in sorted(self.used_filters, key=lambda f: f.attribute)}
        return f"{view}_{hashlib.md5(json.dumps(chosen, sort_keys=True).encode()).hexdigest()}"


@dataclass(frozen=True)
class SuggestQuery:
    shop_id: int
    lang_id: int
    term: str
    terms: int = 6
    products: int = 6
    categories: int = 4


@dataclass(frozen=True)
class Correction:
    original: str
    corrected: str
    distance: int
    count: int
    applied: bool = False
    hits: int = 0


@dataclass(frozen=True)
class FacetValue:
    value_id: str
    label: str
    count: int
    selected: bool = False
    hex: str | None = None

    @property
    def selectable(self) -> bool:
        return self.count > 0 or self.selected


@dataclass(frozen=True)
class Facet:
    attribute: str
    title: str
    values: tuple[FacetValue, ...]
    position: int = 0
    kind: str = "default"
    grouped: bool = False

    @property
    def has_selection(self) -> bool:
        return any(v.selected for v in self.values)

    @property
    def selected_values(self) -> tuple[FacetValue, ...]:
        return tuple(v for v in self.values if v.selected)

    def truncated(self, limit: int) -> bool:
        return len(self.values) >= limit


@dataclass(frozen=True)
class SearchResult:
    query: SearchQuery
    total: int = 0
    ids: tuple[str, ...] = ()
    facets: tuple[Facet, ...] = ()
    correction: Correction | None = None

    def facet(self, attribute: str) -> Facet | None:
        return next((f for f in self.facets if f.attribute == attribute), None)

    @property
    def has_selection(self) -> bool:
        return any(f.has_selection for f in self.facets)


@dataclass(frozen=True)
class SuggestResult:
    terms: tuple[str, ...] = ()
    products: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    brands: tuple[str, ...] = ()
    total: int = 0

    @property
    def empty(self) -> bool:
        return not (self.terms or self.products or self.categories or self.brands)


@dataclass
class Index:
    """Derived tables of one scope or of several."""

    documents: DataFrame
    rollup: DataFrame | None = None
    categories: DataFrame | None = None
    dictionary: DataFrame | None = None
    #: Lists that are small by nature.
    rules: list = field(default_factory=list)
    #: Tokens and the documents that hold them; without it every search looks at all documents.
    postings: DataFrame | None = None
    #: Short parts of the boost text, and the documents of each scope; without them documents are read for both.
    grams: DataFrame | None = None
    sizes: DataFrame | None = None
    #: Documents without texts, their products numbered, and the roll-up by these numbers; without them products are told apart by name.
    cells: DataFrame | None = None
    words: DataFrame | None = None
    #: Parts that are not there yet, each made when a search first asks for it.
    later: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)

    def has(self, name: str) -> bool:
        return name in self.later or getattr(self, name) is not None

    def part(self, name: str) -> DataFrame | None:
        if getattr(self, name) is None and name in self.later:
            setattr(self, name, self.later[name]())
        return getattr(self, name)


def sort_of(order: str | None) -> str:
    """The request's sort expression; titles always ascend."""
    text = (order or "").lower()
    down = "desc" in text
    for word, up, low in (("price", "price_asc", "price_desc"), ("title", "title_asc", "title_asc"), ("insert", "newest", "newest"), ("sold", "bestseller", "bestseller")):
        if word in text:
            return low if down else up
    return "relevance"


def filters_of(raw: object) -> tuple[FacetFilter, ...]:
    """At most 20 attributes with 50 values each; what is no id is dropped."""
    if not isinstance(raw, dict):
        return ()
    out = []
    for attribute, values in raw.items():
        if len(out) == MOST_ATTRIBUTES:
            break
        if not is_id(attribute):
            continue
        wanted = values if isinstance(values, list | tuple) else [values]
        kept = tuple(dict.fromkeys(v for v in wanted if is_id(v)))[:MOST_VALUES]
        if kept:
            out.append(FacetFilter(attribute, kept))
    return tuple(out)


def text_of(value: object) -> str:
    return str(value) if isinstance(value, str | int | float | bool) else ""


def int_of(value: object) -> int:
    try:
        return int(float(value)) if isinstance(value, str | int | float | bool) else 0
    except ValueError:
        return 0


def number_of(value: object) -> float | None:
    try:
        return float(value) if isinstance(value, str | int | float) and not isinstance(value, bool) else None
    except ValueError:
        return None


def query_of(params: dict, shop_id: int, lang_id: int, page_size: int = 10) -> SearchQuery:
    """A search request's parameters."""
    page = max(0, int_of(params.get("page", 0)))
    category, manufacturer = params.get("category"), params.get("manufacturer")
    return SearchQuery(
        shop_id,
        lang_id,
        text_of(params.get("term", "")),
        filters_of(params.get("filters")),
        sort_of(text_of(params.get("sort", ""))),
        page_size,
        page * page_size,
        category if is_id(category) else None,
        manufacturer if is_id(manufacturer) else None,
        number_of(params.get("price_from")),
        number_of(params.get("price_to")),
        params.get("uncorrected") not in (True, "1", 1),
    )


def category_query(category: str, params: dict, shop_id: int, lang_id: int, page_size: int = 10) -> SearchQuery:
    return replace(query_of(params, shop_id, lang_id, page_size), term="", category=category, manufacturer=None)


def manufacturer_query(manufacturer: str, params: dict, shop_id: int, lang_id: int, page_size: int = 10) -> SearchQuery:
    return replace(query_of(params, shop_id, lang_id, page_size), term="", category=None, manufacturer=manufacturer)
