"""Options with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    engine: str = "sql"
    inherit_attributes: bool = True
    manage_stock: bool = True
    min_term_length: int = 2
    #: Words shorter than this are looked for inside the boost text instead of the token index.
    min_token_size: int = 3
    correct: bool = True
    auto_apply: bool = True
    correct_up_to_hits: int = 0
    min_frequency: int = 2
    candidates: int = 400
    facet_values: int = 30
    suggest_terms: int = 6
    suggest_products: int = 6
    suggest_categories: int = 4
    suggest_min_length: int = 2
    log_enabled: bool = True
    #: Attributes offered as facets (none: no facets) and put into the search text (none: all).
    facet_attributes: tuple[str, ...] = ()
    searchable_attributes: tuple[str, ...] = ()
    display_modes: dict[str, str] = field(default_factory=dict)


def active_languages(rows: list[tuple[int, bool]]) -> list[int]:
    """Ids of the active languages; none active is language 0."""
    return [i for i, active in rows if active] or [0]


def scopes(shops: list[int], languages: list[int], shop: int | None = None, lang: int | None = None) -> list[tuple[int, int]]:
    """Every shop with every language; an explicit id stands for all."""
    return [(s, x) for s in (shops if shop is None else [shop]) for x in (languages if lang is None else [lang])]
