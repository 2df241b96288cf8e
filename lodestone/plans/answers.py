"""Results as JSON, as a shop's pages ask for them."""

from __future__ import annotations

import json

from lodestone.plans.model import Facet, SearchResult, SuggestResult


def facet(found: Facet, limit: int) -> dict:
    """A facet's values, and whether there may be more than the ``limit`` that are shown."""
    values = [{"id": v.value_id, "label": v.label, "count": v.count, "selected": v.selected, "hex": v.hex} for v in found.values]
    return {"id": found.attribute, "title": found.title, "type": found.kind, "grouped": found.grouped, "truncated": len(values) >= limit, "values": values}


def facets(result: SearchResult, limit: int) -> str:
    return json.dumps({"total": result.total, "facets": [facet(f, limit) for f in result.facets]}, ensure_ascii=False)


def search(result: SearchResult, limit: int) -> str:
    c = result.correction
    noted = {"original": c.original, "corrected": c.corrected, "applied": c.applied, "hits": c.hits} if c else None
    return json.dumps({"total": result.total, "ids": list(result.ids), "correction": noted, "facets": [facet(f, limit) for f in result.facets]}, ensure_ascii=False)


def suggest(result: SuggestResult, titles: dict[str, str] | None = None) -> str:
    """Products and categories with their titles, or their ids where there is none."""
    named = lambda ids: [{"id": i, "title": (titles or {}).get(i, i)} for i in ids]
    return json.dumps({"terms": list(result.terms), "products": named(result.products), "categories": named(result.categories), "brands": list(result.brands), "total": result.total}, ensure_ascii=False)
