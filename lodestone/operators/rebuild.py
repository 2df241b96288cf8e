"""A whole rebuild: documents of every scope, derived tables, publication; any error rolls back."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import DataFrame

from lodestone.operators import documents
from lodestone.operators.writer import IndexWriter
from lodestone.settings import Settings


GOAL_SECONDS, SMALLEST, LARGEST = 4.0, 50, 2000


@dataclass(frozen=True)
class Tick:
    """Where a rebuild in steps stands; it can be kept between steps and taken up by another process."""

    version: str
    total: int
    cursor: str = ""
    done: int = 0
    size: int = 200
    phase: str = "index"  # index, then publish, then ready


def started(writer: IndexWriter, tables, scope: tuple[int, int], size: int = 200) -> Tick:
    writer.begin([scope])
    return Tick(writer.staging, documents.scope_count(tables["articles"]), size=size)


def tick(writer: IndexWriter, tables, scope: tuple[int, int], state: Tick, settings: Settings, now: datetime) -> Tick:
    """One step: the next batch of documents, or publication when none is left."""
    writer.resume(state.version, [scope])
    if state.phase == "index":
        begin = time.perf_counter()
        found, last = documents.batch(tables, *scope, settings, now, state.cursor, state.size)
        if last == state.cursor:
            return replace(state, phase="publish")
        # Named by where it began: a step whose answer was lost is written over when it is done again.
        writer.write(found, step=state.cursor)
        # The last batch may be shorter; a batch holds every article between two cursors.
        return replace(state, cursor=last, done=min(state.total, state.done + state.size), size=next_size(state.size, time.perf_counter() - begin))
    writer.commit(tables["object2category"])
    return replace(state, phase="ready", done=state.total)


def next_size(size: int, seconds: float) -> int:
    """The batch that would take GOAL_SECONDS, at most twice or half as large, between SMALLEST and LARGEST."""
    factor = min(2.0, max(0.5, GOAL_SECONDS / seconds)) if seconds > 0 else 2.0
    return max(SMALLEST, min(LARGEST, round(size * factor)))


def progress(done: int, total: int, seconds: float) -> tuple[float, float | None]:
    """(documents a second, seconds that remain; None while nothing is done)."""
    rate = done / seconds if seconds > 0 else 0.0
    return rate, (total - done) / rate if rate else None


def rebuild(writer: IndexWriter, catalog: Callable[[int, int], dict[str, DataFrame]], scopes: list[tuple[int, int]], settings: Settings, now: datetime, force: bool = False):
    """Each scope is one job; links are read once all documents are staged."""
    writer.begin(scopes)
    try:
        links = None
        for shop, lang in scopes:
            tables = catalog(shop, lang)
            writer.write(documents.build(tables, shop, lang, settings, now))
            links = tables["object2category"] if links is None else links.unionByName(tables["object2category"])
        return writer.commit(links.distinct() if links is not None else None, force)
    except Exception:
        writer.rollback()
        raise
