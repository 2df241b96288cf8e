"""Health of an index: sizes, freshness, short terms, leftovers and timed searches."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import dictionary
from lodestone.operators.agreement import agreement, nearest_rank
from lodestone.operators.search import Engine
from lodestone.plans.model import FacetFilter, Index, SearchQuery

SLOW_MS, TOO_SLOW_MS = 500, 2000


@dataclass(frozen=True)
class Finding:
    check: str
    level: str  # ok, hint or problem
    text: str


def status(index: Index) -> DataFrame:
    """Rows of each scope, and how many are visible."""
    return index.documents.groupBy("shop_id", "lang_id").agg(F.count("*").alias("documents"), F.sum(F.col("visible").cast("long")).alias("shown"), F.count_distinct("group_id").alias("products"))


def timed(engine: Engine, query: SearchQuery, runs: int = 3) -> dict:
    """One warm-up, then the runs: median, p95, least, most and what was found."""
    engine.search(query)
    took, total = [], 0
    for _ in range(runs):
        begin = time.perf_counter()
        total = engine.search(query).total
        took.append((time.perf_counter() - begin) * 1000)
    return {"term": query.term, "median": nearest_rank(took, 0.5), "p95": nearest_rank(took, 0.95), "min": min(took), "max": max(took), "total": total}


def level_of(ms: float) -> str:
    return "ok" if ms < SLOW_MS else "hint" if ms <= TOO_SLOW_MS else "problem"


FRESH_DAYS = 7


def sizes(writer) -> dict[str, int]:
    """Bytes of each dataset of the live index."""
    found = writer.manifest()
    out = dict.fromkeys(found["parts"], 0) if found else {}
    for name in out:
        for scope, version in found["parts"][name].items():
            shop, lang = scope.split("/")
            out[name] += writer._files().getContentSummary(writer._path(version, name, f"shop_id={shop}", f"lang_id={lang}")).getLength()
    return out


def storage(writer, now: float | None = None) -> list[Finding]:
    """Freshness, memory and leftovers of an index folder."""
    written, out = writer.last_write(), []
    age = ((now if now is not None else time.time()) - written) / 86400 if written is not None else None
    out.append(Finding("freshness", "problem" if age is None else "hint" if age > FRESH_DAYS else "ok", "never written" if age is None else f"written {age:.1f} days ago"))
    held, heap = sum(sizes(writer).values()), writer.spark.sparkContext._jvm.java.lang.Runtime.getRuntime().maxMemory()
    out.append(Finding("memory", "ok" if held <= heap else "hint", f"index {bytes_text(held)}, heap {bytes_text(heap)}"))
    left = vacuum(writer)
    out.append(Finding("leftovers", "hint" if left else "ok", ", ".join(left)))
    return out


def bytes_text(n: float) -> str:
    """Bytes with a unit: B, KiB, MiB or GiB."""
    for unit in ("B", "KiB", "MiB"):
        if n < 1024:
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.1f} GiB"


def ms_text(ms: float) -> str:
    return f"{ms:.0f} ms" if ms < 1000 else f"{ms / 1000:.2f} s"


def scenarios(shop_id: int, lang_id: int, terms: list[str], category: str = "", facet: FacetFilter | None = None, limit: int = 20) -> list[tuple[str, SearchQuery]]:
    """What a benchmark runs: each term, the category, and the first term with a facet's filter."""
    base = SearchQuery(shop_id, lang_id, limit=limit, allow_correction=False)
    out = [(f"term {t}", replace(base, term=t)) for t in terms]
    if category:
        out.append((f"category {category}", replace(base, category=category)))
    if facet is not None and terms:
        out.append((f"term {terms[0]}, facet {facet.attribute}", replace(base, term=terms[0], filters=(facet,))))
    return out


def benchmark(engines: dict[str, Engine], cases: list[tuple[str, SearchQuery]], runs: int = 3) -> tuple[list[dict], DataFrame]:
    """(times of each engine and scenario, agreement of the first pages of the first two engines)."""
    measured, pages = [], []
    for name, engine in engines.items():
        found = []
        for scenario, query in cases:
            measured.append({"engine": name, "scenario": scenario, **timed(engine, query, runs)})
            found += [(scenario, i, x) for i, x in enumerate(engine.search(query).ids)]
        pages.append(found)
    spark = next(iter(engines.values())).index.documents.sparkSession
    left, right = (spark.createDataFrame(p, "query string, pos int, id string") for p in (pages[0], pages[min(1, len(pages) - 1)]))
    return measured, agreement(left, right)


def report(index: Index, engine: Engine, query: SearchQuery, writer=None) -> list[Finding]:
    out = storage(writer) if writer is not None else []
    counts = status(index).collect()
    out.append(Finding("documents", "ok" if counts else "problem", ", ".join(f"{r['shop_id']}/{r['lang_id']}: {r['documents']}" for r in counts) or "the index is empty"))
    if index.has("rollup"):
        empty = index.part("rollup").isEmpty()
        out.append(Finding("rollup", "hint" if empty else "ok", "facets are counted from documents" if empty else "facets of a whole product"))
    if index.has("dictionary"):
        short = [r["term"] for r in dictionary.short_terms(index.part("dictionary"), engine.settings.min_token_size).collect()]
        out.append(Finding("short terms", "hint" if short else "ok", ", ".join(short)))
    run = timed(engine, query, 1)
    out.append(Finding("search", level_of(run["median"]), f"{run['median']:.0f} ms for {run['total']} products"))
    return out


def vacuum(writer, remove: bool = False) -> list[str]:
    """Versions that no part of the live index is in: leftovers of runs that were broken off, or replaced."""
    files, live = writer._files(), writer.versions()
    if not files.exists(writer._path()):
        return []
    names = [s.getPath().getName() for s in files.listStatus(writer._path()) if s.isDirectory()]
    left = [n for n in names if n.startswith("v") and n not in live and n != writer.staging]
    for n in left if remove else ():
        files.delete(writer._path(n), True)
    return left


def saved(measurements: list[dict], path: str) -> None:
    with open(path, "w", encoding="utf-8") as out:
        json.dump(measurements, out, indent=1)


def compared(now: list[dict], path: str) -> list[tuple[str, float]] | None:
    """Ratio of medians to an earlier file's, None when it can't be read."""
    try:
        with open(path, encoding="utf-8") as file:
            before = {m["term"]: m["median"] for m in json.load(file)}
    except (OSError, ValueError):
        return None
    return [(m["term"], m["median"] / before[m["term"]]) for m in now if before.get(m["term"])]
