"""The category tree: paths, breadcrumbs, product links, and the guard of their rebuild."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEEPEST, BREADCRUMB = 20, 10


#: Trees up to this size are walked on the driver; larger ones as a recursive query.
SMALL_TREE = 100_000


def way(start: str, rows: dict[str, tuple[str, str]], deepest: int = DEEPEST) -> list[str]:
    """Titles from the root to a category, blanks left out; a circle ends after ``deepest`` steps."""
    titles: list[str] = []
    at = start
    while at in rows and deepest > 0:
        parent, title = rows[at]
        titles.append(title)
        at, deepest = parent, deepest - 1
    return [t for t in reversed(titles) if t]


def paths(tree: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """id, path, titles of the active categories: the way from the root, `` > `` between."""
    active = tree.where("active").select("id", "parent_id", F.trim(F.coalesce("title", F.lit(""))).alias("title"))
    found = active.limit(SMALL_TREE + 1).collect()
    if len(found) > SMALL_TREE:
        return paths_sql(tree.sparkSession, tree, deepest)
    rows = {r["id"]: (r["parent_id"], r["title"]) for r in found}
    ways = {i: way(i, rows, deepest) for i in rows}
    return tree.sparkSession.createDataFrame([(i, t, " > ".join(t)) for i, t in ways.items()], "id string, titles array<string>, path string")


def paths_sql(spark, tree: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """The same as one recursive query, whatever the depth of the tree."""
    return spark.sql(
        f"""
        WITH RECURSIVE active AS (SELECT id, parent_id, trim(coalesce(title, '')) AS title FROM {{tree}} WHERE active),
        walk(id, titles, next, depth) AS (
          SELECT id, array(title), parent_id, 1 FROM active
          UNION ALL
          SELECT w.id, concat(array(a.title), w.titles), a.parent_id, w.depth + 1 FROM walk w JOIN active a ON w.next = a.id WHERE w.depth < {deepest}),
        whole AS (SELECT id, max_by(titles, depth) AS titles FROM walk GROUP BY id)
        SELECT id, filter(titles, t -> t <> '') AS titles, array_join(filter(titles, t -> t <> ''), ' > ') AS path FROM whole
        """,
        tree=tree,
    )


def breadcrumb(spark, tree: DataFrame) -> DataFrame:
    """Ancestors only, at most ten."""
    return paths_sql(spark, tree, BREADCRUMB + 1).select("id", F.array_join(F.slice("titles", 1, F.greatest(F.lit(0), F.size("titles") - 1)), " > ").alias("breadcrumb"))


def links(documents: DataFrame, object2category: DataFrame) -> DataFrame:
    """shop_id, lang_id, group_id, cat_id of the products in the index."""
    groups = documents.select("shop_id", "lang_id", "group_id").distinct()
    return groups.join(object2category.select(F.col("object_id").alias("group_id"), "cat_id"), "group_id").select("shop_id", "lang_id", "group_id", "cat_id").distinct()


@dataclass(frozen=True)
class RebuildResult:
    written: int
    previous: int
    skipped: bool = False


def plausible(available: int, previous: int, share: float = 0.5) -> bool:
    """Does a rebuild keep at least half of what is live? The first one always may."""
    return previous == 0 or available >= math.ceil(previous * share)
