"""Publishing an index: datasets are written to a version of their own, and one small file names the live one.

Readers follow the pointer, so all datasets change together; a failed rebuild leaves the live version alone.
Only the scopes of a run are replaced: the rest of the live index is carried over.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import schema
from lodestone.operators import categories, cells, dictionary, postings, rollup
from lodestone.plans.model import Index
from lodestone.sources import staging

LAYOUT = {"documents": schema.DOCUMENTS, "rollup": schema.ROLLUP, "categories": schema.CATEGORY_LINKS, "dictionary": schema.DICTIONARY, "postings": schema.POSTINGS, "grams": schema.GRAMS, "sizes": schema.SIZES, "cells": schema.CELLS, "words": schema.WORDS}
#: Datasets that an index of an earlier layout lacks; searches then read documents instead.
LATER = ("grams", "sizes", "cells", "words")
POINTER = "CURRENT"


class IndexWriter:
    """Versions of the index under one folder.

    A version holds the partitions (dataset and scope) that its run wrote; the pointer's file says for every
    partition of the live index which version has it, so what a run leaves alone is neither read nor copied.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.staging: str | None = None
        self.scopes: list[tuple[int, int]] = []
        #: Scopes whose links were left as they are, since too few were found.
        self.refused: frozenset[str] = frozenset()

    # Files go through Hadoop's API, so the folder may be in any store that Spark reads.
    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def _files(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict | None:
        """version, and parts: for each dataset the version of each scope ("shop/lang")."""
        if not self._files().exists(self._path(POINTER)):
            return None
        return json.loads("".join(r["value"] for r in self.spark.read.text(f"{self.folder}/{POINTER}").collect()))

    def live(self) -> str | None:
        found = self.manifest()
        return found["version"] if found else None

    def versions(self) -> set[str]:
        """All versions that the live index has a part in."""
        found = self.manifest()
        return {found["version"], *(v for scopes in found["parts"].values() for v in scopes.values())} if found else set()

    def last_write(self) -> float | None:
        """Seconds since the epoch when the live index was published."""
        if not self._files().exists(self._path(POINTER)):
            return None
        return self._files().getFileStatus(self._path(POINTER)).getModificationTime() / 1000

    def _scopes_in(self, version: str, name: str) -> list[str]:
        """The scopes whose partitions a version has of a dataset."""
        out, top = [], self._path(version, name)
        if self._files().exists(top):
            for shop in self._files().listStatus(top):
                if shop.getPath().getName().startswith("shop_id="):
                    langs = [x.getPath().getName() for x in self._files().listStatus(shop.getPath())]
                    out += [f"{shop.getPath().getName()[8:]}/{x[8:]}" for x in langs if x.startswith("lang_id=")]
        return out

    def _parts(self, name: str, scopes: dict[str, str]) -> DataFrame:
        """Rows of the partitions, each from its version."""
        empty, out = self.spark.createDataFrame([], LAYOUT[name]), None
        for version in sorted(set(scopes.values())):
            base = f"{self.folder}/{version}/{name}"
            paths = [f"{base}/shop_id={shop}/lang_id={lang}" for shop, lang in (s.split("/") for s, v in scopes.items() if v == version)]
            found = self.spark.read.schema(LAYOUT[name]).option("basePath", base).parquet(*paths)
            out = found if out is None else out.unionByName(found)
        return empty if out is None else out.select(*empty.columns)

    def _staged(self, name: str) -> DataFrame:
        return self._parts(name, dict.fromkeys(self._scopes_in(self.staging, name), self.staging))

    def index(self) -> Index | None:
        found = self.manifest()
        return Index(**{n: self._parts(n, found["parts"].get(n, {})) for n in LAYOUT if n in found["parts"] or n not in LATER}) if found else None

    def begin(self, scopes: list[tuple[int, int]]) -> None:
        """No scopes stand for all: then nothing of the live index is kept."""
        if self.staging is not None:
            raise RuntimeError("a rebuild is running")
        self.staging, self.scopes, self.refused = f"v{uuid.uuid4().hex}", list(scopes), frozenset()

    def resume(self, version: str, scopes: list[tuple[int, int]]) -> None:
        """Goes on with what an earlier run has staged."""
        self.staging, self.scopes, self.refused = version, list(scopes), frozenset()

    def clear(self) -> None:
        self._files().delete(self._path(self.staging), True)

    def write(self, documents: DataFrame, step: str | None = None) -> None:
        """Adds documents to the run; those of a named step replace what the same step has written before.

        A run is written either in steps or without.
        """
        if self.staging is None:
            raise RuntimeError("no rebuild is running")
        if len(self.scopes) == 1:
            # Of a step, a folder of its own beside the others.
            self._into_scope("documents", documents, "overwrite" if step is not None else "append", f"step={quote(f'after-{step}', safe='')}" if step is not None else None)
            return
        if step is not None:
            named = documents.withColumn("step", F.lit(f"after-{step}"))
            named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shop_id", "lang_id", "step").parquet(f"{self.folder}/{self.staging}/documents")
            return
        documents.write.mode("append").partitionBy("shop_id", "lang_id").parquet(f"{self.folder}/{self.staging}/documents")

    def _into_scope(self, name: str, df: DataFrame, mode: str, below: str | None = None) -> None:
        """Rows of a run for one scope go straight to its folder, in the order they have: wide rows are not sorted by a scope they share."""
        shop, lang = self.scopes[0]
        own = (F.col("shop_id") == shop) & (F.col("lang_id") == lang)
        # Another scope's rows would be published as this one's. In a column, not a filter: Spark would try a filter on partitions that others leave out.
        first = next(c for c in df.columns if c not in ("shop_id", "lang_id"))
        checked = df.withColumn(first, F.when(own, F.col(first)).otherwise(F.raise_error(F.lit(f"rows outside of scope {shop}/{lang}")))).drop("shop_id", "lang_id")
        parts = [self.staging, name, f"shop_id={shop}", f"lang_id={lang}", *([below] if below else [])]
        checked.write.mode(mode).option("compression", "zstd").parquet("/".join((self.folder, *parts)))
        # A scope without rows has no partition.
        if self._staged(name).isEmpty():
            self._files().delete(self._path(*parts[:3]), True)

    def _put(self, name: str, df: DataFrame) -> None:
        """Derived rows replace those of their scopes: a commit that is done twice changes nothing."""
        if len(self.scopes) == 1:
            self._into_scope(name, df, "overwrite")
            return
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shop_id", "lang_id").parquet(f"{self.folder}/{self.staging}/{name}")

    def _own(self, staged: DataFrame) -> list[tuple[int, int]]:
        """The scopes of the run, by the staged documents if it is for all."""
        return self.scopes or sorted((r["shop_id"], r["lang_id"]) for r in staged.select("shop_id", "lang_id").distinct().collect())

    def commit(self, object2category: DataFrame | None = None, force: bool = False, kept: dict[str, DataFrame] | None = None) -> list[categories.RebuildResult]:
        """Roll-up, links, dictionary and postings of the staged documents; then the pointer moves.

        Without assignments the live links stay, for the products that are still there. Datasets in ``kept`` are written as they are given.
        """
        if self.staging is None:
            raise RuntimeError("no rebuild is running")
        staged, before, kept = self._staged("documents"), self.manifest(), kept or {}
        self._put("rollup", rollup.build(rollup.attribute_rows(staged)))
        self._put("dictionary", dictionary.build(staged))
        self._put("postings", kept["postings"] if "postings" in kept else postings.build(staged))
        self._put("grams", kept["grams"] if "grams" in kept else postings.grams(staged))
        self._put("sizes", postings.sizes(staged))
        self._put("cells", kept["cells"] if "cells" in kept else cells.build(staged))
        self._put("words", cells.words(self._staged("rollup"), self._staged("cells")))
        outcome: list[categories.RebuildResult] = []
        if object2category is not None:
            outcome = self._links(staged, object2category, before, force)
        elif before:
            live = self._parts("categories", before["parts"].get("categories", {}))
            self._put("categories", live.join(staged.select("shop_id", "lang_id", "group_id").distinct(), ["shop_id", "lang_id", "group_id"], "left_semi"))
        self._publish(self._after(before, {f"{s}/{x}" for s, x in self._own(staged)}, set(LAYOUT)))
        self.staging = None
        return outcome

    def _after(self, before: dict | None, own: set[str], written: set[str]) -> dict:
        """The live parts once this run's partitions have taken their places.

        A partition of an own scope that a written dataset lacks is gone, but for links whose rebuild was refused.
        """
        parts = {}
        for name in LAYOUT:
            old = before["parts"].get(name, {}) if before else {}
            there = dict.fromkeys(self._scopes_in(self.staging, name), self.staging)
            keep = {s: v for s, v in old.items() if name not in written or (s in self.refused if s in own and name == "categories" else self.scopes and s not in own)}
            parts[name] = keep | there
        return {"version": self.staging, "parts": parts}

    def _links(self, staged: DataFrame, object2category: DataFrame, before: dict | None, force: bool) -> list[categories.RebuildResult]:
        found = categories.links(staged, object2category)
        new = {(r["shop_id"], r["lang_id"]): r["count"] for r in found.groupBy("shop_id", "lang_id").count().collect()}
        live = self._parts("categories", before["parts"].get("categories", {})) if before else None
        old = {(r["shop_id"], r["lang_id"]): r["count"] for r in live.groupBy("shop_id", "lang_id").count().collect()} if live is not None else {}
        outcome, refused, taken = [], set(), F.lit(False)
        for scope in self._own(staged):
            good = force or categories.plausible(new.get(scope, 0), old.get(scope, 0))
            if good:
                taken = taken | ((F.col("shop_id") == scope[0]) & (F.col("lang_id") == scope[1]))
            else:
                refused.add(f"{scope[0]}/{scope[1]}")
            outcome.append(categories.RebuildResult(new.get(scope, 0), old.get(scope, 0), not good))
        if len(refused) < len(outcome):
            self._put("categories", found.where(taken))
        self.refused = frozenset(refused)
        return outcome

    def rebuild_categories(self, object2category: DataFrame, force: bool = False) -> list[categories.RebuildResult]:
        """New links for the documents that are live, and their category ids with them; no document is built anew.

        A scope that would lose more than half of its links keeps what it has, unless forced.
        """
        before = self.manifest()
        if before is None:
            return []
        documents = self._parts("documents", before["parts"]["documents"])
        self.begin([tuple(int(x) for x in s.split("/")) for s in sorted(before["parts"]["documents"])])
        try:
            outcome = self._links(documents, object2category, before, force)
            ids = self._staged("categories").groupBy("shop_id", "lang_id", "group_id").agg(F.array_sort(F.collect_list("cat_id")).alias("found"))
            changed = documents.join(ids, ["shop_id", "lang_id", "group_id"], "left").withColumn("category_ids", F.coalesce("found", F.array().cast("array<string>")))
            if self.refused:
                changed = changed.where(~F.concat_ws("/", "shop_id", "lang_id").isin(*self.refused))
            self._put("documents", changed.select(*documents.columns))
            after = self._after(before, set(before["parts"]["documents"]), {"categories"})
            self._publish(after)
        except Exception:
            self.rollback()
            raise
        self.staging = None
        return outcome

    def _publish(self, after: dict) -> None:
        draft = self._path(f"{POINTER}.{after['version']}")
        out = self._files().create(draft, True)
        out.write(bytearray(json.dumps(after).encode()))
        out.close()
        context = self.spark.sparkContext
        fs = context._jvm.org.apache.hadoop.fs
        how = getattr(fs, "Options$Rename")
        options = context._gateway.new_array(how, 1)
        options[0] = how.OVERWRITE
        # One rename that replaces: a reader finds the old version or the new one.
        fs.FileContext.getFileContext(draft.toUri(), context._jsc.hadoopConfiguration()).rename(draft, self._path(POINTER), options)

    def rollback(self) -> None:
        if self.staging is not None:
            self.clear()
            self.staging = None

    def delete(self, document_ids: list[str] | DataFrame) -> None:
        """Takes documents, by their ids or a table of them (id), out of every dataset: only the scopes that hold one are written anew."""
        index = self.index()
        if index is None:
            return
        gone = document_ids if isinstance(document_ids, DataFrame) else self.spark.createDataFrame([(i,) for i in document_ids], "id string")
        # Written, so that a short list is sent to every task and no document is shuffled for it.
        gone = staging.staged(gone.select("id").distinct(), "gone")
        hit = index.documents.join(gone, "id", "left_semi").select("shop_id", "lang_id").distinct().collect()
        if not hit:
            return
        self.begin([(r["shop_id"], r["lang_id"]) for r in hit])
        try:
            touched = F.concat_ws("/", "shop_id", "lang_id").isin(*(f"{s}/{x}" for s, x in self.scopes))
            rest = lambda df: df.where(touched).join(gone, "id", "left_anti").select(*df.columns)
            self.write(rest(index.documents))
            # What is stored by document only loses rows; numbers of products that are gone stay free until a rebuild. Several scopes are
            # sorted into their folders, so their postings are made anew.
            by_document = {"postings": index.postings, "grams": index.grams, "cells": index.cells} if len(self.scopes) == 1 else {}
            self.commit(kept={name: rest(df) for name, df in by_document.items() if df is not None})
        except Exception:
            self.rollback()
            raise
