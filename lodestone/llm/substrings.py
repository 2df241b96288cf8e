"""Operator 7, substring dedup by seed and extend.

Texts are fingerprinted by winnowing: of the 41 ten-word grams in each window of 50 words the least hash is
the window's anchor, so equal windows have the same anchor at the same place. Documents are joined on
anchors that two or more of them hold; around each such seed all alignments of a 50-word window whose anchor the
seed is are compared by hash, and windows that also start in a document of smaller id are marked. So a match is not
walked outwards word by word and no maximal repeat is formed as such: its words are those that marked windows cover.

Whole copies go first: of the documents with one word sequence only the smallest id is fingerprinted.
Before the shuffle by anchor each chunk of texts settles its own repeats and forwards one holder of a
window, so a passage that a third of all documents share is forwarded once for each chunk, and its holders
are split among tasks by the window's hash.

Windows are compared by 128 bits: their anchor's hash and their own. Null and empty texts have no words.
A null doc_id counts as smaller than any other; rows of one id are never removed because of each other.
Repeated rows get the same result each. Texts under 50 words are kept whole.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import _shared, _words

LENGTH = 50
GRAM = 10


def anchors_of(grams: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each ``width`` consecutive grams, the leftmost of equal ones."""
    at = np.arange(len(grams))
    span = 1
    while span * 2 <= width:
        a, b = at[:-span], at[span:]
        at = np.where(grams[a] <= grams[b], a, b)
        span *= 2
    if span < width:
        a, b = at[: len(at) - (width - span)], at[width - span :]
        at = np.where(grams[a] <= grams[b], a, b)
    return at


class Seeds:
    """Windows of a chunk and their anchors."""

    def __init__(self, chunk: _words.Chunk, length: int, gram: int):
        _, _, hashes, self.first = chunk.words(_words.SPACES, _words.EXACT)
        self.n_words = np.diff(self.first)
        self.starts = np.zeros(0, np.int64)
        if len(hashes) >= length:
            owner = np.repeat(np.arange(chunk.n), self.n_words)
            n = len(hashes) - length + 1
            self.starts = np.flatnonzero(owner[:n] == owner[length - 1 :])
            self.grams = _words.windows(hashes, gram)
            self.at = anchors_of(self.grams, length - gram + 1)[self.starts]
            self.owner = owner[self.starts]
            self.hashes = hashes

    def windows(self, length: int) -> np.ndarray:
        return _words.windows(self.hashes, length)[self.starts]


FIRST = "doc_id long, id_key long, text_key long, n_words long, words_sha256 string, anchors array<long>, places array<int>"


def fingerprints(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    def run(batches):
        for chunk in _words.chunks(batches):
            seeds = Seeds(chunk, length, gram)
            places = np.unique(seeds.at) if len(seeds.starts) else np.zeros(0, np.int64)
            split = np.searchsorted(places, seeds.first).astype(np.int32)
            own = places - seeds.first[np.searchsorted(seeds.first, places, "right") - 1]
            digests = [hashlib.sha256(b" ".join(t.split())).hexdigest() for t in chunk.texts()]
            hashes = seeds.grams[places].view(np.int64) if len(places) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(chunk.column(c) for c in ("doc_id", "id_key", "text_key")), pa.array(seeds.n_words, pa.int64()), pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(split), pa.array(hashes)), pa.ListArray.from_arrays(pa.array(split), pa.array(own.astype(np.int32)))],
                names=["doc_id", "id_key", "text_key", "n_words", "words_sha256", "anchors", "places"],
            )

    return docs.mapInArrow(run, FIRST)


#: anchor null: the starts are settled, windows of a smaller id were in the same chunk.
EXTENDED = "anchor long, salt int, id_key long, text_key long, starts array<int>, windows array<long>"


def extended(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """For each text and shared anchor (columns places, salts) the windows around it."""

    def run(batches):
        for batch in batches:
            for chunk in _words.cut(batch):
                seeds = Seeds(chunk, length, gram)
                if not len(seeds.starts):
                    continue
                ids, keys = chunk.column("id_key").to_numpy(), chunk.column("text_key").to_numpy()
                shared, salts = chunk.column("places"), chunk.column("salts")
                counts = np.diff(shared.offsets.to_numpy())
                absolute = shared.flatten().to_numpy() + np.repeat(seeds.first[:-1], counts)
                order = np.argsort(absolute, kind="stable")
                absolute, many = absolute[order], salts.flatten().to_numpy()[order]
                at = np.minimum(np.searchsorted(absolute, seeds.at), max(0, len(absolute) - 1))
                use = np.flatnonzero(absolute[at] == seeds.at)
                anchor = seeds.grams[seeds.at[use]]
                window = seeds.windows(length)[use]
                owner = seeds.owner[use]
                start = (seeds.starts[use] - seeds.first[owner]).astype(np.int32)
                salt = (window % np.maximum(1, many[at[use]]).astype(np.uint64)).astype(np.int32)
                # Settle what this chunk knows: a window of a smaller id here.
                order = np.lexsort((start, ids[owner], window, anchor))
                a, w, o, s, z = anchor[order], window[order], owner[order], start[order], salt[order]
                lead = np.r_[True, (a[1:] != a[:-1]) | (w[1:] != w[:-1])] if len(a) else np.zeros(0, bool)
                least = ids[o][np.flatnonzero(lead)][np.cumsum(lead) - 1] if len(a) else ids[:0]
                settled = ids[o] > least
                # Of a window forward one row of its smallest id, and all of that id's places.
                yield from _grouped(np.zeros(settled.sum(), np.uint64), z[settled] * 0, o[settled], s[settled], np.zeros(0, np.uint64), ids, keys, True)
                yield from _grouped(a[~settled], z[~settled], o[~settled], s[~settled], w[~settled], ids, keys, False)

    return docs.mapInArrow(run, EXTENDED)


def _grouped(anchor, salt, owner, start, window, ids, keys, settled):
    """One row for each text, anchor and salt."""
    if not len(owner):
        return
    order = np.lexsort((start, salt, anchor, owner))
    anchor, salt, owner, start = anchor[order], salt[order], owner[order], start[order]
    lead = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])])
    split = np.r_[lead, len(owner)].astype(np.int32)
    values = np.zeros(len(owner), np.int64) if settled else window[order].view(np.int64)
    heads = pa.nulls(len(lead), pa.int64()) if settled else pa.array(anchor[lead].view(np.int64))
    yield pa.RecordBatch.from_arrays(
        [heads, pa.array(salt[lead], pa.int32()), pa.array(ids[owner[lead]]), pa.array(keys[owner[lead]]), pa.ListArray.from_arrays(pa.array(split), pa.array(start)), pa.ListArray.from_arrays(pa.array(split), pa.array(values))],
        names=["anchor", "salt", "id_key", "text_key", "starts", "windows"],
    )


def matched(rows: DataFrame) -> DataFrame:
    """Starts of the windows that a smaller id holds too; rows stand by anchor, salt and ascending id."""

    def run(batches):
        group, seen, fresh, last = None, set(), [], None
        for batch in batches:
            out = {"id_key": [], "text_key": [], "starts": []}
            for anchor, salt, i, k, starts, wins in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                if anchor is None:
                    hit = starts
                else:
                    if (anchor, salt) != group:
                        group, seen, fresh, last = (anchor, salt), set(), [], None
                    if i != last:
                        seen.update(fresh)
                        fresh, last = [], i
                    hit = [s for s, w in zip(starts, wins, strict=True) if w in seen]
                    fresh += [w for w in wins if w not in seen]
                if hit:
                    out["id_key"].append(i)
                    out["text_key"].append(k)
                    out["starts"].append(hit)
            yield pa.RecordBatch.from_arrays([pa.array(out["id_key"], pa.int64()), pa.array(out["text_key"], pa.int64()), pa.array(out["starts"], pa.list_(pa.int32()))], names=list(out))

    # Settled rows need no partner: they go where their id says.
    key = F.coalesce("anchor", "id_key")
    return rows.repartition(key, "salt").sortWithinPartitions("anchor", "salt", "id_key").mapInArrow(run, "id_key long, text_key long, starts array<int>")


def cut(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Removed words and the digest of the rest, for texts with column ``starts``."""

    def run(batches):
        for batch in batches:
            n_removed, digests = [], []
            for text, starts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = text.encode().split()
                gone = _words.covered(np.array(starts, np.int64), length, len(words))
                n_removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(b" ".join(compress(words, ~gone))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())], names=["id_key", "text_key", "n_removed", "kept_sha256"])

    return docs.select("id_key", "text_key", "text", "starts").mapInArrow(run, "id_key long, text_key long, n_removed long, kept_sha256 string")


def removals(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, per_salt: int = 4000) -> tuple[DataFrame, DataFrame]:
    """(all rows with counts and digests, window starts to remove by id_key and text_key)."""
    keyed = _shared.with_keys(docs)
    base = _shared.written(fingerprints(keyed, length, gram), "substring-base")
    smallest = base.groupBy("words_sha256").agg(F.min("id_key").alias("first_id"))
    base_rows = base.drop("anchors", "places").join(smallest, "words_sha256").withColumn("is_copy", (F.col("id_key") > F.col("first_id")) & (F.col("n_words") >= length))
    heads = base.where(F.size("anchors") > 0).join(smallest, "words_sha256").where(F.col("id_key") == F.col("first_id"))
    seeds = heads.select("id_key", "text_key", F.explode(F.arrays_zip("anchors", "places")).alias("x")).select("id_key", "text_key", F.col("x.anchors").alias("anchor"), F.col("x.places").alias("place"))
    seeds = _shared.written(seeds, "substring-seeds")
    # Written, so that the join below reads plain shuffles, which are split where an anchor is frequent.
    joint = seeds.groupBy("anchor").agg(F.min("id_key").alias("a"), F.max("id_key").alias("b"), F.count("*").alias("n")).where("a < b").select("anchor", F.ceil(F.col("n") / per_salt).cast("int").alias("salts"))
    joint = _shared.written(joint, "substring-joint")
    shared = seeds.join(joint, "anchor").groupBy("id_key", "text_key").agg(F.collect_set(F.struct("place", "salts")).alias("x"))
    shared = _shared.written(shared.select("id_key", "text_key", F.col("x.place").alias("places"), F.col("x.salts").alias("salts")), "substring-shared")
    starts = matched(extended(_shared.with_text(shared, keyed), length, gram))
    starts = starts.groupBy("id_key", "text_key").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    return base_rows, _shared.written(starts, "substring-starts")


def deduped(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of ``docs``."""
    rows, starts = removals(docs, length, gram)
    texts = _shared.with_text(starts, _shared.with_keys(docs)).dropDuplicates(["id_key", "text_key"])
    parts = cut(texts, length)
    none = hashlib.sha256(b"").hexdigest()
    out = rows.join(parts, ["id_key", "text_key"], "left")
    return out.select(
        "doc_id",
        "n_words",
        F.when(F.col("is_copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("is_copy"), F.lit(none)).otherwise(F.coalesce("kept_sha256", "words_sha256")).alias("kept_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduped(_shared.documents(spark, sf_dir))


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS g FROM d, range(1, length(w) - 48) t(i) WHERE length(w) >= 50),
marked AS (SELECT r, i, doc_id > min(doc_id) OVER (PARTITION BY g) AS again FROM win),
gone AS (SELECT DISTINCT r, i + k AS j FROM (SELECT r, i FROM marked WHERE again) m, range(0, 50) t(k)),
g AS (SELECT r, list(j) AS js, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, length(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ')
                   ELSE coalesce(array_to_string(list_transform(list_filter(range(1, length(w) + 1), lambda j: NOT list_contains(js, j)), lambda j: w[j]), ' '), '') END) AS kept_sha256
FROM d LEFT JOIN g ON d.r = g.r
"""
