"""Operator 3, benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the 13-word windows of benchmark items (an item of fewer words is one pattern). For each
pattern length there is a shift table over hashed blocks of two words: the search looks at the block that
ends the current window, skips by the table where no pattern can end, and where the shift is 0 looks up the
block's bucket of patterns, narrows it by the window's hash and confirms by comparing the words.

Patterns are places in one buffer of the items' words, in arrays sorted by block and window hash, so they take about
ten times the items' text. The items are taken in blocks of ``block_bytes`` of text, one after the other, so what
the driver holds and sends to the executors is bounded whatever the benchmark's size; hits of several blocks are
united for each document.

Nulls and empty texts have no words: nothing hits them, and as items they have no pattern. Repeated items
of one id count once, and so do all items without an id, which are searched like any other and stand in items as
one null. Repeated documents are judged each; a null doc_id is kept. Empty tables are fine. A column of the
documents that has the name of a result (n_words, hits, items, n_hit, contaminated) gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import _shared, _words

WINDOW = 13
BLOCK = 2
RESULTS = ("n_words", "hits", "items", "n_hit", "contaminated")


@dataclass
class Table:
    """Shift table and buckets of all patterns of one length."""

    length: int
    block: int
    bits: int
    shift: np.ndarray
    #: Of each distinct pattern, sorted by these two: hash of its last block, hash of all its words.
    blocks: np.ndarray
    keys: np.ndarray
    #: Its first word, and where its items begin in ``items`` (one more for the end).
    places: np.ndarray
    edges: np.ndarray
    items: np.ndarray


@dataclass
class Patterns:
    #: Lowered words of all items, each followed by a space, and where each word begins (one more for the end).
    text: bytes
    starts: np.ndarray
    names: list[str | None]
    tables: list[Table]

    def words(self, first: int, n: int) -> bytes:
        return self.text[self.starts[first] : self.starts[first + n] - 1]


def block_hashes(hashes: np.ndarray, block: int) -> np.ndarray:
    return _words.windows(hashes, block) if block > 1 else _words.mix(hashes)


def patterns(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> Patterns:
    names = list(dict.fromkeys(i for i, _ in items))
    number = {name: k for k, name in enumerate(names)}
    text, lengths, hashes, counts = [], [], [], []
    for chunk in _words.cut(pa.RecordBatch.from_arrays([pa.array([t for _, t in items], pa.string())], names=["text"])):
        starts, ends, own, first = chunk.words(_words.NOT_ALNUM, _words.LOWER)
        lowered = chunk.buffer.tobytes().lower()
        text += [lowered[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        lengths.append(ends - starts)
        hashes.append(own)
        counts.append(np.diff(first))
    if not text:
        return Patterns(b"", np.zeros(1, np.int64), names, [])
    hashes, counts = np.concatenate(hashes), np.concatenate(counts)
    begin = np.cumsum(counts) - counts
    item_of = np.repeat(np.array([number[i] for i, _ in items], np.int32), counts)
    out = Patterns(b" ".join([*text, b""]), np.r_[0, np.cumsum(np.concatenate(lengths) + 1)], names, [])
    for n in np.unique(np.minimum(counts[counts > 0], window)).tolist():
        own = counts >= window if n == window else counts == n
        many = np.where(own, counts - n + 1, 0)
        at = np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(many.sum())
        block = min(BLOCK, n)
        blocks, keys = block_hashes(hashes, block), window_hashes(hashes, n)[at]
        bits = max(16, int(np.ceil(np.log2(16 * len(at)))))
        shift = np.full(1 << bits, n - block + 1, np.uint8)
        # From the window's first block to its last: a block that stands several times keeps the least jump.
        for j in range(n - block + 1):
            shift[blocks[at + j] >> np.uint64(64 - bits)] = n - block - j
        last = blocks[at + n - block]
        order = np.lexsort((item_of[at], keys, last))
        at, last, keys = at[order], last[order], keys[order]
        same = np.r_[False, (last[1:] == last[:-1]) & (keys[1:] == keys[:-1])]
        for i in np.flatnonzero(same):
            same[i] = out.words(at[i], n) == out.words(at[i - 1], n)
        lead = np.flatnonzero(~same)
        out.tables.append(Table(n, block, bits, shift, last[lead], keys[lead], at[lead], np.r_[lead, len(at)], item_of[at]))
    return out


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    return _words.windows(hashes, n) if n > 1 else hashes


def search(table: Table, hashes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, pattern) wherever the word hashes of a pattern stand."""
    if len(hashes) < table.length:
        return
    blocks = block_hashes(hashes, table.block)
    jumps = table.shift[blocks >> np.uint64(64 - table.bits)].tobytes()
    ahead, end, found = table.length - table.block, len(jumps), []
    at = ahead
    while at < end:
        jump = jumps[at]
        if jump:
            at += jump
        else:
            found.append(at)
            at += 1
    where = np.array(found, np.int64)
    low = np.searchsorted(table.blocks, blocks[where], "left")
    high = np.searchsorted(table.blocks, blocks[where], "right")
    in_bucket = np.flatnonzero(low < high)
    if not len(in_bucket):
        return
    keys = window_hashes(hashes, table.length)
    for i in in_bucket.tolist():
        start = int(where[i]) - ahead
        bucket = table.keys[low[i] : high[i]]
        for k in range(int(np.searchsorted(bucket, keys[start], "left")), int(np.searchsorted(bucket, keys[start], "right"))):
            yield start, int(low[i]) + k


def scan(docs: DataFrame, items: list[tuple[str | None, str | None]], window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """Columns of ``docs`` (text only if asked), n_words, hits (word indexes inside an occurrence) and items."""
    keep = [c for c in docs.columns if c not in RESULTS and (c != "text" or with_text)]
    schema = docs.select(*keep).withColumn("n_words", F.lit(0).cast("long")).withColumn("hits", F.lit(None).cast("array<int>")).withColumn("items", F.lit(None).cast("array<string>")).schema
    shared = docs.sparkSession.sparkContext.broadcast(patterns(items, window))

    def run(batches):
        known = shared.value
        for chunk in _words.chunks(batches):
            starts, ends, hashes, first = chunk.words(_words.NOT_ALNUM, _words.LOWER)
            owner = np.repeat(np.arange(chunk.n), np.diff(first))
            edge = np.zeros(len(hashes) + 1, np.int32)
            names: dict[int, set[str | None]] = {}
            for table in known.tables:
                n = table.length
                for i, k in search(table, hashes):
                    if owner[i] != owner[i + n - 1]:
                        continue
                    if b" ".join([chunk.buffer[s:e].tobytes().lower() for s, e in zip(starts[i : i + n], ends[i : i + n], strict=True)]) == known.words(table.places[k], n):
                        edge[i] += 1
                        edge[i + n] -= 1
                        names.setdefault(int(owner[i]), set()).update(known.names[x] for x in table.items[table.edges[k] : table.edges[k + 1]])
            hit = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            split = np.searchsorted(hit, first).astype(np.int32)
            place = (hit - first[owner[hit]]).astype(np.int32) if len(hit) else hit.astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(chunk.column(k) for k in keep), pa.array(np.diff(first), pa.int64()), pa.ListArray.from_arrays(pa.array(split), pa.array(place)), pa.array([sorted(names.get(k, ()), key=lambda x: (x is None, x)) for k in range(chunk.n)], pa.list_(pa.string()))],
                names=[*keep, "n_words", "hits", "items"],
            )

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items in blocks of about ``block_bytes`` of text; the driver holds one of them."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").toLocalIterator():
        more = len((row["text"] or "").encode())
        if block and size + more > block_bytes:
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += more
    yield block


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = 8 << 20, with_text: bool = False) -> DataFrame:
    """The columns of ``docs`` (text only if asked), with n_words, hits and items over the whole benchmark."""
    blocks = item_blocks(benchmark, block_bytes)
    block = next(blocks)
    after = next(blocks, None)
    if after is None:
        return scan(docs, block, window, with_text)
    keep = [c for c in docs.columns if c not in RESULTS and (c != "text" or with_text)]
    # Rows are named once, in a written table, so that each scan means the same ones.
    base = _shared.written(docs.select(F.struct(*keep).alias("given"), "text", F.monotonically_increasing_id().alias("row_key")), "decontaminate-rows")
    whole = _shared.written(scan(base.select("row_key", "text"), block, window), "decontaminate")
    while after is not None:
        whole = whole.unionByName(_shared.written(scan(base.select("row_key", "text"), after, window), "decontaminate").where(F.size("items") > 0))
        after = next(blocks, None)
    united = whole.groupBy("row_key").agg(F.first("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return base.drop("text").join(united, "row_key").select("given.*", "n_words", "hits", "items")


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def judged(docs: DataFrame, benchmark: DataFrame, with_text: bool = False) -> DataFrame:
    found = hits(docs, benchmark, with_text=with_text)
    return found.withColumn("n_hit", F.size("hits").cast("long")).withColumn("contaminated", is_contaminated(F.col("n_hit"), F.col("n_words")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _shared.documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = judged(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated")


LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
pat AS (SELECT DISTINCT item, least(13, length(w)) AS n, array_to_string(w[i : i + least(13, length(w)) - 1], ' ') AS g
        FROM b, range(1, greatest(2, length(w) - 11)) t(i) WHERE length(w) > 0),
lens AS (SELECT DISTINCT n FROM pat),
occ AS (SELECT r, i, lens.n, array_to_string(w[i : i + lens.n - 1], ' ') AS g FROM d, lens, range(1, length(w) - lens.n + 2) t(i)),
hit AS (SELECT DISTINCT o.r, o.i, o.n, p.item FROM occ o JOIN pat p ON o.n = p.n AND o.g = p.g),
words AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT r, i, n FROM hit) h, range(0, 13) t(k) WHERE k < n GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, length(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= length(w) AS contaminated
FROM d LEFT JOIN words ON d.r = words.r LEFT JOIN items ON d.r = items.r
"""
