"""Operator 9, n-gram scoring by deleted interpolation.

P(w | h) mixes the maximum-likelihood estimates of n-grams of falling length, the unigram and a uniform
share for words never seen. The weights depend on the bucket of the context's frequency (its power of
two) and are learned by expectation-maximisation on held-out counts: each document of a tenth of the
training set is scored against the counts of all training documents with its own deleted.

Counting and looking up are one exchange. Texts are taken in blocks; a block's distinct n-grams, hashed and
sorted, go as one binary row to each of the buckets that the hashes fall into, with the block's training
counts; a bucket merges what all blocks sent, and answers every block with the total counts in the order
of its question. So a key meets at most once per block however often it occurs, no join is skewed by
frequent words, memory is bounded by the size of blocks and buckets, and counts are exact and cover all
documents. Held-out sums for the weights are gathered in a grid of component probabilities of fixed size.

Tokens are words with A-Z lowered, then one end token, which is also the first word's context. Nulls and
empty texts are an end token alone. A null doc_id is neither held out nor learned from. Repeated rows
count as documents of their own. With no training documents N = V = 0 and every score is that of the
uniform share. Unigrams are told apart by 64-bit hashes, longer n-grams by as many bytes as leave a wrong
meeting less likely than 2**-24 for each key.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import _shared, _words

END = np.uint64(0xE0D0E0D0E0D0E0D1)
#: Buckets of context frequency, and cells of the grid in eighths of a power of two.
N_BUCKETS, CELLS, FINE = 24, 256, 8
SMOOTH = 0.1


def tokens(chunk: _words.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes of all texts with END after each, bounds of the texts)."""
    _, _, words, first = chunk.words(_words.SPACES, _words.LOWER)
    n = chunk.n
    bounds = first + np.arange(n + 1)
    out = np.full(len(words) + n, END, np.uint64)
    inside = np.ones(len(out), bool)
    inside[bounds[1:] - 1] = False
    out[inside] = words
    return out, bounds


def grams(toks: np.ndarray, bounds: np.ndarray, order: int) -> list[np.ndarray]:
    """For each length 1..order the hash of the n-gram that ends at each token; contexts begin with END only."""
    out = [toks]
    start = np.zeros(len(toks), bool)
    start[bounds[:-1]] = True
    # Tokens of the text ahead of each one.
    reach = np.arange(len(toks)) - np.repeat(bounds[:-1], np.diff(bounds))
    for n in range(2, order + 1):
        # Text starts: the context is END once, however long.
        shorter = np.r_[END, out[-1][:-1]]
        shorter[start] = END
        context = np.where(reach >= n - 1, shorter, np.where(reach == n - 2, _words.mix(shorter + np.uint64(n)) if n > 2 else END, END))
        out.append(_words.mix(context * _words.BASE + toks * np.uint64(2 * n + 1)))
    return out


@dataclass
class Plan:
    order: int
    buckets: int
    #: Bytes of a key that are sent for n-grams of two words and more.
    width: int
    block_bytes: int


def plan_for(total_bytes: int, order: int, bucket_bytes: int, block_bytes: int) -> Plan:
    buckets = max(1, -(-total_bytes // bucket_bytes))
    needed = np.log2(max(2, total_bytes / 4)) + 24 - np.log2(buckets)
    return Plan(order, buckets, int(np.clip(np.ceil(needed / 8), 4, 8)), block_bytes)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


@dataclass
class Block:
    """Texts of a block with the distinct keys of each n-gram length."""

    number: int
    chunk: _words.Chunk
    bounds: np.ndarray
    #: For each length: distinct keys by bucket and value, where each bucket begins, each token's key.
    keys: list[np.ndarray]
    splits: list[np.ndarray]
    of_token: list[np.ndarray]
    toks: np.ndarray

    @property
    def check(self) -> int:
        return zlib.crc32(self.toks.tobytes())


def blocks(batches, plan: Plan):
    """Blocks of a partition, in an order that depends on its rows alone."""
    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 32
    for chunk in _words.chunks(batches, limit=plan.block_bytes):
        toks, bounds = tokens(chunk)
        keys, splits, of_token = [], [], []
        for n, g in enumerate(grams(toks, bounds, plan.order), 1):
            bucket = g % np.uint64(plan.buckets)
            # What is sent besides the bucket: all of it, or its upper bytes.
            kept = g if n == 1 else g >> np.uint64(64 - 8 * plan.width)
            order = np.lexsort((kept, bucket))
            b, k = bucket[order], kept[order]
            new = np.r_[True, (b[1:] != b[:-1]) | (k[1:] != k[:-1])]
            place = np.empty(len(g), np.int32)
            place[order] = np.cumsum(new) - 1
            keys.append(k[new])
            splits.append(np.searchsorted(b[new], np.arange(plan.buckets + 1, dtype=np.uint64)))
            of_token.append(place)
        yield Block(number, chunk, bounds, keys, splits, of_token, toks)
        number += 1


def narrow(keys: np.ndarray, width: int) -> bytes:
    """Ascending keys in ``width`` bytes each, byte by byte, which packs the upper ones well."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def wide(data: bytes, width: int) -> np.ndarray:
    n = len(data) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def small(counts: np.ndarray) -> bytes:
    """Counts as bytes, those of 255 and more again in full behind."""
    low = np.minimum(counts, 255).astype(np.uint8)
    return low.tobytes() + counts[counts >= 255].astype("<i8").tobytes()


def large(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<i8", -1, n)
    return out


QUESTIONS = "n int, bucket int, block long, checksum long, keys binary, counts binary"
ANSWERS = "n int, bucket int, block long, checksum long, counts binary, known long, total long"


def questions(docs: DataFrame, plan: Plan) -> DataFrame:
    def run(batches):
        for block in blocks(batches, plan):
            learned = np.repeat(block.chunk.column("learned").to_numpy(zero_copy_only=False), np.diff(block.bounds))
            for n in range(plan.order):
                counts = np.bincount(block.of_token[n][learned], minlength=len(block.keys[n]))
                rows = []
                for b in np.flatnonzero(np.diff(block.splits[n])):
                    i, j = block.splits[n][b], block.splits[n][b + 1]
                    rows.append((int(b), narrow(block.keys[n][i:j], plan.width if n else 8), small(counts[i:j])))
                m = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n + 1] * m, pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array([block.number] * m, pa.int64()), pa.array([block.check] * m, pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
                    names=["n", "bucket", "block", "checksum", "keys", "counts"],
                )

    return docs.mapInArrow(run, QUESTIONS)


def answers(asked: DataFrame, plan: Plan) -> DataFrame:
    """Total counts for each question; ``known`` and ``total`` (distinct keys, tokens) once for each bucket."""

    def settle(n, bucket, rows):
        width = plan.width if n > 1 else 8
        keys = [wide(r[2], width) for r in rows]
        counts = [large(r[3], len(k)) for r, k in zip(rows, keys, strict=True)]
        unique, place = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(place.reshape(-1), np.concatenate(counts).astype(np.float64), len(unique)).astype(np.int64)
        found = np.split(sums[place.reshape(-1)], np.cumsum([len(k) for k in keys])[:-1])
        m = len(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array([n] * m, pa.int32()), pa.array([bucket] * m, pa.int32()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([small(f) for f in found], pa.binary()), pa.array([int((sums > 0).sum())] + [0] * (m - 1), pa.int64()), pa.array([int(sums.sum())] + [0] * (m - 1), pa.int64())],
            names=["n", "bucket", "block", "checksum", "counts", "known", "total"],
        )

    def run(batches):
        group, rows = None, []
        for batch in batches:
            for n, bucket, *row in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if (n, bucket) != group:
                    if rows:
                        yield settle(*group, rows)
                    group, rows = (n, bucket), []
                rows.append(row)
        if rows:
            yield settle(*group, rows)

    # Dealt in turn, as hashed pairs would put several buckets into some tasks and none into others.
    parts = max(1, min(plan.order * plan.buckets, 4096))
    turn = (F.col("bucket") * plan.order + F.col("n") - 1) % parts
    return asked.repartitionById(parts, turn.cast("int")).sortWithinPartitions("n", "bucket", "block").mapInArrow(run, ANSWERS)


JOINT = "block long, kind int, checksum long, payload binary"


def streams(docs: DataFrame, plan: Plan) -> DataFrame:
    """Each block's rows: ids, and for each n-gram length every token's place among the block's keys."""

    def run(batches):
        for block in blocks(batches, plan):
            ids = block.chunk.column("doc_id")
            payload = pa.RecordBatch.from_arrays(
                [ids, block.chunk.column("learned"), block.chunk.column("held_out"), block.chunk.column("develop"), pa.array(np.diff(block.bounds), pa.int64())],
                names=["doc_id", "learned", "held_out", "develop", "length"],
            )
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, payload.schema) as out:
                out.write_batch(payload)
            # A longer n-gram's key is told by its place alone: sorted places pack by plane.
            rows = [(0, sink.getvalue().to_pybytes())]
            rows += [(n + 1, narrow(p.astype(np.uint64), 3 if len(block.keys[n]) < 1 << 24 else 4)) for n, p in enumerate(block.of_token)]
            yield pa.RecordBatch.from_arrays([pa.array([block.number] * len(rows), pa.int64()), pa.array([k for k, _ in rows], pa.int32()), pa.array([block.check] * len(rows), pa.int64()), pa.array([p for _, p in rows], pa.binary())], names=["block", "kind", "checksum", "payload"])

    return docs.mapInArrow(run, JOINT)


@dataclass
class Counted:
    """A block's tokens with the counts of their n-grams and contexts."""

    docs: pa.Table
    bounds: np.ndarray
    own: list[np.ndarray]
    #: counts[n - 1]: of the n-gram that ends at each token; contexts[n - 1]: of its first n - 1 words.
    counts: list[np.ndarray]
    contexts: list[np.ndarray]


def with_counts(rows: list[tuple[int, int, bytes]], plan: Plan, n_docs: int) -> Counted:
    """rows: (kind, bucket, payload) of one block; kind 100 + n are answers."""
    by_kind: dict[int, list[tuple[int, bytes]]] = {}
    for kind, bucket, payload in rows:
        by_kind.setdefault(kind, []).append((bucket, payload))
    docs = pa.ipc.open_stream(by_kind[0][0][1]).read_all()
    lengths = docs["length"].to_numpy()
    bounds = np.r_[0, np.cumsum(lengths)]
    total = int(bounds[-1])
    counts, own = [], []
    for n in range(1, plan.order + 1):
        data = by_kind[n][0][1]
        place = wide(data, len(data) // total).astype(np.int64)
        answer = [(b, p) for b, p in sorted(by_kind.get(100 + n, []))]
        totals = np.concatenate([_all_counts(p) for _, p in answer])
        counts.append(totals[place])
        own.append(place)
    contexts = []
    start = np.zeros(total, bool)
    start[bounds[:-1]] = True
    for n in range(1, plan.order + 1):
        if n == 1:
            contexts.append(np.zeros(total, np.int64))
            continue
        ahead = np.r_[0, counts[n - 2][:-1]]
        # Every training text begins after END, so a start's context is as frequent as there are texts.
        ahead[start] = n_docs
        contexts.append(ahead)
    return Counted(docs, bounds, own, counts, contexts)


def _all_counts(data: bytes) -> np.ndarray:
    """Counts of ``small`` without their number: the bytes of 255 tell how much stands behind."""
    n = len(data)
    raw = np.frombuffer(data, np.uint8)
    # n = low + 8 * (low bytes of 255); solved from the front.
    tops = np.flatnonzero(raw == 255)
    low = n
    for k in range(len(tops) + 1):
        low = n - 8 * k
        if np.searchsorted(tops, low) == k:
            break
    return large(data, low)


def components(c: Counted, n_tokens: int, vocabulary: int, order: int, deleted: bool) -> tuple[list[np.ndarray], np.ndarray]:
    """(probabilities of each component from uniform to the longest, bucket of the context) for each token.

    deleted: without the token's own document.
    """
    total = int(c.bounds[-1])
    owner = np.repeat(np.arange(len(c.bounds) - 1), np.diff(c.bounds))
    counts, contexts, base = c.counts, c.contexts, np.full(total, float(n_tokens))
    if deleted:
        own = []
        for place in c.own:
            # How often the text itself has the key.
            pair = owner.astype(np.int64) * (int(place.max(initial=0)) + 1) + place
            _, inverse, times = np.unique(pair, return_inverse=True, return_counts=True)
            own.append(times[inverse.reshape(-1)])
        counts = [x - o for x, o in zip(counts, own, strict=True)]
        start = np.zeros(total, bool)
        start[c.bounds[:-1]] = True
        contexts = [c.contexts[0]] + [x - np.where(start, 1, np.r_[0, o[:-1]]) for x, o in zip(c.contexts[1:], own[:-1], strict=True)]
        base = base - np.diff(c.bounds)[owner]
    parts = [np.full(total, 1.0 / (vocabulary + 1)), np.divide(counts[0], base, out=np.zeros(total), where=base > 0)]
    for n in range(2, order + 1):
        context = contexts[n - 1]
        parts.append(np.divide(counts[n - 1], context, out=np.zeros(total), where=context > 0))
    deepest = contexts[1] if order > 1 else np.zeros(total, np.int64)
    return parts, np.minimum(np.log2(np.maximum(deepest, 0) + 1).astype(np.int64), N_BUCKETS - 1)


GRID = "bucket int, cells array<int>, n long"


def _cell(p: np.ndarray) -> np.ndarray:
    """0 for nothing, else one more than the eighth of a power of two."""
    return np.where(p > 0, 1 + np.minimum(CELLS - 2, np.round(-np.log2(np.maximum(p, 1e-300)) * FINE)), 0).astype(np.int64)


def _value(cell: np.ndarray) -> np.ndarray:
    return np.where(cell > 0, 2.0 ** (-(cell - 1) / FINE), 0.0)


def learned_weights(cells: list[tuple[int, list[int], int]], uniform: float, order: int, rounds: int = 100) -> np.ndarray:
    """Mixture weights (bucket x component) by expectation-maximisation; a bucket starts from the pooled ones."""
    weights = np.full((N_BUCKETS, order + 1), 1.0 / (order + 1))
    if not cells:
        return weights
    bucket = np.array([b for b, _, _ in cells])
    n = np.array([m for *_, m in cells], np.float64)
    p = np.stack([np.full(len(cells), uniform), *(_value(np.array([c[k] for _, c, _ in cells])) for k in range(order))], 1)

    def fitted(p, n, w, prior):
        for _ in range(rounds):
            q = p * w
            q /= q.sum(1, keepdims=True)
            w = (q * n[:, None]).sum(0) + prior
            w /= w.sum()
        return w

    pooled = fitted(p, n, weights[0], np.full(order + 1, 1e-3))
    weights[:] = pooled
    for b in range(N_BUCKETS):
        own = bucket == b
        if own.any():
            weights[b] = fitted(p[own], n[own], pooled, 20 * pooled)
    # A context that was never seen has no longer n-grams: their share goes to the others, so that all sums to one.
    weights[0, 2:] = 0
    weights[0] /= weights[0].sum()
    return weights


class Lm:
    """Counts of a corpus and the learned weights; ``scores`` gives a row for each document."""

    def __init__(self, docs: DataFrame, order: int = 2, bucket_bytes: int = 16 << 20, block_bytes: int = 8 << 20):
        spark = docs.sparkSession
        doc_id = F.col("doc_id").cast("long")
        rest = F.crc32(doc_id.cast("string").cast("binary")) % 10
        known = doc_id.isNotNull()
        source = docs.select(doc_id.alias("doc_id"), (known & (rest != 0)).alias("learned"), (known & (rest == 0)).alias("held_out"), (known & (rest == 1)).alias("develop"), "text")
        total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
        self.order = order
        self.plan = plan = plan_for(total[0] + total[1], order, bucket_bytes, block_bytes)
        given = _shared.written(answers(questions(source, plan), plan), "lm-answers")
        self.n_docs = source.where("learned").count()
        facts = given.where("n = 1").agg(F.coalesce(F.sum("known"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
        self.vocabulary, self.n_tokens = int(facts[0]), int(facts[1])
        kinds = given.select("block", (F.col("n") + 100).alias("kind"), "bucket", "checksum", F.col("counts").alias("payload"))
        rows = streams(source, plan).select("block", "kind", F.lit(0).alias("bucket"), "checksum", "payload").unionByName(kinds)
        self.joint = _shared.written(self._joined(rows), "lm-blocks")
        grid = self.joint.where("develops").mapInArrow(self._develop(), GRID).groupBy("bucket", "cells").agg(F.sum("n").alias("n")).collect()
        self.weights = learned_weights([(r["bucket"], r["cells"], r["n"]) for r in grid], 1.0 / (self.vocabulary + 1), order)

    def _joined(self, rows: DataFrame) -> DataFrame:
        """One row for each block: its stream and its answers, aligned."""

        def pack(held, checks):
            if len(checks) != 1:
                raise RuntimeError("a block's texts changed between two scans")
            kinds = [k for k, _, _ in held]
            if 0 not in kinds:
                raise RuntimeError("a block's texts are missing")
            return pa.RecordBatch.from_arrays([pa.array([[{"kind": k, "bucket": b, "payload": p} for k, b, p in held]], pa.list_(pa.struct([("kind", pa.int32()), ("bucket", pa.int32()), ("payload", pa.binary())]))), pa.array([pa.compute.any(pa.ipc.open_stream(held[kinds.index(0)][2]).read_all()["develop"]).as_py() or False])], names=["parts", "develops"])

        def run(batches):
            import pyarrow.compute  # noqa: F401

            block, held, checks = None, [], set()
            for batch in batches:
                for b, kind, bucket, check, payload in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                    if b != block:
                        if held:
                            yield pack(held, checks)
                        block, held, checks = b, [], set()
                    held.append((kind, bucket, payload))
                    checks.add(check)
            if held:
                yield pack(held, checks)

        parts = max(1, min(self.plan.buckets * 2, 4096))
        return rows.repartition(parts, "block").sortWithinPartitions("block", "kind", "bucket").mapInArrow(run, "parts array<struct<kind:int,bucket:int,payload:binary>>, develops boolean")

    def _blocks(self):
        plan, n_docs = self.plan, self.n_docs

        def each(batches):
            for batch in batches:
                for row in batch.column(0):
                    yield with_counts([(x["kind"], x["bucket"], x["payload"]) for x in row.as_py()], plan, n_docs)

        return each

    def _develop(self):
        each, order, n_tokens, vocabulary = self._blocks(), self.order, self.n_tokens, self.vocabulary

        def run(batches):
            for c in each(batches):
                parts, bucket = components(c, n_tokens, vocabulary, order, True)
                use = np.repeat(c.docs["develop"].to_numpy(), np.diff(c.bounds))
                cells = np.stack([bucket, *(_cell(p) for p in parts[1:])], 1)[use]
                code = np.zeros(len(cells), np.int64)
                for k in range(cells.shape[1]):
                    code = code * CELLS + cells[:, k]
                values, first, n = np.unique(code, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells[first, 0], pa.int32()), pa.array(cells[first, 1:].tolist(), pa.list_(pa.int32())), pa.array(n, pa.int64())], names=["bucket", "cells", "n"])

        return run

    def scores(self) -> DataFrame:
        """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
        each, order, n_tokens, vocabulary, weights = self._blocks(), self.order, self.n_tokens, self.vocabulary, self.weights

        def run(batches):
            for c in each(batches):
                parts, bucket = components(c, n_tokens, vocabulary, order, False)
                mixed = sum(weights[bucket, k] * p for k, p in enumerate(parts))
                base = np.log10((c.counts[0] + SMOOTH) / (n_tokens + SMOOTH * (vocabulary + 1)))
                sums = [np.add.reduceat(x, c.bounds[:-1]) for x in ((c.counts[0] > 0).astype(np.int64), base, np.log10(mixed))]
                n = len(c.bounds) - 1
                yield pa.RecordBatch.from_arrays(
                    [c.docs["doc_id"].combine_chunks(), c.docs["held_out"].combine_chunks(), pa.array(np.diff(c.bounds), pa.int64()), pa.array(sums[0]), pa.array(np.full(n, n_tokens, np.int64)), pa.array(sums[1]), pa.array(sums[2])],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

        return self.joint.select("parts").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Lm(_shared.documents(spark, sf_dir)).scores()
