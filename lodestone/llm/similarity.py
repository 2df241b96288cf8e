"""Operator 10, n-gram Jaccard join by parity sketches.

A document's distinct word shingles are dealt to parts by their hash, and the hashes in each part are
XORed: a sketch whose parts differ wherever the symmetric difference is odd there. Two sets linked at
Jaccard 0.85 differ in at most D = 15/185 of the sum of their sizes, so of P = D + 1 + E parts at least
1 + E agree. E is half of D: a document of which fewer than 1 + E parts (less those that are empty) are shared
with any other document has no link, which clears away documents that share a passage and no more, however
many they are. Sizes fall into bands with a D of their own; a document near the lower edge of its band takes part
in the band below as well. Documents that agree in a part are candidates.

Of each part's documents all meet the least one first: those pairs are sifted by bit sketches (twice as many bits as
shingles, to the next power of two; a longer one folds to a shorter by XOR), whose Hamming distance never exceeds
the symmetric difference, and verified on the sets themselves, in groups salted by the document, each with a
copy of the least one's text. So a large group of near copies costs one comparison a member. Only parts whose
documents are then still in different components are compared further: all across components, by
sketches; what may link makes blocks, whose texts meet and are verified. Groups and blocks too large for one task
are cut into chunks and every pair of chunks is compared: nothing is capped.

Equal sets are one class from the start: only one node of it is sketched. Shingles are 64-bit hashes.
Texts with fewer words than a shingle are one shingle; null and empty texts have none and link with nothing.
Each (doc_id, text) is a node of its own (a 64-bit hash), so texts without an id are searched and linked each by
itself; repeated rows are one node. Several texts under one id are searched each by itself too, and with ``join_ids``
(as in the query) whatever one of them links with is reached by all; n_shingles is the size of the row's own set.
A group is named by its smallest id, and has no name if none of its rows has an id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import _components, _shared, _words

SHINGLE = 4
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85


class Bands:
    """Lower edges of the size bands, and each band's number of parts and of agreements beyond the first."""

    def __init__(self, percent: int = PERCENT, ratio: float = 1.5, spare: float = 0.5, most: int = 1 << 40):
        self.percent = percent
        edges = [1]
        while edges[-1] < most:
            edges.append(max(edges[-1] + 1, int(edges[-1] * ratio)))
        self.edges = np.array(edges, np.int64)
        smaller = self.edges[1:] - 1
        larger = smaller * 100 // percent
        self.apart = (smaller + larger) * (100 - percent) // (100 + percent)
        self.spare = np.ceil(self.apart * spare).astype(np.int64)
        self.parts = self.apart + 1 + self.spare

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, n, "right") - 1

    def below(self, n: np.ndarray) -> np.ndarray:
        """Can a set of n link with one of the band below?"""
        return self.percent * n < 100 * self.edges[self.of(n)]


def shingles(chunk: _words.Chunk, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of the distinct shingles, by owner and ascending hash."""
    _, _, hashes, first = chunk.words(_words.SPACES, _words.LOWER)
    n = chunk.n
    counts = np.diff(first)
    owner = np.repeat(np.arange(n), counts)
    wins = _words.windows(hashes, size)
    at = np.flatnonzero(owner[: len(wins)] == owner[size - 1 :]) if len(wins) else np.zeros(0, np.int64)
    few = np.flatnonzero((counts > 0) & (counts < size))
    whole = [hashes[first[i] : first[i + 1]] for i in few]
    short = np.array([int(_words.mix(_words.windows(h, len(h)) + np.uint64(len(h)))[0]) for h in whole], np.uint64)
    owners, values = np.r_[owner[at], few], np.r_[wins[at], short]
    order = np.argsort(owners, kind="stable")
    owners, values = owners[order], values[order]
    edge = np.searchsorted(owners, np.arange(n + 1)).tolist()
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        values[a:b].sort()
    new = np.r_[True, (owners[1:] != owners[:-1]) | (values[1:] != values[:-1])] if len(owners) else np.zeros(0, bool)
    return owners[new], values[new]


#: Dealings tried before a part that is empty becomes a key. One in about eighty short sets needs the second, and so on.
DEALINGS = 8


def part_keys(owner: np.ndarray, values: np.ndarray, n: int, bands: Bands, shift: int = 0, dealings: int = DEALINGS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, key) for the parts of each of n sketches in their own band, or the one ``shift`` below, and for each
    sketch how many keys must be shared with other documents; values ascend within an owner.

    Parts that are empty in both agree too: a sketch with E of them or fewer may leave them out and needs so many
    fewer. One with more needs one shared key. If it links with another and no part that holds something agrees,
    the parts that hold something differ in both, so the other has more than E empty parts as well: both are dealt
    again by another hash, and meet there. Only what is left after the last dealing has keys for empty parts.
    """
    sizes = np.bincount(owner, minlength=n)
    q = np.maximum(bands.of(np.maximum(sizes, 1)) - shift, 0)
    use = (sizes > 0) & (bands.apart[q] > 0)
    if shift:
        use &= (bands.of(np.maximum(sizes, 1)) >= shift) & bands.below(np.maximum(sizes, 1))
    owners, keys, need, left = [], [], np.ones(n, np.int64), use
    for turn in range(dealings):
        rows = np.flatnonzero(left[owner])
        if turn and not len(rows):
            break
        o, v = owner[rows], values[rows]
        if turn:
            v = _words.mix(v + np.uint64(turn))
            order = np.lexsort((v, o))
            o, v = o[order], v[order]
        place = lambda q, part, turn=turn: _words.mix(q.astype(np.uint64) * np.uint64(1 << 40) + part + np.uint64(1) + np.uint64(turn << 56))
        part = ((v >> np.uint64(32)) * bands.parts[q[o]].astype(np.uint64)) >> np.uint64(32)
        lead = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (part[1:] != part[:-1])]) if len(o) else np.zeros(0, np.int64)
        o, part = o[lead], part[lead]
        sketch = np.bitwise_xor.reduceat(v, lead) if len(lead) else v
        owners.append(o)
        keys.append(_words.mix(sketch ^ place(q[o], part)))
        empty = np.where(left, bands.parts[q] - np.bincount(o, minlength=n), 0)
        if not turn:
            need = np.where(empty > bands.spare[q], 1, 1 + bands.spare[q] - empty)
        left = left & (empty > bands.spare[q])
    first = np.searchsorted(o, np.arange(n + 1))
    for i in np.flatnonzero(left):
        bare = np.setdiff1d(np.arange(bands.parts[q[i]], dtype=np.uint64), part[first[i] : first[i + 1]])
        owners.append(np.full(len(bare), i))
        keys.append(_words.mix(np.uint64(0xE5) ^ place(np.full(len(bare), q[i]), bare)))
    o, key = np.concatenate(owners), np.concatenate(keys)
    order = np.argsort(o, kind="stable")
    return o[order], key[order], need


BASE = "doc_id long, id_key long, text_key long, n_shingles long, n_bytes long, set_hash long, set_check long, sketch binary, schemes array<struct<need:int,part_keys:array<long>>>"
LEAST_BITS = 256


def bit_sketch(values: np.ndarray) -> bytes:
    """Parity of the hashes that fall on each bit."""
    bits = max(LEAST_BITS, 1 << int(np.ceil(np.log2(max(1, 2 * len(values))))))
    return np.packbits(np.bincount((values & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def folded(sketch: bytes, size: int) -> np.ndarray:
    """The sketch at a smaller number of bytes: halves XORed."""
    out = np.frombuffer(sketch, np.uint64)
    while len(out) * 8 > size:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def sketched(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    def run(batches):
        bands = Bands(percent)
        for chunk in _words.chunks(batches):
            n = chunk.n
            owner, values = shingles(chunk, size)
            sizes = np.bincount(owner, minlength=n).astype(np.int64)
            edge = np.searchsorted(owner, np.arange(n + 1))
            sums = np.zeros((2, n), np.uint64)
            for row, v in zip(sums, (values, _words.mix(values + np.uint64(99))), strict=True):
                total = np.zeros(len(v) + 1, np.uint64)
                np.cumsum(v, out=total[1:])
                row[:] = total[edge[1:]] - total[edge[:-1]]
            # Each text's schemes lie side by side: its own band's, then that of the band below.
            both = [part_keys(owner, values, n, bands, shift) for shift in (0, 1)]
            counts = np.stack([np.bincount(o, minlength=n) for o, _, _ in both], 1)
            keys = np.concatenate([k for _, k, _ in both])[np.argsort(np.concatenate([o for o, _, _ in both]), kind="stable")]
            some = counts.reshape(-1) > 0
            needs = np.stack([need for *_, need in both], 1).reshape(-1)[some]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts.reshape(-1)[some])].astype(np.int32)), pa.array(keys.view(np.int64)))
            schemes = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum((counts > 0).sum(1))].astype(np.int32)), pa.StructArray.from_arrays([pa.array(needs.astype(np.int32)), lists], ["need", "part_keys"]))
            sketches = [bit_sketch(values[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(chunk.column(c) for c in ("doc_id", "id_key", "text_key")), pa.array(sizes), pa.array(np.diff(chunk.offsets) - 1), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array(sketches, pa.binary()), schemes],
                names=["doc_id", "id_key", "text_key", "n_shingles", "n_bytes", "set_hash", "set_check", "sketch", "schemes"],
            )

    return docs.mapInArrow(run, BASE)


class Sketches:
    """Sketches of many sets, compared at the shorter length of two."""

    def __init__(self, sketches: list[bytes], sizes: np.ndarray, percent: int):
        self.sketches, self.sizes, self.percent = sketches, sizes, percent
        self.lengths = np.array([len(s) for s in sketches], np.int64)
        self.at: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def folds(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Row of each sketch (that is long enough), and the rows folded to ``size`` bytes."""
        if size not in self.at:
            long = np.flatnonzero(self.lengths >= size)
            row = np.full(len(self.lengths), -1)
            row[long] = np.arange(len(long))
            self.at[size] = row, np.stack([folded(self.sketches[i], size) for i in long])
        return self.at[size]

    def may_link(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` whose sketch and size allow a link with set i."""
        sizes, percent = self.sizes, self.percent
        others = others[np.minimum(sizes[others], sizes[i]) * 100 >= np.maximum(sizes[others], sizes[i]) * percent]
        keep = np.zeros(len(others), bool)
        for length in np.unique(self.lengths[others]):
            own = self.lengths[others] == length
            row, folds = self.folds(int(min(length, self.lengths[i])))
            apart = np.bitwise_count(folds[row[others[own]]] ^ folds[row[i]]).sum(1, dtype=np.int64)
            keep[own] = apart * (100 + percent) <= (sizes[others[own]] + sizes[i]) * (100 - percent)
        return others[keep]


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ascending sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def is_link(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = common(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def linked(sketches: list[bytes], sizes: np.ndarray, sides: np.ndarray, root: np.ndarray, sets: list[np.ndarray] | None = None, percent: int = PERCENT) -> np.ndarray:
    """Root of each set after uniting, beyond the roots given, all linked pairs; of two sides only pairs across.

    Without the sets themselves a pair whose sketches allow a link counts as linked.
    """
    n, root, known = len(sketches), root.copy(), Sketches(sketches, sizes, percent)
    across = sides.min() != sides.max()
    # The members of the largest class come last: they are compared by the others, and need no turn of their own.
    largest = root == np.bincount(root).argmax()
    turn = np.empty(n, np.int64)
    order = np.argsort(largest, kind="stable")
    turn[order] = np.arange(n)
    for i in order[: n - int(largest.sum())]:
        later = (turn > turn[i]) & (root != root[i])
        for j in known.may_link(i, np.flatnonzero(later & (sides != sides[i]) if across else later)):
            if root[j] != root[i] and (sets is None or is_link(sets[i], sets[j], percent)):
                root[root == max(root[i], root[j])] = min(root[i], root[j])
    return root


def united(rows: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Edges (a, b) between components that span what is linked in each group (block, left_chunk, right_chunk).

    rows have a column ``component``, and ``text``, for links, or ``sketch`` and ``n_shingles``, for pairs that may link.
    """
    whole = "text" in rows.columns

    def settle(ids, data, sizes, chunk_ids):
        names, root = np.unique(np.array(ids, np.int64), return_inverse=True)
        if len(names) < 2:
            return []
        sets = None
        if whole:
            sets = []
            for chunk in _words.cut(pa.RecordBatch.from_arrays([pa.array(data, pa.string())], names=["text"])):
                owner, values = shingles(chunk, size)
                sets += np.split(values, np.searchsorted(owner, np.arange(1, chunk.n)))
            data = [bit_sketch(v) for v in sets]
            sizes = [len(v) for v in sets]
        end = linked(data, np.array(sizes, np.int64), np.array(chunk_ids), root.reshape(-1), sets, percent)
        return list({(int(names[a]), int(names[b])) for a, b in zip(root.reshape(-1).tolist(), end.tolist(), strict=True) if a != b})

    def batch_of(edges):
        return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["a", "b"])

    def run(batches):
        group, held = None, ([], [], [], [])
        for batch in batches:
            edges: list[tuple[int, int]] = []
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                for block, a, b, chunk_id, *row in zip(*(part.column(c).to_pylist() for c in range(7)), strict=True):
                    if (block, a, b) != group:
                        edges += settle(*held)
                        group, held = (block, a, b), ([], [], [], [])
                    for x, v in zip(held, (*row, chunk_id), strict=True):
                        x.append(v)
            yield batch_of(edges)
        yield batch_of(settle(*held))
        _words.release()

    keys = ["block", "left_chunk", "right_chunk"]
    columns = [*keys, "chunk", "component", "text" if whole else "sketch", F.col("n_shingles").cast("long")]
    return rows.select(*columns).repartition(*keys).sortWithinPartitions(*keys, "chunk", "component").mapInArrow(run, "a long, b long")


def dealt(members: DataFrame, weight: str, chunk_docs: int, chunk_bytes: int) -> DataFrame:
    """Every row once for each pair of chunks of its block that holds its own.

    Blocks above the limits are dealt to several chunks by a hash; the others are one chunk.
    """
    weights = members.groupBy("block").agg(F.greatest(F.ceil(F.count("*") / chunk_docs), F.ceil(F.sum(weight) / chunk_bytes)).cast("int").alias("chunks")).where("chunks > 1")
    rows = _shared.joined(members, weights, ["block"], "left", "similarity-weights").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return rows.withColumn("left_chunk", F.least("chunk", "other")).withColumn("right_chunk", F.greatest("chunk", "other"))


def shared_parts(parts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of ``parts`` (node, below, part_key) that two documents agree in, of documents that share enough of them.

    nodes: node, below and need, the number of shared parts without which a document has no link. A document that drops out
    may leave others with too few, so the rest is sifted once more. Parts are by far the most rows there are, so each sifting
    shuffles them once, however many are shared: no join with the shared ones. A part of very many documents is as many short rows.
    """
    alike = Window.partitionBy("part_key")
    for turn in range(2):
        several = parts.withColumn("low", F.min("node").over(alike)).withColumn("high", F.max("node").over(alike)).where("low <> high")
        shared = _shared.written(several.select("node", "below", "part_key").distinct(), f"similarity-shared-{turn}")
        enough = shared.groupBy("node", "below").agg(F.count("*").alias("n")).join(nodes, ["node", "below"]).where("n >= need").select("node", "below")
        parts = _shared.joined(shared, enough, ["node", "below"], "left_semi", "similarity-enough")
    return parts


def sifted(pairs: DataFrame, percent: int) -> DataFrame:
    """Of pairs with both sketches those that may link."""

    def run(batches):
        for batch in batches:
            n = [batch.column(k).to_numpy() for k in (0, 1)]
            ends = [_words.bounds_of(batch.column(k)) for k in (2, 3)]
            lengths = [e - s for _, s, e in ends]
            near = np.minimum(*n) * 100 >= np.maximum(*n) * percent
            keep = np.zeros(batch.num_rows, bool)
            for i in np.flatnonzero(near):
                size = int(min(lengths[0][i], lengths[1][i]))
                a, b = (folded(data[s[i] : e[i]], size) for data, s, e in ends)
                keep[i] = int(np.bitwise_count(a ^ b).sum()) * (100 + percent) <= (n[0][i] + n[1][i]) * (100 - percent)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep)) for k in range(4, batch.num_columns)], names=batch.schema.names[4:])
        _words.release()

    schema = pairs.select(*pairs.columns[4:]).schema
    return pairs.mapInArrow(run, schema)


def confirmed(star: DataFrame, docs: DataFrame, size: int, percent: int, salts: int = 32, per_salt: int = 20_000) -> DataFrame:
    """Edges (a, b) of the pairs (node, low) whose sets link; each low's documents are dealt to several groups.

    A group holds a copy of the low one's text ahead of the others', so a task keeps one set at a time.
    """
    salts = max(salts, -(-star.count() // per_salt))
    members = star.select("low", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("role"), "node", "id_key", "text_key", "low_id_key", "low_text_key")
    pivots = members.select("low", "salt", F.lit(0).alias("role"), F.col("low").alias("node"), F.col("low_id_key").alias("id_key"), F.col("low_text_key").alias("text_key")).distinct()
    rows = _shared.written(members.drop("low_id_key", "low_text_key").unionByName(pivots), "similarity-star-rows")

    def run(batches):
        pivot = np.zeros(0, np.uint64)
        for chunk in _words.chunks(batches):
            owner, values = shingles(chunk, size)
            edge = np.searchsorted(owner, np.arange(chunk.n + 1))
            lows, roles, nodes = (chunk.column(c).to_numpy() for c in ("low", "role", "node"))
            good = np.zeros(chunk.n, bool)
            for i in range(chunk.n):
                own = values[edge[i] : edge[i + 1]]
                if roles[i]:
                    good[i] = is_link(own, pivot, percent)
                else:
                    pivot = own.copy()
            yield pa.RecordBatch.from_arrays([pa.array(nodes[good]), pa.array(lows[good])], names=["a", "b"])

    texts = _shared.with_text(rows, docs).select("low", "salt", "role", "node", "text")
    return texts.repartition("low", "salt").sortWithinPartitions("low", "salt", "role").mapInArrow(run, "a long, b long")


def across(apart: DataFrame, facts: DataFrame, found: DataFrame, keyed: DataFrame, size: int, percent: int, chunk_docs: int, chunk_bytes: int) -> DataFrame:
    """Edges between components of documents that agree in a part (block, node, component) and link."""
    rows = apart.join(facts.select("node", "n_shingles", "sketch", F.octet_length("sketch").alias("n_sketch")), "node")
    may = _shared.written(united(dealt(rows, "n_sketch", 4 * chunk_docs, chunk_bytes), size, percent), "similarity-may")
    # What may link across components makes blocks; their texts meet.
    blocks = _components.components(may).select(F.col("node").alias("component"), F.col("root").alias("block"))
    blocks = blocks.unionByName(blocks.select(F.col("block").alias("component"), "block").distinct())
    members = _shared.joined(facts.drop("sketch"), found, ["node"], "left").withColumn("component", F.coalesce("root", "node")).drop("root")
    members = _shared.written(_shared.joined(members, blocks, ["component"], name="similarity-blocks"), "similarity-members")
    return united(_shared.with_text(dealt(members, "n_bytes", chunk_docs, chunk_bytes), keyed), size, percent)


def classes(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, chunk_docs: int = 1000, chunk_bytes: int = 4 << 20, join_ids: bool = False) -> DataFrame:
    """doc_id, id_key, text_key, n_shingles, component (an id_key), leads for each row of ``docs``.

    Of each group of linked nodes one leads: that of the smallest id, ids ahead of null, and its least text_key.
    """
    keyed = _shared.with_keys(docs)
    node = F.xxhash64("id_key", "text_key").alias("node")
    base = _shared.written(sketched(keyed, size, percent), "similarity-base").select("*", node)
    sets = ["set_hash", "set_check", "n_shingles"]
    # Of the nodes with one set the least goes on; the others are copies.
    heads = base.where("n_shingles > 0").groupBy(*sets).agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head < last").select(*sets, "head")
    rows = _shared.joined(base.select("doc_id", "id_key", "text_key", "node", *sets), heads, sets, "left", "similarity-heads")
    rows = _shared.written(rows.select("doc_id", "id_key", "text_key", "n_shingles", "node", F.coalesce("head", "node").alias("head")), "similarity-rows")
    copies = rows.where("node <> head").select("node").distinct()
    alone = _shared.joined(base.where(F.size("schemes") > 0), copies, ["node"], "left_anti", "similarity-copies")
    schemes = alone.select("node", F.posexplode("schemes").alias("below", "s"))
    parts = schemes.select("node", "below", F.explode("s.part_keys").alias("part_key"))
    groups = shared_parts(parts, schemes.select("node", "below", F.col("s.need").alias("need")).distinct())
    # The least document of each part against all others there.
    alike = Window.partitionBy("part_key")
    groups = groups.withColumn("low", F.min("node").over(alike)).withColumn("high", F.max("node").over(alike)).withColumn("n", F.count("*").over(alike)).where("low <> high")
    groups = _shared.written(groups.select("part_key", "node", "low", "n"), "similarity-groups")
    facts = base.select("node", "id_key", "text_key", "n_shingles", "n_bytes", "sketch")
    facts = _shared.joined(facts, groups.select("node").distinct(), ["node"], "left_semi", "similarity-met").dropDuplicates(["node"])
    facts = _shared.written(facts, "similarity-facts")
    pairs = groups.where("node <> low").select("node", "low").distinct().join(facts, "node")
    other = facts.select(F.col("node").alias("low"), F.col("n_shingles").alias("low_n"), F.col("sketch").alias("low_sketch"), F.col("id_key").alias("low_id_key"), F.col("text_key").alias("low_text_key"))
    pairs = pairs.join(other, "low").select("n_shingles", "low_n", "sketch", "low_sketch", "node", "low", "id_key", "text_key", "low_id_key", "low_text_key")
    star = _shared.written(sifted(pairs, percent), "similarity-star")
    edges = _shared.written(confirmed(star, keyed, size, percent), "similarity-edges")
    # Parts whose documents are still apart: all across the components, by sketches.
    found = _components.components(edges)
    known = _shared.joined(groups, found, ["node"], "left").withColumn("component", F.coalesce("root", "node")).drop("root")
    known = _shared.written(known.where("n > 2").select(F.col("part_key").alias("block"), "node", "component"), "similarity-known")
    split = known.groupBy("block").agg(F.min("component").alias("one"), F.max("component").alias("two")).where("one <> two").select("block")
    apart = _shared.joined(known, split, ["block"], "left_semi", "similarity-split")
    apart = _shared.written(apart, "similarity-apart")
    if not apart.isEmpty():
        edges = edges.unionByName(across(apart, facts, found, keyed, size, percent, chunk_docs, chunk_bytes))
    if join_ids:
        # Nodes of one id are one document.
        heads_of = rows.where(F.col("doc_id").isNotNull()).select("id_key", "head").distinct()
        several = heads_of.groupBy("id_key").agg(F.min("head").alias("b"), F.max("head").alias("last")).where("b < last").select("id_key", "b")
        edges = edges.unionByName(_shared.joined(heads_of, several, ["id_key"], name="similarity-ids").select(F.col("head").alias("a"), "b"))
    links = _components.components(edges).withColumnRenamed("node", "head")
    rooted = _shared.joined(rows, links, ["head"], "left").withColumn("root", F.coalesce("root", "head"))
    rooted = _shared.written(rooted.select("doc_id", "id_key", "text_key", "n_shingles", "node", "root"), "similarity-rooted")
    # A node alone in its group leads it.
    least = rooted.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("without"), "id_key", "text_key")).alias("least"), F.min("node").alias("x"), F.max("node").alias("y")).where("x < y").select("root", "least")
    out = _shared.joined(rooted, least, ["root"], "left", "similarity-least")
    leads = F.col("least").isNull() | ((F.col("id_key") == F.col("least.id_key")) & (F.col("text_key") == F.col("least.text_key")))
    return out.select("doc_id", "id_key", "text_key", "n_shingles", F.coalesce("least.id_key", "id_key").alias("component"), leads.alias("leads"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classes(_shared.documents(spark, sf_dir), join_ids=True)
    return out.select("doc_id", "n_shingles", F.nullif("component", F.lit(_shared.LOWEST)).alias("component_id"))


ORACLE = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 3], ' ')) AS g FROM d, range(1, greatest(2, length(w) - 2)) t(i) WHERE length(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM d
  UNION
  SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(y) FROM reach WHERE reach.x = d.doc_id) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id
"""
