"""Operator 6, token counts by rank-synchronous array merging.

A byte-pair vocabulary of the piece model is applied to batches of pre-tokens held as ragged numpy arrays:
each round looks up the rank of every adjacent pair, finds each sequence's lowest rank, merges its pairs of
that rank from left to right in all sequences at once, and goes on until no pair is left; the surviving
symbols are counted. Counts of pre-tokens are kept in a bounded cache, so a text costs a lookup for each
word of it.

Where a merge would create a pair of lower rank than the one merged, only the leftmost merge of that
sequence is taken in the round; so the result is that of merging one pair after the other.

No piece holds a white-space mark behind another character, so a text may be cut before each mark, and at
line ends, which are in no piece. Longer runs are cut wherever no piece can span two neighbours: a piece that does
is the two characters alone, or holds them with the one ahead or behind, so runs without a space (base64, CJK)
fall into short sequences too, and the counts stay those of the whole. Null and empty texts have no tokens.
Repeated rows are counted each; a null doc_id is kept.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import _shared

MARK = "▁"
MODEL = "piece_bpe_32k.model"
NONE = np.int32(1 << 30)


class Merger:
    """Pair ranks of a piece model and the merging of batches."""

    def __init__(self, pieces: list[tuple[str, float]]):
        """pieces: text and score of the normal pieces; a higher score merges first."""
        ids = {p: i for i, (p, _) in enumerate(pieces)}
        order = {s: r for r, s in enumerate(sorted({-s for _, s in pieces}))}
        parts: dict[str, int] = dict(ids)
        pairs = []
        for p, score in pieces:
            for k in range(1, len(p)):
                a, b = p[:k], p[k:]
                if (a in ids or len(a) == 1) and (b in ids or len(b) == 1):
                    for x in (a, b):
                        parts.setdefault(x, len(parts))
                    pairs.append((parts[a], parts[b], order[-score], ids[p]))
        self.base = len(parts) + 1
        table = np.array(sorted((a * self.base + b, r, m) for a, b, r, m in pairs), np.int64).reshape(-1, 3)
        self.keys, self.ranks, self.merged = table[:, 0].copy(), table[:, 1].astype(np.int32), table[:, 2].astype(np.int32)
        self.symbols = {ord(c): i for c, i in parts.items() if len(c) == 1}
        self.known = np.array(sorted(self.symbols), np.uint32)
        self.symbol_of = np.array([self.symbols[int(c)] for c in self.known], np.int32)
        #: Single characters that are no piece cost their UTF-8 bytes.
        self.in_model = np.array([chr(int(c)) in ids for c in self.known], bool)
        #: Every piece of two characters, and every three neighbours inside a piece.
        self.spans = np.unique(np.array([self._code(p) for p, _ in pieces if len(p) == 2], np.uint64))
        self.threes = np.unique(np.array([self._code(p[k : k + 3]) for p, _ in pieces for k in range(len(p) - 2)], np.uint64))
        self.breaks = "\n" if not any("\n" in p for p, _ in pieces) else ""
        assert not any(MARK in p.lstrip(MARK) for p, _ in pieces), "a piece holds a mark behind another character"

    @staticmethod
    def _code(text: str) -> int:
        """Two or three characters as one number of 21 bits each."""
        out = 0
        for c in text:
            out = out << 21 | ord(c)
        return out

    def cut(self, token: str) -> list[str]:
        """The token in parts that no piece spans."""
        c = np.frombuffer(token.encode("utf-32-le"), np.uint32).astype(np.uint64)
        two, three = c[:-1] << np.uint64(21) | c[1:], c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:]
        spanned = np.isin(two, self.spans)
        known = np.isin(three, self.threes)
        spanned[1:] |= known
        spanned[:-1] |= known
        edges = [0, *(np.flatnonzero(~spanned) + 1).tolist(), len(token)]
        return [token[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE if the pair doesn't merge) and place in the table."""
        want = left.astype(np.int64) * self.base + right
        at = np.minimum(np.searchsorted(self.keys, want), max(0, len(self.keys) - 1))
        ok = (self.keys[at] == want) & (left >= 0) & (right >= 0) if len(self.keys) else np.zeros(len(want), bool)
        return np.where(ok, self.ranks[at] if len(self.keys) else NONE, NONE), at

    def counts(self, tokens: list[str]) -> np.ndarray:
        """Number of symbols that survive in each of the sequences."""
        lengths = np.array([len(t) for t in tokens], np.int64)
        codes = np.frombuffer("".join(tokens).encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.known, codes), len(self.known) - 1)
        hit = self.known[at] == codes
        symbol = np.where(hit, self.symbol_of[at], -1).astype(np.int32)
        size = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        cost = np.where(hit & self.in_model[at], 1, size).astype(np.int64)
        owner = np.repeat(np.arange(len(tokens)), lengths)
        done = np.zeros(len(tokens), np.int64)
        while len(symbol):
            rank, place = self.lookup(symbol[:-1], symbol[1:])
            rank[owner[:-1] != owner[1:]] = NONE
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.minimum.reduceat(np.r_[rank, NONE], first)
            going = least < NONE
            # Sequences without a pair to merge are finished.
            span = np.diff(np.r_[first, len(symbol)])
            if not going.all():
                stay = np.repeat(going, span)
                np.add.at(done, owner[~stay], cost[~stay])
                keep = np.flatnonzero(stay)
                rank = np.r_[rank, NONE][keep][:-1] if len(keep) else rank[:0]
                place = np.r_[place, 0][keep][:-1] if len(keep) else place[:0]
                symbol, cost, owner = symbol[keep], cost[keep], owner[keep]
                least, span = least[going], span[going]
                first = np.r_[0, np.cumsum(span)[:-1]] if len(span) else first[:0]
                if not len(symbol):
                    break
            low = np.repeat(least, span)
            take = self._alternate(np.flatnonzero(rank == low[:-1]))
            trial, left = self._merge(symbol, take, place)
            # Pairs that the merges create must not come before the rank merged.
            new_rank, _ = self.lookup(trial[left[:-1]], trial[left[1:]])
            o = owner[left]
            new_rank[o[:-1] != o[1:]] = NONE
            early = new_rank < low[left][:-1]
            if early.any():
                bad = np.zeros(len(done), bool)
                bad[o[:-1][early]] = True
                lead = np.r_[True, owner[take][1:] != owner[take][:-1]]
                take = take[lead | ~bad[owner[take]]]
                trial, left = self._merge(symbol, take, place)
            cost[take] = 1
            symbol, cost, owner = trial[left], cost[left], owner[left]
        return done

    @staticmethod
    def _alternate(at: np.ndarray) -> np.ndarray:
        """Every other one of each run of adjacent places: pairs that don't overlap, from the left."""
        start = np.r_[True, np.diff(at) > 1]
        begin = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
        return at[(np.arange(len(at)) - begin) % 2 == 0]

    def _merge(self, symbol: np.ndarray, take: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        trial = symbol.copy()
        trial[take] = self.merged[place[take]]
        keep = np.ones(len(symbol), bool)
        keep[take + 1] = False
        return trial, np.flatnonzero(keep)


def pieces_of(path: str) -> list[tuple[str, float]]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [(model.id_to_piece(i), model.get_score(i)) for i in plain]


#: A longer pre-token is cut further.
LONG = 48
RUNS = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")


def pre_tokens(text: str) -> list[str]:
    """The text with its mark in front, cut before marks and around line ends."""
    if "  " in text or MARK in text or text[:1] == " ":
        return RUNS.findall(MARK + text.replace(" ", MARK))
    return (MARK + text.replace(" ", f" {MARK}").replace("\n", " \n ")).split(" ")


class Counter:
    """Counts of texts with a cache of at most ``room`` pre-tokens."""

    def __init__(self, merger: Merger, room: int = 400_000, batch: int = 1_000_000):
        self.merger, self.room, self.batch = merger, room, batch
        self.cache: dict[str, int] = {"": 0}

    def counts(self, texts: list[str]) -> list[int]:
        cut = [self._parts(pre_tokens(t)) if t else [] for t in texts]
        missing = set().union(*cut) - self.cache.keys() if cut else set()
        if len(self.cache) + len(missing) > self.room:
            self.cache = {"": 0}
            missing = set().union(*cut) - {""}
        todo, size = [], 0
        for t in sorted(missing, key=len):
            todo.append(t)
            size += len(t)
            if size >= self.batch:
                self._fill(todo)
                todo, size = [], 0
        self._fill(todo)
        find = self.cache.__getitem__
        return [sum(map(find, c)) for c in cut]

    def _parts(self, tokens: list[str]) -> list[str]:
        if max(map(len, tokens)) <= LONG:
            return tokens
        return [p for t in tokens for p in (self.merger.cut(t) if len(t) > LONG else (t,))]

    def _fill(self, tokens: list[str]) -> None:
        if tokens:
            self.cache.update(zip(tokens, self.merger.counts(tokens).tolist(), strict=True))


def counted(docs: DataFrame, path: str, limit: int = 4096, part: int = 2 << 20) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(Merger(pieces_of(path)))

    def run(batches):
        counter = Counter(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sizes = np.array([len(t.encode()) for t in texts], np.int64)
            n: list[int] = []
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) <= part):
                    size += len(texts[j])
                    j += 1
                n += counter.counts(texts[i:j])
                i = j
            tokens = np.array(n, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return counted(_shared.documents(spark, sf_dir), public_tokenizers.path(MODEL))
