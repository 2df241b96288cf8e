"""Operator 12, SentencePiece encoding and decoding by a score-ordered agenda of adjacent symbol pairs.

A word starts as its characters. Each adjacent pair that makes up a piece stands on the word's agenda under the piece's
score; the best pair, the leftmost of equal ones, is merged, the pairs it stood in go, the two with its new neighbours
come on, and so on until the agenda is empty. The agendas of all words of one length in an Arrow batch are the rows
of one matrix, so a round takes the best pair from every agenda at once; words beyond 48 characters have a heap each. What is left
are the tokens; a symbol that is no piece is written as its UTF-8 bytes. Words are kept in a bounded cache.

Texts are cut where no piece of the vocabulary can span (ahead of a white-space mark, at line ends, and inside long
runs between characters that no piece holds together); they are never truncated. In every Arrow batch the share ``check`` of the texts,
one at least, is encoded and decoded by the sentencepiece library too, as a whole. Where it gives anything else the job
fails and names the text: such ids are never written. 1 compares all texts, 0 none.

Decoding puts the pieces together, turns marks into spaces, drops the one mark that encoding puts ahead of a text, and
skips begin and end ids; bytes that are no UTF-8 become U+FFFD, one for each. Any ids may be decoded.

Null and empty texts have begin and end ids alone and decode to an empty text. Repeated rows are encoded each, a null
doc_id is kept, an empty table gives no rows, and other columns are not looked at.
"""

from __future__ import annotations

import codecs
import hashlib
from array import array
from collections import defaultdict
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import _shared
from lodestone.llm.tokencounts import LONG, MARK, MODEL, NONE, Merger, pieces_of, pre_tokens

#: Share of the texts of an Arrow batch that the library encodes and decodes as well.
SHARE = 1.0

codecs.register_error("one-for-each-byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


class Table:
    """Rank and merged symbol of pairs, by open addressing: a lookup is one or two reads, whatever the vocabulary."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(8 * max(1, len(keys))))))
        size = 1 << self.bits
        self.keys, self.ranks, self.merged = np.full(size, -1, np.int64), np.full(size, NONE, np.int32), np.zeros(size, np.int32)
        todo, slot = np.arange(len(keys)), self._slots(keys)
        while len(todo):
            at = slot[todo]
            free = self.keys[at] < 0
            # Of several keys for one slot the first takes it.
            _, first = np.unique(at, return_index=True)
            wins = np.zeros(len(todo), bool)
            wins[first] = True
            wins &= free
            put = todo[wins]
            self.keys[slot[put]], self.ranks[slot[put]], self.merged[slot[put]] = keys[put], ranks[put], merged[put]
            todo = todo[~wins]
            slot[todo] = (slot[todo] + 1) & (size - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = self._slots(keys)
        there = self.keys[slot]
        far = np.flatnonzero((there != keys) & (there >= 0))
        while len(far):
            slot[far] = (slot[far] + 1) & (len(self.keys) - 1)
            there = self.keys[slot[far]]
            far = far[(there != keys[far]) & (there >= 0)]
        # An empty slot ranks NONE.
        return self.ranks[slot], self.merged[slot]


class Vocabulary:
    """Pieces of a merge-type model: what agendas and decoding look up."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.path, self.begin, self.end, self.unknown = path, model.bos_id(), model.eos_id(), model.unk_id()
        plain = pieces_of(path)
        #: The better the score the lower the rank; pieces of one score share it.
        order = {s: r for r, s in enumerate(sorted({score for _, score in plain}, reverse=True))}
        self.rank = {p: order[score] for p, score in plain}
        self.id = {p: model.piece_to_id(p) for p, _ in plain}
        byte_of = {i: int(model.id_to_piece(i)[3:5], 16) for i in range(size) if model.is_byte(i)}
        self.id_of_byte = {b: i for i, b in byte_of.items()}
        #: What an id stands for when decoded; the mark ahead of a text is dropped later.
        self.bytes = [b"" if model.is_control(i) else bytes([byte_of[i]]) if i in byte_of else model.id_to_piece(i).replace(MARK, " ").encode() for i in range(size)]
        if self.unknown >= 0:
            self.bytes[self.unknown] = " \u2047 ".encode()
        self.marked = [i not in byte_of and not model.is_control(i) and model.id_to_piece(i).startswith(MARK) for i in range(size)]
        #: Symbols are numbered with the plain pieces first; pairs that merge are looked up by both numbers.
        self.pairs = Merger(plain)
        self.id_of_symbol = np.array([self.id[p] for p, _ in plain], np.int64)
        self.found = Table(self.pairs.keys, self.pairs.ranks, self.pairs.merged)
        self.symbol_of = np.full(0x110000, -1, np.int32)
        self.symbol_of[self.pairs.known] = self.pairs.symbol_of


def symbols(word: str, rank: dict[str, int]) -> list[str]:
    """The word's symbols after all merges, by a heap: for words of any length."""
    part: list[str | None] = list(word)
    n, get = len(part), rank.get
    agenda = [(get(word[i : i + 2]), i, word[i : i + 2]) for i in range(n - 1) if word[i : i + 2] in rank]
    heapify(agenda)
    ahead, behind = list(range(1, n + 1)), list(range(-1, n - 1))
    while agenda:
        _, i, pair = heappop(agenda)
        left, j = part[i], ahead[i]
        # Entries whose symbols have changed meanwhile are passed over.
        if left is None or j == n or len(left) + len(part[j]) != len(pair):
            continue
        part[i], part[j] = pair, None
        ahead[i] = k = ahead[j]
        if k < n:
            behind[k] = i
            new = pair + part[k]
            if new in rank:
                heappush(agenda, (get(new), i, new))
        h = behind[i]
        if h >= 0:
            new = part[h] + pair
            if new in rank:
                heappush(agenda, (get(new), h, new))
    return [p for p in part if p is not None]


def _pairs(left: np.ndarray, right: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    rank, into = v.found.lookup(np.where((left >= 0) & (right >= 0), left.astype(np.int64) * v.pairs.base + right, (1 << 62) + 1))
    return rank, into


def merged(codes: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, alive) of words of one length, a row each: alive cells hold what all merges leave."""
    n, width = codes.shape
    symbol = v.symbol_of[codes]
    alive = np.ones((n, width), bool)
    # Column w is a wall on either side: it has no symbol, so nothing merges with it.
    cells = np.concatenate([symbol, np.full((n, 1), -1, np.int32)], 1).ravel()
    step = width + 1
    agenda = np.full(n * step, NONE, np.int32)
    into = np.zeros(n * step, np.int32)
    at = np.flatnonzero(np.arange(n * step) % step < width - 1)
    agenda[at], into[at] = _pairs(cells[at], cells[at + 1], v)
    here = np.arange(n * step, dtype=np.int64)
    ahead, behind = here + 1, here - 1
    behind[::step] += step  # ahead of the first symbol stands the row's wall
    rows = np.arange(n)
    live = alive.ravel()
    while len(rows):
        table = agenda.reshape(n, step)[rows]
        best = table.argmin(1)
        some = table[np.arange(len(rows)), best] < NONE
        rows, best = rows[some], best[some]
        i = rows * step + best
        j = ahead[i]
        k, h = ahead[j], behind[i]
        cells[i] = into[i]
        live[rows * width + (j - rows * step)] = False
        ahead[i], behind[k] = k, i
        agenda[j] = NONE
        left, right = np.concatenate([i, h]), np.concatenate([k, i])
        agenda[left], into[left] = _pairs(cells[left], cells[right], v)
        # The wall never leads a pair.
        agenda[step - 1 :: step] = NONE
    return cells.reshape(n, step)[:, :width], alive


class Codec:
    """Encodes and decodes texts; ids as little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary, room: int = 450_000, check: float = 1.0):
        self.v, self.room, self.check = vocabulary, room, check
        self.cache: dict[str, bytes] = {"": b""}
        self.before: dict[str, bytes] = {}
        self.silent = np.array([not b for b in vocabulary.bytes])
        packed = [int(i).to_bytes(4, "little") for i in range(len(vocabulary.bytes))]
        self.ends, self.packed = (packed[vocabulary.begin], packed[vocabulary.end]), packed
        self.library = None
        if check:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=vocabulary.path)

    def _packed(self, parts: list[str]) -> bytes:
        v, out = self.v, []
        for p in parts:
            if p in v.id:
                out.append(v.id[p])
            elif v.id_of_byte:
                out += [v.id_of_byte[b] for b in p.encode()]
            else:
                out.append(v.unknown)
        return np.array(out, "<u4").tobytes()

    def _fill(self, words: set[str], cells: int = 1 << 20) -> None:
        """Ids of all words into the cache."""
        by_length = defaultdict(list)
        for w in words:
            by_length[len(w)].append(w)
        for width, group in by_length.items():
            if width > LONG:
                self.cache.update((w, self._packed(symbols(w, self.v.rank))) for w in group)
                continue
            most = max(1, cells // width)
            for start in range(0, len(group), most):
                self._fill_rows(group[start : start + most], width)

    def _fill_rows(self, words: list[str], width: int) -> None:
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(-1, width)
        symbol, alive = merged(codes, self.v)
        odd = (alive & ((symbol < 0) | (symbol >= len(self.v.id_of_symbol)))).any(1)
        for r in np.flatnonzero(odd):
            starts = [*np.flatnonzero(alive[r]).tolist(), width]
            self.cache[words[r]] = self._packed([words[r][a:b] for a, b in pairwise(starts)])
        even = np.flatnonzero(~odd)
        flat = self.v.id_of_symbol[symbol[even][alive[even]]].astype("<u4").tobytes()
        ends = [0, *(4 * np.cumsum(alive[even].sum(1))).tolist()]
        self.cache.update((words[r], flat[a:b]) for r, (a, b) in zip(even.tolist(), pairwise(ends), strict=True))

    def _words(self, text: str) -> list[str]:
        words = pre_tokens(text)
        if max(map(len, words)) <= LONG:
            return words
        return [p for w in words for p in (self.v.pairs.cut(w) if len(w) > LONG else (w,))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, with begin and end."""
        cut = [self._words(t) if t else [] for t in texts]
        words = set().union(*cut)
        missing = words - self.cache.keys()
        if len(self.cache) + len(missing) > self.room:
            # The words of the filling before stay at hand, so frequent ones are never merged again.
            self.before, self.cache, missing = self.cache, {"": b""}, words - {""}
        found = missing & self.before.keys()
        self.cache.update((w, self.before[w]) for w in found)
        self._fill(missing - found)
        begin, end = self.ends
        find = self.cache.__getitem__
        return [b"".join([begin, *map(find, words), end]) for words in cut]

    def decode(self, ids: list[bytes]) -> list[str]:
        """Texts of any ids."""
        piece, out = self.v.bytes.__getitem__, []
        for one in ids:
            packed = np.frombuffer(one, "<u4")
            numbers = packed.tolist()
            # Begin and end ids end a run of byte pieces; nearly always they stand at the ends alone.
            runs, start = [], 0
            for k in [*np.flatnonzero(self.silent[packed]).tolist(), len(numbers)]:
                if k > start:
                    runs.append(b"".join(map(piece, numbers[start:k])).decode("utf-8", "one-for-each-byte"))
                start = k + 1
            first = next((i for i in numbers if not self.silent[i]), None)
            text = "".join(runs)
            out.append(text[1:] if first is not None and self.v.marked[first] else text)
        return out

    def both(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """Ids and decoded texts, compared with the library's."""
        ids = self.encode(texts)
        back = self.decode(ids)
        if self.library:
            turn = max(1, round(1 / self.check))
            theirs = self.library.encode(texts[::turn], add_bos=True, add_eos=True, num_threads=1)
            for text, own, mine, ids_, decoded in zip(texts[::turn], ids[::turn], back[::turn], theirs, self.library.decode(theirs), strict=True):
                if own != array("I", ids_).tobytes() or mine != decoded:
                    raise ValueError(f"the library encodes or decodes a text of {len(text)} characters in another way: {text[:200]!r}")
        return ids, back


def parts(texts: list[str], most: int):
    """(start, end) of stretches of about ``most`` characters; one text is never divided."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= most):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


def _arrow(docs: DataFrame, path: str, check: float, part: int, kinds: str, rows) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches):
        codec = Codec(shared.value, check=check)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, j in parts(texts, part):
                columns = rows(*codec.both(texts[i:j]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns.values()], names=["doc_id", *columns])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {kinds}")


def encoded(docs: DataFrame, path: str, check: float = SHARE, part: int = 4 << 20) -> DataFrame:
    """doc_id, ids (array of int, with begin and end) and the decoded text of each document."""

    def rows(ids: list[bytes], texts: list[str]) -> dict[str, pa.Array]:
        flat = np.frombuffer(b"".join(ids), "<i4")
        offsets = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
        return {"ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), "decoded": pa.array(texts, pa.string())}

    return _arrow(docs, path, check, part, "ids array<int>, decoded string", rows)


def digests(docs: DataFrame, path: str, check: float = SHARE, part: int = 4 << 20) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the decoded text: what ``encoded`` gives, without its size."""

    def rows(ids: list[bytes], texts: list[str]) -> dict[str, pa.Array]:
        return {
            "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
            "decoded_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts]),
        }

    return _arrow(docs, path, check, part, "n_tokens long, ids_sha256 string, decoded_sha256 string", rows)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(_shared.documents(spark, sf_dir), public_tokenizers.path(MODEL))
