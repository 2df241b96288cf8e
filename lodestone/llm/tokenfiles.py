"""Operator 5, token files with directly addressable codes.

File format (files of some two million tokens in the order of ids; little-endian):

    header    b"LDAC1\\0\\0\\0", then int64: documents, tokens, alphabet size, levels
    widths    one byte a level: bits of a chunk at that level, then padding to 8 bytes
    doc ids   int64 for each document (ascending; the least int64 stands for null)
    offsets   int64 for each document and one more: where its tokens begin
    alphabet  uint32 token ids by falling frequency in the file; a token's code is its place there
    for each level: int64 count, the chunks (``width`` bits each, packed, padded to 8 bytes); and, but for
    the last level, a bitmap (bit i: does chunk i go on?) and a rank directory, uint32 ones ahead of each
    512-bit block (both padded to 8 bytes)

A code's lowest bits are its chunk at level 0; if the bitmap's bit is set, the rest is at level 1, at the
place that the number of ones ahead of it names, and so on. So any token is read by one chunk and one rank
for each level, without decoding what stands before it.

Documents are range-partitioned by id between size-weighted splitters, encoded and written by the tasks, a range
as one file or several, each under a temporary name that is then renamed, so a task that is run again only replaces
its files. A task holds one file's tokens, whatever the size of its range. Files go through Arrow's file systems
(local, HDFS, S3, GCS, Azure), so the folder must be in one of these.
Words are tokenised once and kept in a bounded cache: the tokenizer's pre-tokens don't cross white space.

Nulls: a null text is an empty document (the end id only); a null doc_id sorts first. Repeated rows are
documents of their own. An empty table writes no file and gives an empty result.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import _ranges, _shared, _words

TOKENIZER = "word_bpe_49k.json"
END = 1
MAGIC = b"LDAC1\0\0\0"
BLOCK = 512
#: Chunks of the first level are whole bytes, which need no packing.
LEVEL_0 = (8,)


def _padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % 8)


def _packed(values: np.ndarray, width: int) -> bytes:
    if width == 8:
        return _padded(values.astype(np.uint8).tobytes())
    bits = (values.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return _padded(np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little").tobytes())


def widths_for(counts: np.ndarray) -> list[int]:
    """Chunk widths of two or three levels that take the least space for codes of these frequencies."""
    ahead = np.r_[0, np.cumsum(counts)]
    over = lambda bits: int(ahead[-1] - ahead[min(len(counts), 1 << bits)])
    total = max(1, int(np.ceil(np.log2(max(2, len(counts))))))
    best = (int(ahead[-1]) * total, [total])
    for a in LEVEL_0:
        if a >= total:
            break
        best = min(best, (int(ahead[-1]) * (a + 1) + over(a) * (total - a), [a, total - a]))
        for b in range(2, total - a):
            best = min(best, (int(ahead[-1]) * (a + 1) + over(a) * (b + 1) + over(a + b) * (total - a - b), [a, b, total - a - b]))
    return best[1]


def encode(doc_ids: np.ndarray, offsets: np.ndarray, tokens: np.ndarray) -> bytes:
    """A file's bytes from its documents' ids, token offsets and tokens."""
    frequency = np.bincount(tokens) if len(tokens) else np.zeros(0, np.int64)
    alphabet = np.argsort(-frequency, kind="stable")[: int((frequency > 0).sum())]
    code_of = np.zeros(len(frequency), np.uint32)
    code_of[alphabet] = np.arange(len(alphabet), dtype=np.uint32)
    widths = widths_for(frequency[alphabet])
    out = [MAGIC, np.array([len(doc_ids), len(tokens), len(alphabet), len(widths)], "<i8").tobytes(), _padded(bytes(widths)), doc_ids.astype("<i8").tobytes(), offsets.astype("<i8").tobytes(), _padded(alphabet.astype("<u4").tobytes())]
    codes = code_of[tokens] if len(tokens) else np.zeros(0, np.uint32)
    for k, width in enumerate(widths):
        out += [np.array([len(codes)], "<i8").tobytes(), _packed(codes & np.uint32((1 << width) - 1), width)]
        if k < len(widths) - 1:
            rest = codes >> np.uint32(width)
            more = rest > 0
            bitmap = np.packbits(more, bitorder="little")
            blocks = np.add.reduceat(more, np.arange(0, len(more), BLOCK)) if len(more) else np.zeros(0, np.int64)
            out += [_padded(bitmap.tobytes()), _padded((np.cumsum(blocks) - blocks).astype("<u4").tobytes())]
            codes = rest[more]
    return b"".join(out)


class Reader:
    """A file's bytes with random access to tokens and documents."""

    def __init__(self, data: bytes | memoryview):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        n_docs, self.n_tokens, n_alphabet, levels = np.frombuffer(data, "<i8", 4, 8).tolist()
        at = 40
        self.widths = list(data[at : at + levels])
        at += -(-levels // 8) * 8
        self.doc_ids = np.frombuffer(data, "<i8", n_docs, at)
        at += 8 * n_docs
        self.offsets = np.frombuffer(data, "<i8", n_docs + 1, at)
        at += 8 * (n_docs + 1)
        self.alphabet = np.frombuffer(data, "<u4", n_alphabet, at)
        at += -(-4 * n_alphabet // 8) * 8
        self.levels = []
        for k, width in enumerate(self.widths):
            n = int(np.frombuffer(data, "<i8", 1, at)[0])
            at += 8
            size = -(-n * width // 8)
            chunks = np.frombuffer(data, np.uint8, size, at)
            at += -(-size // 8) * 8
            bitmap = ranks = None
            if k < levels - 1:
                size = -(-n // 8)
                bitmap = np.frombuffer(data, np.uint8, size, at)
                at += -(-size // 8) * 8
                size = 4 * -(-n // BLOCK)
                ranks = np.frombuffer(data, "<u4", size // 4, at)
                at += -(-size // 8) * 8
            self.levels.append((n, width, chunks, bitmap, ranks))

    @staticmethod
    def _chunk(chunks: np.ndarray, width: int, i: int) -> int:
        bit = i * width
        return int.from_bytes(chunks[bit >> 3 : (bit + width + 7) >> 3].tobytes(), "little") >> (bit & 7) & ((1 << width) - 1)

    def token(self, i: int) -> int:
        """The i-th token of the file, from one chunk and rank a level."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        code = shift = 0
        for _, width, chunks, bitmap, ranks in self.levels:
            code |= self._chunk(chunks, width, i) << shift
            shift += width
            if bitmap is None or not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            ahead = np.unpackbits(bitmap[block * BLOCK // 8 : (i >> 3) + 1], bitorder="little")[: i - block * BLOCK]
            i = int(ranks[block]) + int(ahead.sum())
        return int(self.alphabet[code])

    def tokens(self) -> np.ndarray:
        """All tokens of the file, level by level."""
        codes = np.zeros(self.n_tokens, np.uint32)
        where, shift = None, 0
        for n, width, chunks, bitmap, _ in self.levels:
            if width == 8:
                values = chunks[:n].astype(np.uint32)
            else:
                values = np.zeros(n, np.uint32)
                bits = np.unpackbits(chunks, bitorder="little")[: n * width].reshape(n, width)
                for b in range(width):
                    values |= bits[:, b].astype(np.uint32) << np.uint32(b)
            values <<= np.uint32(shift)
            if where is None:
                codes |= values
                where = np.arange(n)
            else:
                codes[where] |= values
            shift += width
            if bitmap is not None:
                where = where[np.unpackbits(bitmap, bitorder="little")[:n].astype(bool)]
        return self.alphabet[codes] if self.n_tokens else np.zeros(0, np.uint32)


class Encoder(dict):
    """Words to their token ids as bytes, found out when they are first asked for.

    A word that is letters and one mark at most is cut there, as the tokenizer's pattern cuts it, if its letters
    stay letters in the normaliser (some become a letter and a combining mark, which goes with the mark), and lower
    ASCII letters, which the normaliser leaves alone, go straight to its merges. Two generations of at most
    ``room`` words are kept.
    """

    def __init__(self, path: str, room: int = 500_000):
        super().__init__({"": b""})
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.room = Tokenizer.from_file(path), room
        self.merges = self.tokenizer.model.tokenize
        self.old: dict[str, bytes] = {}
        self.marks = {m: self._whole(m) for m in ".,"}

    def _whole(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            mark = self.marks.get(word[-1], b"")
            core = word[:-1] if mark else word
            if not core.isalpha():
                ids = self._whole(word)
            elif not core.isascii():
                ids = self[core] + mark if mark and unicodedata.normalize("NFC", core).lower().isalpha() else self._whole(word)
            elif (low := core.lower()) != word:
                ids = self[low] + mark
            else:
                ids = array("I", [t.id for t in self.merges(low)]).tobytes()
        self[word] = ids
        return ids

    def encode(self, text: str, tail: bytes = b"") -> bytes:
        if len(self) > self.room:
            self.old = dict(self)
            self.clear()
            self[""] = b""
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" "))) + tail


#: Of a worker process, which runs many tasks.
_ENCODERS: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_file(folder: str, name: str, data: bytes) -> None:
    """Under a temporary name first: readers see whole files only, and a task run again replaces its own."""
    from pyarrow import fs

    # Spark's names of S3 are Arrow's by another scheme.
    folder = re.sub("^s3[an]:", "s3:", folder)
    system, path = fs.FileSystem.from_uri(folder if "://" in folder else folder.removeprefix("file:"))
    system.create_dir(path, recursive=True)
    draft = f"{path}/_{name}.{os.getpid()}.{os.urandom(4).hex()}"
    with system.open_output_stream(draft) as out:
        out.write(data)
    system.move(draft, f"{path}/{name}")


def write(docs: DataFrame, folder: str, tokenizer: str, end: int | None = END, range_bytes: int = 24 << 20, file_tokens: int = 2 << 20) -> int:
    """Write all ``docs`` to ``folder`` in ascending doc_id order: file r-k holds the k-th part of the r-th range of ids.

    Returns the number of ranges, which _ranges.MOST_RANGES bounds.
    """
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_shared.LOWEST)).alias("id_key"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumn("text_key", F.xxhash64("text")).withColumn("size", (F.octet_length("text") + 8).cast("long"))
    index = _shared.written(keyed.select("id_key", "text_key", "size"), "token-index")
    total = index.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    keys = ["id_key", "text_key"]
    boundaries = _ranges.splitters(index, keys, "size", max(1, -(-total // range_bytes)))
    placed = _ranges.assigned(keyed, keys, boundaries)

    def run(batches):
        encoder = encoder_for(tokenizer)
        current, number, ids, parts, held = None, 0, [], [], 0

        def flush():
            ends = np.cumsum([len(p) // 4 for p in parts])
            write_file(folder, f"ids-{current:06d}-{number:06d}.dac", encode(np.array(ids, np.int64), np.r_[0, ends], np.frombuffer(b"".join(parts), "<u4")))

        tail = b"" if end is None else np.array([end], "<u4").tobytes()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                for r, d, text in zip(*(batch.slice(i, 256).column(k).to_pylist() for k in range(3)), strict=True):
                    if ids and (r != current or held >= 4 * file_tokens):
                        flush()
                        number, ids, parts, held = number + 1, [], [], 0
                    if r != current:
                        current, number = r, 0
                    ids.append(d)
                    parts.append(encoder.encode(text, tail))
                    held += len(parts[-1])
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["rows"])
        if ids:
            flush()
        _words.release()

    n_parts = len(boundaries) + 1
    # A task for each range: hashed ids would put several into some tasks and none into others.
    done = placed.select("range_id", "id_key", "text", "text_key").repartitionById(n_parts, "range_id").sortWithinPartitions("range_id", "id_key", "text_key").select("range_id", "id_key", "text").mapInArrow(run, "rows long")
    done.agg(F.sum("rows")).collect()
    return n_parts


DOCUMENTS = "range_id int, file int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each document in the files: its range, file, id, start in the file, length and CRC."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                path = batch.column(0)[i].as_py()
                reader = Reader(memoryview(batch.column(1)[i].as_buffer()))
                tokens = reader.tokens().astype("<u4")
                crcs = [zlib.crc32(tokens[a:b]) for a, b in zip(reader.offsets[:-1].tolist(), reader.offsets[1:].tolist(), strict=True)]
                place = [np.full(len(crcs), int(x), np.int32) for x in path.rsplit("/", 1)[1].split(".")[0].split("-")[1:]]
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, place), pa.array(reader.doc_ids), pa.array(reader.offsets[:-1]), pa.array(np.diff(reader.offsets)), pa.array(crcs, pa.int64())],
                    names=["range_id", "file", "doc_id", "local_start", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "ids-*.dac").load(folder).select("path", "content")
    return files.mapInArrow(run, DOCUMENTS)


def round_trip(docs: DataFrame, tokenizer: str, range_bytes: int = 24 << 20, file_tokens: int = 2 << 20) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, all from files that were written and read back."""
    spark = docs.sparkSession
    folder = _shared.new_path(spark, "token-files")
    if docs.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    write(docs, folder, tokenizer, range_bytes=range_bytes, file_tokens=file_tokens)
    found = _shared.written(read(spark, folder), "token-documents")
    # Starts of the files inside their range on the executors, those of the ranges (_ranges.MOST_RANGES rows) on the driver.
    files = found.groupBy("range_id", "file").agg(F.sum("n_tokens").alias("n"))
    running = Window.partitionBy("range_id").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = _shared.written(files.withColumn("inside", F.coalesce(F.sum("n").over(running), F.lit(0))), "token-sums")
    sizes = files.groupBy("range_id").agg(F.sum("n").alias("n")).toPandas().sort_values("range_id", ignore_index=True)
    ahead = spark.createDataFrame([(int(r), int(a)) for r, a in zip(sizes["range_id"], sizes["n"].cumsum() - sizes["n"], strict=True)], "range_id int, ahead long")
    starts = files.join(F.broadcast(ahead), "range_id").select("range_id", "file", (F.col("ahead") + F.col("inside")).alias("ahead"))
    out = _shared.joined(found, starts, ["range_id", "file"], name="token-starts")
    return out.select(F.nullif("doc_id", F.lit(_shared.LOWEST)).alias("doc_id"), (F.col("ahead") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(_shared.documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))
