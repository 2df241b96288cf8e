"""Operator 8, quality rules by cross-document line frequency.

Each line with a word is normalised (A-Z lowered, runs of white space to one, digits alike) and hashed; a
line's frequency on a host (the ``source``) is the number of distinct documents (doc_id) there that hold it; rows
without an id are documents of their own. With ``by="text"`` it is the number of distinct texts, so that exact copies
of one document don't make its own lines boilerplate. Lines above the limit are removed, and a document that keeps
too few of its words is rejected. Base rules come first: too few words, or too many words inside repeated
5-word windows.

Nulls: a null text is empty and fails for its word count; null sources are one host; a null doc_id is kept as
such. Repeated rows are judged each. An empty table gives an empty result. Columns besides doc_id, the host and text
are not read, so their names can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import _shared, _words

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[10] = True
RUN = 5

STATS = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content long, lines array<long>, line_words array<int>"


def _per_text(owner: np.ndarray, marks: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner[marks], minlength=n).astype(np.int64)


def _copies(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: does the same hash occur earlier, and does it occur twice or more, in the same text."""
    order = np.lexsort((np.arange(len(owner)), hashes, owner))
    same = np.r_[False, (owner[order][1:] == owner[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])] if len(owner) else np.zeros(0, bool)
    earlier, twice = np.zeros(len(owner), bool), np.zeros(len(owner), bool)
    earlier[order] = same
    twice[order] = same | np.r_[same[1:], False] if len(owner) else same
    return earlier, twice


def measure(batches):
    """Base statistics of each text and its normalised lines."""
    names = ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content", "lines", "line_words"]
    for chunk in _words.chunks(batches):
        n, buffer, bounds = chunk.n, chunk.buffer, chunk.offsets
        starts, _, words, first = chunk.words(_words.SPACES, _words.LOWER_DIGITS)
        exact = _words.span_hashes(buffer, starts, _, _words.EXACT)
        owner = np.repeat(np.arange(n), np.diff(first))
        # Lines: the separator between texts is a newline too, so no line spans two texts.
        line_starts, line_ends = _words.spans(buffer, NEWLINE)
        a, b = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
        full = b > a
        line_starts, line_ends, a, b = line_starts[full], line_ends[full], a[full], b[full]
        line_owner = np.searchsorted(bounds, line_starts, "right") - 1
        raw = _words.span_hashes(buffer, line_starts, line_ends, _words.EXACT)
        dup, _ = _copies(line_owner, raw)
        # A normalised line is the sequence of its words' hashes.
        up, down = _words._Powers.to(len(words) + 1)
        running = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * up[: len(words)], out=running[1:])
        normal = _words.mix((running[b] - running[a]) * down[a] + (b - a).astype(np.uint64))
        # 5-word windows inside one text.
        wins = _words.windows(exact, RUN)
        inside = np.flatnonzero(owner[: len(wins)] == owner[RUN - 1 :]) if len(wins) else np.zeros(0, np.int64)
        _, twice = _copies(owner[inside], wins[inside])
        repeated = _words.covered(inside[twice], RUN, len(words))
        chars = ((buffer & 0xC0) != 0x80) & ~_words.SPACES[buffer]
        content = _words.span_hashes(buffer, bounds[:-1], bounds[1:], _words.EXACT)
        split = np.searchsorted(line_owner, np.arange(n + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                chunk.column("doc_id"),
                chunk.column("host"),
                *(pa.array(x, pa.int64()) for x in (np.diff(first), _words.sums_by(chars, bounds), _words.sums_by(SYMBOLS[buffer], bounds), _per_text(line_owner, dup, n), _per_text(owner, repeated, n), content.view(np.int64))),
                pa.ListArray.from_arrays(pa.array(split), pa.array(normal.view(np.int64))),
                pa.ListArray.from_arrays(pa.array(split), pa.array((b - a).astype(np.int32))),
            ],
            names=names,
        )


def judged(docs: DataFrame, host: str = "source", by: str = "document", min_docs: int = 10, max_share: float = 0.005, min_left: float = 0.3, min_words: int = 10, max_repeat: int = 20) -> DataFrame:
    """Base statistics, base_failed, n_left_words and kept for each document.

    A line is removed when more than ``min_docs`` distinct documents (or texts, by ``by``) of the host, and more than
    ``max_share`` of the host's, hold it; a document is depleted when fewer than ``min_left`` of its words stay.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), "text")
    base = source.mapInArrow(measure, STATS).withColumn("row_key", F.monotonically_increasing_id())
    # Ids and row numbers are kept apart by the sign.
    member = F.col("content") if by == "text" else F.when(F.col("doc_id").isNull(), -1 - F.col("row_key")).otherwise(F.xxhash64("doc_id").bitwiseAND((1 << 63) - 1))
    base = _shared.written(base.withColumn("member", member), "quality-base")
    hosts = base.select("host", "member").distinct().groupBy("host").agg(F.count("*").alias("host_members")).withColumn("host_key", F.xxhash64("host"))
    lines = base.select("host", "member", "row_key", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("host", "member", "row_key", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    counted = lines.select("host", "line", "member").distinct().groupBy("host", "line").agg(F.count("*").alias("n_members")).where(F.col("n_members") > min_docs)
    counted = counted.withColumn("host_key", F.xxhash64("host"))
    often = (
        _shared.joined(counted, hosts.select("host_key", F.col("host").alias("h"), "host_members"), ["host_key"], name="quality-hosts")
        .where(F.col("host").eqNullSafe(F.col("h")) & (F.col("n_members") > F.col("host_members") * max_share))
        .select(F.col("host").alias("often_host"), F.col("line").alias("often_line"), F.xxhash64("host", "line").alias("line_key"))
    )
    lines = lines.withColumn("line_key", F.xxhash64("host", "line"))
    gone = _shared.joined(lines, often, ["line_key"], name="quality-often").where((F.col("line") == F.col("often_line")) & F.col("host").eqNullSafe(F.col("often_host"))).groupBy("row_key").agg(F.sum("words").alias("gone_words"), F.count("*").alias("n_removed_lines"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("gone_words", F.lit(0))
    return (
        base.drop("lines", "line_words", "content", "member").join(gone, "row_key", "left")
        .withColumn("base_failed", failed).withColumn("n_left_words", left)
        .withColumn("kept", ~failed & (left >= min_left * F.col("n_words")))
        .withColumn("n_removed_lines", F.coalesce("n_removed_lines", F.lit(0)).cast("long"))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_lines", "n_left_words", "kept")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(_shared.documents(spark, sf_dir))


ORACLE = """
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         row_number() OVER () AS r, coalesce(doc_id::VARCHAR, 'row' || row_number() OVER ()) AS m FROM documents),
runs AS (SELECT r, i, array_to_string(w[i : i + 4], ' ') AS g FROM d, range(1, length(w) - 3) t(i) WHERE length(w) >= 5),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM runs) WHERE c >= 2),
reps AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(0, 5) t(k) GROUP BY r),
rawl AS (SELECT r, m, source, string_split(text, chr(10)) AS ls FROM d),
lines AS (SELECT r, m, source, i, ls[i] AS l, regexp_extract_all(ls[i], '[^\\x20\\x09-\\x0D]+') AS lw FROM rawl, range(1, length(ls) + 1) t(i)),
full_lines AS (SELECT *, regexp_replace(translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g') AS norm
               FROM lines WHERE length(lw) > 0),
dups AS (SELECT r, sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS n FROM (SELECT r, row_number() OVER (PARTITION BY r, l ORDER BY i) AS k FROM full_lines) GROUP BY r),
hosts AS (SELECT source, count(DISTINCT m) AS host_docs FROM d GROUP BY source),
often AS (
  SELECT f.source, f.norm FROM (SELECT source, norm, count(DISTINCT m) AS n FROM full_lines GROUP BY source, norm) f
  JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source WHERE n > 10 AND n > host_docs * 0.005),
gone AS (SELECT f.r, sum(length(f.lw)) AS words, count(*) AS n FROM full_lines f JOIN often o ON f.norm = o.norm AND f.source IS NOT DISTINCT FROM o.source GROUP BY f.r),
base AS (
  SELECT d.doc_id, length(d.w)::BIGINT AS n_words, coalesce(list_sum(list_transform(d.w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_extract_all(d.text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(u.n, 0)::BIGINT AS n_dup_lines,
         coalesce(p.n, 0)::BIGINT AS n_repeat_words, coalesce(g.n, 0)::BIGINT AS n_removed_lines,
         (length(d.w) - coalesce(g.words, 0))::BIGINT AS n_left_words
  FROM d LEFT JOIN reps p ON d.r = p.r LEFT JOIN dups u ON d.r = u.r LEFT JOIN gone g ON d.r = g.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_removed_lines, n_left_words,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_left_words >= 0.3 * n_words AS kept
FROM base
"""
