"""Operator 11, conversation structure repair on a DAG of edits.

A conversation should read ``(s?(ua)+)?`` by its roles' initials. Its nodes are (rows passed, state of that pattern), its arcs the
edits: Keep, Rerole, Delete a row, Insert a message. Minimum costs to every node from the start and from it to the
end show which arcs are tight (on some cheapest way); a traversal starts with the set of the start alone and follows,
of all tight arcs that leave its nodes, those with the ASCII-least letter, so it spells the least of all cheapest audits.

Rows are dealt by sampled ranges of (conversation, turn), so a conversation of any length is spread over tasks. It is cut into
segments of ``SEGMENT`` rows at most, of which a few bytes a row are kept. A segment that is a whole conversation
is settled at once. The others send a 4 x 4 matrix of least costs from any state to any state; matrices of a
conversation, one a segment, give the costs at its borders; each segment is then traversed from every state that a
cheapest way may enter it by, and the way through is put together from (state in, state out). Texts move only to be
written in their new order.

Results of ``Repair``: ``segments`` (audit letters and counts), ``messages`` (the repaired conversations, in order of
seq and pos) and ``audits`` (one row a conversation). SHA-256 of a conversation, which the query adds, reads its messages one after the other in one
task without holding them, as such a hash must.

A null role or text counts as one space, so it is no pattern's role or blank. A null conv_id is a conversation of its
own, a null turn comes first and takes no part in gaps. Rows of one turn go by a hash of role and text, equal ones are
duplicates (told by 128 bits). Conversations of which nothing is left have zeros, an empty audit and no messages. An empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import _shared

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: By state (start, after s, after u, after a) and kind of role (other, s, u, a) the next state.
NEXT = ((None, 1, 2, None), (None, None, 2, None), (None, None, None, 3), (None, None, 2, None))
ACCEPT = (0, 3)
STATES = range(4)
#: What a message that is inserted or given another role becomes, by the state it leads to.
ROLE = {2: "user", 3: "assistant"}
LEGAL = {(1, 2), (2, 3), (3, 2)}
SPACE = " \t\n\x0b\x0c\r"
FAR = 1 << 60
SEGMENT = 1 << 16

#: A row as one number: kind of role, + 4 if truncated, + 8 if it must be deleted.
INSERTS = [[(INSERT, r) for k in (2, 3) if (r := NEXT[q][k]) is not None] for q in STATES]


def _arcs(code: int) -> list[list[tuple[str, int, int]]]:
    """By state (letter, cost, next state) of a row's edits."""
    extra = TRUNCATED if code & 4 else 0
    out = []
    for q in STATES:
        arcs = [("D", DELETE, q)]
        if not code & 8:
            if NEXT[q][code & 3] is not None:
                arcs.append(("K", KEEP + extra, NEXT[q][code & 3]))
            arcs += [("R", REROLE + extra, NEXT[q][k]) for k in (2, 3) if NEXT[q][k] is not None]
        out.append(arcs)
    return out


ARCS = [_arcs(code) for code in range(16)]


def _after_inserts(costs: list[int]) -> list[int]:
    """Costs to states, with inserts on the way."""
    costs = list(costs)
    for _ in STATES:
        for q in STATES:
            for w, r in INSERTS[q]:
                costs[r] = min(costs[r], costs[q] + w)
    return costs


def _before_inserts(costs: list[int]) -> list[int]:
    """Costs from states, with inserts on the way."""
    costs = list(costs)
    for _ in STATES:
        for q in STATES:
            for w, r in INSERTS[q]:
                costs[q] = min(costs[q], w + costs[r])
    return costs


#: From each state to the end of a conversation whose rows are all passed.
END = _before_inserts([0 if q in ACCEPT else FAR for q in STATES])


def forward(codes: bytes, start: list[int], last: bool) -> list[list[int]]:
    """Least costs to the nodes ahead of and behind each row; those behind the last without inserts, unless nothing follows."""
    found = [_after_inserts(start) if codes or last else list(start)]
    for i, code in enumerate(codes):
        costs = [FAR] * 4
        for q, arcs in enumerate(ARCS[code]):
            for _, w, r in arcs:
                costs[r] = min(costs[r], found[-1][q] + w)
        found.append(_after_inserts(costs) if last or i + 1 < len(codes) else costs)
    return found


def backward(codes: bytes, end: list[int]) -> list[list[int]]:
    """Least costs from the nodes to the end, ``end`` being those behind the last row."""
    found = [list(end)]
    for code in reversed(codes):
        ahead = found[-1]
        found.append(_before_inserts([min(w + ahead[r] for _, w, r in arcs) for arcs in ARCS[code]]))
    return found[::-1]


def traversed(codes: bytes, to: list[list[int]], rest: list[list[int]], least: int, state: int, last: bool) -> tuple[str, int]:
    """The least letters over tight arcs from ``state``, and the state they end in."""
    letters, i, front = [], 0, {state}
    while True:
        if i == len(codes) and (not last or any(q in ACCEPT and to[i][q] == least for q in front)):
            return "".join(letters), min(front)
        steps: dict[str, set[int]] = {}
        for q in front:
            for w, r in INSERTS[q]:
                if to[i][q] + w + rest[i][r] == least:
                    steps.setdefault("I", set()).add(r)
            for letter, w, r in ARCS[codes[i]][q] if i < len(codes) else ():
                if to[i][q] + w + rest[i + 1][r] == least:
                    steps.setdefault(letter, set()).add(r)
        letter = min(steps)
        letters.append(letter)
        front = steps[letter]
        i += letter != "I"


def _solved(codes: bytes) -> tuple[int, str]:
    to, rest = forward(codes, [0, FAR, FAR, FAR], True), backward(codes, END)
    return rest[0][0], traversed(codes, to, rest, rest[0][0], 0, True)[0]


_solved_short = lru_cache(1 << 16)(_solved)


def solved(codes: bytes) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    return _solved_short(codes) if len(codes) <= 32 else _solved(codes)


def transfer(codes: bytes) -> list[int]:
    """Least costs from each state ahead of the rows to each behind them (without inserts there), row by row of the matrix."""
    return [min(w, FAR) for q in STATES for w in forward(codes, [0 if p == q else FAR for p in STATES], False)[-1]]


def edited(codes: bytes, letters: str, state: int = 0):
    """(place in the segment or None, new role or None) of each message that stays or comes."""
    i = 0
    for letter in letters:
        if letter != "D":
            # Kept rows follow the pattern, so a step's next state is the only one its role can lead to.
            state = NEXT[state][codes[i] & 3] if letter == "K" else next(NEXT[state][k] for k in (2, 3) if NEXT[state][k] is not None)
            yield (None if letter == "I" else i), (None if letter == "K" else ROLE[state])
        i += letter != "I"


def kind_of_role(role: Column) -> Column:
    initial = F.substring(role, 1, 1)
    return F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)


def judged(rows: DataFrame) -> DataFrame:
    """Written rows (conv_id, turn, role, text) with keys, code and first fault of each."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    plain = rows.select(F.col("conv_id").isNotNull().alias("named"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    body = F.rtrim(F.col("text"), F.lit(SPACE))
    marked = plain.withColumns({
        "row": F.monotonically_increasing_id(), "h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(11), "text", "role"),
        "kind": kind_of_role(F.col("role")), "blank": body == "", "truncated": ~F.right(body, F.lit(1)).isin(".", "!", "?"),
    })
    table = _shared.written(marked, "conversation-rows")
    same = ["named", "conv", "h1", "h2"]
    # Nulls are the least of a struct's fields, so the first of equal rows is the one by turn, nulls first.
    again = table.groupBy(*same).agg(F.count("*").alias("times"), F.min(F.struct("turn", "row"))["row"].alias("first")).where("times > 1").drop("times")
    thin = _shared.joined(table.drop("role", "text"), again, same, "left", "conversation-repeats")
    fault = F.when(F.col("blank"), 1).when(F.col("first") != F.col("row"), 2).when(F.col("truncated"), 3).otherwise(0)
    code = F.col("kind") + F.when(fault == 3, 4).when(fault == 0, 0).otherwise(8)
    return table, thin.select("named", "conv", "turn", "h1", "h2", "row", code.cast("int").alias("code"), fault.cast("int").alias("fault"))


SEGMENTS = (
    "named boolean, conv long, seq long, whole boolean, codes binary, rows binary, blank long, duplicate long, truncated long, illegal long, "
    "low_turn long, high_turn long, turns long, first_turn long, last_turn long, first_kind int, last_kind int, cost long, letters string, matrix array<long>"
)


def cut(thin: DataFrame, segment: int) -> DataFrame:
    """Segments of the rows in order; whole conversations inside a task are settled."""
    keys = ["named", "conv", F.col("turn").asc_nulls_first(), "h1", "h2", "row"]
    ordered = thin.repartitionByRange(*keys).sortWithinPartitions(*keys)

    def run(batches):
        from pyspark import TaskContext

        seq = TaskContext.get().partitionId() << 33
        held: list[tuple] = []  # (turn, code, fault, row) arrays of the conversation at hand
        key, size, opened = None, 0, False

        def closed(whole: bool):
            nonlocal seq, held, size
            turn, code, fault, row = (np.concatenate(c) for c in zip(*held, strict=True))
            codes, kinds = code.astype(np.uint8).tobytes(), code & 3
            known = turn[~np.isnan(turn.astype(float))] if turn.dtype == object else turn
            known = known.astype(np.int64)
            cost, letters = solved(codes) if whole else (None, None)
            out = (
                key[0], key[1], seq, whole, codes, row.astype(np.int64).tobytes(), *(int((fault == k).sum()) for k in (1, 2, 3)), sum(p not in LEGAL for p in zip(kinds[:-1].tolist(), kinds[1:].tolist(), strict=True)),
                int(known[0]) if len(known) else None, int(known[-1]) if len(known) else None, int((np.diff(known) != 0).sum()) + 1 if len(known) else 0,
                None if turn[0] is None else int(turn[0]), None if turn[-1] is None else int(turn[-1]), int(kinds[0]), int(kinds[-1]), cost, letters, None if whole else transfer(codes),
            )
            seq, held, size = seq + 1, [], 0
            return out

        done: list[tuple] = []

        def batch_of(rows: list[tuple]):
            kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), *[pa.int64()] * 9, pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in SEGMENTS.split(", ")])

        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            named, conv = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("named", "conv"))
            turn = np.array(batch.column("turn").to_pylist(), object)
            code, fault, row = (batch.column(c).to_numpy() for c in ("code", "fault", "row"))
            edges = [0, *(np.flatnonzero((conv[1:] != conv[:-1]) | (named[1:] != named[:-1])) + 1).tolist(), len(conv)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                here = (bool(named[a]), int(conv[a]))
                if here != key:
                    if held:
                        # A conversation at the border of a task may go on in its neighbour.
                        done.append(closed(not first and not opened))
                        first = False
                    elif key is not None:
                        first = False
                    key, opened = here, False
                while a < b:
                    n = min(b - a, segment - size)
                    held.append((turn[a : a + n], code[a : a + n], fault[a : a + n], row[a : a + n]))
                    size, a = size + n, a + n
                    if size >= segment:
                        done.append(closed(False))
                        opened = True
            if sum(len(d[4]) for d in done) > 1 << 18 or len(done) > 2000:
                yield batch_of(done)
                done = []
        if held:
            done.append(closed(False))
        if done:
            yield batch_of(done)

    return ordered.mapInArrow(run, SEGMENTS)


def _times(costs: list[int], matrix: list[int]) -> list[int]:
    return [min(FAR, *(costs[q] + matrix[4 * q + r] for q in STATES)) for r in STATES]


def _borders(parts: pd.DataFrame) -> pd.DataFrame:
    """Costs at the borders of a conversation's segments, and what adds up across them."""
    parts = parts.sort_values("seq", ignore_index=True)
    matrices = [list(m) for m in parts["matrix"]]
    to, rest = [[0, FAR, FAR, FAR]], [END]
    for m in matrices[:-1]:
        to.append(_times(to[-1], m))
    for m in reversed(matrices):
        rest.append([min(FAR, *(m[4 * q + r] + rest[-1][r] for r in STATES)) for q in STATES])
    # Behind the last segment inserts may follow, which END holds.
    rest = rest[::-1]
    last_kind, last_turn = parts["last_kind"].shift(), parts["last_turn"].shift()
    illegal = [int(i > 0 and (int(a), int(b)) not in LEGAL) for i, (a, b) in enumerate(zip(last_kind.fillna(0), parts["first_kind"], strict=True))]
    again = [int(a == b) for a, b in zip(last_turn, parts["first_turn"], strict=True)]
    n = len(parts)
    return pd.DataFrame({"seq": parts["seq"], "to": to, "rest": rest[1:], "least": [rest[0][0]] * n, "last": [i == n - 1 for i in range(n)], "more_illegal": illegal, "turns_again": again})


def _ways(batches):
    """Each segment traversed from all states that a cheapest way may enter it by."""
    for batch in batches:
        out = {"seq": [], "came": [], "went": [], "way": []}
        for seq, codes, to, rest, least, last in zip(*(batch.column(c).to_pylist() for c in ("seq", "codes", "to", "rest", "least", "last")), strict=True):
            f, b = forward(codes, to, last), backward(codes, rest)
            for q in STATES:
                if to[q] + b[0][q] == least:
                    letters, went = traversed(codes, f, b, least, q, last)
                    for name, value in zip(out, (seq, q, went, letters), strict=True):
                        out[name].append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out["seq"], pa.int64()), pa.array(out["came"], pa.int32()), pa.array(out["went"], pa.int32()), pa.array(out["way"], pa.string())], names=list(out))


def _chained(ways: pd.DataFrame) -> pd.DataFrame:
    """The state by which each segment of a conversation is entered, from the start on."""
    state, out = 0, []
    went = {(s, c): w for s, c, w in zip(ways["seq"], ways["came"], ways["went"], strict=True)}
    for seq in sorted(set(ways["seq"])):
        out.append((seq, state))
        state = went[seq, state]
    return pd.DataFrame(out, columns=["seq", "came"])


class Repair:
    """Repaired conversations of a table with conv_id, turn, role and text."""

    def __init__(self, conversations: DataFrame, segment: int = SEGMENT):
        self.table, thin = judged(conversations)
        found = _shared.written(cut(thin, segment), "conversation-segments")
        settled = found.where("whole").drop("matrix").withColumns({"came": F.lit(0), "more_illegal": F.lit(0), "turns_again": F.lit(0)})
        parts, keys = found.where("NOT whole").drop("cost", "letters"), ["named", "conv"]
        borders = "seq long, to array<long>, rest array<long>, least long, last boolean, more_illegal int, turns_again int"
        # A row of some 200 bytes for each segment of a conversation, so a group holds one for every 65,536 rows of it.
        small = parts.select(*keys, "seq", "matrix", "first_kind", "last_kind", "first_turn", "last_turn")
        edges = _shared.written(small.groupBy(*keys).applyInPandas(_borders, borders), "conversation-borders")
        ways = parts.select(*keys, "seq", "codes").join(edges, "seq")
        ways = _shared.written(ways.select(*keys, "seq", "codes", "to", "rest", "least", "last").mapInArrow(_ways, "seq long, came int, went int, way string").join(parts.select(*keys, "seq"), "seq"), "conversation-ways")
        chain = ways.select(*keys, "seq", "came", "went").groupBy(*keys).applyInPandas(_chained, "seq long, came int")
        chosen = ways.select("seq", "came", "way").join(chain, ["seq", "came"])
        joined = parts.drop("matrix").join(edges.select("seq", F.col("least").alias("cost"), "more_illegal", "turns_again"), "seq").join(chosen.withColumnRenamed("way", "letters"), "seq")
        self.segments = _shared.written(settled.unionByName(joined), "conversation-repairs")

    def audits(self) -> DataFrame:
        """named, conv, gaps, faults, illegal, cost and audit of each conversation with rows."""
        letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "letters"))), lambda s: s["letters"]), "")
        turns = F.sum("turns") - F.sum("turns_again")
        return self.segments.groupBy("named", "conv").agg(
            F.coalesce(F.max("high_turn") - F.min("low_turn") + 1 - turns, F.lit(0)).alias("gaps"), F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"), F.sum("truncated").alias("truncated"),
            F.sum(F.col("illegal") + F.col("more_illegal")).alias("illegal"), F.max("cost").alias("cost"), letters.alias("audit"),
        )

    def messages(self) -> DataFrame:
        """named, conv, seq, pos, role, text: the repaired conversations, in the order of seq and pos."""

        def run(batches):
            for batch in batches:
                for r in range(batch.num_rows):
                    named, conv, seq, codes, rows, letters, came = (c[r].as_py() for c in batch.columns)
                    numbers = np.frombuffer(rows, np.int64)
                    stays = list(edited(codes, letters, came))
                    n = len(stays)
                    row = [None if i is None else int(numbers[i]) for i, _ in stays]
                    yield pa.RecordBatch.from_arrays([pa.array([named] * n, pa.bool_()), pa.array([conv] * n, pa.int64()), pa.array([seq] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(row, pa.int64()), pa.array([role for _, role in stays], pa.string())], names=["named", "conv", "seq", "pos", "row", "new_role"])

        edits = self.segments.select("named", "conv", "seq", "codes", "rows", "letters", "came").mapInArrow(run, "named boolean, conv long, seq long, pos int, row long, new_role string")
        edits = _shared.written(edits, "conversation-edits")
        place = ["named", "conv", "seq", "pos"]
        stay = edits.where("row IS NOT NULL").join(self.table.select("row", "role", "text"), "row").select(*place, F.coalesce("new_role", "role").alias("role"), "text")
        return stay.unionByName(edits.where("row IS NULL").select(*place, F.col("new_role").alias("role"), F.lit("").alias("text")))


def hashed(messages: DataFrame) -> DataFrame:
    """named, conv, repaired_sha256 over ``role:text``, joined by line ends; one message at a time is held."""

    def run(batches):
        key, state = None, None
        out: list[tuple] = []

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array([o[0][0] for o in out], pa.bool_()), pa.array([o[0][1] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string())], names=["named", "conv", "repaired_sha256"])

        for batch in batches:
            for named, conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (named, conv):
                    if key:
                        out.append((key, state.hexdigest()))
                    key, state = (named, conv), hashlib.sha256(f"{role}:{text}".encode())
                else:
                    state.update(f"\n{role}:{text}".encode())
            if len(out) > 5000:
                yield batch_of()
                out = []
        if key:
            out.append((key, state.hexdigest()))
        if out:
            yield batch_of()

    ordered = messages.repartition("named", "conv").sortWithinPartitions("named", "conv", "seq", "pos")
    return ordered.select("named", "conv", "role", "text").mapInArrow(run, "named boolean, conv long, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's faults, by a checksum of conversation and turn."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("long").cast("string"), F.lit(" ")))
    rows = conversations.select("conv_id", "turn", "role", "text", (F.crc32(F.encode(key, "UTF-8")) % 20).alias("fate")).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("time")).drop("time")


EMPTY = hashlib.sha256(b"").hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return report(conversations, Repair(damaged(conversations)))


def report(conversations: DataFrame, repair: Repair) -> DataFrame:
    """The contract's row for every conv_id of the table."""
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    every = every.select("conv_id", F.col("conv_id").isNotNull().alias("named"), F.coalesce("conv_id", F.lit(0)).alias("conv"))
    found = every.join(repair.audits(), ["named", "conv"], "left").join(hashed(repair.messages()), ["named", "conv"], "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return found.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY)).alias("repaired_sha256"))


#: Row by row the cheapest, then least, audit of every state; crc32 bit by bit, as DuckDB has none.
ORACLE = r"""
WITH RECURSIVE keyed AS (
  SELECT coalesce(conv_id::VARCHAR, '') AS conv, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS letters
  FROM conversations
), fated AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(letters, lambda c: unicode(c)::BIGINT)),
    lambda x, b: list_reduce(list_prepend(xor(x, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 20 AS fate
  FROM keyed
), hurt AS (
  SELECT conv, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS time
  FROM fated WHERE fate <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, time) AS i, left(role, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM hurt
), judged AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv ORDER BY i) || initial AS pair
  FROM placed
), counted AS (
  SELECT conv, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv
), inserts(q, q2, w, ls) AS (
  VALUES (0, 0, 0, ''), (0, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 1, 0, ''), (1, 2, 3, 'I'), (1, 3, 6, 'II'), (2, 2, 0, ''), (2, 3, 3, 'I'), (3, 3, 0, ''), (3, 2, 3, 'I')
), follows(q, initial, q2) AS (
  VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), arcs AS (
  SELECT q, q2, 0 AS w, 'K' AS l, initial FROM follows UNION ALL SELECT q, q2, 3, 'R', NULL FROM follows WHERE initial <> 's' UNION ALL SELECT q, q, 4, 'D', NULL FROM (VALUES (0), (1), (2), (3)) t(q)
), dp AS (
  SELECT conv, 0::BIGINT AS i, 0 AS q, '000000000' AS best FROM counted
  UNION ALL
  SELECT d.conv, d.i + 1, a.q2, min(lpad((d.best[1:9]::BIGINT + n.w + a.w + CASE WHEN a.l <> 'D' AND r.fault = 'truncated' THEN 3 ELSE 0 END)::VARCHAR, 9, '0') || d.best[10:] || n.ls || a.l)
  FROM dp d JOIN inserts n ON n.q = d.q JOIN judged r ON r.conv = d.conv AND r.i = d.i + 1
  JOIN arcs a ON a.q = n.q2 AND (a.l = 'D' OR (r.fault NOT IN ('blank', 'duplicate') AND (a.l = 'R' OR a.initial = r.initial)))
  GROUP BY d.conv, d.i + 1, a.q2
), ended AS (
  SELECT d.conv, min(lpad((d.best[1:9]::BIGINT + n.w)::VARCHAR, 9, '0') || d.best[10:] || n.ls) AS best
  FROM dp d JOIN counted c ON c.conv = d.conv AND c.n = d.i JOIN inserts n ON n.q = d.q WHERE n.q2 IN (0, 3) GROUP BY d.conv
), lettered AS (
  SELECT conv, l, p, sum((l <> 'I')::INTEGER) OVER w AS i, sum((l <> 'D')::INTEGER) OVER w AS out
  FROM (SELECT conv, unnest(string_split(best[10:], '')) AS l, unnest(range(1, len(best) - 8)) AS p FROM ended WHERE len(best) > 9)
  WINDOW w AS (PARTITION BY conv ORDER BY p)
), kept AS (
  SELECT e.conv, e.l, e.out, r.role, CASE WHEN e.l = 'I' THEN '' ELSE r.text END AS text, max((e.out = 1 AND e.l = 'K' AND r.initial = 's')::INTEGER) OVER (PARTITION BY e.conv) AS lead
  FROM lettered e LEFT JOIN judged r ON r.conv = e.conv AND r.i = e.i WHERE e.l <> 'D'
), said AS (
  SELECT conv, sha256(string_agg(CASE WHEN l = 'K' THEN role WHEN (out - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY out)) AS hash FROM kept GROUP BY conv
)
SELECT k.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best[1:9]::BIGINT, 0) AS cost, coalesce(best[10:], '') AS audit, coalesce(hash, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv, conv_id FROM keyed) k LEFT JOIN counted USING (conv) LEFT JOIN ended USING (conv) LEFT JOIN said USING (conv)
"""
