"""Operator 11 against a plain search over all edits."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lodestone.llm import conversations as c

LAYOUT = "conv_id long, turn long, role string, text string, seq string, row long, code string"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def table(seed=1):
    r = random.Random(seed)
    texts = [None, "", " \n\t", "Yes.", "No!", "why?", "cut off", "Ends. ", "x" * 30_000 + ".", "\x0b\x0c.", "a.\x85", "é"]
    rows = []
    for conv in [*range(40), None, -5]:
        for turn in range(r.randint(1, 9)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]) if turn % 3 else r.choice(["system", "user"])
            rows.append((conv, r.choice([turn, turn, turn * 2, None]), role, r.choice(texts), "x", 1, "y"))
    rows += [(99, 7, "user", "Same.", None, None, None)] * 30
    rows += [(77, t, ["user", "assistant", "tool"][t % 3], r.choice(texts[3:8]), None, None, None) for t in range(400)]
    return rows


@pytest.fixture(scope="module")
def talks(spark):
    return spark.createDataFrame(table(), LAYOUT).repartition(5).cache()


def cheapest(codes):
    """(cost, audit) by all audits of every state, of which the cheapest, then least, stays: no costs to the end are used."""
    pattern = re.compile(r"(s?(ua)+)?")
    found = {"": (0, "")}  # what has been said, shortened to the part that decides -> cost and audit

    def state(said):
        return said if len(said) < 2 else said[-1] if said[-1] == "u" else "ua"

    def inserted(now):
        for _ in range(4):
            for said, (cost, audit) in list(now.items()):
                for x in "ua":
                    if re.fullmatch(r"s?(ua)*u?", said + x):
                        key, new = state(said + x), (cost + 3, audit + "I")
                        now[key] = min(now.get(key, new), new)
        return now

    for initial, truncated, must in codes:
        new = {}
        for said, (cost, audit) in inserted(dict(found)).items():
            steps = [(said, 4, "D")]
            if not must:
                steps += [(state(said + x), (0 if x == initial else 3) + (3 if truncated else 0), "K" if x == initial else "R") for x in {"u", "a", initial} if x and re.fullmatch(r"s?(ua)*u?", said + x) and (x == initial or x != "s")]
            for key, w, letter in steps:
                value = (cost + w, audit + letter)
                new[key] = min(new.get(key, value), value)
        found = new
    return min(v for said, v in inserted(dict(found)).items() if said in ("", "ua") and pattern.fullmatch(said))


def expected(rows, damage):
    by = {}
    for conv, turn, role, text, *_ in rows:
        by.setdefault(conv, [])
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 and text is not None else text
            by[conv] += [(turn, "user" if fate == 4 else " " if role is None else role, " " if text is None else text)] * (2 if fate == 3 else 1)
    return by


def summary(rows):
    """The contract's columns of rows in order."""
    counts, seen, codes = dict(blank=0, duplicate=0, truncated=0), set(), []
    for _, role, text in rows:
        marks = BLANK.findall(text)
        fault = "blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        codes.append((role[:1] if role[:1] in "sua" else "", fault == "truncated", fault in ("blank", "duplicate")))
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    cost, audit = cheapest(codes)
    said, i, lead = [], 0, 0
    for letter in audit:
        role, text = rows[i][1:] if letter != "I" else (None, "")
        if letter != "D":
            lead += not said and letter == "K" and role[:1] == "s"
            said.append((role if letter == "K" else ["user", "assistant"][(len(said) - lead) % 2], text))
        i += letter != "I"
    assert re.fullmatch(r"(s?(ua)+)?", "".join(r[0] for r, _ in said))
    digest = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in said).encode()).hexdigest()
    return gaps, *counts.values(), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest


@pytest.mark.parametrize("segment", [1, 3, 1 << 16])
def test_whole_table(spark, talks, same, segment):
    repair = c.Repair(c.damaged(talks), segment)
    order = {(r.conv, r.named): [] for r in repair.table.select("conv", "named").distinct().collect()}
    rank = {}
    for r in repair.table.select("role", "text", "h1", "h2").distinct().collect():
        rank[r.role, r.text] = (r.h1, r.h2)
    wanted = []
    for conv, rows in expected(table(), True).items():
        rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, *rank[x[1], x[2]]))
        wanted.append((conv, *summary(rows)))
    assert len(order) <= len(wanted)
    same(c.report(talks, repair), wanted)


def test_costs_and_letters_of_all_short_conversations():
    r = random.Random(4)
    names = {0: "", 1: "s", 2: "u", 3: "a"}
    for _ in range(3000):
        codes = bytes(r.choice([0, 1, 2, 3, 5, 6, 7, 8, 10]) for _ in range(r.randint(0, 8)))
        assert c.solved(codes) == cheapest([(names[x & 3], bool(x & 4), bool(x & 8)) for x in codes]), codes


def test_an_exhaustive_search_agrees():
    """Every audit of up to three rows and three inserts, spelt out."""
    names = "?sua"

    def search(codes, said, cost, audit, inserts):
        if not codes and re.fullmatch(r"(s?(ua)+)?", said):
            yield cost, audit
        if inserts:
            for x in "ua":
                yield from search(codes, said + x, cost + 3, audit + "I", inserts - 1)
        if codes:
            extra = 3 if codes[0] & 4 else 0
            yield from search(codes[1:], said, cost + 4, audit + "D", inserts)
            if not codes[0] & 8:
                yield from search(codes[1:], said + names[codes[0] & 3], cost + extra, audit + "K", inserts)
                for x in "ua":
                    yield from search(codes[1:], said + x, cost + 3 + extra, audit + "R", inserts)

    kinds = [0, 1, 2, 3, 6, 8]
    for codes in [(), *[(a,) for a in kinds], *[(a, b) for a in kinds for b in kinds], *[(a, b, d) for a in kinds for b in kinds for d in kinds]]:
        assert c.solved(bytes(codes)) == min(search(codes, "", 0, "", 3)), codes


def test_nothing_and_all_rows_dropped(spark, talks):
    nothing = spark.createDataFrame([], LAYOUT)
    assert c.report(nothing, c.Repair(c.damaged(nothing))).collect() == []
    gone = c.report(talks, c.Repair(talks.where(F.lit(False)))).collect()
    assert len(gone) == talks.select("conv_id").distinct().count()
    assert {tuple(r)[1:] for r in gone} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_messages_come_in_order_with_their_texts(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Go."), (1, 2, "user", "Go."), (1, 3, "assistant", "Done")]
    repair = c.Repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 2)
    got = [(r.role, r.text) for r in repair.messages().orderBy("seq", "pos").collect()]
    assert repair.audits().first().audit == "IKKDK" and got == [("user", ""), ("assistant", "Hi."), ("user", "Go."), ("assistant", "Done")]
