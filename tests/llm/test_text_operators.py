import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import _components, _shared, _words, decontamination, quality, similarity, substrings

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab A\n\té日-9", max_size=30), max_size=6))
def test_word_kernel(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    found, seen = [], {}
    for chunk in _words.cut(batch, limit=20):
        starts, ends, hashes, first = chunk.words(_words.SPACES, _words.EXACT)
        for k in range(chunk.n):
            own = [bytes(chunk.buffer[s:e]).decode() for s, e in zip(starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]], strict=True)]
            found.append(own)
            for w, h in zip(own, hashes[first[k] : first[k + 1]], strict=True):
                assert seen.setdefault(w, h) == h
    assert found == [SPACE.findall(t) for t in texts]
    assert len(set(map(int, seen.values()))) == len(seen)


def brute_decontamination(rows, items):
    patterns = {}
    for item, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        n = min(13, len(w))
        for i in range(len(w) - n + 1) if n else ():
            patterns.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    for d, t, *_ in rows:
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, ids = set(), set()
        for n in {len(p) for p in patterns}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in patterns:
                    hit.update(range(i, i + n))
                    ids |= patterns[tuple(w[i : i + n])]
        yield d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


def test_decontamination(spark, docs, rows, same):
    long = next(t for _, t, *_ in rows if t and len(t) > 20_000)
    items = [(1, long[1000:1200]), (2, None), (3, ""), (10, "one TWO"), (11, "é"), (11, "é"), (5, rows[15][1]), (6, "not there at all " * 5)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for block in (32 << 20, 100):
        out = decontamination.hits(docs, benchmark, block_bytes=block)
        assert set(out.columns) == {c for c in docs.columns if c != "text"} | {"n_words", "hits", "items"}
        out = out.select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("h"))
        same(out, [x[:5] for x in brute_decontamination(rows, items)])


def test_items_without_an_id_are_searched(spark, same):
    passage = " ".join(f"p{i}" for i in range(20))
    other = " ".join(f"q{i}" for i in range(20))
    docs = spark.createDataFrame([(1, passage), (2, f"{other} {passage}"), (3, "clean words"), (None, other)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(None, passage), (None, passage[:60]), (4, other)], "item_id long, text string")
    empty, four = (hashlib.sha256(x).hexdigest() for x in (b"", b"4"))
    for block in (32 << 20, 100):
        out = decontamination.hits(docs, benchmark, block_bytes=block)
        out = out.select("doc_id", F.size("hits").alias("n_hit"), F.size("items").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256))
        same(out, [(1, 20, 1, empty), (2, 40, 2, four), (3, 0, 0, empty), (None, 20, 1, four)])
    assert decontamination.judged(docs, benchmark).where("contaminated").count() == 3


def test_decontamination_of_and_by_nothing(spark, docs, nothing):
    empty = spark.createDataFrame([], "item_id long, text string")
    plain = docs.select("doc_id", "text")
    assert decontamination.judged(plain, empty).where("contaminated").count() == 0
    assert decontamination.judged(nothing.select("doc_id", "text"), empty).count() == 0


def test_shift_tables_find_every_occurrence():
    r = np.random.default_rng(0)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 3, 400)) for _ in range(3)]
    items = [(str(i), " ".join(f"w{x}" for x in r.integers(0, 3, n))) for i, n in enumerate([1, 2, 3, 5, 13, 14, 20])]
    rows = [(i, t) for i, t in enumerate(texts)]
    wanted = list(brute_decontamination(rows, items))
    tables = decontamination.patterns(items).tables
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    for chunk in _words.cut(batch):
        _, _, hashes, first = chunk.words(_words.NOT_ALNUM, _words.LOWER)
        for k in range(3):
            own = hashes[first[k] : first[k + 1]]
            hit = {j for t in tables for i, _ in decontamination.search(t, own) for j in range(i, i + t.length)}
            assert len(hit) == wanted[k][2]


def test_patterns_take_little_more_than_their_text():
    r = np.random.default_rng(1)
    text = " ".join(f"{x:x}" for x in r.integers(0, 1 << 24, 60_000))
    known = decontamination.patterns([("a", text), ("b", text[: len(text) // 2])])
    held = len(known.text) + known.starts.nbytes + sum(x.nbytes for t in known.tables for x in (t.shift, t.blocks, t.keys, t.places, t.edges, t.items))
    assert held < 20 * 1.5 * len(text)
    assert sum(len(t.items) for t in known.tables) == 60_000 - 12 + len(text[: len(text) // 2].split()) - 12


def brute_substrings(rows, length=50):
    first = {}
    words = [(d, SPACE.findall(t or "")) for d, t, *_ in rows]
    key = lambda d: -1 if d is None else d
    for d, w in words:
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            first[k] = min(first.get(k, key(d)), key(d))
    for d, w in words:
        gone = {j for i in range(len(w) - length + 1) if first[tuple(w[i : i + length])] < key(d) for j in range(i, i + length)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        yield d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()


def test_substrings(docs, rows, nothing, same):
    same(substrings.deduped(docs), list(brute_substrings(rows)))
    assert substrings.deduped(nothing).count() == 0


def test_substrings_with_many_salts(spark, same):
    rows = [(i, " ".join(["same passage of words"] * 20 + [f"u{i}-{j}" for j in range(i % 5)] + ["other common ending"] * 30)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    base, starts = substrings.removals(df, per_salt=3)
    assert base.count() == 60 and starts.count() > 0
    same(substrings.deduped(df), list(brute_substrings(rows)))


def brute_quality(rows, by="document"):
    normal = lambda line: re.sub("[0-9]", "0", " ".join(SPACE.findall(line)).translate(LOWER))
    holders, hosts = defaultdict(set), defaultdict(set)
    for k, (d, t, _, s, *_) in enumerate(rows):
        member = (t or "") if by == "text" else ("row", k) if d is None else d
        hosts[s].add(member)
        for line in (t or "").split("\n"):
            if SPACE.search(line):
                holders[s, normal(line)].add(member)
    for d, t, _, s, *_ in rows:
        t = t or ""
        w = SPACE.findall(t)
        runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        repeated = {i + k for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if SPACE.search(x)]
        gone = [x for x in lines if len(holders[s, normal(x)]) > max(10, 0.005 * len(hosts[s]))]
        left = len(w) - sum(len(SPACE.findall(x)) for x in gone)
        failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
        yield d, len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated), failed, len(gone), left, not failed and left >= 0.3 * len(w)


def test_quality(docs, rows, nothing, same):
    for by in ("document", "text"):
        same(quality.judged(docs, by=by), list(brute_quality(rows, by)))
    assert quality.judged(nothing).count() == 0


def test_quality_removes_a_common_line(spark, same):
    rows = [(i, f"page {i} " + "abcdefghij"[i % 10] * 3 + f" text number {i}\ncopyright of this site and all of its friends 19{i % 90 + 10}\n" + " ".join(f"v{i}x{j}" for j in range(20 if i % 2 else 1)), "en", "h") for i in range(40)]
    out = list(brute_quality(rows))
    assert any(x[7] for x in out) and any(not x[9] and not x[6] for x in out)
    same(quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")), out)


def test_quality_counts_copies_as_documents_or_one_text(spark, same):
    text = "these are the words of one page that was copied\nand this is its last line of all"
    rows = [(i if i < 12 else None, text, "en", "h") for i in range(14)] + [(3, "another text under one of the ids " + text, "en", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for by, kept in (("document", 1), ("text", 15)):
        out = list(brute_quality(rows, by))
        same(quality.judged(df, by=by), out)
        assert sum(x[9] for x in out) == kept


def brute_similarity(rows):
    sets, names = [], []
    for d, t, *_ in rows:
        w = SPACE.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
        names.append(-1 if d is None else d)
    root = {n: n for n in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((find(names[i]), find(names[j])))
                root[y] = x
    for (d, *_), s, n in zip(rows, sets, names, strict=True):
        c = find(n)
        yield d, len(s), None if c == -1 else c


def test_similarity(docs, rows, nothing, same):
    out = similarity.classes(docs)
    same(out.select("doc_id", "n_shingles", F.nullif("component", F.lit(-(1 << 63)))), list(brute_similarity(rows)))
    assert similarity.classes(nothing).count() == 0


def near(seed, n=90):
    import random

    r = random.Random(seed)
    out, base = [], []
    for i in range(n):
        if i % 15 == 0:
            base = [f"b{r.randrange(900)}" for _ in range(r.choice([8, 20, 60, 150]))]
        w = list(base)
        for _ in range(r.randrange(4)):
            k = r.randrange(len(w))
            w[k : k + r.randrange(2)] = [f"e{r.randrange(99)}"] * r.randrange(3)
        out.append((i, " ".join(w)))
    return out


def test_similarity_near_the_threshold_in_small_chunks(spark, same):
    for seed, chunk in ((1, 2000), (2, 7)):
        rows = near(seed)
        out = similarity.classes(spark.createDataFrame(rows, "doc_id long, text string"), chunk_docs=chunk)
        same(out.select("doc_id", "n_shingles", "component"), list(brute_similarity(rows)))


def by_text(rows):
    """Names the groups of rows, each text of an id by itself, by their least id; the rows of the other texts that lead."""
    nodes = sorted({(d is None, -1 if d is None else d, t) for d, t in rows if t})
    group = {i: c for i, _, c in brute_similarity([(i, t) for i, (_, _, t) in enumerate(nodes)])}
    least = {n: nodes[group[i]] for i, n in enumerate(nodes)}
    return [(d, t, None if least[d is None, -1 if d is None else d, t][0] else least[d is None, -1 if d is None else d, t][1]) for d, t in rows if t]


def several_texts():
    """A third without an id, three rows an id, near copies of all kinds, repeated rows."""
    rows = [(None if i % 3 == 0 else 1000 - i // 4, t) for i, t in near(5)]
    alone = [(None, " ".join(f"n{i}x{j}" for j in range(30))) for i in range(5)] + [(7, " ".join(f"s{i}x{j}" for j in range(30))) for i in range(5)]
    return [*rows, *alone, rows[0], rows[1], alone[0], (None, None), (None, None), (7, "")]


def test_similarity_of_texts_without_an_id_or_with_the_same(spark, same):
    rows = several_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for chunk in (2000, 7):
        out = similarity.classes(df, chunk_docs=chunk).join(df.select(F.xxhash64("text").alias("text_key"), "text").distinct(), "text_key").where("text <> ''")
        same(out.select("doc_id", "text", F.nullif("component", F.lit(-(1 << 63)))), by_text(rows))
        # One node of each group leads.
        n_groups = len(brute_groups([t for _, t in rows if t]))
        assert out.where("leads").select("id_key", "text_key").distinct().count() == n_groups


def test_texts_of_one_id_reach_what_each_of_them_links_with(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(3, a), (5, a), (5, b), (4, b + " tail"), (9, b), (None, "n " + a), (None, "m m m m m"), (7, "m m m m m k")]
    out = similarity.classes(spark.createDataFrame(rows, "doc_id long, text string"), join_ids=True)
    got = sorted((r.doc_id or 0, r.component) for r in out.collect())
    assert got[2:] == [(3, 3), (4, 3), (5, 3), (5, 3), (7, 7), (9, 3)] and sorted(c for _, c in got[:2]) == [-(1 << 63), 3]


def brute_groups(texts):
    return {c for _, _, c in brute_similarity(list(enumerate(texts)))}


def test_near_copies_keep_one_row_of_each_linked_group(spark):
    import corpus_pipeline

    clean = [(d, t, "s") for d, t in several_texts() if not t or len(t.split()) >= 30]
    df = spark.createDataFrame(clean, "doc_id long, text string, source string")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()]
    alone = [(d, t) for d, t, _ in clean if t and t[0] in "ns" and t[1].isdigit()]
    assert sorted(x for x in kept if x in alone and x[0] is None) == sorted({x for x in alone if x[0] is None})
    assert sorted(x for x in kept if x in alone and x[0] == 7) == sorted(x for x in alone if x[0] == 7)
    sets = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    like = lambda a, b: 100 * len(sets(a) & sets(b)) >= 80 * len(sets(a) | sets(b))
    texts = [t for _, t in kept if t]
    assert not [1 for i, a in enumerate(texts) for b in texts[:i] if like(a, b)]
    reached, seen = set(), list(texts)
    while seen:
        a = seen.pop()
        reached.add(a)
        seen += [t for _, t, _ in clean if t and t not in reached and t not in seen and like(a, t)]
    assert reached == {t for _, t, _ in clean if t}
    assert len([1 for _, t in kept if not t]) == 3


def test_linked_sets_always_share_a_part_key():
    r = np.random.default_rng(3)
    bands = similarity.Bands()
    for _ in range(300):
        n = int(r.integers(7, 300))
        pool = np.unique(r.integers(0, 2**63, 3 * n, dtype=np.uint64) * np.uint64(2))
        common = int(np.ceil(0.85 * n))
        a = np.sort(np.r_[pool[:common], pool[common : common + r.integers(0, max(1, n - common))]])
        b = np.sort(np.r_[pool[:common], pool[-int(r.integers(1, max(2, n - common))) :]])
        if 100 * common < 85 * len(np.union1d(a, b)) or len(np.union1d(a, b)) == common:
            continue
        owner, schemes = np.repeat([0, 1], [len(a), len(b)]), []
        for shift in (0, 1):
            o, k, need = similarity.part_keys(owner, np.r_[a, b], 2, bands, shift)
            schemes.append((set(k[o == 0].tolist()), set(k[o == 1].tolist()), need, shift))
        # They agree, in one band, in as many parts as either of them asks for.
        ways = [(x & y, need) for x, y, need, _ in ((p[0], q[1], (p[2][0], q[2][1]), 0) for p in schemes for q in schemes) if x & y]
        assert any(len(both) >= max(need) for both, need in ways), (len(a), len(b))
        sketches = [similarity.bit_sketch(a), similarity.bit_sketch(b)]
        assert len(similarity.Sketches(sketches, np.array([len(a), len(b)]), 85).may_link(0, np.array([1]))) == 1


def test_components(spark):
    pairs = [(i + 1, i) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (200, 200)]
    got = {r.node: r.root for r in _components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}
    assert _components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def random_sets(n, least, most, seed):
    """owner, hash of n random sets of ``least`` to ``most`` shingles, ascending within each."""
    rng = np.random.default_rng(seed)
    owner = np.repeat(np.arange(n), rng.integers(least, most + 1, n))
    values = rng.integers(0, 1 << 63, len(owner)).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, len(owner)).astype(np.uint64)
    order = np.lexsort((values, owner))
    return owner, values[order]


def test_similarity_parts_of_short_unlinked_sets_are_not_shared():
    owner, values = random_sets(300_000, 6, 13, 1)
    for shift in (0, 1):
        _, keys, _ = similarity.part_keys(owner, values, 300_000, similarity.Bands(), shift)
        assert np.unique(keys, return_counts=True)[1].max() < 20


@pytest.mark.parametrize("dealings", [1, 2, similarity.DEALINGS])
def test_similarity_short_linked_sets_always_share_enough_parts(dealings):
    """Pairs at the very threshold, many of them with more empty parts than are spared."""
    n, rng, bands = 20_000, np.random.default_rng(2), similarity.Bands()
    whole = [np.sort(rng.integers(1, 1 << 63, k).astype(np.uint64) * np.uint64(2)) for k in rng.integers(7, 30, n)]
    pairs = [(a, np.delete(a, rng.choice(len(a), rng.integers(1, len(a) * 15 // 100 + 1), replace=False))) for a in whole]
    flat = [x for pair in pairs for x in pair]
    owner, values = np.repeat(np.arange(2 * n), [len(x) for x in flat]), np.concatenate(flat)
    found = np.zeros(n, bool)
    schemes = [similarity.part_keys(owner, values, 2 * n, bands, shift, dealings) for shift in (0, 1)]
    for o1, k1, need1 in schemes:
        left = {(o, k) for o, k in zip(o1.tolist(), k1.tolist(), strict=True) if o % 2 == 0}
        for o2, k2, need2 in schemes:
            shared = np.bincount(np.array([o // 2 for o, k in zip(o2.tolist(), k2.tolist(), strict=True) if o % 2 and (o - 1, k) in left], np.int64), minlength=n)
            found |= (shared > 0) & (shared >= need1[0::2]) & (shared >= need2[1::2])
    assert found.all()


def test_similarity_parts_are_shuffled_once_however_many_are_shared(spark, monkeypatch):
    rows = [(i, f"w{i % 7} w{i % 5} " + " ".join(f"v{(i // 4) * j}" for j in range(40))) for i in range(24)]
    monkeypatch.setattr(_shared, "MOST_IDS", 0)
    plans, written = {}, _shared.written

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        return written(df, name)

    monkeypatch.setattr(_shared, "written", noted)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {tuple(r) for r in similarity.classes(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert got == {(i, c) for i, _, c in brute_similarity(rows)}
    # The tables that hold no more than what is shared may be shuffled, the parts once.
    first = [plan for name, plan in plans.items() if name in ("similarity-several-0", "similarity-shared-0")]
    assert sum(plan.count("Exchange hashpartitioning(part_key") for plan in first) == 1
    # Once for each sifting, once to find the least document of each.
    assert sum(plan.count("Exchange hashpartitioning(part_key") for plan in plans.values()) == 3
