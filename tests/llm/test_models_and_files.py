import math
import random
import re
import time
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import _words, lm, tokencounts, tokenfiles, toxicity

ODD = ["a\tb  c\x0bd", "It's we'll 123 don't.", "<|endoftext|> x<|startoftext|>", "é ́x,", "ΑΣ ΣΑΣ\x85y\xa0z\x1cq", "日本, 語.", "İI ß ſ", "", " \n", "Don't. A.B,c .,", "<s>é<0x41></s>", "▁a  ▁▁b", "lo" * 900, "\n\n a\n  b"]


# Operator 5


def test_encoder_gives_the_librarys_ids(rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(tokenfiles.TOKENIZER)
    library, own = Tokenizer.from_file(path), tokenfiles.Encoder(path, room=20)
    for text in [*ODD, *((t or "") for _, t, *_ in rows)]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_encoder_cuts_no_mark_from_letters_that_end_in_a_combining_one():
    from tokenizers import Tokenizer

    path = public_tokenizers.path(tokenfiles.TOKENIZER)
    library, own = Tokenizer.from_file(path), tokenfiles.Encoder(path)
    letters = [c for c in map(chr, range(0x80, 0x110000)) if c.isalpha()]
    odd = [c for c in letters if not unicodedata.normalize("NFC", c).lower().isalpha()]
    assert {"\u0130", "\u0958", "\u09df", "\ufb2a"} <= set(odd)
    words = [f"{a}{c}{m}" for a in ("", "al") for c in [*odd, *letters[::97]] for m in ("", ".", ",")]
    for word in [*words, "AL\u0130. x", "\u0130a."]:
        assert np.frombuffer(own.encode(word), "<u4").tolist() == library.encode(word, add_special_tokens=False).ids, word


def strings(n, seed):
    """Words of all kinds of letters, marks and signs that normalising changes, with and without spaces between."""
    r = random.Random(seed)
    kinds = ["abcxyzABCXYZ", "0123456789", ".,;:!?'\"-_()[]<>|", " \t\n\x0b\x85\xa0\u2003\u3000", "\u0130\u0131ßſΣςÄéÅŒ", "\u01c5\u01c8\u01cb\u01f2\u1f88\u1f9c", "\u0300\u0301\u0307\u0323\u0345\u200d\ufe0f", "\u0958\u09df\u09dc\ufb2a\ufb4b\u0f43", "日本語학교العربية", "😀👩🏽\u200b\ufeff"]
    for _ in range(n):
        yield "".join(r.choice(r.choice(kinds[: r.randint(1, len(kinds))])) for _ in range(r.randint(1, 24)))


def test_encoder_gives_the_librarys_ids_for_any_string():
    from tokenizers import Tokenizer

    path = public_tokenizers.path(tokenfiles.TOKENIZER)
    library, own = Tokenizer.from_file(path), tokenfiles.Encoder(path, room=5000)
    for text in strings(20_000, 7):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize(("n", "most"), [(0, 10), (1, 5), (5000, 3), (20_000, 40_000)])
def test_codes_round_trip_and_random_access(n, most):
    r = np.random.default_rng(n)
    tokens = np.minimum((r.pareto(0.7, n) * 3).astype(np.int64), most)
    offsets = np.unique(np.r_[0, r.integers(0, n + 1, 20), n])
    reader = tokenfiles.Reader(tokenfiles.encode(np.arange(len(offsets) - 1), offsets, tokens))
    assert (reader.tokens() == tokens).all() and (reader.offsets == offsets).all()
    assert all(reader.token(i) == tokens[i] for i in r.integers(0, max(1, n), 200) if n)
    with pytest.raises(IndexError):
        reader.token(n)


def test_files_in_order(spark, docs, rows, nothing):
    from tokenizers import Tokenizer

    from lodestone.llm import _shared

    path = public_tokenizers.path(tokenfiles.TOKENIZER)
    library, at, wanted = Tokenizer.from_file(path), 0, []
    folder = _shared.new_path(spark, "files")
    assert tokenfiles.write(docs, folder, path, range_bytes=9000) > 3
    ids = {t: np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for _, t, *_ in rows}
    for d, t in sorted(((d, t) for d, t, *_ in rows), key=lambda x: -1 if x[0] is None else x[0]):
        wanted.append((d, at, len(ids[t]), zlib.crc32(ids[t].tobytes())))
        at += len(ids[t])
    for ranges, tokens in ((9000, 2 << 20), (6 << 20, 2 << 20), (30_000, 500)):
        got = [tuple(r) for r in tokenfiles.round_trip(docs, path, ranges, tokens).collect()]
        assert sorted(got, key=lambda r: r[1]) == wanted
    assert tokenfiles.round_trip(nothing, path).count() == 0


# Operator 6


def test_counts_are_the_librarys(docs, rows, nothing):
    import sentencepiece

    path = public_tokenizers.path(tokencounts.MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    counter = tokencounts.Counter(tokencounts.Merger(tokencounts.pieces_of(path)), room=50)
    r = random.Random(1)
    parts = ["a", "b", "the", " ", "  ", "\n", "▁", "é", "日", "𝄞", "\t", "<s>", "ing", "er", "1", "aaaa", "!!!", "ab" * 30]
    texts = ODD + ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(400)]
    assert counter.counts(texts) == [len(x) for x in library.encode(texts)]
    got = {(x.doc_id, x.n_bytes, x.n_tokens, x.over_limit) for x in tokencounts.counted(docs, path).collect()}
    assert got == {(d, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for d, t, *_ in rows}
    assert tokencounts.counted(nothing, path).count() == 0


def test_long_runs_without_a_space():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, counter = sentencepiece.SentencePieceProcessor(model_file=path), tokencounts.Counter(tokencounts.Merger(tokencounts.pieces_of(path)))
    r = random.Random(2)
    draw = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    texts = [draw("abcdefghijklmnopqrstuvwxyz", 1_000_000), draw("acgt", 50_000), "ab" * 40_000, draw("日本語学a1é😀", 30_000), *(draw("theraninso▁ \n", 400) for _ in range(30))]
    began = time.time()
    assert counter.counts(texts[:1]) == [len(library.encode(texts[0]))]
    assert time.time() - began < 10
    assert counter.counts(texts) == [len(library.encode(t)) for t in texts]


# Operator 4


def test_gradients():
    r = np.random.default_rng(0)
    net = toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = r.normal(size=(30, toxicity.N_FEATURES)).astype(np.float32)
    x[-1] = 0
    w, y = r.integers(0, 29, (5, 12)), np.array([0, 1, 1, 0, 1.0])
    w[0, 8:] = 29

    def loss():
        return np.mean(np.log1p(np.exp(-(2 * y - 1) * net.logits(x, w).astype(np.float64))))

    for name, g in net.gradients(x, w, y).items():
        i = tuple(r.integers(0, s) for s in net.p[name].shape)
        old = net.p[name][i]
        net.p[name][i] = old + 1e-2
        up = loss()
        net.p[name][i] = old - 1e-2
        down = loss()
        net.p[name][i] = old
        assert g[i] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=2e-5)


def test_every_word_is_in_a_window():
    for n in (1, 47, 48, 49, 80, 81, 200):
        batch = pa.RecordBatch.from_arrays([pa.array([" ".join(f"w{i}" for i in range(n)), None])], names=["text"])
        (chunk,) = _words.cut(batch)
        lexicon = toxicity.Lexicon(chunk)
        owner, words = lexicon.windows()
        assert set(owner) == {0} and set(words[words < lexicon.size].tolist()) == set(range(n))


def toxic_rows(n=700, seed=4):
    r = random.Random(seed)
    out, labels = [], []
    for i in range(n):
        w = [r.choice(["ta", "ro", "mi", "len", "so"]) + r.choice(["ka", "du", "per", "", "ni"]) for _ in range(r.randint(20, 150))]
        bad = i % 4 == 0
        for _ in range(3 * bad):
            w.insert(r.randrange(len(w)), r.choice(["blarg", "vexo" + r.choice(["ta", "mi", "ro", "sel", "nu"])]))
        out.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return out, labels


def test_learned_from_the_rest_and_right_on_held_out_rows(spark, docs, nothing):
    rows, labels = toxic_rows()
    given = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), given)
    got = toxicity.scored(spark.createDataFrame(rows, "doc_id long, text string"), model, ["doc_id"]).collect()
    held = [(x.score >= 0.5) == bool(labels[x.doc_id][1]) for x in got if zlib.crc32(str(x.doc_id).encode()) % 5 == 0]
    assert len(held) > 100 and sum(held) / len(held) > 0.95
    scores = [x.score for x in toxicity.scored(docs, model, ["doc_id"]).collect()]
    assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)
    empty = toxicity.scored(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), model, ["doc_id"]).collect()
    assert all(x.score < 0.5 for x in empty)
    assert toxicity.scored(nothing, model, ["doc_id"]).count() == 0
    # Labels of held-out rows change nothing.
    other = given.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    again = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), other)
    assert all((again.network.p[k] == v).all() for k, v in model.network.p.items())


def brute_score(model, text):
    """One text's score word by word and step by step, without arrays of words or windows."""
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.encode().lower())
    if not words:
        return model.nothing

    def gram(letters):
        h = 0x9E3779B9 + len(letters)
        for c in letters:
            h = ((h ^ c) * 0x01000193) & 0xFFFFFFFF
            h ^= h >> 13
        return ((h * 2654435761) & 0xFFFFFFFF) >> (32 - toxicity.GRAM_BITS)

    def features(w):
        (own,) = _words.cut(pa.RecordBatch.from_arrays([pa.array([w.decode()])], names=["text"]))
        out = [model.word_odds[int(own.words(_words.NOT_ALNUM, _words.LOWER)[2][0]) >> (64 - toxicity.WORD_BITS)], math.log1p(len(w)) / 4]
        for n, odds in zip(toxicity.GRAMS, model.gram_odds, strict=True):
            padded = b"\0" + w + b"\0"
            values = [float(odds[gram(padded[i : i + n])]) for i in range(max(1, len(padded) - n + 1))]
            out += [max(values), sum(values) / len(values), values[0]]
        return np.array(out, np.float64)

    p, k = {a: v.astype(np.float64) for a, v in model.network.p.items()}, toxicity.HIDDEN
    best, x = -math.inf, [features(w) for w in words]
    for start in range(0, max(1, len(x)), toxicity.STRIDE):
        if start and start - toxicity.STRIDE + toxicity.WIDTH >= len(x):
            break
        window = x[start : start + toxicity.WIDTH]
        score, value = np.zeros(len(window)), np.zeros(len(window))
        for d, order in (("f", range(len(window))), ("b", range(len(window) - 1, -1, -1))):
            h = np.zeros(k)
            for t in order:
                g, u = window[t] @ p[f"W{d}"] + p[f"c{d}"], h @ p[f"U{d}"]
                z, r = (1 / (1 + np.exp(-(g[: 2 * k] + u[: 2 * k])))).reshape(2, k)
                m = np.tanh(g[2 * k :] + r * u[2 * k :])
                h = z * h + (1 - z) * m
                score[t] += h @ p[f"v{d}"]
                value[t] += h @ p[f"g{d}"]
        weight = np.exp(score - score.max())
        best = max(best, float(weight @ value / weight.sum() + p["bias"][0]))
    return 1 / (1 + math.exp(-(model.slope * best + model.shift)))


def test_scores_are_those_of_the_slow_way(spark, rows):
    given, labels = toxic_rows(300)
    model = toxicity.train(spark.createDataFrame(given, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    some = [t for _, t, *_ in rows if t and len(t) < 2000][:25] + [t for _, t in given[:25]] + ["", "a", "a b", "ab i"]
    df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    for x in toxicity.scored(df, model, ["doc_id"]).collect():
        assert x.score == pytest.approx(brute_score(model, some[x.doc_id]), abs=1e-3)


def test_labelled_texts_without_words_and_labelled_ids_with_several_rows(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    empty = spark.createDataFrame([(i, None if i % 3 else "") for i in range(40)], "doc_id long, text string")
    assert all(abs(x.score - 0.5) < 0.2 for x in toxicity.judged(empty, labels).collect())
    many = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "other words")], "doc_id long, text string")
    model = toxicity.train(many, labels)
    one = toxicity.train(spark.createDataFrame([(1, "text 0"), (2, "other words")], "doc_id long, text string"), labels)
    assert all((model.network.p[k] == v).all() for k, v in one.network.p.items())


def test_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(x.predicted == 0 for x in toxicity.judged(docs, none).collect())


# Operator 9


@pytest.mark.parametrize("order", [2, 3])
def test_language_model(docs, rows, nothing, order):
    model = lm.Lm(docs, order, bucket_bytes=20_000, block_bytes=9_000)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = [(d, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)), None]) for d, t, *_ in rows]
    rest = lambda d: -1 if d is None else zlib.crc32(str(d).encode()) % 10
    one, two, three = Counter(), Counter(), Counter()
    learned = [w for d, w in texts if rest(d) > 0]
    for w in learned:
        one.update(w)
        two.update(zip([None, *w], w, strict=False))
        three.update(tuple(([None, *w])[max(0, k - 1) : k + 2]) for k in range(len(w)))
    n, v = sum(one.values()), len(one)
    assert (model.n_tokens, model.vocabulary, model.n_docs) == (n, v, len(learned))
    wanted = defaultdict(list)
    for d, w in texts:
        base = sum(math.log10((one[t] + 0.1) / (n + 0.1 * (v + 1))) for t in w)
        score = 0.0
        for k, t in enumerate(w):
            context = one[w[k - 1]] if k else len(learned)
            parts = [1 / (v + 1), one[t] / n, two[([None, *w])[k], t] / context if context else 0]
            if order == 3:
                below = two[tuple(([None, *w])[k - 1 : k + 1])] if k else len(learned)
                parts.append(three[tuple(([None, *w])[max(0, k - 1) : k + 2])] / below if below else 0)
            score += math.log10(sum(a * b for a, b in zip(model.weights[min(int(math.log2(context + 1)), 23)], parts, strict=True)))
        wanted[d].append((rest(d) == 0, len(w), sum(one[t] > 0 for t in w), n, base, score))
    got = defaultdict(list)
    for d, *x in model.scores().collect():
        got[d].append(tuple(x))
    assert got.keys() == wanted.keys()
    for d, x in got.items():
        for a, b in zip(sorted(x), sorted(wanted[d]), strict=True):
            assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:])
    assert np.allclose(model.weights.sum(1), 1)
    assert lm.Lm(nothing, order).scores().count() == 0


# The pipeline


def test_stages(spark, tmp_path, rows):
    out, labels = toxic_rows(300)
    layout = "doc_id long, text string, lang string, source string, n_chars long"
    more = [(10_000 + (d or 0) if d is not None else None, t, lang, s, c) for d, t, lang, s, c, *_ in rows]
    docs = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in out] + more
    spark.createDataFrame(docs, layout).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("quality", F.lit(1)).write.parquet(f"{tmp_path}/labels.parquet")
    leaked = out[1][1]
    spark.createDataFrame([(1, leaked)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sizes = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        at = stage(spark, at, str(tmp_path))
        if i < 4:
            assert at.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        at.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        sizes.append(at.count())
        if name == "toxicity":
            assert not [r for r in at.collect() if r.text and "blarg" in r.text]
        if name == "near_copies":
            kept = [r.text for r in at.collect() if r.text and r.text.strip()]
            assert len(kept) == len(set(kept))
        if name == "decontamination":
            assert leaked not in [r.text for r in at.collect()]
    assert sizes[0] >= sizes[1] >= sizes[2] and sizes[3] == sizes[4]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == sizes[4]


def test_stages_of_nothing(spark, tmp_path):
    layout = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], layout).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
