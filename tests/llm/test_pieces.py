"""Operator 12 against the sentencepiece library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from lodestone.llm import pieces
from lodestone.llm.tokencounts import MODEL

from test_models_and_files import ODD, strings

PATH = public_tokenizers.path(MODEL)
MORE = ["\x00a\x00", " ▁ a", "▁", "  ", "<s>", "</s><unk>▁", "a▁b", "ab" * 30_000, "x" * 47, "x" * 48, "x" * 49, "\U0001f600" * 60, "日本語" * 40]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(PATH)


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def test_agenda_gives_the_librarys_ids_and_texts(library, vocabulary):
    codec = pieces.Codec(vocabulary, room=5000, check=0)
    texts = [*ODD, *MORE, *strings(20_000, 11)]
    for k in range(0, len(texts), 100):
        own, theirs = codec.encode(texts[k : k + 100]), library.encode(texts[k : k + 100], add_bos=True, add_eos=True)
        for text, a, b in zip(texts[k : k + 100], own, theirs, strict=True):
            assert a == packed(b), text
        assert codec.decode(own) == library.decode(theirs)


def test_any_ids_decode(library, vocabulary):
    r, codec = random.Random(3), pieces.Codec(vocabulary, check=0)
    kinds = [lambda: r.randrange(300), lambda: r.randrange(32_000), lambda: r.choice([28705, 0, 1, 2, 3, 13])]
    for _ in range(20_000):
        ids = [r.choice(kinds)() for _ in range(r.randint(0, 9))]
        assert codec.decode([packed(ids)])[0] == library.decode(ids), ids


def test_heap_and_matrix_agree(vocabulary):
    r = random.Random(5)
    for _ in range(300):
        width = r.randint(1, 20)
        words = ["".join(r.choice("abcdeilnorst▁éö日") for _ in range(width)) for _ in range(10)]
        symbol, alive = pieces.merged(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(-1, width), vocabulary)
        for w, row in zip(words, alive, strict=True):
            starts = [*np.flatnonzero(row).tolist(), width]
            assert [w[a:b] for a, b in zip(starts, starts[1:], strict=False)] == pieces.symbols(w, vocabulary.rank)


def test_ties_merge_from_the_left():
    assert pieces.symbols("aaaa", {"aa": 0}) == ["aa", "aa"]
    assert pieces.symbols("aaaa", {"aa": 0, "aaa": 0}) == ["aaa", "a"]
    assert pieces.symbols("abc", {"ab": 1, "bc": 1}) == ["ab", "c"]
    assert pieces.symbols("abc", {"ab": 1, "bc": 0}) == ["a", "bc"]


def test_a_wrong_id_is_never_written(vocabulary):
    codec = pieces.Codec(vocabulary, check=1)
    codec.cache["▁hello"] = packed([5])
    with pytest.raises(ValueError, match="hello"):
        codec.both(["hello"])


def test_whole_tables(spark, docs, rows, nothing, same, library):
    wanted = []
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        wanted.append((doc_id, len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    same(pieces.digests(docs, PATH), wanted)
    assert pieces.digests(nothing, PATH).collect() == []
    got = pieces.encoded(docs, PATH, check=0, part=1000).where("doc_id is not null").collect()
    texts = {(i, t or "") for i, t, *_ in rows}
    assert {(r.doc_id, r.decoded) for r in got} == {(i, t) for i, t in texts if i is not None}
    assert all(r.ids[0] == 1 and r.ids[-1] == 2 for r in got)
