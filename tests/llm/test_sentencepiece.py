import random

import numpy as np
import pytest

from hoplite.llm import sentencepiece_codec as S

sp = pytest.importorskip("sentencepiece")
DIR = "/root/testdata/sf0.001"
rng = random.Random(5)
TEXTS = ["", " ", "  a  b ", "a\n\n b\t日本x𝄞 z", "￿", "The thing and the others, of course."] + ["".join(rng.choice("ab the\n日é\x00") for _ in range(40)) for _ in range(80)]
LONG = ["x" * 300, "ab" * 200, "aaaa" * 800, "日本" * 90 + " a b" * 20, " " * 200, "the " * 90, "".join(rng.choice("etaoinsh") for _ in range(900)), "\n" * 70]


@pytest.fixture(scope="module")
def codec():
    return S.Codec.load(S.default_model_path())


@pytest.fixture(scope="module")
def library():
    return sp.SentencePieceProcessor(model_file=S.default_model_path())


def in_chunks(codec, text, size):
    """Ids by chunks, their matrices combined one after the other."""
    text, parts = codec.prepared(text), []
    for at in range(0, len(text), size):
        low, end = max(0, at - codec.longest), min(at + size, len(text))
        parts.append((text[low : end + codec.longest], at - low, end - low))
    matrices = [codec.matrix(*p) for p in parts]
    total = matrices[0]
    for m in matrices[1:]:
        total = S.product(total, m)
    assert np.count_nonzero(total == 0) == 1  # one segmentation, no tie
    at = S.chosen_states(matrices, 0, int(np.argmax(total[0])))
    return b"".join(codec.chunk_ids(*p, i, j) for p, i, j in zip(parts, at, at[1:]))


def test_ids_of_the_library(codec, library):
    for t in TEXTS + LONG:
        assert codec.encode(t).tolist() == library.encode(t)


def test_ids_of_the_library_on_the_tables(spark, codec, library):
    texts = [r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").select("text").collect() if r.text]
    assert [codec.encode(t).tolist() for t in texts] == library.encode(texts, num_threads=1)


def test_round_trip(codec):
    for t in TEXTS + LONG:
        assert codec.decode(codec.encode(t).tolist()) == t


@pytest.mark.parametrize("size", [1, 7, 40, 64, 200])
def test_chunks_give_the_ids_of_the_whole(codec, library, size):
    for t in TEXTS[6:20] + LONG:
        if t:
            assert np.frombuffer(in_chunks(codec, t, size), np.int32).tolist() == library.encode(t)


def test_compatible_pairs_by_the_merges_themselves(codec, library):
    """Two pieces are compatible exactly if the library leaves their joint text as those two."""
    names = [p for p, (_, i) in codec.pieces.items() if p.isascii() and i % 37 == 0]
    for _ in range(3000):
        a, b = rng.choice(names), rng.choice(names)
        got = library.encode("\n" + a + b, out_type=str)[2:]  # the line end separates the blank that is put in front
        assert codec.meets(codec.pieces[a][1], codec.pieces[b][1]) == (got == [a, b])


def test_products_are_associative():
    g = np.random.default_rng(3)
    a, b, c = g.normal(size=(3, 5, 5))
    assert np.allclose(S.product(S.product(a, b), c), S.product(a, S.product(b, c)))
    best = S.product(S.product(a, b), c)
    states = S.chosen_states([a, b, c], 2, 4)
    assert states[0] == 2 and states[-1] == 4 and np.isclose(sum(m[i, j] for m, i, j in zip((a, b, c), states, states[1:])), best[2, 4])


def test_giant_texts_in_the_engine(spark, codec):
    """Chunks of 100 in a tree of fan 2 and 64: the same ids as whole, for repeated rows, null ids and clashing columns too."""
    rows = [(i, t) for i, t in enumerate(TEXTS[:20])] + [(100, None), (101, "The thing and others. " * 200), (101, "The thing and others. " * 200), (None, "word\n" * 500), (102, "x" * 3000)]
    df = spark.createDataFrame([(a, b, 1, [7]) for a, b in rows], "doc_id long, text string, row int, piece_ids array<int>")
    out = S.encoded(df, giant=500, chunk=100, check=True).collect()
    assert len(out) == len(rows) and out[0].row == 1 and all(r.round_trip for r in out)
    for r in out:
        assert r.piece_ids == (None if r.text is None else codec.encode(r.text).tolist())
    back = spark.createDataFrame([(r.text, r.piece_ids) for r in out if r.text], "text string, ids array<int>")
    assert back.where(S.decoder(codec, spark)("ids") != back.text).count() == 0


def test_tree_of_small_fan(spark, codec):
    from hoplite.plans.workspace import Workspace

    df = spark.createDataFrame([(1, "aaaa" * 100), (2, "the cat sat " * 30), (3, "日")], "row long, text string")
    got = {r.row: r.ids for r in S.encode_giants(df, codec, Workspace(spark, "t"), chunk=20, fan=2).collect()}
    assert got == {r.row: codec.encode(r.text).tolist() for r in df.collect()}


def test_empty_table(spark):
    assert S.encoded(spark.createDataFrame([], "doc_id long, text string")).collect() == []
