import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from hoplite.llm import language_id as L

rng = random.Random(3)
SAMPLES = {"a": ["".join(rng.choice("abcde é") for _ in range(rng.randint(0, 40))).encode() for _ in range(30)], "b": ["".join(rng.choice("cdefgh ü") for _ in range(rng.randint(0, 40))).encode() for _ in range(30)]}


def brute(trees, text, lang, samples=SAMPLES):
    """Code length by walking the contexts, byte by byte."""
    counts = [defaultdict(Counter) for _ in range(4)]
    symbols = lambda b: [0] * 3 + [int(trees.symbol[x]) for x in b]
    for x in samples[lang]:
        s = symbols(x)
        for i in range(3, len(s)):
            for k in range(4):
                counts[k][tuple(s[i - k : i])][s[i]] += 1
    s, bits = symbols(text), 0.0
    for i in range(3, len(s)):
        p = 1.0
        for k in (3, 2, 1, 0):
            c = counts[k].get(tuple(s[i - k : i]))
            if not c:
                continue
            n, d = sum(c.values()), len(c)
            if s[i] in c:
                p *= c[s[i]] / (n + d)
                break
            p *= d / (n + d)
        else:
            p /= 256
        bits -= math.log2(p)
    return bits


@pytest.mark.parametrize("piece", [5, 1 << 18])
def test_code_lengths(monkeypatch, piece):
    monkeypatch.setattr(L, "SLICE", piece)
    trees = L.ContextTrees(SAMPLES)
    texts = ["".join(rng.choice("abcdefgh éüz") for _ in range(rng.randint(0, 30))).encode() for _ in range(20)] + [b"", b"a", b"ab", b"", b"abc"]
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])]
    got = trees.code_lengths(np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert np.abs(got - [[brute(trees, t, lang) for lang in trees.langs] for t in texts]).max() < 1e-3


def test_twenty_languages_of_all_bytes():
    """256 symbols and 20 languages: nothing is cut off, code lengths are those of the trees."""
    g = np.random.default_rng(7)
    samples = {f"l{i:02}": [((g.integers(0, 16, 300) * 17 + g.integers(0, 3, 300) * i) % 256).astype(np.uint8).tobytes(), bytes(range(256))] for i in range(20)}
    trees = L.ContextTrees(samples)
    assert trees.size == 258
    texts = [samples["l03"][0][40:90], samples["l11"][0][7:60], bytes(range(200, 256)), g.integers(0, 256, 50).astype(np.uint8).tobytes()]
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])]
    got = trees.code_lengths(np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert np.abs(got - [[brute(trees, t, lang, samples) for lang in trees.langs] for t in texts]).max() < 1e-2
    assert trees.langs[got[0].argmin()] == "l03" and trees.langs[got[1].argmin()] == "l11"


def test_sample_is_cut_where_tables_would_outgrow_the_bound():
    trees = L.ContextTrees(SAMPLES, cells=700)
    assert trees.two.cells + trees.three.cells <= 700
    bits = trees.code_lengths(np.frombuffer(b"abcde", np.uint8), np.array([0, 5]))
    assert np.isfinite(bits).all() and bits[0, 0] < bits[0, 1]


def test_edge_rows(spark):
    rows = [(i, ("the cat and the hat " if i % 2 else "der hund und die katze ") * 5, "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "123 !?", "en"), (103, "the hat " * 40000, None), (None, "und die katze", None), (1, "the cat and the hat", "en"), (1, "the cat and the hat", "en")]
    df = spark.createDataFrame([(a, b, c, 0.5) for a, b, c in rows], "doc_id long, text string, lang string, score double")
    out = L.identify(df).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    by = {r.doc_id: r for r in out}
    assert [by[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and by[100].score == 0.0
    assert by[103].lang_pred == "en" and by[None].lang_pred == "de"
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out if r.doc_id is not None)


@pytest.mark.parametrize("rows", [[], [(1, "text", None)]])
def test_nothing_to_learn(spark, rows):
    out = L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert [(r.lang_pred, r.score) for r in out] == [("und", 0.0)] * len(rows)


def test_sample_has_every_language_and_a_bound(spark, monkeypatch):
    monkeypatch.setattr(L, "TRAIN_BYTES", 2000)
    monkeypatch.setattr(L, "TRAIN_TEXT", 300)
    got = {}
    monkeypatch.setattr(L, "ContextTrees", lambda samples: got.update(samples))
    # 3 texts of 40 bytes with 3000 copies each; one text above TRAIN_TEXT; many short ones
    rows = [(f"copied text {i} ".ljust(40, "c"), "copies") for i in range(3) for _ in range(3000)]
    rows += [("long " * 2000, "long"), *((f"short text number {i}", "short") for i in range(900))]
    L.train(spark.createDataFrame(rows, "text string, lang string"))
    assert sorted(got) == ["copies", "long", "short"]
    assert sorted(got["copies"]) == sorted({t.encode() for t, lang in rows if lang == "copies"})
    assert [len(t) for t in got["long"]] == [2000]
    assert len(set(got["short"])) == len(got["short"]) and 2000 <= sum(map(len, got["short"])) < 2100
