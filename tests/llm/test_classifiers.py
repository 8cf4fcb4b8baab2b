import random

import numpy as np
import pytest

from hoplite.llm import common, labelled
from hoplite.llm import quality as Q
from hoplite.llm import toxicity as T

rng = random.Random(9)
WORDS = ["tree", "house", "river", "stone", "green", "walk", "bread", "light"]
prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n)) + "."
ROWS = [(i, prose(30) + (f" you {rng.choice(['moron', 'grumblefink', 'grumblesnout'])} {rng.choice(['grumblefink', 'scum'])}" if i % 4 == 0 else ""), int(i % 4 == 0), 1) for i in range(200)]
ROWS += [(1000 + i, " | ".join(prose(1).upper() for _ in range(30)) + "!!", 0, 0) for i in range(60)]
ODD = [(5000, None), (5001, ""), (5002, " \n"), (5003, "tree " * 50000), (None, "tree house"), (1, ROWS[1][1]), (1, ROWS[1][1])]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(a, b, "x", 3) for a, b, *_ in ROWS] + [(*r, "x", 3) for r in ODD], "doc_id long, text string, score string, y int")
    labels = spark.createDataFrame([(a, q, t) for a, _, t, q in ROWS] + [(None, 1, 1), (7, None, None), (5000, 0, 1)], "doc_id long, quality int, toxic int")
    return docs.cache(), labels.cache()


@pytest.mark.parametrize("f, column, threshold", [(T.toxicity, 2, 0.5), (Q.quality, 3, 0.3)])
def test_held_out_accuracy(tables, f, column, threshold):
    out = f(*tables).collect()
    assert len(out) == len(ROWS) + len(ODD)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in out)
    truth = {r[0]: r[column] for r in ROWS}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(held) > 20 and np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.95
    twice = [r.score for r in out if r.doc_id == 1]
    assert len(twice) == 3 and len(set(twice)) == 1


@pytest.mark.parametrize("f", [T.toxicity, Q.quality])
def test_no_labels_and_no_documents(spark, tables, f):
    docs, labels = tables
    assert all(0 <= r.score <= 1 for r in f(docs, labels.limit(0)).collect())
    assert f(docs.limit(0), labels).collect() == []


def test_filters_keep_columns(tables):
    docs, labels = tables
    clean, good = T.without_toxic(docs, labels), Q.good_only(docs, labels)
    assert clean.columns == docs.columns == good.columns
    left = {r.doc_id for r in clean.collect()}
    assert not left & {r[0] for r in ROWS if r[2]} and len(left & {r[0] for r in ROWS if not r[2]}) >= 200
    assert not {r.doc_id for r in good.collect()} & {r[0] for r in ROWS if not r[3]}


def test_label_model_weighs_copies_of_a_voter_down():
    rand = np.random.default_rng(2)
    y = rand.random(2000) < 0.3
    good = [(rand.random(2000) < np.where(y, 0.8, 0.05)).astype(float) for _ in range(4)]
    noise = (rand.random(2000) < 0.4).astype(float)
    votes = np.stack([*good, *[noise] * 6], axis=1)
    labels = np.where(rand.random(2000) < 0.3, y, -1).astype(int)
    p = T.label_model(votes, labels)
    assert np.mean((p >= 0.5) == y) > 0.93


def test_nearest_breaks_ties_by_place():
    cosine = np.array([[0.5, 0.9, 0.5, 0.5]])
    assert Q.Model._nearest(cosine, 2).tolist() == [[0, 1]]


def test_votes_match_brute_force():
    m = Q.train([(b.encode(), q) for _, b, _, q in ROWS])
    texts = ["TREE | HOUSE!!", "tree house river."] + [prose(rng.randint(1, 60)) + rng.choice(["", "!!", "\n\n", " | A B"]) for _ in range(150)]
    got = m.scores([t.encode() for t in texts])
    x64 = lambda a: np.asarray(a, np.float64)
    unit = lambda v: v / np.sqrt((v * v).sum())
    compared = 0
    for text, score in zip(texts, got, strict=True):
        x = unit(unit(np.log1p(x64(Q.terms(text.encode()))) * x64(m.idf))[m.keep] @ x64(m.axes))
        cosine = [sum(a * b for a, b in zip(x.tolist(), p, strict=True)) for p in x64(m.points).tolist()]
        near = sorted(range(len(cosine)), key=lambda i: (-cosine[i], i))
        k = Q.NEIGHBOURS
        # float32 may order neighbours of nearly equal cosine differently: labels of all that tie with the last must agree
        edge = {float(m.y[i]) for i in near if abs(cosine[i] - cosine[near[k - 1]]) < 1e-6}
        if len(edge) == 1:
            w = [max(cosine[i], 1e-6) ** 8 for i in near[:k]]
            assert abs(score - sum(a * m.y[i] for a, i in zip(w, near)) / sum(w)) < 1e-5
            compared += 1
    assert compared > 100


def test_terms_by_slices(monkeypatch):
    """Texts that are cut into slices have the terms of the whole."""
    texts = [" ".join(rng.choice(["a", "B!", "c\n", "\n\n", "word", "1 2"]) for _ in range(n)).encode() for n in (1, 5, 90, 400)] + [b"x" * 300, b"\n" * 120, b"a\n" * 64]
    whole = [Q.terms(t) for t in texts]
    monkeypatch.setattr(Q, "SPAN", 7)
    monkeypatch.setattr(Q, "slices", lambda t, ends=b" \n": common.slices(t, ends, 16))
    for t, w in zip(texts, whole, strict=True):
        assert (w is None and Q.terms(t) is None) or np.abs(Q.terms(t) - w).max() < 1e-3
    for t in texts:
        assert b"".join(common.slices(t, size=16)) == t


def test_toxicity_score_against_brute_force():
    import math
    import re

    m = T.train([(b.encode(), t) for _, b, t, _ in ROWS])
    lexicon, starts = m.voters.words, m.voters.starts
    seed, first_pattern = m.voters.count - 1 - len(T.PATTERNS), m.voters.count - len(T.PATTERNS)
    assert lexicon and any(abs(w) > 0.1 for w in m.weights)

    def brute(text):
        found = [0.0] * (m.voters.count + 1)
        for w in re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text)):
            mine = [lexicon[w.encode()]] if w.encode() in lexicon else []
            mine += [n for s, n in starts.items() if len(s.decode()) in T.BEGINNINGS and w.startswith(s.decode())]
            mine += [seed] if w.encode() in T.SEED else []
            for v in mine:
                found[v] += 1
            found[-1] += bool(mine)
        for i, p in enumerate(T.PATTERNS):
            found[first_pattern + i] = float(re.search(p, text.encode()) is not None)
        z = m.weights[-1] + sum(w * math.log1p(k) for w, k in zip(m.weights, found))
        return 1 / (1 + math.exp(-max(-30, min(30, z))))

    texts = [b for _, b, *_ in ROWS] + ["", "YOU MORON!!! @#$", "é grumblefink-scum", "nothing here"] + [" ".join(rng.choice(["you", "scum", "grumblesnout", "tree", "WOW!!!"]) for _ in range(30)) for _ in range(50)]
    for t in texts:
        assert abs(m.score(t.encode()) - brute(t)) < 1e-9


def test_slices_leave_the_toxicity_score():
    m = T.train([(b.encode(), t) for _, b, t, _ in ROWS])
    long = (" ".join(b for _, b, *_ in ROWS) * 40).encode()
    assert len(long) > common.SLICE_BYTES
    whole = T.words_of(long)
    fired = m.voters.fire(long)
    assert fired[m.voters.count] == sum(w in m.voters.telling for w in whole)


@pytest.mark.parametrize("f, column", [(T, "toxic"), (Q, "quality")])
def test_only_long_texts_are_labelled(spark, f, column):
    """Texts above the window bound teach by windows from their whole length."""
    bad = lambda i: " ".join(prose(1) for _ in range(9000)) + " you moron scum grumblefink!!" * 700 if column == "toxic" else " | ".join(prose(1).upper() for _ in range(9000))
    rows = [(i, bad(i) if i % 2 else " ".join(prose(8) for _ in range(1500))) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").cache()
    labels = spark.createDataFrame([(i, i % 2 if column == "toxic" else 1 - i % 2) for i, _ in rows], f"doc_id long, {column} int")
    assert min(len(t) for _, t in rows) > f.TRAIN_TEXT
    out = (T.toxicity if column == "toxic" else Q.quality)(docs, labels).collect()
    truth = {i: i % 2 if column == "toxic" else 1 - i % 2 for i, _ in rows}
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.9


def test_sample_is_one_text_an_id_within_bytes(spark):
    """60,000 rows of one labelled id are one; the byte bound ends the sample."""
    from pyspark.sql import functions as F

    hot = spark.range(60_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("hot text "), F.col("id").cast("string")).alias("text"))
    docs = hot.unionByName(spark.range(2, 400).select(F.col("id").alias("doc_id"), F.concat(F.lit("some text "), F.col("id").cast("string")).alias("text")))
    labels = spark.range(1, 400).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic")).unionByName(spark.range(70_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(0).alias("toxic")))
    all_of = labelled.labelled_sample(docs, labels, "toxic", 8000, 1 << 16, 1 << 20)
    assert [t for t, _ in all_of if t.startswith(b"hot")] == [b"hot text 0"] and 250 < len(all_of) < 400
    few = labelled.labelled_sample(docs, labels, "toxic", 8000, 1 << 16, 200)
    assert 0 < sum(len(t) for t, _ in few) <= 200 and set(few) < set(all_of)


def test_a_text_of_50_mb_takes_little_beside_itself():
    """The working memory of both scorers stays within a few times the text."""
    import tracemalloc

    text = b"tree house river. " * (50 * 1024 * 1024 // 18)
    t, q = T.train([(b.encode(), t) for _, b, t, _ in ROWS]), Q.train([(b.encode(), q) for _, b, _, q in ROWS])
    for score in (lambda: t.score(text), lambda: q.scores([text])):
        tracemalloc.start()
        score()
        assert tracemalloc.get_traced_memory()[1] < 6 * len(text)
        tracemalloc.stop()
