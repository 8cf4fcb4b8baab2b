import hashlib
import random
import re

import pyarrow as pa
import pytest

from hoplite.llm import decontaminate as D


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(10, len(w))
        for i in range(len(w) - k + 1) if w else ():
            windows.setdefault(tuple(w[i : i + k]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if (owners := windows.get(tuple(w[i : i + k]))) is not None:
                    hit.update(range(i, i + k))
                    found |= owners
        names = sorted({str(x) for x in found if x is not None})
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def made(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Ünder", "x1", "日本", "a", "b", "C"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 3, 5, 9, 10, 11, 25]))) for i in range(12)] + [(3, None), (None, text(12)), (7, "the of the of the of the of the of the of")]
    docs = [(i, text(rng.randint(0, 30))) for i in range(40)]
    docs += [(100 + i, f"{text(7)} {t} {text(7)}") for i, (_, t) in enumerate(items) if t] + [(None, None), (1, ""), (1, "  "), (2, "the " * 3000)]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    docs, items = made(seed)
    got = D.contamination(spark.createDataFrame([(a, b, "x", [1]) for a, b in docs], "doc_id long, text string, n_words string, hit array<int>"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items)


def test_blocks_of_the_benchmark(spark, monkeypatch):
    docs, items = made(3)
    monkeypatch.setattr(D, "BLOCK_BYTES", 200)
    got = D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items)


@pytest.mark.parametrize("docs, items", [([], [(1, "a b")]), ([(1, "a b")], []), ([], [])])
def test_empty_tables(spark, docs, items):
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(tuple(r) for r in D.contamination(d, b).collect()) == brute(docs, items)
    assert D.clean_only(d, b).count() == len(docs)


def test_clean_only_goes_by_rows(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"x {passage} y", "en"), (1, "clean", "en"), (None, None, None), (2, passage[:20], "en")], "doc_id long, text string, lang string")
    out = D.clean_only(docs, spark.createDataFrame([(9, passage)], "item_id long, text string"))
    assert out.columns == docs.columns and sorted(map(str, (r.text for r in out.collect()))) == sorted(["clean", "None", passage[:20]])


def test_clean_only_in_blocks(spark, monkeypatch):
    docs, items = made(4)
    monkeypatch.setattr(D, "BLOCK_BYTES", 150)
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in docs], "doc_id long, text string, row int, block int")
    out = D.clean_only(df, spark.createDataFrame(items, "item_id long, text string"))
    assert out.columns == df.columns
    clean = [(d, t) for d, t in docs if not brute([(d, t)], items)[0][5]]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(clean, key=str)


def test_a_block_takes_about_five_bytes_for_each_of_text():
    import pickle

    rng = random.Random(1)
    items = [(str(i), " ".join(rng.choice("abcdefgh") * rng.randint(2, 9) for _ in range(200))) for i in range(400)]
    assert len(pickle.dumps(D.Block(iter(items)))) < 8 * sum(len(t) for _, t in items)


def test_windows_of_equal_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(D, "window_hashes", lambda h, k: D.mixed(h[: max(0, len(h) - k + 1)] * 0))
    block = D.Block(iter([("p", "one two three"), ("q", "four five six")]))
    monkeypatch.setattr(D, "windows_at", lambda h, starts, k: D.mixed(h[starts] * 0))
    assert list(block.hits(D.Words(pa.array(["no", "four five six seven", "one two"]), D.ALPHANUMERIC))) == [(1, 3, {1})]
