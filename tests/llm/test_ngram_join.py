import random

import numpy as np
import pytest

from hoplite.llm import ngram_join as N


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(rows):
    """Components by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    return sorted(((d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=key)


def made(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    docs = []
    for base in ([rng.choice(words) for _ in range(rng.randint(30, 80))] for _ in range(4)):
        for _ in range(16):
            d = list(base)
            for _ in range(rng.randint(0, 3)):
                d[rng.randrange(len(d))] = rng.choice(words)
            docs.append(" ".join(d))
    docs += [" ".join(docs[0].split()[:20] + [rng.choice(words) for _ in range(25)]) for _ in range(6)]
    docs += [None, "", " \t", "a b", "A  B", "a b c d e", "x", docs[0], docs[0]]
    return [(i * 3, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize("seed, widest", [(1, 64), (2, 4)])
def test_components(spark, seed, widest):
    rows = made(seed) + ([(None, made(seed)[0][1]), (None, "only without id"), (0, made(seed)[0][1])] if seed == 1 else [])
    df = spark.createDataFrame([(a, b, 1, "z") for a, b in rows], "doc_id long, text string, g int, comp string")
    got = N.ngram_components(df, widest=widest, block=3).collect()
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == brute(rows)


def test_empty_table(spark):
    assert N.ngram_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_one_of_each_group(spark):
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "other words of this one"), (None, None), (4, None)]
    df = spark.createDataFrame([(a, b, "s") for a, b in rows], "doc_id long, text string, source string")
    out = N.one_of_each_group(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in out.collect()) == [(False, 0), (True, 1), (True, 2), (True, 4)]


def test_one_of_each_group_tells_rows_of_an_id_apart(spark):
    x, y, z = "a b c d e f", "other words of this one", "nothing like those two at all"
    rows = [(7, y), (7, z), (3, x), (7, x), (7, z), (8, x), (None, "p q r s t u"), (None, "p q r s t u"), (None, "P q r s t u"), (None, z), (None, None), (None, None), (9, ""), (9, "")]
    out = N.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, (r.text or "").lower()) for r in out)
    assert got == [(-1, ""), (-1, ""), (-1, "p q r s t u"), (3, x), (7, z), (7, y), (9, ""), (9, "")]


def test_sketches_never_lose_a_link():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(5, 400))
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(len(a) * rng.uniform(0.7, 1))], rng.integers(0, 1 << 62, int(rng.integers(0, n // 3 + 1))).astype(np.uint64)]))
        k = len(np.intersect1d(a, b))
        if 100 * k >= 80 * (len(a) + len(b) - k):
            x, y = N.sketch(a), N.sketch(b)
            words = min(len(x), len(y)) // 8
            assert N.can_link(len(a), len(b), N.folded([x], words), N.folded([y], words), 80)[0]


def test_components_of_a_long_chain(spark):
    from hoplite.llm.components import connected_components
    from hoplite.plans.workspace import Workspace

    order = list(range(40))
    random.Random(4).shuffle(order)
    links = spark.createDataFrame(list(zip(order, order[1:])) + [(100, 101)], "a long, b long")
    got = {r.id: r.comp for r in connected_components(links, Workspace(spark, "chain")).collect()}
    assert got == {**{i: 0 for i in order}, 100: 100, 101: 100}


def _scan(spark, rows, work):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = spark.sparkContext.broadcast((np.empty(0, np.uint64), np.empty(0, np.int64)))
    return docs, N.scanned(docs, order, 80, 64, work)


@pytest.mark.parametrize("partners", [1, 256])
def test_verification_is_exact(spark, monkeypatch, partners):
    """Pairs at the border of the threshold, partners dealt to parts, rows that repeat, and a partner that fails."""
    from hoplite.plans.workspace import Workspace

    monkeypatch.setattr(N, "PARTNERS", partners)
    w = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(w[:44])), (2, " ".join(w[:49])), (3, " ".join(w[:54])), (4, " ".join(w[5:44])), (5, " ".join(w[20:])), (2, " ".join(w[:49])), (None, " ".join(w[:45]))]
    with Workspace(spark, "verify") as work:
        docs, scan = _scan(spark, rows, work)
        name = {r.doc_id: r.g for r in scan.collect()}
        pairs = spark.createDataFrame([(name[1], name[x]) for x in (2, 3, 4, 5, None)] + [(name[2], name[3])], "a long, b long")
        back = {g: d for d, g in name.items()}
        got = {(back[r.a], back[r.b]) for r in N.verified(pairs, docs, scan, 80, work, "t").collect()}
    jaccard = lambda x, y: len(shingles(x) & shingles(y)) / len(shingles(x) | shingles(y))
    text = dict(rows)
    assert got == {(a, b) for a, b in [(1, 2), (1, 3), (1, 4), (1, 5), (1, None), (2, 3)] if jaccard(text[a], text[b]) >= 0.8}
    assert (1, 5) not in got and (1, 2) in got


def test_sets_that_share_a_first_digest(spark, monkeypatch):
    """A 64-bit accident is told apart by the second digest."""
    honest = N.set_ids
    monkeypatch.setattr(N, "set_ids", lambda s: (7, honest(s)[1]))
    rows = [(i, f"some words of text number {i // 2} here") for i in range(8)]
    got = N.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(i, i // 2 * 2) for i in range(8)]


@pytest.mark.parametrize("broadcast", [0, 1_000_000])
def test_long_columns_by_blocks(spark, monkeypatch, broadcast):
    """Columns of many sizes and groups that no pivot joins, with and without broadcasts; blocks of two."""
    monkeypatch.setattr(N, "BROADCAST_IDS", broadcast)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    common = [rng.choice(words) for _ in range(12)]
    docs = []
    for size in (12, 14, 18, 25, 40, 60):
        for _ in range(4):
            base = common + [rng.choice(words) for _ in range(size - 12)]
            for _ in range(3):
                d = list(base)
                if size > 20:
                    d[rng.randrange(12, size)] = rng.choice(words)
                docs.append(" ".join(d))
    rows = list(enumerate(docs))
    rng.shuffle(rows)
    got = N.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), widest=3, block=2).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


def test_long_columns_of_one_group_of_copies(spark):
    """A group beyond COLUMN, of near copies: one component, and its exact copies with it."""
    rng = random.Random(13)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(150):
        d = list(base)
        for _ in range(rng.randint(0, 2)):
            d[rng.randrange(200)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(d)))
    got = N.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


def test_rows_of_near_copies_meet_once(spark, monkeypatch):
    """Copies further apart than a link, which have many long columns in common: few rows go to pairs of blocks, and no link is lost."""
    rng = random.Random(17)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(240):
        d = list(base)
        for _ in range(rng.randint(1, 4)):
            d[rng.randrange(150)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(d)))
    honest, made = N._dealt, []

    def dealt(*args):
        out = honest(*args)
        made.append(0 if out is None else out.count())
        return out

    monkeypatch.setattr(N, "_dealt", dealt)
    got = N.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), widest=8, block=16).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)
    assert 0 < max(made) <= 20 * len(rows)


def test_groups_of_long_columns(spark):
    """Columns with the same sets become one group; those that only their core has in common stay apart."""
    from hoplite.plans.workspace import Workspace

    rows = [(s, g, 9) for s in (1, 2, 3) for g in range(100, 110)] + [(s, g, 9) for s in (4, 5, 6) for g in [200, *range(1000 * s, 1000 * s + 9)]]
    with Workspace(spark, "groups") as work:
        members, cores = N.grouped(spark.createDataFrame(rows, "s long, g long, n int"), work)
        found = {r.s: r.core for r in cores.collect()}
        got = sorted((r.s, r.g) for r in members.collect())
    core = next(s for s in found if s >= 100)
    assert found == {core: core, 4: 200, 5: 200, 6: 200}
    assert got == sorted([(core, g) for g in range(100, 110)] + [(s, g) for s, g, _ in rows if s in (4, 5, 6)])


@pytest.mark.parametrize("percent", [40, 60, 95])
def test_other_thresholds(spark, percent):
    rows = [(i, t) for i, t in made(5) if i is not None][:60]
    got = {r.doc_id: r.component_id for r in N.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent, widest=4, block=3).collect()}
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            k = len(sets[i] & sets[j])
            if j < i and k and 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert got == {i: root(i) for i in sets}


def test_groups_with_clashing_columns(spark):
    rows = [(3, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (7, "other words of this one"), (None, "a b c d e f")]
    names = ["_row", "_key", "key", "doc", "row", "g", "gone", "kept", "comp", "n"]
    df = spark.createDataFrame([(a, b, *range(len(names))) for a, b in rows], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    out = N.one_of_each_group(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(3, "a b c d e f"), (7, "other words of this one")]
