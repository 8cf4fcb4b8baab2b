import numpy as np
import pytest

from hoplite.llm import topk as T


def brute(rows, k, every):
    ok = [(i, [int(np.floor(1024 * float(np.float32(c)))) for c in v]) for i, v in rows if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for q in sorted({i for i, _ in ok if i is not None and i % every == 0}):
        x = min(v for i, v in ok if i == q)
        hits = sorted((-sum(a * b for a, b in zip(x, v)), i is None, i or 0) for i, v in ok if i != q and len(v) == len(x))
        out += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(hits[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed, spread", [(1, 1.0), (2, 0.01), (3, 900.0)])
def test_against_brute_force(spark, seed, spread):
    rng = np.random.default_rng(seed)
    rows = [(int(i), (rng.normal(size=8) * spread).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300, None), (310, []), (320, [float("nan")] + [0.0] * 7), (330, [None] + [0.0] * 7), (340, [float("inf")] * 8), (350, [0.0] * 8), (360, [1.0, 2.0]), (361, [1.0, -2.0]), (None, rows[5][1]), (20, rows[7][1])]
    rows += [rows[11]] * 12  # ties of equal ids
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "vec_id long, embedding array<float>, score int, rank int")
    assert sorted((tuple(r) for r in T.top_k(df, 10, 10).collect()), key=str) == brute(rows, 10, 10)


def test_groups_of_queries(spark, monkeypatch):
    monkeypatch.setattr(T, "GROUP_CELLS", 20)
    rows = [(i, [float(i % 7), float(i % 3), 1.0, -0.5]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted((tuple(r) for r in T.top_k(df, 3, 5).collect()), key=str) == brute(rows, 3, 5)


@pytest.mark.parametrize("rows", [[], [(0, [1.0])], [(7, [1.0])]])
def test_too_few_rows(spark, rows):
    assert T.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect() == []


@pytest.mark.parametrize("dropped", [0, 1, 3, 6])
def test_candidates_hold_the_best(dropped):
    rng = np.random.default_rng(dropped)
    rows = rng.integers(-500, 500, (777, 12))
    block = T.Slices.of(rows, dropped)
    for _ in range(20):
        q = rng.integers(-500, 500, 12)
        scores = rows @ q
        least = np.sort(scores)[-10]
        assert set(np.flatnonzero(scores >= least)) <= set(block.candidates(q, 10).tolist())


def test_wide_components_are_exact(spark):
    """Components far beyond 64-bit products, among narrow ones: ranked exactly, shown within 64 bits."""
    rows = [(i, [float(i - 20), 1.0, -2.5]) for i in range(40)] + [(100, [1e7, 3.0, 1.0]), (101, [1e7, 3.0, 1.0009765625]), (110, [-1e300, 1e300, 1.0]), (111, [1e38, 5.0, 0.1]), (120, [3e5, -7e6, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    exact = {i: [(int(c) if abs(c) >= 2**53 else None, c) for c in v] for i, v in rows}
    number = {i: [w * 1024 if w is not None else int(np.floor(c * 1024)) for w, c in v] for i, v in exact.items()}
    got = {}
    for r in T.top_k(df, 12, 10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == [i for i, _ in rows if i % 10 == 0]
    for q, found in got.items():
        hits = sorted((-sum(a * b for a, b in zip(number[q], v)), i) for i, v in number.items() if i != q)[:12]
        assert sorted(found) == [(r + 1, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(hits)]


def test_order_keys_sort_as_numbers():
    rng = np.random.default_rng(4)
    numbers = [0, 1, -1, 127, 128, 255, 256, -127, -128, -129, -256, 2**63, -(2**63), 2**2000, -(2**2000)] + [int(x) * 10 ** int(e) for x, e in zip(rng.integers(-99, 99, 200), rng.integers(0, 90, 200))]
    assert sorted(numbers) == sorted(numbers, key=T.order_key)


def test_small_blocks_and_groups(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(8)
    rows = [(int(i), rng.normal(size=3).astype(np.float32).tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    assert sorted((tuple(r) for r in T.top_k(df, 4, 9).collect()), key=str) == brute(rows, 4, 9)
