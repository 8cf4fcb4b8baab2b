import gzip
import hashlib

import pytest

from hoplite.llm import warc as W


def brute(rows):
    pay = [(i, (h or "").encode("utf-8")) for i, h in rows]
    first = {}
    for i, p in pay:
        if len(p) >= 100 and i is not None:
            first[p] = min(first.get(p, i), i)
    several = {p for p in first if sum(q == p for _, q in pay) > 1}
    out = []
    for i, p in pay:
        ref = first[p] if p in several and first[p] != i else None
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "response" if ref is None else "revisit", ref))
    return sorted(out, key=str)


ROWS = [(3, "x" * 100), (1, "x" * 100), (2, "x" * 99), (4, "x" * 99), (5, None), (6, ""), (7, "ü\r\n\r\n日" * 40), (8, "ü\r\n\r\n日" * 40), (1, "x" * 100), (None, "x" * 100), (9, "y" * 3_000_000), (10, "WARC/1.1\r\nContent-Length: 5\r\n\r\n"), (11, "\x1f\x8b\x08" * 50)]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://x/{i}\r\nEvil: 1", h, "clash", 1) for i, h in ROWS], "page_id long, url string, html string, digest string, first int")
    W.write_archives(df, str(tmp_path / "w"))
    got = W.read_archives(spark, str(tmp_path / "w")).collect()
    num = lambda x: int(x) if x else None
    assert sorted(((num(r.id), r.payload_bytes, r.payload_digest, r.record_type, num(r.refers)) for r in got), key=str) == brute(ROWS)


def test_empty_table(spark, tmp_path):
    W.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert W.read_archives(spark, str(tmp_path / "w")).count() == 0


def test_files_are_plain_multi_member_gzip(spark, tmp_path):
    W.write_archives(spark.createDataFrame([(1, None, "a"), (2, "u", "b")], "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("part-*")))
    assert raw.count(b"WARC/1.1\r\n") == 2 and raw.endswith(b"b\r\n\r\n")


def test_reader_finds_faults():
    good = W.record_bytes("response", "1", "u", b"payload")
    assert W.read_record(next(W.members(good + W.EMPTY_MEMBER)))[2:5] == (7, hashlib.sha256(b"payload").hexdigest(), "response")
    with pytest.raises(W.CorruptArchive):
        list(W.members(good[:-3]))
    with pytest.raises(W.CorruptArchive):
        list(W.members(b"no archive"))
    plain = gzip.decompress(good)
    for bad in (plain.replace(b"payload", b"pAyload"), plain[:-1], b"junk\r\n\r\n", plain.replace(b"Content-Length: 7", b"Content-Length: 8")):
        with pytest.raises(W.CorruptArchive):
            W.read_record(bad)


def test_members_in_small_pieces(monkeypatch):
    monkeypatch.setattr(W, "FEED", 3)
    two = W.record_bytes("response", "1", None, b"a" * 500) + W.EMPTY_MEMBER + W.record_bytes("revisit", "2", None, b"a" * 500, "1")
    assert [W.read_record(m)[4:] for m in W.members(two)] == [("response", None), ("revisit", "1")]


def test_ids_of_any_text(spark, tmp_path):
    """Empty ids, line ends, percent signs and the writer's own markers come back as they were; nothing is injected."""
    ids = ["", "a\r\nContent-Length: 3", "50%25", "<urn:nobody>", ">", "日本", " x ", None]
    rows = [(i, "u\r\nWARC-Type: x", f"payload {n % 4} " * 20) for n, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    W.write_archives(df, str(tmp_path / "w"))
    got = {(r.id, r.record_type, r.refers, r.payload_bytes) for r in W.read_archives(spark, str(tmp_path / "w")).collect()}
    expected = set()
    for n, (i, _, html) in enumerate(rows):
        first = min(x for x in (ids[n % 4], ids[n % 4 + 4]) if x is not None)
        expected.add((i, "response" if i == first else "revisit", None if i == first else first, len(html)))
    assert got == expected


def test_archives_are_bounded_by_bytes(spark, tmp_path):
    """Large pages that lie together, behind many small ones: no archive outgrows the bound by more than a record."""
    import random

    rng = random.Random(1)
    rows = [(i, "u", "s" * 10) for i in range(300)] + [(1000 + i, "u", rng.randbytes(15_000).hex()) for i in range(30)]
    W.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"), file_bytes=40_000)
    sizes = [p.stat().st_size for p in (tmp_path / "w").glob("part-*")]
    assert len(sizes) > 8 and max(sizes) < 40_000 + 20_000
    got = W.read_archives(spark, str(tmp_path / "w"))
    assert sorted(int(r.id) for r in got.select("id").collect()) == sorted(i for i, _, _ in rows)
