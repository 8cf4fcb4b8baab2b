import random
import re

import numpy as np
import pyarrow as pa
import pytest

from hoplite.llm import common as C

rng = random.Random(12)
TEXTS = [None, "", " ", "a", "A b\x0bC", "x" * 40 + " y", None, "\x00 \u00a0é É\u2028z", "end", ""] + ["".join(rng.choice("aB c\n1-é日\x00") for _ in range(rng.randint(0, 60))) for _ in range(200)]
PATTERNS = {"SPACED": "[^\x20\x09-\x0d]+", "ALPHANUMERIC": "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"}


def plain(text, pattern):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [w.encode() for w in re.findall(pattern, low)]


@pytest.mark.parametrize("name", PATTERNS)
@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_words(name, kind):
    w = C.Words(pa.array(["cut off", *TEXTS, "cut"], kind)[1:-1], getattr(C, name))
    for t, text in enumerate(TEXTS):
        expected = plain(text, PATTERNS[name])
        mine = range(w.bounds[t], w.bounds[t + 1])
        assert [w.text(i) for i in mine] == expected
        assert w.hashes[mine.start : mine.stop].tolist() == C.word_hashes(expected).tolist()
        assert w.room()[mine.start : mine.stop].tolist() == list(range(len(expected), 0, -1))
    assert w.text(int(w.bounds[5]), 2) == b"x" * 40 + b" y"


def test_no_texts():
    assert len(C.Words(pa.array([], pa.string()))) == 0 and len(C.Words(pa.array([None, None], pa.string()))) == 0


def test_hashes_part_words():
    words = list({rng.randbytes(rng.randint(1, 30)) for _ in range(20000)} | {bytes([a, b]) for a in range(256) for b in range(256)} | {b"a" * n for n in range(1, 400)})
    h = C.word_hashes(words)
    assert len(np.unique(h)) == len(words)
    for bits in (h, h >> np.uint64(40), h << np.uint64(40)):  # spread over all bits
        assert len(np.unique(bits)) > 0.99 * len(words)


def test_windows_at_places():
    h = C.word_hashes([bytes([i]) for i in range(50)])
    for k in (1, 3, 10):
        assert C.windows_at(h, np.arange(51 - k), k).tolist() == C.window_hashes(h, k).tolist()


def test_smaller_settings_of_the_session_stay(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for given, kept in (("10", "10"), ("50000", str(C.BATCH_ROWS)), ("0", str(C.BATCH_ROWS))):
            spark.conf.set(key, given)
            C.small_batches(spark)
            assert spark.conf.get(key) == kept
    finally:
        spark.conf.set(key, before)
