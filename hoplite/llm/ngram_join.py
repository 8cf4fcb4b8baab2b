"""N-gram Jaccard self-join of documents.

The document by shingle incidence matrix is multiplied with its transpose in
blocks, over the shingles that a pair above the threshold cannot avoid: with a
global order of shingles, two sets of Jaccard similarity ``t`` or more share a
shingle among the first ``n - ceil(t n) + 1`` of each. The order puts
shingles that are frequent in a sample last; any order gives the same links, this one
keeps the matrix' columns short.

* Columns of at most ``COLUMN`` documents are multiplied in one pass over
  the incidence sorted by shingle. Overlap counts accumulate per pair, and pairs
  below bounds that follow from the two sizes are dropped.
* In longer columns (large groups of near copies, passages that many documents
  consist of) every document is paired with one pivot.
* Pairs are verified on complete shingle sets in two rounds: first one partner of each document, which joins most groups,
  then those pairs whose ends are still in different components and whose bitmap sketches leave a link possible. For
  a verification the text of a document goes to the tasks of its partners, in parts where these are many.
* Long columns that share most of their documents are then taken as one: near copies have many columns in common, and meet once.
  What shares a component with the core of such a group, a document of all its columns, need not be compared among itself; the
  remaining documents are multiplied with each other and with the core's component, block by block, blocks being
  cut by size so that only those of neighbouring sizes meet, after sketches have ruled out the rows that cannot link. Of m documents
  there are about sqrt(m / BLOCK) blocks, so the rows that are dealt to pairs of blocks grow with m to the power of 1.5.

Long columns may be hot keys: what there is once per column is broadcast while it is small, beyond that it is
copied to ``PARTS`` parts of each column.

Words and shingles are compared by 64-bit hashes, whole sets by two of them: sets whose first digests are equal by accident are told
apart by the second and named anew. Intermediate tables are deleted as soon as their readers have been written.

Defined results: null and blank texts have size 0 and no links; equal sets are one class and
count as linked; rows that repeat a doc_id each get a row; a null doc_id gets a
row but never names a component (which is null if no member has an id).
Columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hoplite.llm.common import Words, batches_of, small_batches, table, window_hashes
from hoplite.llm.components import connected_components
from hoplite.plans.workspace import Workspace, within

#: Documents that share a column are multiplied in one task up to this many; beyond it by pivot and block.
COLUMN = 64
#: Rows of a block of a group of long columns while one is enough, and rows that a block's product takes at a time.
BLOCK = 256
#: One document in so many is counted to order shingles by frequency, and the most frequent kept for that.
ORDER_SAMPLE, ORDER_SIZE = 8, 1 << 18
#: Ids sent to every executor at once at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Parts of a long column where what it has once can't be broadcast.
PARTS = 64
#: Partners that one task verifies against a document.
PARTNERS = 64
#: Shingles in a window.
SIZE = 5


def shingle_sets(column: pa.Array, size: int = SIZE) -> list[np.ndarray]:
    """For each text, its sorted distinct 64-bit shingle hashes."""
    words = Words(column)
    windows = window_hashes(words.hashes, size)
    bounds = words.bounds.tolist()
    whole = lambda lo, hi: window_hashes(words.hashes[lo:hi], hi - lo) if hi > lo else np.empty(0, np.uint64)
    return [np.unique(windows[lo : hi - size + 1]) if hi - lo >= size else whole(lo, hi) for lo, hi in zip(bounds, bounds[1:])]


def set_ids(shingles: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit digests of a whole set; the first stands for all documents with that set."""
    both = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return tuple(int(np.uint64(x).view(np.int64)) for x in (both >> 64, both & 0xFFFFFFFFFFFFFFFF))


def sketch(shingles: np.ndarray) -> bytes:
    """A bitmap of two to four bits per shingle; one of half the length is the union of its halves."""
    size = max(64, 1 << (2 * len(shingles) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[(shingles >> np.uint64(8)) & np.uint64(size - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def folded(sketches: list[bytes], words: int) -> np.ndarray:
    """Sketches of one length, as rows of 64-bit words, halved until they have ``words``."""
    out = np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)
    while out.shape[1] > words:
        half = out.shape[1] // 2
        out = out[:, :half] | out[:, half:]
    return out


def can_link(na, nb, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """False where the bits that one sketch has alone leave too small an overlap; never false for a link."""
    only_a = np.bitwise_count(a & ~b).sum(axis=-1, dtype=np.int64)
    only_b = np.bitwise_count(b & ~a).sum(axis=-1, dtype=np.int64)
    return np.minimum(na - only_a, nb - only_b) * (100 + percent) >= percent * (na + nb)


def prefix_length(n, percent: int):
    """Shingles, first in the global order, of which a linked partner shares one."""
    return n - -(-percent * n // 100) + 1


def _sample_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        u, c = np.unique(np.concatenate([*shingle_sets(batch.column(0)), np.empty(0, np.uint64)]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c.astype(np.int64))], ["s", "c"])


def frequent_shingles(docs: DataFrame, work: Workspace) -> tuple[np.ndarray, np.ndarray]:
    """At most ORDER_SIZE of the sample's most frequent shingles, sorted, with their counts."""
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(ORDER_SAMPLE)) == 0).select("text")
    counts = work.put(chosen.mapInArrow(_sample_scan, "s long, c long").groupBy("s").agg(F.sum("c").alias("c")).where("c > 1"), "order")
    levels = counts.groupBy(F.floor(F.log2("c") * 4).alias("lv")).agg(F.count("*").alias("k"), F.min("c").alias("least")).orderBy(F.desc("lv")).collect()
    kept, least = 0, None
    for row in levels:
        kept += row.k
        if kept > ORDER_SIZE:
            break
        least = row.least
    if least is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    got = counts.where(F.col("c") >= least).toPandas()
    s, c = got.s.to_numpy(np.int64).view(np.uint64), got.c.to_numpy(np.int64)
    by = np.argsort(s)
    return s[by], c[by]


def _ranks(shingles: np.ndarray, heavy: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if not len(heavy):
        return np.zeros(len(shingles), np.int64)
    at = np.minimum(np.searchsorted(heavy, shingles), len(heavy) - 1)
    return np.where(heavy[at] == shingles, counts[at], 0)


def _scanner(order, percent: int, widest: int):
    """Per document: size, set digests, and its first shingles, those of long columns apart, with a sketch.

    The first document of a set in a task brings the shingles, the others only the digests.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, counts = order.value
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for s in shingle_sets(batch.column(2)):
                g, common, rare, bits = (None, None), None, None, None
                if len(s):
                    g = set_ids(s)
                    if g not in seen:
                        seen.add(g)
                        rank = _ranks(s, heavy, counts)
                        first = np.argsort(rank, kind="stable")[: prefix_length(len(s), percent)]
                        long = rank[first] * ORDER_SAMPLE >= widest
                        rare, common, bits = s[first[~long]].view(np.int64), s[first[long]].view(np.int64), sketch(s)
                for column, value in zip(out, (len(s), *g, rare, common, bits), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, t.type) for c, t in zip(out, _SCANNED, strict=True))], ["doc_id", "row", *_SCANNED.names])

    return scan


_SCANNED = pa.schema([("n", pa.int32()), ("g", pa.int64()), ("g2", pa.int64()), ("rare", pa.list_(pa.int64())), ("common", pa.list_(pa.int64())), ("sketch", pa.binary())])


def scanned(docs: DataFrame, order, percent: int, widest: int, work: Workspace) -> DataFrame:
    """``doc_id, row, n, g, rare, common, sketch`` of every document; ``row`` is a hash of id and text, ``g`` the name of its set."""
    key = docs.select("doc_id").schema.simpleString()[7:-1]
    numbered = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    scan = work.put(numbered.mapInArrow(_scanner(order, percent, widest), f"{key}, row long, n int, g long, g2 long, rare array<long>, common array<long>, sketch binary"), "scan")
    shared = scan.where("g is not null").groupBy("g").agg(F.min("g2").alias("one"), F.max("g2").alias("two")).where("one <> two").select("g")
    if shared.isEmpty():
        return scan.drop("g2")
    # sets that differ but share the first digest: about 3 in 10 billion
    again = F.when(F.col("_known"), F.xxhash64("g", "g2")).otherwise(F.col("g"))
    marked = scan.join(shared.withColumn("_known", F.lit(True)), "g", "left").withColumn("g", again)
    return work.put(marked.drop("_known", "g2"), "scan2")


def _close(a, b, percent: int):
    """The size bound: neither set is too small to reach the threshold with the other."""
    return np.int64(100) * np.minimum(a, b) >= np.int64(percent) * np.maximum(a, b)


def _columns(percent: int, widest: int):
    """Multiply the incidence, sorted by shingle and set, with its transpose: pairs of short columns, rows of long ones."""

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)]

        def flush(s, g, n) -> Iterator[pa.RecordBatch]:
            once = np.r_[True, (s[1:] != s[:-1]) | (g[1:] != g[:-1])]  # sets that several tasks have met
            s, g, n = s[once], g[once], n[once]
            start = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            size = np.diff(np.r_[start, len(s)])
            long = np.repeat(size > widest, size)
            if long.any():
                none = np.zeros(int(long.sum()), np.int64)
                yield rows_of(none + 1, s[long], g[long], n[long], none, none)
            for first in range(0, len(start), 200_000):  # bounds the pairs held at once
                st, sz = start[first : first + 200_000], size[first : first + 200_000]
                for width in np.unique(sz):
                    if 2 <= width <= widest:
                        rows = st[sz == width][:, None] + np.arange(width)
                        i, j = np.triu_indices(width, 1)
                        step = max(1, 4_000_000 // len(i))
                        for r in range(0, len(rows), step):
                            a, b = rows[r : r + step, i].ravel(), rows[r : r + step, j].ravel()
                            ok = _close(n[a], n[b], percent) & (g[a] != g[b])
                            a, b = a[ok], b[ok]
                            swap = g[a] > g[b]
                            a, b = np.where(swap, b, a), np.where(swap, a, b)
                            yield from counted(g[a], g[b], n[a], n[b])

        def counted(a, b, na, nb) -> Iterator[pa.RecordBatch]:
            if len(a):
                by = np.lexsort((b, a))
                a, b, na, nb = a[by], b[by], na[by], nb[by]
                st = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
                yield rows_of(np.zeros(len(st), np.int64), a[st], b[st], na[st], nb[st], np.diff(np.r_[st, len(a)]))

        def rows_of(*columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x.astype(t.type.to_pandas_dtype())) for x, t in zip(columns, PRODUCT, strict=True)], schema=PRODUCT)

        waiting, size = [], 0
        for batch in batches:
            waiting.append([c.to_numpy() for c in batch.columns])
            size += batch.num_rows
            if size >= AT_ONCE:
                got = [np.concatenate(x) for x in zip(held, *waiting, strict=True)]
                end = int(np.searchsorted(got[0], got[0][-1]))  # the last column may go on in the next batch
                if end:
                    yield from flush(*[x[:end] for x in got])
                held, waiting, size = [x[end:] for x in got], [], 0
        held = [np.concatenate(x) for x in zip(held, *waiting, strict=True)]
        if len(held[0]):
            yield from flush(*held)

    return product


PRODUCT = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("na", pa.int32()), ("nb", pa.int32()), ("k", pa.int32())])
#: Rows of the incidence multiplied at a time.
AT_ONCE = 1 << 18


def _owners(scan: DataFrame, ids: DataFrame) -> DataFrame:
    """``(g, row)``: for each of the sets ``ids(g)``, one document that has it."""
    return scan.where("rare is not null").select("g", "row").join(ids, "g", "left_semi").groupBy("g").agg(F.min("row").alias("row"))


def _with_text(docs: DataFrame, sent: DataFrame) -> DataFrame:
    """``sent(row, ...)`` with the texts; the documents stay where they are while what is sent is small."""
    hint = F.broadcast if within(sent, BROADCAST_IDS) else (lambda x: x)
    return docs.select(F.xxhash64("doc_id", "text").alias("row"), "text").join(hint(sent), "row")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(g, set)`` from ``(g, text)``, one row for each set in a task."""

    def rows():
        seen: set[int] = set()
        for batch in batches:
            for g, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1)), strict=True):
                if g not in seen:
                    seen.add(g)
                    yield g, s.view(np.int64)

    yield from batches_of(rows(), pa.schema([("g", pa.int64()), ("set", pa.list_(pa.int64()))]), 200)


def needed_sets(docs: DataFrame, scan: DataFrame, ids: DataFrame, work: Workspace, name: str) -> DataFrame:
    """Complete shingle sets ``(g, set)`` of the sets ``ids(g)``, made again from texts that have them."""
    owners = work.put(_owners(scan, ids.distinct()), f"{name}_own")
    made = _with_text(docs, owners).select("g", "text").mapInArrow(_sets, "g long, set array<long>")
    work.put(made, name)
    work.drop(f"{name}_own")
    out = work.spark.read.parquet(work.path(name))
    repeated = out.groupBy("g").count().where("count > 1")
    return out if repeated.isEmpty() else out.dropDuplicates(["g"])


def _verify(percent: int):
    """Links among ``(a, part, partner, g, text)`` in this order: the text of ``a`` itself comes first, then its partners'."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, x, last = None, None, None
        for batch in batches:
            a, g, found = batch.column(0).to_pylist(), batch.column(3).to_pylist(), ([], [])
            for p, partner, b, y in zip(a, batch.column(2).to_pylist(), g, shingle_sets(batch.column(4)), strict=True):
                if not partner:
                    pivot, x = p, y
                elif p == pivot and (p, b) != last:
                    at = np.searchsorted(x, y)
                    at[at == len(x)] = 0
                    k = int(np.count_nonzero(x[at] == y))
                    if 100 * k >= percent * (len(x) + len(y) - k):
                        found[0].append(p)
                        found[1].append(b)
                last = p, b
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], ["a", "b"])

    return check


_MOVED = "a long, part int, partner boolean, g long, text string"


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first of equal ``(a, part, partner, g)`` in a task."""
    seen: set[tuple] = set()
    for batch in batches:
        keys = list(zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True))
        fresh = [not (k in seen or seen.add(k)) for k in keys]
        yield batch.filter(pa.array(fresh, pa.bool_()))


def verified(pairs: DataFrame, docs: DataFrame, scan: DataFrame, percent: int, work: Workspace, name: str) -> DataFrame:
    """Those of ``pairs(a, b)`` whose complete sets reach the threshold. The partners b of one a are dealt to parts of
    PARTNERS; each part gets the texts of its partners and that of a."""
    pairs = work.put(pairs.select("a", "b"), f"{name}_pairs")
    parts = F.ceil(F.count("*") / PARTNERS).cast("int")
    sizes = work.put(pairs.groupBy("a").agg(parts.alias("parts")), f"{name}_sizes")
    hint = F.broadcast if within(sizes, BROADCAST_IDS) else (lambda x: x)
    partners = pairs.join(hint(sizes), "a").select(F.col("b").alias("g"), "a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("partner"))
    itself = sizes.select(F.col("a").alias("g"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("partner"))
    dealt = work.put(partners.unionByName(itself), f"{name}_dealt")
    owners = _owners(scan, dealt.select("g").distinct())
    sent = work.put(dealt.join(owners, "g").select("row", "a", "part", "partner", "g"), f"{name}_sent")
    count = max(int(work.spark.conf.get("spark.sql.shuffle.partitions")), 1)
    moved = _with_text(docs, sent).select("a", "part", "partner", "g", "text")
    repeated = scan.select("row").join(sent.select("row").distinct(), "row", "left_semi").groupBy("row").count().where("count > 1")
    if not repeated.isEmpty():  # rows with the id and the text of another
        moved = moved.mapInArrow(_once, _MOVED)
    moved = moved.repartition(count, "a", "part")
    out = work.put(moved.sortWithinPartitions("a", "part", "partner", "g").mapInArrow(_verify(percent), "a long, b long"), name)
    work.drop(*(f"{name}_{x}" for x in ("pairs", "sizes", "dealt", "sent")))
    return out


def _star_filter(percent: int):
    """Pairs whose sketches do not rule a link out."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, sa, sb = batch.columns
            keep = []
            for x, y, m, n in zip(sa.to_pylist(), sb.to_pylist(), na.to_pylist(), nb.to_pylist(), strict=True):
                words = min(len(x), len(y)) // 8
                keep.append(bool(can_link(m, n, folded([x], words), folded([y], words), percent)[0]))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])

    return check


def _sides(key, frame):
    """The rows of both blocks of a pair ``(s, level, i, side, other level, j)``; a block of the rest can meet itself."""
    left, right = frame[frame.side == 0], frame[frame.side == 1]
    return left, left if key[3] == 0 and key[1] == key[4] and key[2] == key[5] else right


def _possible(key, frame, percent: int):
    """For groups of rows of both blocks: their labels, which two may link by their sketches (in different components only), and how many bits
    the two sketches have apart."""
    left, right = _sides(key, frame)
    for la, a in left.groupby(left.sketch.map(len)):
        for lb, b in right.groupby(right.sketch.map(len)):
            words = min(la, lb) // 8
            fa, fb = folded(list(a.sketch), words), folded(list(b.sketch), words)
            na, nb, ca, cb = (x.to_numpy() for x in (a.n, b.n, a.comp, b.comp))
            step = max(1, (1 << 21) // (len(b) * words))  # bounds the bits held at once
            for lo in range(0, len(a), step):
                rows = slice(lo, lo + step)
                maybe = can_link(na[rows, None], nb[None], fa[rows, None], fb[None], percent)
                maybe &= _close(na[rows, None], nb[None], percent) & (ca[rows, None] != cb[None])
                if maybe.any():
                    yield a.index[rows].to_numpy(), b.index.to_numpy(), maybe, np.bitwise_count(fa[rows, None] ^ fb[None]).sum(axis=-1, dtype=np.int64)


def _block_filter(percent: int):
    """Rows of a pair of blocks that may link to another component, each two in the least group of columns that they share."""

    def rows(key, frame):
        stay: set[int] = set()
        of = {i: x.tolist() for i, x in frame.groups_of.items()}
        for left, right, maybe, _ in _possible(key, frame, percent):
            for r, i in enumerate(left.tolist()):
                if maybe[r].any():
                    mine = set(of[i])
                    here = [j for j in right[maybe[r]].tolist() if next(c for c in of[j] if c in mine) == key[0]]
                    if here:
                        stay.add(i)
                        stay.update(here)
        return frame.loc[sorted(stay), [*PAIR, "side", "g", "n", "comp"]]

    return rows


def _likeliest(percent: int):
    """For each row of a pair of blocks the partner whose sketch differs least."""

    def pairs(key, frame):
        import pandas as pd

        g = frame.g.to_dict()
        best: dict[int, tuple[int, int]] = {}
        far = np.iinfo(np.int64).max
        for left, right, maybe, apart in _possible(key, frame, percent):
            apart = np.where(maybe, apart, far)
            for mine, others, d in ((left, right, apart), (right, left, apart.T)):
                at = d.argmin(axis=1)
                least = d[np.arange(len(mine)), at]
                for x, y, k in zip(mine.tolist(), others[at].tolist(), least.tolist(), strict=True):
                    if k < far and (x not in best or (k, g[y]) < best[x]):
                        best[x] = k, g[y]
        found = {(min(g[x], other), max(g[x], other)) for x, (_, other) in best.items()}
        return pd.DataFrame(sorted(found), columns=["a", "b"], dtype="int64")

    return pairs


def _overlaps(left, right) -> np.ndarray:
    """Sizes of all intersections of two lists of sets by a product of their incidence matrices."""
    # only shingles that occur on both sides can overlap
    la, lb = np.concatenate(left), np.concatenate(right)
    vocabulary = np.intersect1d(la, lb)
    ra, rb = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    overlap = np.zeros((len(left), len(right)), np.float32)
    ca, cb = np.searchsorted(vocabulary, la), np.searchsorted(vocabulary, lb)
    ca[ca == len(vocabulary)], cb[cb == len(vocabulary)] = 0, 0
    ha, hb = (vocabulary[ca] == la, vocabulary[cb] == lb) if len(vocabulary) else (ca < 0, cb < 0)
    for c in range(0, len(vocabulary), 8192):
        ia, ib = np.zeros((len(left), 8192), np.float32), np.zeros((len(right), 8192), np.float32)
        for inc, row, col, hit in ((ia, ra, ca, ha), (ib, rb, cb, hb)):
            m = hit & (col >= c) & (col < c + 8192)
            inc[row[m], col[m] - c] = 1
        overlap += ia @ ib.T
    return overlap


def _block_product(percent: int, block: int):
    """All overlaps of two blocks, ``block`` rows of each at a time; links of different components come out."""

    def product(key, frame):
        import pandas as pd

        left, right = _sides(key, frame)
        found: list[tuple[int, int]] = []
        parent: dict[int, int] = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        slices = lambda side: [side.iloc[i : i + block] for i in range(0, len(side), block)]
        for a, b in ((a, b) for a in slices(left) for b in slices(right)):
            overlap = _overlaps(list(a["set"]), list(b["set"]))
            union = a.n.to_numpy()[:, None] + b.n.to_numpy()[None, :] - overlap
            ga, gb, pa_, pb_ = a.g.to_numpy(), b.g.to_numpy(), a.comp.to_numpy(), b.comp.to_numpy()
            i, j = np.nonzero((100 * overlap >= percent * union) & (pa_[:, None] != pb_[None, :]))
            for x, y in zip(i.tolist(), j.tolist(), strict=True):  # one link for each two components that meet
                p, q = root(int(pa_[x])), root(int(pb_[y]))
                if p != q:
                    parent[p] = q
                    found.append((int(ga[x]), int(gb[y])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return product


#: What names a pair of blocks.
PAIR = ["s", "level", "i", "kind", "other", "j"]


def by_column(rows: DataFrame, once: DataFrame) -> DataFrame:
    """``rows(s, g, ...)`` joined with what each long column has once."""
    if within(once, BROADCAST_IDS):
        return rows.join(F.broadcast(once), "s")
    copies = once.withColumn("_p", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    return rows.withColumn("_p", F.pmod(F.xxhash64("g"), F.lit(PARTS))).join(copies, ["s", "_p"]).drop("_p")


def star_pairs(rows: DataFrame, percent: int, work: Workspace) -> DataFrame:
    """``(a, b)``: in each long column of ``rows(s, g, n)`` every set with the pivot, where sizes leave a link possible."""
    pivots = work.put(rows.groupBy("s").agg(F.min(F.struct("n", "g")).alias("p")).select("s", F.col("p.g").alias("pivot"), F.col("p.n").alias("np")), "pivots")
    star = by_column(rows, pivots).where(f"g <> pivot and 100L * least(n, np) >= {percent} * greatest(n, np)")
    return star.select(F.least("pivot", "g").alias("a"), F.greatest("pivot", "g").alias("b")).distinct()


def named(rows: DataFrame, comp: DataFrame, column: str, out: str) -> DataFrame:
    """``rows`` with the component of the set in ``column``; one without links is its own."""
    return rows.join(comp.select(F.col("id").alias(column), F.col("comp").alias("_comp")), column, "left").withColumn(out, F.coalesce("_comp", column)).drop("_comp")


def joined(comp: DataFrame, links: DataFrame, work: Workspace, label: str) -> DataFrame:
    """Components ``(id, comp)`` after more ``links(a, b)``; only names of components meet again."""
    if links.isEmpty():
        return comp
    between = named(named(links, comp, "a", "x"), comp, "b", "y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    up = work.put(connected_components(work.put(between, f"{label}_between"), work, f"{label}_"), f"{label}_up")
    moved = named(comp.select("id", "comp"), up, "comp", "_new").select("id", F.col("_new").alias("comp"))
    fresh = up.join(comp.select("id"), "id", "left_anti")
    return work.put(moved.unionByName(fresh), label)


def grouped(rows: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """Long columns ``rows(s, g, n)`` as groups of columns, which hold each set once, and the core ``(s, core)`` of each group.

    A column goes with the other columns of the one of its sets that most long columns hold; that set is the core. Where such columns
    have so little in common that they take fewer pairs by themselves, each stays a group of its own.
    """
    held = rows.groupBy("g").agg(F.count("*").alias("k"))
    columns = rows.join(held, "g").groupBy("s").agg(F.max(F.struct("k", "g")).alias("core"), F.count("*").cast("double").alias("size"))
    columns = work.put(columns.select("s", "core.g", "size").withColumnRenamed("g", "core"), "cores")
    together = by_column(rows.select("s", "g"), columns.select("s", "core")).select("core", "g").distinct().groupBy("core").agg(F.count("*").cast("double").alias("all"))
    better = columns.groupBy("core").agg(F.sum(F.col("size") * F.col("size")).alias("pairs")).join(together, "core").where("`all` * `all` <= pairs").select("core")
    groups = columns.select("s", "core").join(better.withColumn("one", F.lit(True)), "core", "left").select("s", "core", F.when(F.col("one"), F.col("core")).otherwise(F.col("s")).alias("to"))
    groups = work.put(groups, "groups")
    members = work.put(by_column(rows, groups.select("s", "to")).select(F.col("to").alias("s"), "g", "n").distinct(), "members")
    return members, groups.groupBy(F.col("to").alias("s")).agg(F.min("core").alias("core"))


def _dealt(scan: DataFrame, rows: DataFrame, cores: DataFrame, comp: DataFrame, percent: int, block: int, work: Workspace, label: str) -> DataFrame | None:
    """The rows of all pairs of blocks of the groups ``rows(s, g, n)``, with sketches; None if every row shares the component of its group's core."""
    put = lambda df, name: work.put(df, f"{label}_{name}")
    known = named(rows, comp, "g", "comp").select("s", "g", "n", "comp")
    core = named(cores.withColumnRenamed("core", "g"), comp, "g", "core").select("s", "core")
    level = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / min(percent, 99))) + 1e-9).cast("int")
    tail = by_column(known, put(core, "core")).select("s", "g", "n", "comp", level.alias("level"), (F.col("comp") == F.col("core")).alias("in_core"))
    tail = put(tail, "tail")
    count = lambda what: F.ceil(F.sqrt(F.sum(what.cast("long")) / block)).cast("int")
    sizes = tail.groupBy("s", "level").agg(count(~F.col("in_core")).alias("rest"), count(F.col("in_core")).alias("core"))
    # one row a group: its blocks by level, of which there are as many as sizes have powers of 100 / percent
    maps = sizes.groupBy("s").agg(F.max("rest").alias("most"), *(F.map_from_entries(F.collect_list(F.struct("level", x))).alias(f"{x}s") for x in ("rest", "core")))
    maps = put(maps.where("most > 0").drop("most"), "levels")
    if maps.isEmpty():
        return None
    open_ = by_column(tail, maps)
    at = lambda m, shift: F.coalesce(F.try_element_at(m, F.col("level") + shift), F.lit(0))
    mine = F.when(F.col("in_core"), at("cores", 0)).otherwise(at("rests", 0))
    blocks = open_.withColumn("h", F.pmod(F.xxhash64("g"), mine).cast("int"))
    numbers = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def pair(level, i, kind, other, j, side):
        return F.struct(level.cast("int").alias("level"), i.alias("i"), F.lit(kind).alias("kind"), other.cast("int").alias("other"), j.alias("j"), F.lit(side).alias("side"))

    def with_core(d: int):
        return F.transform(numbers(at("cores", d)), lambda j: pair(l, h, 1, l + d, j, 0))

    def with_rest(d: int):
        return F.transform(numbers(at("rests", d)), lambda i: pair(l + d, i, 1, l, h, 1))

    l, h = F.col("level"), F.col("h")
    # a block of the rest is the left side: of itself and later ones of its level, of all one level up, and of the core's around it
    left = [F.transform(F.filter(numbers(at("rests", 0)), lambda j: j >= h), lambda j: pair(l, h, 0, l, j, 0)), F.transform(numbers(at("rests", 1)), lambda j: pair(l, h, 0, l + 1, j, 0)), *map(with_core, (-1, 0, 1))]
    right = [F.transform(F.filter(numbers(at("rests", 0)), lambda i: i < h), lambda i: pair(l, i, 0, l, h, 1)), F.transform(numbers(at("rests", -1)), lambda i: pair(l - 1, i, 0, l, h, 1))]
    of_core = [*map(with_rest, (-1, 0, 1))]
    every = F.when(F.col("in_core"), F.concat(*of_core)).otherwise(F.concat(*left, *right))
    dealt = blocks.select("s", "g", "n", "comp", F.explode(every).alias("e")).select("s", "e.*", "g", "n", "comp")
    wanted = dealt.select("g").distinct()
    sketches = put(scan.where("sketch is not null").select("g", "sketch").join(wanted, "g", "left_semi").groupBy("g").agg(F.min("sketch").alias("sketch")), "sketches")
    groups = put(rows.join(wanted, "g", "left_semi").groupBy("g").agg(F.sort_array(F.collect_list("s")).alias("groups_of")), "groups")
    return dealt.join(sketches.join(groups, "g"), "g")


def _in_blocks(docs: DataFrame, scan: DataFrame, rows: DataFrame, comp: DataFrame, percent: int, block: int, work: Workspace) -> DataFrame:
    """``comp`` after all links that long columns ``rows(s, g, n)`` add between components: first the likeliest partner of each row in each pair of
    blocks, then the product of what is left."""
    rows, cores = grouped(rows, work)
    dealt = _dealt(scan, rows, cores, comp, percent, block, work, "near")
    if dealt is None:
        return comp
    near = dealt.groupBy(*PAIR).applyInPandas(_likeliest(percent), "a long, b long").distinct()
    comp = joined(comp, verified(near, docs, scan, percent, work, "links3"), work, "comp3")
    work.drop("near_core", "near_tail", "near_levels", "near_sketches", "near_groups")
    dealt = _dealt(scan, rows, cores, comp, percent, block, work, "block")
    if dealt is None:
        return comp
    ddl = "s long, level int, i int, kind int, other int, j int, side int, g long, n int, comp long"
    maybe = work.put(dealt.groupBy(*PAIR).applyInPandas(_block_filter(percent), ddl), "maybe")
    work.drop("block_core", "block_tail", "block_levels", "block_sketches", "block_groups")
    if maybe.isEmpty():
        return comp
    sets = needed_sets(docs, scan, maybe.select("g"), work, "block_sets")
    links = work.put(maybe.join(sets, "g").groupBy(*PAIR).applyInPandas(_block_product(percent, block), "a long, b long"), "block_links")
    work.drop("maybe", "block_sets")
    return joined(comp, links, work, "comp4")


def _components(docs: DataFrame, scan: DataFrame, percent: int, widest: int, block: int, work: Workspace) -> DataFrame:
    """``(id, comp)`` of all sets with a link."""
    rare = scan.where("rare is not null").select(F.explode("rare").alias("s"), "g", "n")
    count = max(int(work.spark.conf.get("spark.sql.shuffle.partitions")), 1)
    multiplied = rare.repartition(count, "s").sortWithinPartitions("s", "g").mapInArrow(_columns(percent, widest), "kind int, a long, b long, na int, nb int, k int")
    product = work.put(multiplied, "product")
    na, nb = F.col("na").cast("long"), F.col("nb").cast("long")
    least = F.ceil(F.lit(percent) * (na + nb) / F.lit(100 + percent))
    beyond = F.ceil(F.lit(percent) * F.greatest(na, nb) / 100) - 1  # outside the first shingles of either
    pairs = product.where("kind = 0").groupBy("a", "b", "na", "nb").agg(F.sum("k").alias("k")).where(F.col("k") + beyond >= least).select("a", "b")
    common = scan.where("size(common) > 0").select(F.explode("common").alias("s"), "g", "n").unionByName(product.where("kind = 1").select(F.col("a").alias("s"), F.col("b").alias("g"), F.col("na").alias("n")))
    common = work.put(common.distinct(), "common")
    long = not common.isEmpty()
    if long:
        pairs = pairs.unionByName(star_pairs(common, percent, work)).distinct()
    pairs = work.put(pairs, "pairs")
    work.drop("product")
    # one partner of each set, then what is still open between components
    first = verified(pairs.groupBy("b").agg(F.min("a").alias("a")), docs, scan, percent, work, "links1")
    comp = work.put(connected_components(first, work), "comp1")
    apart = work.put(named(named(pairs, comp, "a", "x"), comp, "b", "y").where("x <> y").select("a", "b"), "apart")
    work.drop("pairs")
    if not apart.isEmpty():
        ids = apart.select(F.explode(F.array("a", "b")).alias("g")).distinct()
        sketches = work.put(scan.where("sketch is not null").select("g", "n", "sketch").join(ids, "g", "left_semi").groupBy("g", "n").agg(F.min("sketch").alias("sketch")), "sketches")
        side = lambda x: sketches.select(F.col("g").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
        maybe = apart.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_star_filter(percent), "a long, b long")
        second = verified(maybe, docs, scan, percent, work, "links2")
        comp = joined(comp, second, work, "comp2")
        work.drop("sketches", "apart")
    if long:
        comp = _in_blocks(docs, scan, common, comp, percent, block, work)
    return comp


def _linked(docs: DataFrame, percent: int, widest: int, block: int, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """The scan of ``docs(doc_id, text)``, and the components ``(id, comp)`` of its sets."""
    spark = docs.sparkSession
    small_batches(spark)
    order = spark.sparkContext.broadcast(frequent_shingles(docs, work))
    scan = scanned(docs, order, percent, widest, work)
    return scan, _components(docs, scan, percent, widest, block, work)


def ngram_components(docs: DataFrame, percent: int = 80, widest: int = COLUMN, block: int = BLOCK) -> DataFrame:
    """Every document with the size of its 5-word shingle set and its component: ``(doc_id, n_shingles, component_id)``."""
    with Workspace(docs.sparkSession, "ngram", keep=("result",)) as work:
        scan, comp = _linked(docs.select("doc_id", "text"), percent, widest, block, work)
        # classes of equal sets, then components of classes
        classes = scan.where("g is not null").groupBy("g").agg(F.min("doc_id").alias("first"))
        classes = work.put(named(classes, comp, "g", "comp").select("g", "first", "comp"), "classes")
        least_id = classes.groupBy("comp").agg(F.min("first").alias("component_id"))
        by_class = work.put(classes.join(least_id, "comp").select("g", "component_id"), "byclass")
        out = scan.where("g is not null").select("doc_id", "n", "g").join(by_class, "g").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
        alone = scan.where("g is null").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
        return work.put(out.unionByName(alone), "result")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


def one_of_each_group(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: the smallest doc_id, ids before nulls, then by the hash of the row.

    Rows are told apart by id and text, so a repeated doc_id loses only rows that a kept row stands for; rows without
    words have no copies and stay. What goes is broadcast up to BROADCAST_IDS rows, so the texts stay where they are.
    """
    with Workspace(docs.sparkSession, "kept", keep=("dropped", "repeated")) as work:
        scan, comp = _linked(docs.select("doc_id", "text"), percent, COLUMN, BLOCK, work)
        rows = scan.where("g is not null").select("g", "doc_id", "row")
        order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
        classes = work.put(named(rows.groupBy("g").agg(F.min(order).alias("first"), F.count("*").alias("k")), comp, "g", "comp").select("g", "first", "k", "comp"), "classes")
        several = classes.groupBy("comp").agg(F.min("first").alias("kept"), F.sum("k").alias("k")).where("k > 1")
        of_set = work.put(classes.join(several.select("comp", "kept"), "comp").select("g", "kept"), "ofset")
        hint = F.broadcast if within(of_set, BROADCAST_IDS) else (lambda x: x)
        mine = rows.join(hint(of_set), "g").withColumn("first", (F.col("row") == F.col("kept.row")) & F.col("doc_id").eqNullSafe(F.col("kept.doc_id")))
        counted = work.put(mine.groupBy("doc_id", "row", "first").agg(F.count("*").alias("k")), "counted")
        dropped = work.put(counted.where("not first").select(F.struct("doc_id", "row").alias("gone")), "dropped")
        repeated = work.put(counted.where("first and k > 1").select(F.struct("doc_id", "row").alias("again")), "repeated")
    whole = docs.select(F.struct(*docs.columns).alias("doc"), F.struct("doc_id", F.xxhash64("doc_id", "text").alias("row")).alias("key"))
    same = lambda other: (whole["key.row"] == other["row"]) & whole["key.doc_id"].eqNullSafe(other["doc_id"])
    hint = F.broadcast if within(dropped, BROADCAST_IDS) else (lambda x: x)
    out = whole.join(hint(dropped), same(F.col("gone")), "left_anti")
    if not repeated.isEmpty():
        # rows of equal id and text: partial aggregates leave one a task before the shuffle
        once = out.join(repeated, same(F.col("again")), "left_semi").dropDuplicates(["key"])
        out = out.join(repeated, same(F.col("again")), "left_anti").unionByName(once)
    return out.select("doc.*")


QUERIES = {"op2_ngram_jaccard_join": op2_ngram_jaccard_join}

ORACLES = {
    "op2_ngram_jaccard_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0))
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), meets AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM meets o JOIN sizes x ON o.a = x.doc_id JOIN sizes y ON o.b = y.doc_id WHERE 100 * k >= 80 * (x.n + y.n - k)
), sides AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS id, doc_id AS seen FROM documents UNION SELECT r.id, e.b FROM reach r JOIN sides e ON r.seen = e.a
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, m.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT id, min(seen) AS component_id FROM reach GROUP BY id) m ON m.id = d.doc_id
"""
}
