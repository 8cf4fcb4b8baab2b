"""URL filter: gradient-boosted trees on lexical features, in DataFrame functions only.

Rules of the form host and path prefix decide what they fit, and label the
URLs that the trees learn from; the trees decide the rest. Training works on a table
of at most about ``SAMPLE`` labelled rows with binned features: each
level of a tree is one aggregation of gradients by (node, feature, bin), a result
whose size depends on the bins only. Suffix statistics are smoothed rates of blocked rows; while the trees
learn, a row's rates are those of the other half of the sample, so that they show what rates tell of unseen rows.
A trained ensemble is a sum of
nested CASE expressions, so scoring is a single scan without shuffle.

Defined results: a null URL or one without ``://`` has an empty host and path and is judged by the trees; with no
labelled row at all the verdict is ``allow``. Repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hoplite.llm.common import sampled, table
from hoplite.plans.workspace import Workspace

#: Labelled rows to learn from, about; chosen by the hash of the URL.
SAMPLE = 20_000
TREES, DEPTH, RATE, BINS, SMOOTH = 6, 3, 0.6, 16, 1.0
#: Hash buckets of the suffix statistics.
BUCKETS = 256
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The fixed rules of the registered query.
RULES = (Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"), Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.coalesce(F.regexp_extract(rest, "^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, _UPPER, _LOWER), path


def matched(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def _entropy(text: Column) -> Column:
    """Bits per character of a text's characters."""
    n = F.length(text).cast("double")
    each = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.when(n > 0, F.aggregate(each, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0))).otherwise(0.0)


def lexical(df: DataFrame) -> DataFrame:
    """``df(url, host, path)`` with the numeric features and the keys of the suffix statistics."""
    u = F.coalesce(F.col("url"), F.lit(""))
    n = F.length(u)
    digits = n - F.length(F.translate(u, "0123456789", ""))
    count = lambda text, what: F.length(text) - F.length(F.translate(text, what, ""))
    suffix = F.substring_index("host", ".", -1)
    section = F.regexp_extract("path", "^/?([^/]*)", 1)
    ending = F.regexp_extract("path", r"\.([A-Za-z0-9]{1,8})$", 1)
    return df.withColumns({
        "f_length": n.cast("double"),
        "f_host": F.length("host").cast("double"),
        "f_depth": count(F.col("path"), "/").cast("double"),
        "f_labels": count(F.col("host"), ".").cast("double"),
        "f_digits": F.when(n > 0, digits / n).otherwise(0.0),
        "f_entropy": _entropy(u),
        "f_params": (count(u, "&") + count(u, "?") + count(u, "#")).cast("double"),
        "k_suffix": suffix,
        "k_domain": F.substring_index("host", ".", -2),
        "k_section": F.concat_ws("/", suffix, section),
        "k_ending": ending,
    })


NUMERIC = ("f_length", "f_host", "f_depth", "f_labels", "f_digits", "f_entropy", "f_params")
KEYS = ("k_suffix", "k_domain", "k_section", "k_ending")


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _half() -> Column:
    """Which half of the sample a row is in, by the hash of its URL."""
    return F.pmod(F.xxhash64(F.coalesce(F.col("url"), F.lit("")), F.lit("half")), F.lit(2)).cast("int")


def _rates(cells: list, p: float) -> dict[str, list[float]]:
    """Smoothed rates of label 1 by bucket of each key, from rows ``(k, b, y, n)``."""
    sums = {k: [[0.0, 0] for _ in range(BUCKETS)] for k in KEYS}
    for r in cells:
        sums[r.k][r.b][0] += r.y
        sums[r.k][r.b][1] += r.n
    return {k: [(y + 4 * p) / (n + 4) for y, n in sums[k]] for k in KEYS}


@dataclass
class Model:
    base: float
    rates: dict[str, list[float]]
    cuts: dict[str, list[float]]
    trees: list[dict]  # nested: {"f", "at", "low", "high"} or {"value"}

    @property
    def features(self) -> list[str]:
        return [*NUMERIC, *(f"s_{k}" for k in KEYS)]

    def with_features(self, df: DataFrame, halves: list[dict[str, list[float]]] | None = None) -> DataFrame:
        """``df(url, host, path)`` with all features; with ``halves``, the rates of the half that a row is not in."""
        pick = lambda rates, k: F.element_at(F.array(*[F.lit(x) for x in rates[k]]), _bucket(k) + 1)
        if halves is None:
            return lexical(df).withColumns({f"s_{k}": pick(self.rates, k) for k in KEYS})
        return lexical(df).withColumns({f"s_{k}": F.when(_half() == 0, pick(halves[0], k)).otherwise(pick(halves[1], k)) for k in KEYS})

    @staticmethod
    def _walk(node: dict) -> Column:
        if "value" in node:
            return F.lit(float(node["value"]))
        return F.when(F.col(node["f"]) <= node["at"], Model._walk(node["low"])).otherwise(Model._walk(node["high"]))

    def probability(self) -> Column:
        total = F.lit(self.base)
        for t in self.trees:
            total = total + self._walk(t)
        return 1 / (1 + F.exp(-total))


def _leaf(tree: dict[int, tuple[str, int]]) -> Column:
    """The number of the open node that a row is in; inner nodes number their children 2i and 2i+1."""
    out = F.lit(1)
    for i in sorted(tree):
        f, at = tree[i]
        out = F.when(out == i, F.when(F.col(f"b_{f}") <= at, 2 * i).otherwise(2 * i + 1)).otherwise(out)
    return out


def fit(labelled: DataFrame) -> Model:
    """Trees from ``labelled(url, host, path, y)`` with y 1 for block."""
    import math

    spark = labelled.sparkSession
    with Workspace(spark, "urls") as work:
        rows = work.put(lexical(labelled.select("url", "host", "path", "y")), "sample")
        total = rows.agg(F.count("*"), F.avg("y")).first()
        if not total[0]:
            return Model(-1.0, {k: [0.5] * BUCKETS for k in KEYS}, {}, [])
        p = min(max(total[1], 1e-3), 1 - 1e-3)
        keys = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), _bucket(k).alias("b")) for k in KEYS]))
        stats = rows.select(_half().alias("half"), keys.alias("e"), "y").groupBy("half", "e.k", "e.b").agg(F.sum("y").alias("y"), F.count("*").alias("n")).collect()
        model = Model(math.log(p / (1 - p)), _rates(stats, p), {}, [])
        data = model.with_features(rows, [_rates([r for r in stats if r.half != half], p) for half in (0, 1)])
        names = model.features
        cut = data.agg(*[F.percentile_approx(f, [i / BINS for i in range(1, BINS)], 2000).alias(f) for f in names]).first()
        model.cuts = {f: sorted(set(cut[f])) for f in names}
        binned = {f"b_{f}": F.expr("+".join(["0", *(f"int({f} > {float(c)!r}D)" for c in model.cuts[f])])) for f in names}
        data = work.put(data.withColumns(binned).select("y", *binned, F.lit(model.base).alias("score")), "tree0")
        for t in range(TREES):
            p_now = 1 / (1 + F.exp(-F.col("score")))
            state = data.select("*", (F.col("y") - p_now).alias("g"), (p_now * (1 - p_now)).alias("h"))
            shape: dict[int, tuple[str, int]] = {}
            sums: dict[int, tuple[float, float]] = {}
            for level in range(DEPTH):
                open_ = [n for n in range(2**level, 2 ** (level + 1)) if level == 0 or n // 2 in shape]
                if not open_:
                    break
                cells = state.select(_leaf(shape).alias("node"), "g", "h", F.posexplode(F.array(*binned)).alias("f", "b"))
                got = cells.groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n")).collect()
                for node in open_:
                    split = _best_split([r for r in got if r.node == node], names)
                    if split:
                        shape[node] = split[:2]
                        sums[2 * node], sums[2 * node + 1] = split[2], split[3]
            if not shape:
                break
            value = {n: RATE * g / (h + SMOOTH) for n, (g, h) in sums.items() if n not in shape}
            model.trees.append(_grow(1, shape, value, model.cuts))
            gained = F.element_at(F.create_map(*[x for n, v in value.items() for x in (F.lit(n), F.lit(v))]), _leaf(shape))
            data = work.put(data.withColumn("score", F.col("score") + gained), f"tree{t + 1}")
        return model


def _best_split(cells: list, names: list[str]) -> tuple | None:
    """(feature, last bin of the low side, sums of the low side, sums of the high side) of the greatest gain."""
    best, found = 1e-6, None
    for i, f in enumerate(names):
        bins = sorted((r.b, r.g, r.h, r.n) for r in cells if r.f == i)
        gt, ht, nt = (sum(b[k] for b in bins) for k in (1, 2, 3))
        gl = hl = nl = 0.0
        for b, g, h, n in bins[:-1]:
            gl, hl, nl = gl + g, hl + h, nl + n
            gain = gl * gl / (hl + SMOOTH) + (gt - gl) ** 2 / (ht - hl + SMOOTH) - gt * gt / (ht + SMOOTH)
            if gain > best + 1e-9 and min(nl, nt - nl) >= 5:
                best, found = gain, (f, b, (gl, hl), (gt - gl, ht - hl))
    return found


def _grow(node: int, shape: dict, value: dict, cuts: dict) -> dict:
    if node not in shape:
        return {"value": value.get(node, 0.0)}
    f, b = shape[node]
    return {"f": f, "at": cuts[f][b], "low": _grow(2 * node, shape, value, cuts), "high": _grow(2 * node + 1, shape, value, cuts)}


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``pages(page_id, url)`` to ``page_id, host, path, rule, verdict, score``; score is the trees' probability of block."""
    host, path = host_and_path(F.col("url"))
    df = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    df = df.withColumns({"rule": rule, "given": verdict})
    known = df.where("given is not null").withColumn("y", (F.col("given") == "block").cast("double"))
    model = fit(sampled(known, F.coalesce(F.col("url"), F.lit("")), SAMPLE, known.count()))
    scored = model.with_features(df).withColumn("score", model.probability())
    method = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("given", method).alias("verdict"), "score")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


QUERIES = {"op1_url_filters": op1_url_filters}
