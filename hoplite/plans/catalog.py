"""Registered graph queries and the SQL that each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hoplite.functions import codec, text
from hoplite.operators import adjacency, dictionary, service, traversal
from hoplite.plans.workspace import Workspace
from hoplite.schema import NO_NODE
from hoplite.sources import lines, relations
from hoplite.sources.store import Graph, load_offsets, read_binary

#: Literal lines whose acceptance is known (fixed values); the sixth is empty.
LINES = ("a,b,c,d", "a,b,c,", "a,b,c,,", "a,b,c", "", "a,b,,d", "a,b,c,d,e,f", "a,b,c,d\r", ",,,x", "a,b,c,\r", "last,b,c,d")
#: A header that is a proper edge too.
HEADER = "start_id,start_label,edge_label,end_id,end_label"
#: Edges listed out of order, for dictionaries in first-seen order (fixed values).
LISTED = ("alice,Person,KNOWS,bob,Person", "carol,Person,LIKES,post1,Post", "post1,Post,HAS_TAG,tag_000001,Tag", "dave,Person,LIKES,dave,Person", "tag_000001,Tag,PART_OF,topic,Topic")
#: Numbers at the borders of the codes' lengths (fixed values).
NUMBERS = (0, 1, 127, 128, 300, 16383, 16384, 2097151, 2097152, 268435455, 268435456, 4294967295)
REQUEST = 'POST /q{n} HTTP/1.1\r\nHost: x\r\n\r\n{body}'
#: Bodies of the requests (fixed values): a query, one with labels, one that isn't JSON.
BODIES = ('{"items":["c1"],"length":2,"labels":[]}', '{"items":["c1","c2"],"length":3,"labels":["PLACED","CONTAINS"]}', "not json")


_built: dict[tuple[str, str], tuple[Workspace, Graph]] = {}


def _graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The encoded graph of a folder's tables, built once in an application, as a store that answers many queries is."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _built or not _built[key][0].alive:
        work = Workspace(spark, "graph")
        _built[key] = work, Graph.build(relations.edges(spark, sf_dir), work)
    return _built[key][1]


def _lines(spark: SparkSession, rows: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(rows)), "line_no long, value string")


def _table_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.edges(spark, sf_dir).select(F.concat_ws(",", "start_id", "start_label", "edge_label", "end_id", "end_label").alias("value"))


def edge_parse(spark, sf_dir):
    return lines.parsed(_table_lines(spark, sf_dir))


def edge_parse_fields_2_3(spark, sf_dir):
    return lines.endpoints(_table_lines(spark, sf_dir), 2, 3).groupBy("src_str", "dst_str").agg(F.count("*").alias("n"))


def edge_accept_counts(spark, sf_dir):
    return _lines(spark, LINES).select("line_no", lines.accepted(F.col("value")).alias("accepted"))


def node_count(spark, sf_dir):
    return adjacency.node_count(dictionary.endpoints_of(relations.edges(spark, sf_dir)))


def edge_count(spark, sf_dir):
    return adjacency.edge_count(relations.edges(spark, sf_dir))


def node_dictionary(spark, sf_dir):
    return dictionary.node_dictionary(relations.edges(spark, sf_dir), Workspace(spark, "dictionary"))


def edge_accept_tables(spark, sf_dir):
    every = _table_lines(spark, sf_dir).unionByName(_lines(spark, LINES).select("value"))
    return every.select(lines.accepted(F.col("value")).alias("accepted")).groupBy("accepted").agg(F.count("*").alias("n"))


def string_to_id(spark, sf_dir):
    """Every node, and text that is none."""
    misses = spark.createDataFrame([("zzz",), ("",)], "str_id string")
    return dictionary.string_to_id(dictionary.endpoints_of(relations.edges(spark, sf_dir)).unionByName(misses), _graph(spark, sf_dir).nodes)


def _all_ids(spark, sf_dir) -> DataFrame:
    """Every node's id, and ids out of range."""
    return _graph(spark, sf_dir).nodes.select("id").unionByName(spark.createDataFrame([(NO_NODE,), (-1,)], "id long"))


def id_to_string(spark, sf_dir):
    return dictionary.id_to_string(_all_ids(spark, sf_dir), _graph(spark, sf_dir).nodes)


def label_dictionary(spark, sf_dir):
    return dictionary.label_dictionary(lines.parsed(_lines(spark, LISTED)))


def relation_dictionary(spark, sf_dir):
    return dictionary.relation_dictionary(lines.parsed(_lines(spark, LISTED)))


def encoded_edges(spark, sf_dir):
    return _graph(spark, sf_dir).edges


def sorted_edges(spark, sf_dir):
    return adjacency.sorted_edges(_graph(spark, sf_dir).edges)


def _degrees(direction):
    def query(spark, sf_dir):
        g = _graph(spark, sf_dir)
        return adjacency.degrees(g.nodes, g.edges, direction)

    return query


def degree_lookup(spark, sf_dir):
    g = _graph(spark, sf_dir)
    both = adjacency.degree_lookup(_all_ids(spark, sf_dir), g.edges, "out").withColumnRenamed("degree", "out_degree")
    return adjacency.degree_lookup(both, g.edges, "in").withColumnRenamed("degree", "in_degree")


def _neighbours(direction):
    def query(spark, sf_dir):
        g = _graph(spark, sf_dir)
        return adjacency.neighbours(g.edges, direction).select("node", F.array_join("list", ",").alias("neighbours"))

    return query


def neighbour_lookup(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return adjacency.neighbour_lookup(_all_ids(spark, sf_dir), g.edges).select("id", F.array_join("list", ",").alias("neighbours"))


def _offsets(direction):
    def query(spark, sf_dir):
        g = _graph(spark, sf_dir)
        return adjacency.csr_offsets(g.nodes, g.edges, direction)

    return query


def neighbor_deltas(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return adjacency.neighbours(g.edges).select("node", F.array_join(codec.deltas(F.col("list")), ",").alias("deltas"))


def varint_hex(spark, sf_dir):
    numbers = spark.createDataFrame([(x,) for x in NUMBERS], "value long").unionByName(spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_orderkey") * 7919).alias("value")))
    return numbers.select("value", codec.varint_hex(F.col("value")).alias("hex"), codec.varint_length(F.col("value")).cast("int").alias("bytes"))


def varint_roundtrip(spark, sf_dir):
    g = _graph(spark, sf_dir)
    lists = adjacency.neighbours(g.edges)
    return lists.select("node", F.array_join(codec.decompressed(codec.compressed(F.col("list"))), ",").alias("neighbours"))


def compressed_size(spark, sf_dir):
    g = _graph(spark, sf_dir)
    size = lambda d: adjacency.compressed_sizes(g.edges, d).agg(F.sum("bytes").alias("bytes")).select(F.lit(d).alias("direction"), "bytes")
    return size("out").unionByName(size("in"))


def _khop(seeds, length, labels=(), direction="out", mode=None, end_labels=()):
    def query(spark, sf_dir):
        edges = relations.edges(spark, sf_dir)
        asked = traversal.KHopQuery(seeds, length, labels).frame(spark)
        layers = traversal.khop_layers(edges, asked, direction)
        if end_labels:
            layers = traversal.with_label(layers, edges, end_labels)
        if mode:
            return traversal.counts(layers, asked, mode).select("count")
        return traversal.counts_by_hop(layers, length)

    return query


def khop_bitmap(spark, sf_dir):
    edges = relations.edges(spark, sf_dir)
    nodes = _graph(spark, sf_dir).nodes
    layers = traversal.khop_layers(edges, traversal.KHopQuery(("c1",), 5).frame(spark))
    return traversal.bitmap_count(layers.join(nodes, layers.node == nodes.str_id).select("id"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _khop(("c1",), 2, mode="within")(spark, sf_dir)


def _requests(spark):
    return spark.createDataFrame([(i, REQUEST.format(n=i, body=b)) for i, b in enumerate(BODIES)] + [(90, "GET"), (91, ""), (92, None)], "req long, raw string")


def http_parse(spark, sf_dir):
    return service.parse_requests(_requests(spark)).select("req", "path", "body")


def json_request(spark, sf_dir):
    q = service.parse_queries(service.parse_requests(_requests(spark)))
    return q.select("req", F.array_join("items", "|").alias("items"), "length", F.array_join("labels", "|").alias("labels"))


def json_response(spark, sf_dir):
    rows = spark.createDataFrame([(x,) for x in (0, 11, 12345678, 4294967296)], "n long")
    return rows.select("n", service.json_response(F.col("n")).alias("body"), service.http_response(F.col("n")).alias("response"))


def http_answer(spark, sf_dir):
    return service.answer(_requests(spark), relations.edges(spark, sf_dir)).select("req", "path", "count")


def int_to_text(spark, sf_dir):
    rows = spark.createDataFrame([(x,) for x in (0, -1, 7, -2147483648, 9223372036854775807)], "x long").unionByName(spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_orderkey") * 1000003 - 500000).alias("x")))
    return rows.select("x", text.int_to_text(F.col("x")).alias("text"))


def radix_text(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_orderkey") * 1000003).alias("x"))
    return rows.select("x", *[text.radix_text(F.col("x"), r).alias(f"r{r}") for r in (2, 7, 10, 16, 36)])


def store_roundtrip(spark, sf_dir):
    path = Workspace(spark, "store").path("graph")
    _graph(spark, sf_dir).save(path)
    g = Graph.load(spark, path)
    last = load_offsets(spark, path).agg(F.max("edge_offset")).first()[0]
    return spark.createDataFrame([(g.node_count(), g.edge_count(), last)], "nodes long, edges long, last_offset long")


def _numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.edges(spark, sf_dir, numbered=True)


def label_dictionary_tables(spark, sf_dir):
    return dictionary.label_dictionary(_numbered_lines(spark, sf_dir))


def relation_dictionary_tables(spark, sf_dir):
    return dictionary.relation_dictionary(_numbered_lines(spark, sf_dir))


def _written(spark: SparkSession, sf_dir: str, name: str) -> str:
    """The tables' lines as text files, each beginning with the same line as one that follows it, among lines that don't count."""
    path = Workspace(spark, name).path("lines")
    _table_lines(spark, sf_dir).unionByName(spark.createDataFrame([(x,) for x in LINES], "value string")).write.option("lineSep", "\n").text(path)
    return path


def edge_scan(spark, sf_dir):
    return lines.read_edges(spark, _written(spark, sf_dir, "scan"))


def edge_scan_header(spark, sf_dir):
    """One file whose header is equal to two data lines, of which both count."""
    path = Workspace(spark, "header").path("lines")
    spark.createDataFrame([(HEADER,)], "value string").coalesce(1).write.option("lineSep", "\n").text(f"{path}/part=0")
    spark.createDataFrame([(HEADER,), *((x,) for x in LINES), (HEADER,), (HEADER,)], "value string").coalesce(1).write.option("lineSep", "\n").text(f"{path}/part=1")
    return lines.parsed(lines.read_lines(spark, path, header=True)).groupBy("start_id", "end_id").agg(F.count("*").alias("n"))


def binary_read(spark, sf_dir):
    """Bytes and line ends of the written lines, from whole files."""
    content = F.col("content")
    files = read_binary(spark, _written(spark, sf_dir, "binary") + "/*.txt")
    ends = F.length(content) - F.octet_length(F.translate(F.decode(content, "UTF-8"), "\n", ""))
    return files.agg(F.sum(F.length(content)).cast("long").alias("bytes"), F.sum(ends).cast("long").alias("line_ends"))


def store_contents(spark, sf_dir):
    """Every row of a saved and loaded graph: nodes, edges with their number, and both offsets."""
    path = Workspace(spark, "contents").path("graph")
    _graph(spark, sf_dir).save(path)
    g = Graph.load(spark, path)
    rows = lambda df, part, a, b, c: df.select(F.lit(part).alias("part"), F.col(a).cast("long").alias("a"), F.col(b).cast("string").alias("b"), F.col(c).cast("long").alias("c"))
    edges = g.edges.groupBy("src", "dst").agg(F.count("*").alias("n"))
    out = rows(g.nodes.withColumn("c", F.lit(0)), "node", "id", "str_id", "c").unionByName(rows(edges, "edge", "src", "dst", "n"))
    for direction in ("out", "in"):
        out = out.unionByName(rows(load_offsets(spark, path, direction), direction, "node_id", "edge_offset", "byte_offset"))
    return out


def _compressed(direction):
    def query(spark, sf_dir):
        g = _graph(spark, sf_dir)
        return adjacency.neighbours(g.edges, direction).select("node", codec.compressed_hex(F.col("list")).alias("code"))

    return query


def neighbor_rows(spark, sf_dir):
    return adjacency.neighbour_rows(_graph(spark, sf_dir).edges).select("node", F.col("rank").cast("long").alias("rank"), "peer")


def radix_text_negative(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select((-F.col("o_orderkey") * 1000003 - 1).alias("x"))
    return rows.select("x", *[text.radix_text(F.col("x"), r).alias(f"r{r}") for r in (7, 10, 16, 36)])


QUERIES = {
    "edge_scan": edge_scan,
    "edge_scan_header": edge_scan_header,
    "binary_read": binary_read,
    "label_dictionary_tables": label_dictionary_tables,
    "relation_dictionary_tables": relation_dictionary_tables,
    "store_contents": store_contents,
    "compressed_lists_fwd": _compressed("out"),
    "compressed_lists_bwd": _compressed("in"),
    "neighbor_rows": neighbor_rows,
    "radix_text_negative": radix_text_negative,
    "edge_parse": edge_parse,
    "edge_parse_fields_2_3": edge_parse_fields_2_3,
    "edge_accept_counts": edge_accept_counts,
    "edge_accept_tables": edge_accept_tables,
    "node_count": node_count,
    "edge_count": edge_count,
    "node_dictionary": node_dictionary,
    "string_to_id": string_to_id,
    "id_to_string": id_to_string,
    "label_dictionary": label_dictionary,
    "relation_dictionary": relation_dictionary,
    "encoded_edges": encoded_edges,
    "sorted_edges": sorted_edges,
    "out_degree": _degrees("out"),
    "in_degree": _degrees("in"),
    "degree_lookup": degree_lookup,
    "out_neighbors": _neighbours("out"),
    "in_neighbors": _neighbours("in"),
    "neighbor_lookup": neighbour_lookup,
    "csr_offsets_fwd": _offsets("out"),
    "csr_offsets_bwd": _offsets("in"),
    "neighbor_deltas": neighbor_deltas,
    "varint_hex": varint_hex,
    "varint_roundtrip": varint_roundtrip,
    "compressed_size": compressed_size,
    "khop_within": _khop(("c1",), 6),
    "khop_exact": _khop(("c1",), 5, mode="exact"),
    "khop_in": _khop(("p1",), 3, direction="in"),
    "khop_both": _khop(("c1",), 4, direction="both"),
    "khop_multi_seed": _khop(("c1", "c2", "c3", "nobody"), 4),
    "khop_edge_label": _khop(("c1",), 4, labels=("PLACED", "CONTAINS")),
    "khop_end_label": _khop(("c1",), 6, end_labels=("part",)),
    "khop_bitmap": khop_bitmap,
    "http_parse": http_parse,
    "json_request": json_request,
    "json_response": json_response,
    "http_answer": http_answer,
    "int_to_text": int_to_text,
    "radix_text": radix_text,
    "store_roundtrip": store_roundtrip,
}


# ---- the same queries as SQL ----

_EDGES = f"edges AS ({relations.edges_sql()})"
_PARSE = "f[1] AS start_id, f[2] AS start_label, f[3] AS edge_label, f[4] AS end_id, f[5] AS end_label"
_ACCEPT = "(len(f) > 4 OR (len(f) = 4 AND f[4] <> ''))"
_NODES = f"{_EDGES}, nodes AS (SELECT CAST(row_number() OVER (ORDER BY str_id) - 1 AS BIGINT) AS id, str_id FROM (SELECT start_id AS str_id FROM edges UNION SELECT end_id FROM edges))"
_ENCODED = f"{_NODES}, enc AS (SELECT a.id AS src, b.id AS dst FROM edges e JOIN nodes a ON e.start_id = a.str_id JOIN nodes b ON e.end_id = b.str_id)"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'" if "\r" not in s and "\n" not in s else "concat(" + ", ".join(f"chr({ord(p)})" if p in "\r\n" else _q(p) for p in _pieces(s)) + ")"


def _pieces(s: str) -> list[str]:
    out = [""]
    for c in s:
        if c in "\r\n":
            out += [c, ""]
        else:
            out[-1] += c
    return [p for p in out if p]


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda x: "NULL" if x is None else _q(x) if isinstance(x, str) else str(x)
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({names})"


def _side(direction: str) -> tuple[str, str]:
    return ("src", "dst") if direction == "out" else ("dst", "src")


def _degree_sql(direction: str) -> str:
    a, _ = _side(direction)
    return f"WITH {_ENCODED} SELECT n.id, CAST(count(e.{a}) AS BIGINT) AS degree FROM nodes n LEFT JOIN enc e ON e.{a} = n.id GROUP BY n.id"


def _lists_sql(direction: str) -> str:
    a, b = _side(direction)
    return f"WITH {_ENCODED} SELECT {a} AS node, string_agg(CAST({b} AS VARCHAR), ',' ORDER BY {b}) AS neighbours FROM enc GROUP BY {a}"


_BYTES = "CASE WHEN {x} < 128 THEN 1 WHEN {x} < 16384 THEN 2 WHEN {x} < 2097152 THEN 3 WHEN {x} < 268435456 THEN 4 ELSE 5 END"


def _deltas_sql(direction: str) -> str:
    a, b = _side(direction)
    return f"deltas_{direction} AS (SELECT {a} AS node, {b} AS peer, {b} - lag({b}, 1, 0) OVER (PARTITION BY {a} ORDER BY {b}) AS d FROM enc)"


def _offsets_sql(direction: str) -> str:
    return f"""WITH {_ENCODED}, {_deltas_sql(direction)}, per AS (SELECT node, count(*) AS n, sum({_BYTES.format(x='d')}) AS b FROM deltas_{direction} GROUP BY node),
every AS (SELECT id, coalesce(n, 0) AS n, coalesce(b, 0) AS b FROM nodes LEFT JOIN per ON per.node = nodes.id UNION ALL SELECT max(id) + 1, 0, 0 FROM nodes)
SELECT id AS node_id, CAST(sum(n) OVER (ORDER BY id) - n AS BIGINT) AS edge_offset, CAST(sum(b) OVER (ORDER BY id) - b AS BIGINT) AS byte_offset FROM every"""


def _reach_sql(seeds, length, labels=(), direction="out", end_labels=()) -> str:
    where = f" WHERE edge_label IN ({', '.join(map(_q, labels))})" if labels else ""
    ahead, back = f"SELECT start_id AS a, end_id AS b FROM edges{where}", f"SELECT end_id AS a, start_id AS b FROM edges{where}"
    links = {"out": ahead, "in": back, "both": f"{ahead} UNION {back}"}[direction]
    only = f" AND node IN (SELECT start_id FROM edges WHERE start_label IN ({', '.join(map(_q, end_labels))}) UNION SELECT end_id FROM edges WHERE end_label IN ({', '.join(map(_q, end_labels))}))" if end_labels else ""
    return f"""WITH RECURSIVE {_EDGES}, links AS (SELECT DISTINCT a, b FROM ({links})),
walk AS (SELECT node, 0 AS hop FROM {_values([(s,) for s in seeds], 'node')} UNION SELECT l.b, w.hop + 1 FROM walk w JOIN links l ON l.a = w.node WHERE w.hop < {length}),
first AS (SELECT node, min(hop) AS hop FROM walk GROUP BY node), layers AS (SELECT node, hop FROM first WHERE hop > 0{only})"""


def _hops_sql(seeds, length, **options) -> str:
    return f"""{_reach_sql(seeds, length, **options)}, per AS (SELECT CAST(h.hop AS INTEGER) AS hop, CAST(count(l.node) AS BIGINT) AS new_nodes FROM range(1, {length + 1}) AS h(hop) LEFT JOIN layers l ON l.hop = h.hop GROUP BY h.hop)
SELECT hop, new_nodes, CAST(sum(new_nodes) OVER (ORDER BY hop) AS BIGINT) AS within FROM per"""


_REQUESTS = _values([(i, REQUEST.format(n=i, body=b)) for i, b in enumerate(BODIES)] + [(90, "GET"), (91, ""), (92, None)], "req, raw")
_PARSED = f"""p AS (SELECT CAST(req AS BIGINT) AS req, CASE WHEN strpos(substr(raw, 6), ' ') > 0 THEN split_part(substr(raw, 6), ' ', 1) END AS path,
CASE WHEN strpos(raw, concat(chr(13), chr(10), chr(13), chr(10))) > 0 THEN substr(raw, strpos(raw, concat(chr(13), chr(10), chr(13), chr(10)))) END AS body FROM {_REQUESTS})"""
_IDS = "ids AS (SELECT id FROM nodes UNION ALL SELECT 4294967295 UNION ALL SELECT -1)"
_HEAD = _q(service.HEAD)

_VARINT = "printf('%02X', {x} >> {s} & 127)"
_MORE = "printf('%02X', ({x} >> {s} & 127) | 128)"


def _varint_sql(x: str) -> str:
    parts = []
    for n, limit in enumerate((1 << 7, 1 << 14, 1 << 21, 1 << 28, None)):
        code = " || ".join([_MORE.format(x=x, s=7 * i) for i in range(n)] + [_VARINT.format(x=x, s=7 * n)])
        parts.append(f"WHEN {x} < {limit} THEN {code}" if limit else f"ELSE {code}")
    return f"CASE {' '.join(parts)} END"


_WRITTEN = f"written AS (SELECT concat_ws(',', start_id, start_label, edge_label, end_id, end_label) AS value FROM edges UNION ALL SELECT line FROM {_values(list(enumerate(LINES)), 'line_no, line')})"


def _compressed_sql(direction: str) -> str:
    return f"WITH {_ENCODED}, {_deltas_sql(direction)} SELECT node, string_agg({_varint_sql('d')}, '' ORDER BY peer, d DESC) AS code FROM deltas_{direction} GROUP BY node"


def _unsigned_sql(radix: int, low: int) -> str:
    """Digits of a negative number's unsigned view, in two halves that to_base can take."""
    u, unit = "(CAST(x AS HUGEINT) + 18446744073709551616)", radix**low
    return f"to_base(CAST({u} // {unit} AS BIGINT), {radix}) || to_base(CAST({u} % {unit} AS BIGINT), {radix}, {low})"


def _contents_sql() -> str:
    part = lambda d: f"SELECT '{d}', node_id, CAST(edge_offset AS VARCHAR), byte_offset FROM ({_offsets_sql(d)})"
    return f"""SELECT 'node' AS part, id AS a, str_id AS b, CAST(0 AS BIGINT) AS c FROM (WITH {_NODES} SELECT * FROM nodes) UNION ALL
SELECT 'edge', src, CAST(dst AS VARCHAR), n FROM (WITH {_ENCODED} SELECT src, dst, count(*) AS n FROM enc GROUP BY ALL) UNION ALL {part('out')} UNION ALL {part('in')}"""


ORACLES = {
    "edge_scan": f"WITH {_EDGES}, {_WRITTEN}, f AS (SELECT string_split(value, ',') AS f FROM written) SELECT {_PARSE} FROM f WHERE {_ACCEPT}",
    "edge_scan_header": f"WITH f AS (SELECT string_split(line, ',') AS f FROM {_values([(x,) for x in LINES], 'line')}) SELECT f[1] AS start_id, f[4] AS end_id, count(*) AS n FROM f WHERE {_ACCEPT} GROUP BY ALL UNION ALL SELECT 'start_id', 'end_id', 2",
    "binary_read": f"WITH {_EDGES}, {_WRITTEN} SELECT CAST(sum(octet_length(encode(value)) + 1) AS BIGINT) AS bytes, count(*) AS line_ends FROM written",
    "label_dictionary_tables": f"WITH {_EDGES} SELECT CAST(row_number() OVER (ORDER BY min(k)) - 1 AS BIGINT) AS label_id, label FROM (SELECT 2 * line_no AS k, start_label AS label FROM edges UNION ALL SELECT 2 * line_no + 1, end_label FROM edges) GROUP BY label",
    "relation_dictionary_tables": f"WITH {_EDGES} SELECT CAST(row_number() OVER (ORDER BY min(line_no)) - 1 AS BIGINT) AS relation_id, edge_label AS relation FROM edges GROUP BY edge_label",
    "store_contents": _contents_sql(),
    "compressed_lists_fwd": _compressed_sql("out"),
    "compressed_lists_bwd": _compressed_sql("in"),
    "neighbor_rows": f"WITH {_ENCODED} SELECT src AS node, CAST(row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS BIGINT) AS rank, dst AS peer FROM enc",
    "radix_text_negative": f"SELECT x, {_unsigned_sql(7, 10)} AS r7, CAST(x AS VARCHAR) AS r10, {_unsigned_sql(16, 8)} AS r16, {_unsigned_sql(36, 5)} AS r36 FROM (SELECT -o_orderkey * 1000003 - 1 AS x FROM orders)",
    "edge_parse": f"WITH {_EDGES}, f AS (SELECT string_split(concat_ws(',', start_id, start_label, edge_label, end_id, end_label), ',') AS f FROM edges) SELECT f[1] AS start_id, f[2] AS start_label, f[3] AS edge_label, f[4] AS end_id, f[5] AS end_label FROM f WHERE len(f) > 4 OR (len(f) = 4 AND f[4] <> '')",
    "edge_parse_fields_2_3": f"WITH {_EDGES} SELECT edge_label AS src_str, end_id AS dst_str, count(*) AS n FROM edges GROUP BY ALL",
    "edge_accept_counts": f"SELECT CAST(line_no AS BIGINT) AS line_no, len(string_split(line, ',')) > 4 OR (len(string_split(line, ',')) = 4 AND string_split(line, ',')[4] <> '') AS accepted FROM {_values(list(enumerate(LINES)), 'line_no, line')}",
    "node_count": f"WITH {_EDGES} SELECT count(*) AS node_count FROM (SELECT start_id FROM edges UNION SELECT end_id FROM edges)",
    "edge_count": f"WITH {_EDGES} SELECT count(*) AS edge_count FROM edges",
    "node_dictionary": f"WITH {_NODES} SELECT id, str_id FROM nodes",
    "edge_accept_tables": f"WITH {_EDGES}, {_WRITTEN}, f AS (SELECT string_split(value, ',') AS f FROM written) SELECT {_ACCEPT} AS accepted, count(*) AS n FROM f GROUP BY 1",
    "string_to_id": f"WITH {_NODES} SELECT str_id, id FROM nodes UNION ALL SELECT 'zzz', 4294967295 UNION ALL SELECT '', 4294967295",
    "id_to_string": f"WITH {_NODES} SELECT id, str_id FROM nodes UNION ALL SELECT 4294967295, '' UNION ALL SELECT -1, ''",
    "label_dictionary": f"SELECT CAST(row_number() OVER (ORDER BY min(k)) - 1 AS BIGINT) AS label_id, label FROM (SELECT 2 * line_no AS k, string_split(line, ',')[2] AS label FROM {_values(list(enumerate(LISTED)), 'line_no, line')} UNION ALL SELECT 2 * line_no + 1, string_split(line, ',')[5] FROM {_values(list(enumerate(LISTED)), 'line_no, line')}) GROUP BY label",
    "relation_dictionary": f"SELECT CAST(row_number() OVER (ORDER BY min(line_no)) - 1 AS BIGINT) AS relation_id, string_split(line, ',')[3] AS relation FROM {_values(list(enumerate(LISTED)), 'line_no, line')} GROUP BY relation",
    "encoded_edges": f"WITH {_ENCODED} SELECT src, dst FROM enc",
    "sorted_edges": f"WITH {_ENCODED} SELECT src, dst FROM enc ORDER BY src, dst",
    "out_degree": _degree_sql("out"),
    "in_degree": _degree_sql("in"),
    "degree_lookup": f"WITH {_ENCODED}, {_IDS}, o AS (SELECT src, count(*) AS n FROM enc GROUP BY src), i AS (SELECT dst, count(*) AS n FROM enc GROUP BY dst) SELECT p.id, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree FROM ids p LEFT JOIN o ON o.src = p.id LEFT JOIN i ON i.dst = p.id",
    "out_neighbors": _lists_sql("out"),
    "in_neighbors": _lists_sql("in"),
    "neighbor_lookup": f"WITH {_ENCODED}, {_IDS} SELECT p.id, coalesce(string_agg(CAST(e.dst AS VARCHAR), ',' ORDER BY e.dst), '') AS neighbours FROM ids p LEFT JOIN enc e ON e.src = p.id GROUP BY p.id",
    "csr_offsets_fwd": _offsets_sql("out"),
    "csr_offsets_bwd": _offsets_sql("in"),
    "neighbor_deltas": f"WITH {_ENCODED}, {_deltas_sql('out')} SELECT node, string_agg(CAST(d AS VARCHAR), ',' ORDER BY peer, d DESC) AS deltas FROM deltas_out GROUP BY node",
    "varint_hex": f"SELECT value, {_varint_sql('value')} AS hex, CAST({_BYTES.format(x='value')} AS INTEGER) AS bytes FROM (SELECT CAST(value AS BIGINT) AS value FROM {_values([(x,) for x in NUMBERS], 'value')} UNION ALL SELECT o_orderkey * 7919 FROM orders)",
    "varint_roundtrip": _lists_sql("out"),
    "compressed_size": f"WITH {_ENCODED}, {_deltas_sql('out')}, {_deltas_sql('in')} SELECT 'out' AS direction, CAST(sum({_BYTES.format(x='d')}) AS BIGINT) AS bytes FROM deltas_out UNION ALL SELECT 'in', CAST(sum({_BYTES.format(x='d')}) AS BIGINT) FROM deltas_in",
    "khop_within": _hops_sql(("c1",), 6),
    "khop_exact": f"{_reach_sql(('c1',), 5)} SELECT count(*) AS count FROM layers WHERE hop = 5",
    "khop_in": _hops_sql(("p1",), 3, direction="in"),
    "khop_both": _hops_sql(("c1",), 4, direction="both"),
    "khop_multi_seed": _hops_sql(("c1", "c2", "c3", "nobody"), 4),
    "khop_edge_label": _hops_sql(("c1",), 4, labels=("PLACED", "CONTAINS")),
    "khop_end_label": _hops_sql(("c1",), 6, end_labels=("part",)),
    "khop_bitmap": f"{_reach_sql(('c1',), 5)} SELECT count(*) AS count FROM layers",
    "http_parse": f"WITH {_PARSED} SELECT req, path, body FROM p",
    "json_request": f"""WITH {_PARSED}, j AS (SELECT req, CASE WHEN json_valid(ltrim(body, concat(chr(13), chr(10)))) THEN CAST(ltrim(body, concat(chr(13), chr(10))) AS JSON) END AS j FROM p)
SELECT req, array_to_string(CAST(j->'items' AS VARCHAR[]), '|') AS items, CAST(j->>'length' AS INTEGER) AS length, array_to_string(CAST(j->'labels' AS VARCHAR[]), '|') AS labels FROM j""",
    "json_response": f"""SELECT CAST(n AS BIGINT) AS n, '{{"count":' || n || '}}' AS body, {_HEAD} || n || '}}' AS response FROM {_values([(x,) for x in (0, 11, 12345678, 4294967296)], 'n')}""",
    "http_answer": f"""SELECT CAST(0 AS BIGINT) AS req, '/q0' AS path, ({_reach_sql(('c1',), 2)} SELECT count(*) FROM layers) AS count UNION ALL
SELECT 1, '/q1', ({_reach_sql(('c1', 'c2'), 3, labels=('PLACED', 'CONTAINS'))} SELECT count(*) FROM layers) UNION ALL SELECT 2, '/q2', 0 UNION ALL SELECT req, NULL, 0 FROM range(90, 93) AS r(req)""",
    "int_to_text": f"SELECT x, CAST(x AS VARCHAR) AS text FROM (SELECT CAST(x AS BIGINT) AS x FROM {_values([(x,) for x in (0, -1, 7, -2147483648, 9223372036854775807)], 'x')} UNION ALL SELECT o_orderkey * 1000003 - 500000 FROM orders)",
    "radix_text": "SELECT x, to_base(x, 2) AS r2, to_base(x, 7) AS r7, CAST(x AS VARCHAR) AS r10, to_base(x, 16) AS r16, to_base(x, 36) AS r36 FROM (SELECT o_orderkey * 1000003 AS x FROM orders)",
    "store_roundtrip": f"WITH {_NODES} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM edges) AS last_offset",
}
