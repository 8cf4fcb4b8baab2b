"""The hand graph of eight edges: a duplicate edge, a self-loop, a cycle, a sink and a ten-byte id."""

import pytest
from pyspark.sql import functions as F

from hoplite.functions import codec
from hoplite.operators import adjacency, dictionary, traversal
from hoplite.plans.workspace import Workspace
from hoplite.schema import EDGE
from hoplite.sources import lines
from hoplite.sources.store import Graph, load_offsets, read_binary

HAND = """alice,Person,KNOWS,bob,Person
alice,Person,KNOWS,carol,Person
bob,Person,KNOWS,carol,Person
carol,Person,KNOWS,alice,Person
carol,Person,LIKES,post1,Post
alice,Person,KNOWS,bob,Person
dave,Person,LIKES,dave,Person
post1,Post,HAS_TAG,tag_000001,Tag"""


@pytest.fixture(scope="module")
def edges(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("edges") / "edges.csv"
    path.write_text(HAND)
    return lines.read_edges(spark, str(path)).cache()


@pytest.fixture(scope="module")
def graph(spark, edges):
    return Graph.build(edges, Workspace(spark, "hand"))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_dictionary(graph):
    assert rows(graph.nodes, "id", "str_id") == list(enumerate(["alice", "bob", "carol", "dave", "post1", "tag_000001"]))
    assert (graph.node_count(), graph.edge_count()) == (6, 8)
    assert graph.string_to_id("zzz") == 4294967295 and graph.string_to_id("post1") == 4
    assert graph.id_to_string(6) == "" and graph.id_to_string(5) == "tag_000001"


def test_lists_and_degrees(graph):
    out = dict(rows(adjacency.neighbours(graph.edges).withColumn("l", F.array_join("list", ",")), "node", "l"))
    into = dict(rows(adjacency.neighbours(graph.edges, "in").withColumn("l", F.array_join("list", ",")), "node", "l"))
    assert out == {0: "1,1,2", 1: "2", 2: "0,4", 3: "3", 4: "5"}
    assert into == {0: "2", 1: "0,0", 2: "0,1", 3: "3", 4: "2", 5: "4"}
    assert [d for _, d in rows(adjacency.degrees(graph.nodes, graph.edges), "id", "degree")] == [3, 1, 2, 1, 1, 0]
    assert [d for _, d in rows(adjacency.degrees(graph.nodes, graph.edges, "in"), "id", "degree")] == [1, 2, 2, 1, 1, 1]
    assert graph.out_degree(6) == 0 and graph.in_degree(1) == 2
    assert graph.out_neighbours(0) == [1, 1, 2] and graph.out_neighbours(99) == [] and graph.in_neighbours(1) == [0, 0]
    assert rows(adjacency.neighbour_rows(graph.edges), "node", "rank", "peer")[:3] == [(0, 0, 1), (0, 1, 1), (0, 2, 2)]
    with pytest.raises(ValueError):
        adjacency.turned(graph.edges, "sideways")


def test_offsets(graph):
    assert [o for _, o in rows(adjacency.csr_offsets(graph.nodes, graph.edges), "node_id", "edge_offset")] == [0, 3, 4, 6, 7, 8, 8]
    back = rows(adjacency.csr_offsets(graph.nodes, graph.edges, "in"), "node_id", "edge_offset", "byte_offset")
    assert [o for _, o, _ in back] == [0, 1, 3, 5, 6, 7, 8] and back[-1][2] == 8


def test_offsets_over_blocks(spark, graph, monkeypatch):
    monkeypatch.setattr(adjacency, "BLOCK", 2)
    assert [o for _, o in rows(adjacency.csr_offsets(graph.nodes, graph.edges), "node_id", "edge_offset")] == [0, 3, 4, 6, 7, 8, 8]


def test_labels(spark):
    numbered = spark.createDataFrame(list(enumerate(HAND.split("\n"))), "line_no long, value string")
    parsed = lines.parsed(numbered)
    assert rows(dictionary.label_dictionary(parsed), "label_id", "label") == [(0, "Person"), (1, "Post"), (2, "Tag")]
    assert rows(dictionary.relation_dictionary(parsed), "relation_id", "relation") == [(0, "KNOWS"), (1, "LIKES"), (2, "HAS_TAG")]


@pytest.mark.parametrize(
    "seeds, k, options, new",
    [
        (("alice",), 4, {}, [2, 1, 1, 0]),
        (("dave",), 2, {}, [0, 0]),
        (("post1",), 3, {"direction": "in"}, [1, 2, 0]),
        (("alice",), 3, {"labels": ("KNOWS",)}, [2, 0, 0]),
        (("alice",), 3, {"end": ("Post",)}, [0, 1, 0]),
        (("alice", "dave"), 1, {}, [2]),
        (("alice", "bob"), 1, {}, [1]),
        (("tag_000001",), 4, {"direction": "both"}, [1, 1, 2, 0]),
        (("zzz",), 2, {}, [0, 0]),
    ],
)
def test_khop(spark, edges, seeds, k, options, new):
    q = traversal.KHopQuery().with_items(*seeds).with_length(k).with_labels(*options.get("labels", ()))
    layers = traversal.khop_layers(edges, q.frame(spark), options.get("direction", "out"))
    if "end" in options:
        layers = traversal.with_label(layers, edges, options["end"])
    got = rows(traversal.counts_by_hop(layers, k), "hop", "new_nodes", "within")
    assert [n for _, n, _ in got] == new and got[-1][2] == sum(new)


def test_khop_counts(edges):
    assert traversal.khop_count(edges, traversal.KHopQuery(("alice",), 4)) == 4
    assert traversal.khop_count(edges, traversal.KHopQuery(("alice",), 2), mode="exact") == 1
    assert traversal.khop_count(edges, traversal.KHopQuery(("alice",), 0)) == 0
    assert traversal.khop_count(edges, traversal.KHopQuery()) == 0
    with pytest.raises(ValueError):
        traversal.counts(edges, edges, "about")


def test_store(spark, graph, tmp_path):
    graph.save(str(tmp_path / "g"))
    again = Graph.load(spark, str(tmp_path / "g"))
    assert (again.node_count(), again.edge_count()) == (6, 8)
    assert rows(again.edges, "src", "dst") == rows(graph.edges, "src", "dst")
    assert load_offsets(spark, str(tmp_path / "g")).count() == 7
    assert again.keep().node_count() == 6
    again.release()


def test_empty_graph(spark, tmp_path):
    g = Graph.build(spark.createDataFrame([], EDGE), Workspace(spark, "empty"))
    g.save(str(tmp_path / "g"))
    again = Graph.load(spark, str(tmp_path / "g"))
    assert (again.node_count(), again.edge_count(), again.out_degree(0), again.string_to_id("a")) == (0, 0, 0, 4294967295)
    assert rows(load_offsets(spark, str(tmp_path / "g")), "node_id", "edge_offset") == [(0, 0)]


def test_null_endpoints_are_no_nodes(spark):
    e = spark.createDataFrame([("a", "X", "r", None, None), ("a", "X", "r", "b", "Y")], EDGE)
    g = Graph.build(e, Workspace(spark, "nulls"))
    assert (g.node_count(), g.edge_count()) == (2, 1)
    assert traversal.khop_count(e, traversal.KHopQuery(("a",), 2)) == 1


@pytest.mark.parametrize(
    "numbers, code",
    [([], ""), ([0], "00"), ([127], "7F"), ([128], "8001"), ([300], "AC02"), ([16383], "FF7F"), ([16384], "808001"), ([2097151], "FFFF7F"), ([2097152], "80808001"), ([268435455], "FFFFFF7F"), ([268435456], "8080808001"), ([4294967295], "FFFFFFFF0F"), ([5, 8, 8, 7], "050300FFFFFFFF0F")],
)
def test_codec(spark, numbers, code):
    df = spark.createDataFrame([(numbers,)], "list array<long>")
    got = df.select(codec.compressed_hex(F.col("list")).alias("h"), codec.decompressed(codec.compressed(F.col("list"))).alias("l"), codec.compressed_length(F.col("list")).alias("n")).first()
    assert got.h == code and got.l == numbers and got.n == len(code) // 2


def test_lines_write_and_header(spark, edges, tmp_path):
    lines.write_lines(edges, str(tmp_path / "out"))
    assert rows(lines.read_edges(spark, str(tmp_path / "out")), *EDGE.names) == rows(edges, *EDGE.names)
    (tmp_path / "h.csv").write_text("s,sl,e,t,tl\na,X,r,b,Y\n")
    assert lines.read_edges(spark, str(tmp_path / "h.csv"), header=True).count() == 1
    bad = spark.createDataFrame([("a,b", "X", "r", "c", "Y")], EDGE)
    with pytest.raises(Exception, match="comma"):
        lines.write_lines(bad, str(tmp_path / "bad"))


def test_read_binary(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"\x00\x01")
    assert bytes(read_binary(spark, str(tmp_path / "x.bin")).first().content) == b"\x00\x01"
    with pytest.raises(Exception):
        read_binary(spark, str(tmp_path / "absent")).collect()


def test_decoding_is_linear_in_a_hub(spark):
    import time

    n = 1_000_000
    hub = spark.range(1).select(F.sequence(F.lit(0), F.lit(7 * (n - 1)), F.lit(7)).cast("array<bigint>").alias("list"))
    began = time.perf_counter()
    got = hub.select(codec.decompressed(codec.compressed(F.col("list"))).alias("back"), "list").select((F.col("back") == F.col("list")).alias("same"), F.size("back").alias("n")).first()
    assert got.same and got.n == n and time.perf_counter() - began < 30


def test_codes_in_one_batch(spark):
    """Unfinished ends, long codes, empty and null codes beside each other."""
    cases = [("AC02", [300]), ("", []), ("80", []), ("0180", [1]), ("8080808080800103", [0, 3]), (None, None), ("FFFFFFFF0F7F", [4294967295, 127]), ("FF", []), ("05", [5])]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "i int, h string").coalesce(1)
    got = {r.i: r.v for r in df.select("i", codec.decode_varints(F.unhex("h")).alias("v")).collect()}
    assert got == {i: v for i, (_, v) in enumerate(cases)}
    sums = spark.createDataFrame([([5, 3, 0, 4294967295],), ([],), (None,), ([1, 1],)], "d array<bigint>").coalesce(1)
    assert [r.s for r in sums.select(codec.undeltas(F.col("d")).alias("s")).collect()] == [[5, 8, 8, 7], [], None, [1, 2]]


def test_hub_over_many_ranges(spark):
    """A hub's list, with repeated edges, crosses ranges."""
    pairs = [(0, p) for p in range(4000)] + [(0, 17)] * 500 + [(1, 3), (2, 1), (2, 1)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    sizes = {r.node: (r.edges, r.bytes) for r in adjacency.compressed_sizes(edges).collect()}
    assert sizes == {0: (4500, 4500), 1: (1, 1), 2: (2, 2)}
    got = [(r.node, r["rank"], r.peer) for r in adjacency.neighbour_rows(edges).collect()]
    expected = [(n, i, p) for n in range(3) for i, p in enumerate(sorted(p for m, p in pairs if m == n))]
    assert sorted(got) == expected


def test_header_is_one_line_a_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("s,x,y,t,z\n1,a,b,2,c\ns,x,y,t,z\n")
    (tmp_path / "b.csv").write_text("s,x,y,t,z\n")
    (tmp_path / "c.csv").write_text("")
    assert sorted(r.value for r in lines.read_lines(spark, str(tmp_path), header=True).collect()) == ["1,a,b,2,c", "s,x,y,t,z"]


def test_command_line(spark, tmp_path, capsys):
    import json

    from hoplite import __main__ as cli

    (tmp_path / "e.csv").write_text("head\n" + HAND)
    g = cli.build(spark, str(tmp_path / "e.csv"), str(tmp_path / "g"), header=True)
    assert (g.node_count(), g.edge_count()) == (6, 8)
    assert cli.lookup(spark, str(tmp_path / "g"), ["alice", "zzz"]) == [{"node": "alice", "id": 0, "out": [1, 1, 2], "in": [2]}, {"node": "zzz", "id": 4294967295, "out": [], "in": []}]
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "1").write_text('POST /q HTTP/1.1\r\n\r\n{"items":["alice"],"length":4,"labels":[]}', newline="")
    (tmp_path / "r" / "2").write_text("nothing")
    got = cli.answers(spark, str(tmp_path / "e.csv"), str(tmp_path / "r")).collect()
    assert [(r.path, r["count"]) for r in got] == [("/q", 4), (None, 0)]
    with pytest.raises(SystemExit):
        cli.main(["walk"])
    assert json.loads('{"port": 8080}')["port"] == cli._arguments(["serve", "x"]).port


def test_server(spark, edges):
    import socket
    import threading

    from hoplite.streaming.server import RequestServer

    body = '{"items":["alice"],"length":1,"labels":[]}'
    with RequestServer(edges, 0, "127.0.0.1") as server:
        for raw, count in ((f"POST /q HTTP/1.1\r\nContent-Length: {len(body)}\r\n\r\n{body}", 2), ("GET / HTTP/1.1\r\n\r\n", 0)):
            worker = threading.Thread(target=server.serve_one)
            worker.start()
            with socket.create_connection(("127.0.0.1", server.port)) as c:
                c.sendall(raw.encode())
                got = b"".join(iter(lambda: c.recv(4096), b""))
            worker.join()
            assert got.decode().endswith('\r\n\r\n{"count":%d}' % count)


def test_release(spark):
    from hoplite.plans import workspace

    work = Workspace(spark, "gone")
    df = work.put(spark.range(3), "t")
    assert df.count() == 3 and workspace.release(spark) > 0
    assert not spark._jvm.java.io.File(work.root.removeprefix("file://")).exists()
