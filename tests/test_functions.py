import pytest
from pyspark.sql import functions as F

from hoplite.functions import text
from hoplite.operators import service
from hoplite.sources import lines

CASES = {"a,b,c,d": True, "a,b,c,": False, "a,b,c,,": True, "a,b,c": False, "": False, "a,b,,d": True, "a,b,c,d,e,f": True, "a,b,c,d\r": True, ",,,x": True, "a,b,c,\r": True, "last,b,c,d": True}


def test_acceptance(spark):
    df = spark.createDataFrame([(k,) for k in CASES], "value string")
    assert {r.value: r.ok for r in df.select("value", lines.accepted(F.col("value")).alias("ok")).collect()} == CASES
    got = {tuple(r) for r in lines.endpoints(df, 2, 3).collect()}
    assert ("c", "d\r") in got and ("", "d") in got and ("c", "\r") in got


@pytest.mark.parametrize("value, radix, signed, expected", [(-2147483648, 10, True, "-2147483648"), (-1, 16, True, "F" * 16), (-(1 << 63), 16, True, "8" + "0" * 15), (255, 36, True, "73"), (-1, 10, False, str((1 << 64) - 1)), (-(1 << 63), 36, True, "1Y2P0IJ32E8E8"), (-2, 7, False, "45012021522523134134600"), (5, 2, True, "101")])
def test_radix(spark, value, radix, signed, expected):
    got = spark.createDataFrame([(value,)], "x long").select(text.radix_text(F.col("x"), radix, signed).alias("t")).first().t
    digits, n = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", value % (1 << 64)
    brute = ""
    while n:
        n, d = divmod(n, radix)
        brute = digits[d] + brute
    assert got == (expected if radix == 10 and signed else brute)


def test_radix_range():
    with pytest.raises(ValueError):
        text.radix_text(F.lit(1), 37)


def test_service(spark):
    raw = 'POST /q HTTP/1.1\r\nHost: x\r\n\r\n{"a":1}'
    r = service.parse_requests(spark.createDataFrame([(raw,)], "raw string")).first()
    assert (r.path, r.body) == ("/q", '\r\n\r\n{"a":1}')
    out = spark.createDataFrame([(11,)], "n long").select(service.json_response(F.col("n")).alias("j"), service.http_response(F.col("n")).alias("h")).first()
    assert out.j == '{"count":11}' and out.h == 'HTTP/1.1 200 OK\r\nContent-Type: application/json\r\n\r\n{"count":11}'


def test_answers_and_streams(spark, tmp_path):
    from hoplite.streaming import requests as streams

    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "1.csv").write_text("a,X,r,b,Y\nb,Y,s,c,Z\nbroken\n")
    edges = lines.read_edges(spark, str(tmp_path / "e"))
    body = '{"items":["a"],"length":2,"labels":[%s]}'
    asked = [(1, "POST /x HTTP/1.1\r\n\r\n" + body % ""), (2, "POST /y HTTP/1.1\r\n\r\n" + body % '"r"'), (3, "bad"), (4, None)]
    frame = spark.createDataFrame(asked, "req long, raw string")
    assert {r.req: r["count"] for r in service.answer(frame, edges).collect()} == {1: 2, 2: 1, 3: 0, 4: 0}
    q = streams.edge_stream(spark, str(tmp_path / "e")).writeStream.format("memory").queryName("edge_stream").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("edge_stream").count() == 2
    frame.write.parquet(str(tmp_path / "r"))
    got = {}
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "r"))
    q = streams.answer_stream(stream, edges, lambda df, _: got.update({r.req: r["count"] for r in df.collect()}))
    q.processAllAvailable()
    q.stop()
    assert got == {1: 2, 2: 1, 3: 0}
    assert streams.query_stream(frame).columns[-3:] == ["items", "length", "labels"]
