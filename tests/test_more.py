"""Cover, map data, sinks and arguments."""

import math
import zlib

import pytest
from pyspark.sql import functions as F

from spanforge.operators import cover
from spanforge.plans import cli, etl
from spanforge.sources import blocks, pbf, sinks

RING = "array<struct<e:double,n:double>>"


def square(x, y, s):
    return [{"e": x + a * s, "n": y + b * s} for a, b in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))]


def test_cover_prefers_buildings_and_spares_islands(spark):
    shapes = spark.createDataFrame([("water", square(0.0, 0.0, 300.0)), ("island", square(100.0, 100.0, 50.0)), ("building", square(10.0, 10.0, 20.0))], f"kind string, ring {RING}")
    points = spark.createDataFrame([(1, 15.0, 15.0), (2, 120.0, 120.0), (3, 250.0, 250.0), (4, 400.0, 1.0)], "id long, e double, n double")
    got = {r["id"]: r["cover"] for r in cover.cover(points, shapes, ["id"]).collect()}
    assert got == {1: "building", 2: "none", 3: "water", 4: "none"}


def test_incomplete_is_unknown(spark):
    wanted = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "span string, block int")
    held = spark.createDataFrame([(1, "x")], "block int, way string")
    assert [(r["span"], r["way"]) for r in cover.held_if_complete(wanted, held, "block", "span").collect()] == [("b", "x")]


def test_circles_need_most_of_their_cells(spark):
    cells = spark.createDataFrame([(x, y, float(x), "canopy" if y > 5 else "ground") for x in range(11) for y in range(11)], "cx long, cy long, z double, cover string")
    points = spark.createDataFrame([(1, 5.5, 5.5), (2, 0.5, 0.5)], "id long, e double, n double")
    got = {r["id"]: r for r in cover.around(points, cells, "id", 3.0).collect()}
    assert got[1]["relief"] == 6 and got[1]["top"] == 8 and 0 < got[1]["canopy"] < 0.5 and got[1]["building"] == 0
    assert got[2]["relief"] is None


def test_searched_areas(spark):
    lon, lat = 13.0, 52.0
    outlines = spark.createDataFrame([("x", square(lon, lat, 0.5)), ("y", square(lon + 3, lat, 0.5))], f"name string, ring {RING}")
    searched = spark.createDataFrame([(300000.0, 5700000.0, 420000.0, 5900000.0)], "min_e double, min_n double, max_e double, max_n double")
    assert [r["name"] for r in cover.searched_areas(outlines, searched).collect()] == ["x"]


def test_oldest_entries_go(spark):
    df = spark.createDataFrame([(f"k{i}", 10, i) for i in range(10)], "key string, bytes int, used_at int")
    assert {r["key"] for r in cover.evicted(df, 90).collect()} == {"k0", "k1", "k2"}
    assert cover.evicted(df, 100).count() == 0


def varint(v):
    out = b""
    while v > 127:
        out += bytes([v & 127 | 128])
        v >>= 7
    return out + bytes([v])


def message(*parts):
    out = b""
    for number, value in parts:
        out += varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value
    return out


def deltas(values):
    out, last = b"", 0
    for v in values:
        out += varint(blocks.zigzag(v - last))
        last = v
    return out


def pbf_file():
    table = message(*[(1, s.encode()) for s in ("", "highway", "primary", "natural", "water", "outer", "inner")])
    at = [(1, 13.0, 52.0), (2, 13.001, 52.0), (3, 13.001, 52.001), (4, 13.0, 52.001), (99, 0.0, 0.0)]
    dense = message((1, deltas([a[0] for a in at])), (8, deltas([round(a[2] * 1e7) for a in at])), (9, deltas([round(a[1] * 1e7) for a in at])))
    road = message((1, 10), (2, varint(1)), (3, varint(2)), (8, deltas([1, 2, 3])))
    broken = message((1, 11), (2, varint(1)), (3, varint(2)), (8, deltas([1, 77])))
    half = [message((1, 12), (8, deltas([1, 2, 3]))), message((1, 13), (8, deltas([3, 4, 1])))]
    lake = message((1, 20), (2, varint(3)), (3, varint(4)), (8, varint(5) + varint(5)), (9, deltas([12, 13])), (10, varint(1) + varint(1)))
    body = message((1, table), (2, message((2, dense))), (2, message((3, road), (3, broken), *[(3, h) for h in half])), (2, message((4, lake))))
    blob = message((2, len(body)), (3, zlib.compress(body)))
    head = message((1, b"OSMData"), (3, len(blob)))
    other = message((1, b"OSMHeader"), (3, 0))
    return len(other).to_bytes(4, "big") + other + len(head).to_bytes(4, "big") + head + blob


def test_map_data_to_blocks(spark):
    data = pbf.split(spark.createDataFrame([("f", bytearray(pbf_file()))], "path string, content binary"), 2)
    assert pbf.nodes(data).count() == 5 and pbf.ways(data).count() == 4 and pbf.relations(data).first()["members"][0]["role"] == "outer"
    found = etl.features(pbf.nodes(data), pbf.ways(data), pbf.relations(data))
    rows = {r["kind"]: r for r in found.collect()}
    assert set(rows) == {"road", "water"} and rows["road"]["id"] == 10 and len(rows["road"]["pts"]) == 3 and rows["water"]["id"] < 0 and len(rows["water"]["pts"]) >= 5
    back = blocks.read(blocks.write(etl.by_block(found)).withColumn("path", F.concat(F.lit("/x/"), "block", F.lit(".bin"))))
    assert {r["kind"] for r in back.collect()} == {"road", "water"} and etl.census(found).count() == 2


def test_a_used_node_out_of_bounds_is_an_error(spark):
    nodes = spark.createDataFrame([(1, 52.0, 13.0), (2, 0.0, 0.0), (3, 0.0, 0.0)], "id long, lat double, lon double")
    lines = spark.createDataFrame([(10, [1, 2], {"highway": "primary"})], "id long, refs array<long>, tags map<string,string>")
    relations = spark.createDataFrame([], pbf.RELATIONS)
    with pytest.raises(Exception, match="out of bounds in way 10"):
        etl.features(nodes, lines, relations).count()
    assert etl.features(nodes.where("id <> 2").unionByName(nodes.where("id = 1").withColumn("id", F.lit(2).cast("long"))), lines, relations).count() == 1


def test_links_round_trip():
    state = {"box": (52.1234567, 13.1, 52.2, 13.4), "line": "a_b", "sag": 5.0, "kinds": ["urban"], "filters": {"score": 40.0, "maxlen": 300.0, "canopy": 100.0}}
    text = sinks.to_query(state)
    got = sinks.from_query(text)
    assert "canopy" not in text and got["line"] == "a_b" and got["kinds"] == ["urban"] and got["filters"] == {"score": 40.0, "maxlen": 300.0}
    assert all(a <= b for a, b in zip(got["box"][:2], state["box"][:2], strict=True)) and all(a >= b for a, b in zip(got["box"][2:], state["box"][2:], strict=True))
    assert sinks.from_query("at=1,2,x,4&score=oops&kinds=zzz") == {"box": None, "line": None, "sag": None, "kinds": None, "filters": {}}


def test_published_lines_keep_their_kind(spark, tmp_path):
    df = spark.createDataFrame([(1, "urban", 1.04, 2.0, 3.0, 4.0, 5.06, 9.12345)], "id long, kind string, ae double, an double, be double, bn double, length double, score double")
    sinks.write_lines(df, str(tmp_path / "l"))
    r = sinks.read_lines(spark, str(tmp_path / "l")).first()
    assert r["kind"] == "urban" and r["ae"] == 1.0 and math.isclose(r["length"], 5.1) and r["score"] == 9.123


@pytest.mark.parametrize("bad", [["1", "2", "3"], ["--chunk", "52-1"], ["--before", "soon"], ["--hotspots", "--all"], ["a", "b", "c", "d"]])
def test_contradictions_are_errors(bad):
    with pytest.raises(ValueError, match="."):
        cli.asked(bad)


def test_arguments():
    got = cli.asked(["1", "2", "3", "4", "--chunk", "52_-3", "--before", "2026-01-02"])
    assert got.rectangles == [(1, 2, 3, 4)] and got.chunks == [(52, -3)] and got.before.year == 2026
