"""Formats: round trips, and what is dropped."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.operators import openness, regions, search
from spanforge.params import DEFAULTS
from spanforge.sources import blocks, readers
from spanforge.streaming import regions as stream


def test_blocks_round_trip(spark):
    rows = [
        {"id": 7, "kind": "street", "name": "residential", "half": 3.0, "bridge": True, "pts": [(8000.1, 16000.2), (8100.0, 15990.5)]},
        {"id": -3, "kind": "island", "name": "ä", "half": 0.0, "bridge": False, "pts": [(8001.0, 16001.0)]},
    ]
    data = blocks.encode("1-2", rows)
    assert blocks.decode("1-2", data) == sorted(rows, key=lambda r: r["id"])
    with pytest.raises(ValueError, match="block"):
        blocks.decode("1-2", blocks.gzip.compress(b"\x01\x00"))
    df = spark.createDataFrame([("/x/1-2.bin", bytearray(data))], "path string, content binary")
    back = blocks.read(df)
    assert back.count() == 2 and blocks.decode("1-2", bytes(blocks.write(back).first()["content"])) == blocks.decode("1-2", data)


def test_simplify():
    line = [(0.0, 0.0), (1.0, 0.05), (2.0, 0.0), (3.0, 2.0), (4.0, 0.0)]
    assert blocks.simplify(line, 0.1) == [(0.0, 0.0), (2.0, 0.0), (3.0, 2.0), (4.0, 0.0)]


def tiff(z, west, north, cell):
    raw = zlib.compress(z.astype("<f4").tobytes())
    entries = [(256, 4, 1, z.shape[1]), (257, 4, 1, z.shape[0]), (258, 3, 1, 32), (259, 3, 1, 8), (273, 4, 1, None), (278, 4, 1, z.shape[0]), (279, 4, 1, len(raw)), (339, 3, 1, 3)]
    at = 8 + 2 + 12 * (len(entries) + 2) + 4
    extra = struct.pack("<3d", cell, cell, 0) + struct.pack("<6d", 0, 0, 0, west, north, 0)
    out = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(entries) + 2)
    for tag, kind, count, value in entries:
        value = at + len(extra) if value is None else value
        out += struct.pack("<HHI", tag, kind, count) + (struct.pack("<HH", value, 0) if kind == 3 else struct.pack("<I", value))
    out += struct.pack("<HHII", 33550, 12, 3, at) + struct.pack("<HHII", 33922, 12, 6, at + 24) + struct.pack("<I", 0)
    return out + extra + raw


def test_geotiffs_keep_the_highest_and_drop_nodata(spark):
    z = np.array([[1, 2, -9999, 4], [5, 6, 7, 8]], float)
    df = spark.createDataFrame([("a", bytearray(tiff(z, 100, 202, 1.0)))], "path string, content binary")
    got = {(r["cx"], r["cy"]): r["z"] for r in readers.read_geotiffs(df, 2.0).collect()}
    assert got == {(50, 100): 6.0, (51, 100): 8.0}


def test_level_faces(spark):
    flat, steep = "0 0 5 1 0 5 1 1 5 0 0 5", "0 0 5 1 0 6 1 1 5 0 0 5"
    gml = f"<gml:posList srsDimension='3'>{flat}</gml:posList><gml:posList>{steep}</gml:posList><gml:posList>0 0 1 1 1 1</gml:posList>"
    got = readers.level_faces(spark.createDataFrame([("t", gml)], "tile string, gml string")).collect()
    assert len(got) == 1 and got[0]["z"] == 5 and len(got[0]["ring"]) == 4


def test_overpass_poly_and_geojson(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"elements":[{"type":"way","id":1,"tags":{"highway":"track","bridge":"yes"},"geometry":[{"lat":52,"lon":13},{"lat":52.1,"lon":13}]},{"type":"relation","id":2,"tags":{"natural":"water"},"members":[{"role":"inner","geometry":[{"lat":52,"lon":13}]},{"role":"outer","geometry":[]}]},{"type":"way","id":3,"tags":{"building":"yes"},"geometry":[{"lat":1,"lon":1}]}]}')
    got = {r["kind"]: r for r in readers.read_overpass(spark, str(tmp_path / "o.json")).collect()}
    assert set(got) == {"path", "island"} and got["path"]["bridge"] and got["island"]["id"] < 0
    (tmp_path / "d.poly").write_text("x\n1\n   13.0  52.0\n   14.0  52.5\n   13.5  53.0\nEND\nEND\n")
    assert [tuple(p) for p in readers.read_poly(spark, str(tmp_path / "d.poly")).first()["ring"]] == [(13, 52), (14, 52.5), (13.5, 53)]
    (tmp_path / "l.json").write_text('{"features":[{"properties":{"c":"DE","lt":"h"},"geometry":{"type":"LineString","coordinates":[[1,2],[3,4]]}},{"properties":{"c":"FR","lt":"h"},"geometry":null}]}')
    assert readers.known_lines(spark, str(tmp_path / "l.json")).first()["type"] == "LineString"


def test_priority_and_surface(spark):
    w = spark.createDataFrame([(1, 1, None), (1, 2, 5.0), (1, 3, 6.0)], "k int, priority int, z double")
    assert readers.prefer(w, ["k"]).first()["z"] == 5
    cells = spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0)], "cx long, cy long, z double")
    got = {r["cx"]: (r["surface"], r["known"]) for r in readers.with_surface(cells, cells.where("cx = 1").withColumn("z", F.lit(9.0))).collect()}
    assert got == {0: (1.0, False), 1: (9.0, True)}


def canyon(spark, floor=20.0, w=300, h=120):
    return spark.range(w * h).select((F.col("id") % w).alias("cx"), F.floor(F.col("id") / w).alias("cy")).withColumn("z", F.when((F.col("cx") < 60) | (F.col("cx") >= 240), 50.0).otherwise(floor))


def test_anchors_at_the_rim(spark):
    found = openness.scan(canyon(spark), p=DEFAULTS, tile=128).collect()
    assert found and all(40 <= r["e"] < 60 or 240 <= r["e"] <= 260 for r in found)
    assert all(r["open_count"] > 0 and r["drop_depth"] >= 10 for r in found)
    assert openness.scan(canyon(spark, 50.0), p=DEFAULTS, tile=128).count() == 0
    assert len({(r["e"], r["n"]) for r in found}) == len(found)


def test_a_line_over_the_canyon(spark):
    scene = search.Scene(canyon(spark))
    spans = spark.createDataFrame([(1, 57.5, 60.5, 242.5, 60.5), (2, 57.5, 60.5, 70.5, 60.5), (3, 57.5, 60.5, 900.5, 60.5), (4, 20.5, 60.5, 90.5, 60.5)], "id long, ae double, an double, be double, bn double")
    got = {r["id"]: r for r in search.evaluate(spans, scene).collect()}
    assert got[1]["reject"] is None and got[1]["length"] == 185 and got[1]["score"] > 50 and got[1]["kind"] == "natural"
    assert got[2]["reject"] == "length" and got[3]["reject"] == "geometry" and got[4]["reject"] is not None
    road = spark.createDataFrame([(1, "highway", "motorway", 12.5, False, [{"e": 150.0, "n": 0.0}, {"e": 150.0, "n": 119.0}])], "id long, tier string, kind string, half double, bridge boolean, pts " + readers.POINTS)
    over = search.evaluate(spans.where("id = 1"), search.Scene(canyon(spark), ways=road)).first()
    assert over["reject"] in (None, "crossing")
    planned = search.plan(spans.where("id in (1, 2)"), scene).collect()
    assert {r["id"]: len(r["violations"]) > 0 for r in planned} == {1: False, 2: True}


def test_areas_chunks_and_results(spark, tmp_path):
    assert [b for b, _ in regions.merge_areas([(0, 0, 1, 1), (5, 5, 6, 6), (1.5, 0, 3, 1)], 1)] == [(5, 5, 6, 6), (0, 0, 3, 1)]
    boxes = spark.createDataFrame([(7999.0, 0.0, 8001.0, 10.0)], "min_e double, min_n double, max_e double, max_n double")
    assert {(r["ce"], r["load_min_e"]) for r in regions.chunk_boxes(regions.chunks_over(boxes)).collect()} == {(0, -1000.0), (1, 7000.0)}
    with pytest.raises(ValueError, match="chunk"):
        regions.parse_chunk_name("52-1")
    path = str(tmp_path / "t")
    lines = spark.createDataFrame([(1, 5.0)], "id long, score double")
    for name in ("a", "b", "a"):
        regions.write_region(lines, path, name)
    assert regions.read_regions(spark, path).count() == 2 and regions.read_regions(spark, path, ["a"]).count() == 1


def test_stream_replaces_regions(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5.0, "a"), (2, 6.0, "b")], "id long, score double, region_id string")
    rows.write.parquet(str(tmp_path / "in" / "x"))
    table = str(tmp_path / "out")
    for _ in range(2):
        stream.follow(spark, str(tmp_path / "in" / "*"), "id long, score double, region_id string", table, str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(table).count() == 2
