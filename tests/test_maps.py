"""Map tiles, reports and readers that SQL can't be held against: odd inputs."""

import pytest
from pyspark.sql import functions as F

from spanforge.functions import maps
from spanforge.operators import places
from spanforge.plans import report
from spanforge.sources import readers, sinks


def test_phases_are_scaled_to_their_stage():
    assert report.phase_rows(10, 20, [("a", 8.0), ("b", 10.0)]) == [("b", 5.0), ("a", 4.0), ("other", 1.0)]
    assert report.phase_rows(10, 5, [("a", 9.9)]) == [("a", 9.9)] and report.phase_rows(1, 0, []) == []


def test_report(spark):
    text = report.render(spark, [("scan", 2.0, 1_200_000, 1800), ("pair", 6.0, 1800, 4000), ("load", 0.0, None, 0)])
    assert [line.split() for line in text.splitlines()] == [["stage", "time", "share", "in", "out", "kept"], ["scan", "2.0s", "25%", "1.2M", "1,800", "0.15%"], ["pair", "6.0s", "75%", "1,800", "4,000", "x2.2"], ["load", "0.0s", "0.00%", "0"], ["total", "8.0s"]]


def test_rasters_in_replies():
    assert readers.raster_in(b"II*\x00abc") == (b"II*\x00abc", None)
    assert readers.raster_in(b"--x\r\n\r\nMM\x00*abc") == (b"MM\x00*abc", None)
    assert readers.raster_in(b"<ServiceException/>")[1] == "refused, no reason given" and readers.raster_in(b"")[0] is None
    assert readers.raster_in(b" " * 65536 + b"II*\x00")[0] is None


def test_optional_files(spark, tmp_path):
    assert readers.files(spark, str(tmp_path / "none"), optional=True).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.files(spark, str(tmp_path / "none"))


def test_wrong_numbers_of_areas_and_lists_are_errors(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"features":[{"properties":{"gen":"x","gf":4},"geometry":{"type":"MultiPolygon","coordinates":[[[[1,2],[3,4],[5,0]]],[[[7,8],[9,9],[8,7]]]]}},{"properties":{"gen":"x","gf":2},"geometry":null}]}')
    assert [len(line) for line in readers.outlines(spark, str(tmp_path / "a.json"), 1).first()["lines"]] == [3, 3]
    with pytest.raises(ValueError, match="1 areas"):
        readers.outlines(spark, str(tmp_path / "a.json"), 2)
    (tmp_path / "o.json").write_text('{"id":[1,2],"drop":[1.5]}')
    with pytest.raises(Exception, match="differ in length"):
        readers.overlay(spark, str(tmp_path / "o.json"), "id long, drop double").collect()


def test_a_track_needs_a_ratio():
    with pytest.raises(ValueError):
        maps.track_position(None, 0, 5)


def test_places_without_data(spark):
    lines = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 0.0), (2, 5.0, 5.0, 5.0, 5.0)], "id long, ae double, an double, be double, bn double")
    ground = spark.createDataFrame([(-1, 0, 3.0)], "cx long, cy long, z double")
    got = places.wings(lines, ground).collect()
    assert {(r["id"], r["side"]) for r in got} == {(1, "before")} and all(r["surface"] == r["ground"] == 3 and r["d"] < 0 for r in got)
    none = spark.createDataFrame([], "name string, ring array<struct<e:double,n:double>>")
    at = spark.createDataFrame([(1, 10.0, 50.0), (2, None, None)], "id long, e double, n double")
    assert places.near_outlines(at, none, ["id"]).count() == 0
    sources = spark.createDataFrame([("all", 1, True, None)], "source string, priority long, surface boolean, outline string")
    assert {(r["id"], r["source"]) for r in places.covered_by(at, sources, none, ["id"]).collect()} == {(1, "all"), (2, "all")}
    assert {r["source"] for r in places.covered_by(at, sources.limit(0), none, ["id"]).collect()} == {None}
    tiles = spark.createDataFrame([], "te long, tn long")
    assert tuple(places.tile_census(tiles, tiles).first()) == (0, 0, 0, 0, 0.0)


def test_meta_of_nothing(spark, tmp_path):
    lines = spark.createDataFrame([], "kind string, score double, length double, exposure double")
    sinks.write_meta(sinks.meta(lines, {}), f"file://{tmp_path}/meta.json")
    about = spark.read.json(f"file://{tmp_path}/meta.json").first()
    assert (about["count_urban"], about["max_length"]) == (0, 100)


def test_all_of(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    assert sinks.all_of([a, a.drop("y"), a]).where(F.col("y").isNull()).count() == 1
    with pytest.raises(ValueError):
        sinks.all_of([])
