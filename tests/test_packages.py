"""GeoPackages that are written read back equal, whatever tasks fail or repeat."""

import os
import sqlite3

import pytest

from cadastra.geometry import wkb
from cadastra.sources import layers, packages


def box(x, y, n=1.0):
    return wkb.dump([[[(x, y), (x + n, y), (x + n, y + n), (x, y + n)]]])


@pytest.fixture
def rows(spark):
    data = [(f"0{k % 3}", k, f"it's {k}", k / 2, k % 2 == 0, box(k, 0) if k % 5 else None) for k in range(20)] + [(None, 99, None, None, None, wkb.dump([]))]
    return spark.createDataFrame(data, "geocode string, fid long, name string, area double, even boolean, geom binary")


def test_written_layers_read_back(spark, rows, tmp_path):
    path = str(tmp_path / "out")
    packages.write_geopackages(rows, path, template="Layer {geocode}_bgy areas")
    assert sorted(os.listdir(path)) == ["00_bgy_areas.gpkg", "01_bgy_areas.gpkg", "02_bgy_areas.gpkg", "null_bgy_areas.gpkg"]
    schema = "geocode string, fid long, name string, area double, even boolean, geom binary"
    got = [r for c in ("00", "01", "02", "null") for r in layers.read_gpkg(spark, f"{path}/{c}_bgy_areas.gpkg", f"{c}_bgy_areas", schema).collect()]
    assert sorted(map(str, got)) == sorted(map(str, rows.collect()))
    assert {r["layer"] for r in layers.gpkg_layers(spark, path).collect()} == {"00_bgy_areas", "01_bgy_areas", "02_bgy_areas", "null_bgy_areas"}
    with sqlite3.connect(f"{path}/01_bgy_areas.gpkg") as db:
        assert db.execute("PRAGMA application_id").fetchone() == (0x47504B47,) and db.execute("PRAGMA integrity_check").fetchone() == ("ok",)
        assert db.execute("SELECT data_type, min_x, min_y, max_x, max_y FROM gpkg_contents").fetchall() == [("features", 1.0, 0.0, 20.0, 1.0)]
        assert db.execute('SELECT count(DISTINCT "_fid") FROM "01_bgy_areas"').fetchone() == (7,)


def test_append_overwrite_and_split(spark, rows, tmp_path):
    path = str(tmp_path / "out")
    packages.write_geopackages(rows, path)
    packages.write_geopackages(rows.where("geocode = '01' AND fid < 5"), path, append=True)

    def count(stem):
        return layers.read_gpkg(spark, f"{path}/{stem}.gpkg", stem, "fid long").count()

    assert (count("00"), count("01")) == (7, 9)
    packages.write_geopackages(rows.where("geocode = '01' AND fid < 5"), path)
    assert (count("00"), count("01"), count("null")) == (7, 2, 1)
    split = str(tmp_path / "split")
    packages.write_geopackages(rows, split, rows_per_file=3)
    files = sorted(f[:-5] for f in os.listdir(split) if f.startswith("00"))
    assert len(files) > 1 and sum(layers.read_gpkg(spark, f"{split}/{f}.gpkg", f, "fid long").count() for f in files) == 7
    empty = str(tmp_path / "empty")
    packages.write_geopackages(rows.limit(0), empty)
    assert not os.path.exists(empty) or os.listdir(empty) == []


def test_failed_writes_leave_nothing(spark, rows, tmp_path):
    path = str(tmp_path / "out")
    with pytest.raises(Exception, match="cannot name a file"):
        packages.write_geopackages(rows.selectExpr("'../x' AS geocode", "geom"), path)
    spark.dataSource.register(packages.GeoPackage)
    with pytest.raises(Exception, match="several tasks"):
        rows.selectExpr("*", "'one' AS _file").repartition(4, "fid").write.format("geopackage").mode("append").save(path)
    assert not os.path.exists(path) or os.listdir(path) == []
    table = str(tmp_path / "table")
    packages.write_geopackages(rows.select("geocode", "fid"), table, code="geocode")
    with sqlite3.connect(f"{table}/00.gpkg") as db:
        assert db.execute("SELECT data_type FROM gpkg_contents").fetchall() == [("attributes",)]


def test_folders_must_be_mounted():
    assert packages.local_path("file:/a/b") == packages.local_path("file:///a/b") == packages.local_path("/a/b") == "/a/b"
    with pytest.raises(ValueError, match="no mounted folder"):
        packages.local_path("hdfs://host/a")
    assert packages.file_stem("01", "EA {geocode}_bgy areas") == "01_bgy_areas" and packages.file_stem(None, "{geocode}") == "null"
