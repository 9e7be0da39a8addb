import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from orbisloom.functions import keys
from orbisloom.sources import colmap, files


@pytest.fixture
def model(spark, tmp_path):
    cameras = spark.createDataFrame([(1, "SIMPLE_PINHOLE", 360, 360, [180.0, 180.0, 180.0]), (2, "SPHERE", 2048, 1024, [1.0, 1024.0, 512.0])], "camera_id int, model string, width long, height long, params array<double>")
    images = spark.createDataFrame(
        [(7, 1.0, 0.0, 0.0, 0.0, 0.5, 0.0, -1.0, 1, "frame_0_perspective_1.png", [(1.5, 2.5, -1), (3.0, 4.0, 2**53 + 1)]), (8, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 2, "é.png", [])],
        "image_id int, qw double, qx double, qy double, qz double, tx double, ty double, tz double, camera_id int, name string, observations array<struct<x:double,y:double,point3d_id:long>>",
    )
    points = spark.createDataFrame([(2**53 + 1, 1.0, 2.0, 3.0, 255, 0, 9, 0.5, [(7, 1)]), (3, 0.0, 0.0, 0.0, 1, 2, 3, 0.0, [])], "point3d_id long, x double, y double, z double, r int, g int, b int, error double, track array<struct<image_id:int,idx:int>>")
    colmap.write_model({"cameras": cameras, "images": images, "points3d": points}, str(tmp_path))
    return str(tmp_path)


def test_model_round_trip(spark, model):
    got = colmap.read_model(spark, model)
    cameras = {r.camera_id: r for r in got["cameras"].collect()}
    assert cameras[2].model == "SPHERE" and cameras[2].model_id == 11 and list(cameras[1].params) == [180.0] * 3
    images = {r.image_id: r for r in got["images"].collect()}
    assert images[7].observations[1].point3d_id == 2**53 + 1 and images[8].name == "é.png" and images[8].observations == []
    points = {r.point3d_id: r for r in got["points3d"].collect()}
    assert points[2**53 + 1].track[0].image_id == 7 and points[3].track == []
    assert [r.n for r in colmap.record_count(spark, f"{model}/images.bin").collect()] == [2]


def test_names_only_scan(spark, model):
    spark.dataSource.register(colmap.ModelSource)
    out = spark.read.format("colmap").option("kind", "images").option("names_only", "true").load(f"{model}/images.bin")
    assert {(r.name, r.observations) for r in out.collect()} == {("frame_0_perspective_1.png", None), ("é.png", None)}


def test_unknown_model_and_wrong_parameters_fail(spark, tmp_path):
    (tmp_path / "cameras.bin").write_bytes(struct.pack("<QiiQQ", 1, 1, 99, 4, 4))
    with pytest.raises(KeyError), open(tmp_path / "cameras.bin", "rb") as f:
        list(colmap.read_cameras(f))
    bad = spark.createDataFrame([(1, "PINHOLE", 4, 4, [1.0])], "camera_id int, model string, width long, height long, params array<double>")
    with pytest.raises(Exception, match="PINHOLE has 4 parameters"):
        colmap.write_model({"cameras": bad}, str(tmp_path))
    assert not (tmp_path / "cameras.bin.tmp").exists()


def test_many_parts_give_the_bytes_of_one(spark, tmp_path):
    rows = [(i, float(i), 2.0, 3.0, 1, 2, 3, 0.5, [(i, j) for j in range(i % 4)]) for i in range(5000)]
    schema = "point3d_id long, x double, y double, z double, r int, g int, b int, error double, track array<struct<image_id:int,idx:int>>"
    colmap.write_model({"points3d": spark.createDataFrame(rows, schema).repartition(7)}, str(tmp_path))
    want = struct.pack("<Q", 5000)
    for i, x, y, z, r, g, b, e, track in rows:
        want += struct.pack("<Qddd3BdQ", i, x, y, z, r, g, b, e, len(track)) + b"".join(struct.pack("<ii", *t) for t in track)
    assert (tmp_path / "points3D.bin").read_bytes() == want
    colmap.write_model({"points3d": spark.createDataFrame([], schema)}, str(tmp_path / "none"))
    assert (tmp_path / "none" / "points3D.bin").read_bytes() == struct.pack("<Q", 0)


def png(width, height):
    data = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + data + struct.pack(">I", zlib.crc32(b"IHDR" + data))


def test_listing_and_png_sizes(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(640, 480))
    (tmp_path / "b.PNG").write_bytes(b"no")
    (tmp_path / "c.png").write_bytes(b"no image")
    (tmp_path / "d.txt").write_bytes(b"x")
    assert {r.name for r in files.listing(spark, str(tmp_path)).collect()} == {"a.png", "b.PNG", "c.png"}
    assert {(r.name, r.width, r.height) for r in files.png_sizes(spark, str(tmp_path)).collect()} == {("a.png", 640, 480), ("c.png", None, None)}


def test_marker(spark, tmp_path):
    f = str(tmp_path / "m.json")
    files.write_json({"kind": "k", "sequences": [["a", "b"], ["c"]], "num_images": 3}, f)
    m = files.read_marker(spark, f)
    assert m.first().num_images == 3 and {tuple(r) for r in files.marker_sequences(m).collect()} == {(0, 0, "a"), (0, 1, "b"), (1, 0, "c")}
    (tmp_path / "m.json").write_text("{no json")
    assert files.read_marker(spark, f).first().kind is None and files.read_marker(spark, f + "x").first().kind is None


def test_rail_and_anchors(spark):
    eye = [[float(i == j) for j in range(4)] for i in range(4)]
    text = spark.createDataFrame([(json.dumps([eye, eye]),)], "value string")
    assert [len(r.m) for r in files.rail(text).collect()] == [16, 16]
    with pytest.raises(Exception):
        files.rail(spark.createDataFrame([("[[[1.0]]]",)], "value string")).collect()
    rows = files.anchors(spark.createDataFrame([("# path\n0 0 0\n1, 2, 3, 4, 5, 6\n",)], "value string")).collect()
    assert [(r.x, r.tz) for r in rows] == [(0.0, None), (1.0, 6.0)]
    assert files.anchors(spark.createDataFrame([("[[0,0,0],[1,2,3]]",)], "value string")).count() == 2
    assert files.anchors(spark.createDataFrame([("1 2",)], "value string"), strict=False).count() == 0
    with pytest.raises(Exception):
        files.anchors(spark.createDataFrame([("1 2 3",)], "value string")).collect()


def test_key_columns(spark):
    rows = spark.createDataFrame([("frame_3_perspective_5.PNG",), ("x_frame_1_perspective_2.png.bak",), ("hires_12.png",), ("__a b__",)], "n string")
    n = F.col("n")
    got = [tuple(r) for r in rows.select(keys.frame_of(n), keys.face_of(n), keys.frame_of(n, False), keys.hires_of(n), keys.safe_name(n), keys.stem(n)).collect()]
    assert got[0][:3] == (3, 5, 3) and got[1][:3] == (None, None, 1) and got[2][3] == 12 and got[3][4] == "a_b" and got[2][5] == "hires_12"
    colours = spark.createDataFrame([("#0f8",), ("#102030",), ("300, -5,7",), ("red",), (None,)], "t string").select(keys.colour(F.col("t"), (1, 2, 3)).alias("c"))
    assert [tuple(r.c) for r in colours.collect()] == [(0, 255, 136), (16, 32, 48), (255, 0, 7), (1, 2, 3), (1, 2, 3)]
