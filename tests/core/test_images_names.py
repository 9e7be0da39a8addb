import math

import pytest
from pyspark.sql import functions as F

from orbisloom.operators import images, names


def grid(spark, f, h=6, w=8):
    return spark.createDataFrame([(0, y, x, float(f(y, x))) for y in range(h) for x in range(w)], "frame int, y int, x int, v double")


def test_blur_keeps_constants_and_mass(spark):
    flat = images.blurred(grid(spark, lambda y, x: 3), "frame", "v", 1.0, 6, 8).collect()
    assert len(flat) == 48 and all(r.v == pytest.approx(3.0) for r in flat)


def test_metrics_and_edges(spark):
    a = grid(spark, lambda y, x: (x + y) % 2)
    m = images.repair_metrics(a, a.withColumn("v", F.col("v") * 2), "frame", "v").first()
    assert m.gain == pytest.approx(4.0) and m.drift == pytest.approx(0.5)
    assert images.repair_metrics(grid(spark, lambda y, x: 1), a, "frame", "v").first().gain is None
    edges = images.depth_edges(grid(spark, lambda y, x: 1 if x < 4 else 9), "frame", "v", 0.5, 6, 8)
    assert {r.x for r in edges.filter("edge").collect()} == {3, 4}


def test_bilinear_sampling_wraps(spark):
    px = grid(spark, lambda y, x: x)
    t = spark.createDataFrame([(1, 2.5 / 8, 0.5), (2, 0.0, 0.5)], "k int, a double, b double")
    got = {r.k: r.v for r in images.sampled(t, px, "a", "b", "v", 6, 8).collect()}
    assert got[1] == pytest.approx(2.0) and got[2] == pytest.approx(3.5)


def test_uv_code(spark):
    u = spark.range(50).select((F.col("id") / 50).alias("u"))
    assert all(abs(r.u - r.d) < 1e-9 for r in u.select("u", images.decode_uv(images.encode_uv(F.col("u"), 8), 8).alias("d")).collect())


def test_agreement_and_feather(spark):
    p = grid(spark, lambda y, x: x * x + y).withColumn("w", 2 * F.col("v") + 1)
    assert all(r.zncc == pytest.approx(1.0) for r in images.agreement(p, "frame", "v", "w", 1, 6, 8).collect())
    soft = images.box_feathered(grid(spark, lambda y, x: x == 0), "frame", "v", 1, 6, 8).collect()
    assert {r.v for r in soft if r.x == 0} == {1.0} and all(0 < r.v < 1 for r in soft if r.x == 1)


def test_least_squares(spark):
    a = spark.createDataFrame([(0, 0, 2.0), (1, 1, 1.0), (2, 0, 1.0), (2, 1, 1.0)], "i int, j int, v double")
    b = spark.createDataFrame([(0, 2.0), (1, 3.0), (2, 4.0)], "i int, b double")
    got = {r.j: r.x for r in images.least_squares(a, b).collect()}
    assert got[0] == pytest.approx(1.0, abs=1e-6) and got[1] == pytest.approx(3.0, abs=1e-6)


def test_vanishing_points(spark):
    rows = [("a", 10.0 * math.cos(t), 10.0 * math.sin(t), 40.0 * math.cos(t), 40.0 * math.sin(t)) for t in [k * 0.3 for k in range(12)]]
    df = spark.createDataFrame(rows, "image string, x0 double, y0 double, x1 double, y1 double")
    r = images.vanishing_points(df, "image", rounds=50).first()
    assert r.inliers >= 10 and abs(r.vx / r.vw) < 1e-6 and abs(r.vy / r.vw) < 1e-6


def test_culling_keeps_what_is_seen(spark):
    v = spark.createDataFrame([(i, *c) for i, c in enumerate([(0.0, 0.0, 1.0), (5.0, 0.0, 1.0), (0.0, 5.0, 1.0), (5.0, 5.0, 1.0), (6.0, 5.0, 1.0)])], "vid int, x double, y double, w double")
    f = spark.createDataFrame([(0, 0, 1, 2), (1, 1, 3, 4)], "fid int, v0 int, v1 int, v2 int")
    assert [r.fid for r in images.frustum_culled(f, v).collect()] == [0]


def test_names(spark):
    k = spark.createDataFrame([("a.lora_A",), ("b.other",)], "k string")
    assert [r.new_key for r in names.renamed_keys(k, "k", {".lora_A": ".down"}).collect()] == ["a.down", None]
    n = spark.createDataFrame([("Old_x",), ("Old_y",), ("z",)], "id string")
    ok = spark.createDataFrame([("New_x",)], "c string")
    assert {(r.id, r.status, r.new_id) for r in names.remapped_ids(n, "id", ok, "c", "Old_", "New_").collect()} == {("Old_x", "mapped", "New_x"), ("Old_y", "dropped", "Old_y"), ("z", "skipped", "z")}
    d = spark.createDataFrame([('{"a": [{"type": "x"}]}',), ("no",), (None,)], "t string")
    assert [r.moved for r in names.remap_documents(d, "t", {"x": "y"}).collect()] == [1, None, None]
    m = spark.createDataFrame([({"a": "1", "b": "2"}, {"a": "1", "b": "3", "c": "4"})], "o map<string,string>, n map<string,string>")
    assert m.select(names.changed_knobs(F.col("o"), F.col("n")).alias("c")).first().c == ["b", "c"]
    t = spark.createDataFrame([(2, "b"), (1, None)], "i int, s string")
    assert [r.line for r in names.markdown_table(t, ["i"]).collect()] == ["| i | s |", "| --- | --- |", "| 1 |  |", "| 2 | b |"]
    old = spark.createDataFrame([("a", 1)], "k string, v int")
    assert names.first_backups(old, spark.createDataFrame([("a", 2), ("b", 3)], "k string, v int"), "k").count() == 2
