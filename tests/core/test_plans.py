import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from orbisloom.operators import ordered as od
from orbisloom.operators import rails
from orbisloom.operators import relational as rel
from orbisloom.plans import datasets as ds
from orbisloom.streaming import chunks

IMAGE = "image_id int, qw double, qx double, qy double, qz double, tx double, ty double, tz double, camera_id int, name string"


@pytest.fixture
def model(spark):
    faces = [(f * 10 + c + 1, math.cos(c / 2), 0.0, math.sin(c / 2), 0.0, 0.0, 0.0, 0.0, 1, f"frame_{f}_perspective_{c}.png") for f in (0, 1) for c in range(3)]
    faces[4] = (*faces[4][:5], 5.0, 0.0, 0.0, 1, faces[4][9])
    hires = [(90, 1.0, 0.0, 0.0, 0.0, 0.1, 0.0, 0.0, 2, "hires_0.png"), (91, 1.0, 0.0, 0.0, 0.0, 9.0, 0.0, 0.0, 2, "hires_1.png")]
    return {
        "cameras": spark.createDataFrame([(1, "SIMPLE_PINHOLE", 360, 360, [180.0, 180.0, 180.0]), (2, "PINHOLE", 1920, 1080, [900.0, 900.0, 960.0, 540.0]), (3, "SPHERE", 8, 4, [1.0, 4.0, 2.0])], "camera_id int, model string, width long, height long, params array<double>"),
        "images": spark.createDataFrame(faces + hires, IMAGE),
        "points": spark.createDataFrame([(1,), (2,), (3,)], "point3d_id long"),
        "tracks": spark.createDataFrame([(1, 0, 1, 0), (1, 1, 11, 0), (2, 0, 12, 0)], "point3d_id long, pos int, image_id int, idx int"),
        "observations": spark.createDataFrame([(1, 0, 10.0, 20.0, 1), (11, 0, 1.0, 1.0, 1), (12, 0, 2.0, 2.0, 2), (1, 1, 3.0, 3.0, -1)], "image_id int, idx int, x double, y double, point3d_id long"),
        "disk": spark.createDataFrame([(r[9], 720 if r[9].startswith("frame_0") else 360, 720 if r[9].startswith("frame_0") else 360) for r in faces[:-1]] + [("hires_0.png", 1920, 1080)], "name string, width int, height int"),
    }


def test_repair_selection(spark, model):
    faces = ds.face_views(model["images"], model["cameras"], model["disk"])
    assert faces.count() == 5
    c = ds.repair_candidates(faces)
    row = c.first()
    assert c.count() == 1 and row.name == "frame_1_perspective_1.png" and row.reference == "frame_0_perspective_1.png"
    assert row.dist == pytest.approx(5.0) and row.ref_angle == pytest.approx(0.0, abs=1e-4)
    sharp = spark.createDataFrame([(row.name, 20.0), (row.reference, 40.0)], "name string, sharpness double")
    for method in ("rank_by_damage", "furthest", "every_nth"):
        assert ds.select_repairs(c, sharp, method).first().ratio == 0.5
    assert ds.select_repairs(c, sharp, "furthest", threshold=50.0).count() == 0
    with pytest.raises(ValueError):
        ds.select_repairs(c, sharp, "other")


def test_coverage_and_pruning(spark, model):
    faces = ds.face_views(model["images"], model["cameras"], model["disk"])
    hires = model["images"].filter("name like 'hires%'")
    cov = {r.name: r.coverage for r in ds.covered_faces(faces, hires, model["cameras"], 1.0).collect()}
    assert cov["frame_0_perspective_0.png"] > 0.4 and cov["frame_1_perspective_1.png"] == 0.0
    table = spark.createDataFrame(list(cov.items()), "name string, coverage double")
    gone = ds.select_pruned(faces, table, least=0.4)
    assert {r.name for r in gone.collect()} == {"frame_1_perspective_0.png"}
    out = ds.apply_removal(model["cameras"], model["images"], model["tracks"], gone)
    assert out["images"].count() == 7 and {r.camera_id for r in out["cameras"].collect()} == {1, 2}
    assert {(r.point3d_id, r.image_id) for r in out["tracks"].collect()} == {(1, 1), (2, 12)}
    with pytest.raises(ValueError):
        ds.select_pruned(faces, table, least=0.0, protected=[])


def test_trim_and_append(spark, model):
    keep = spark.createDataFrame([("frame_0_perspective_0.png",)], "name string")
    out = ds.trim_model(*(model[k] for k in ("cameras", "images", "points", "tracks", "observations")), keep)
    assert {r.point3d_id for r in out["points"].collect()} == {1} and {r.point3d_id for r in out["observations"].collect()} == {1, -1}
    tables = {k: model[k] for k in ("cameras", "images", "points", "tracks", "observations")}
    both = ds.append_model(tables, tables)
    assert both["images"].count() == 16 and both["images"].select("image_id").distinct().count() == 16
    assert both["observations"].filter("point3d_id = -1").count() == 2
    assert rel.orphans(both["tracks"], both["points"], "point3d_id").count() == 0 and rel.orphans(both["images"], both["cameras"], "camera_id").count() == 0


def test_rebuild(model):
    out = ds.rebuild(model["cameras"], model["images"].filter("name like 'frame%'"), model["observations"], model["tracks"], model["disk"], (model["cameras"], model["images"]))
    cams = {r.camera_id: r for r in out["cameras"].collect()}
    assert [cams[i].width for i in (1, 2, 3)] == [720, 360, 1920] and list(cams[1].params) == [360.0] * 3
    images = {r.name: r for r in out["images"].collect()}
    assert len(images) == 6 and images["hires_0.png"].image_id == 14 and images["hires_0.png"].camera_id == 3
    first = next(r for r in out["observations"].collect() if r.image_id == 1 and r.idx == 0)
    assert (first.x, first.y) == (20.0, 40.0)


def test_sequences_and_stride(spark, model):
    seqs = ds.camera_sequences(model["images"], spark.createDataFrame([(0, 1), (1, 1)], "traj int, size int"))
    assert {(r.face, r.traj): r.names for r in seqs.collect()}[2, 1] == ["frame_1_perspective_2.png"]
    flat = spark.createDataFrame([(0, i, f"n{i}") for i in range(7)] + [(1, 0, "n0")], "seq_id int, pos int, name string")
    kept, skipped = ds.stride_split(flat.filter("seq_id = 0"), flat.select("name").distinct(), 3, True)
    assert {r.name for r in kept.collect()} == {"n0", "n3"} and skipped.count() == 5
    order = ds.upscale_order(flat, spark.createDataFrame([("n0",), ("n6",), ("z",), ("y",)], "name string"))
    assert [(r.group_id, r.name) for r in order.orderBy("group_id", "pos").collect()] == [(0, "n0"), (0, "n6"), (2, "y"), (2, "z")]
    with pytest.raises(ValueError):
        ds.stride_split(flat, flat, 1)


def test_alignment(spark):
    f = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 4.0, 0.0, 0.0)], "frame int, cx double, cy double, cz double")
    assert ds.check_alignment(f, f).first().aligned
    assert not ds.check_alignment(f, f.withColumn("cx", F.col("cx") + 0.1)).first().aligned


def test_path_suggestions(spark):
    r = random.Random(0)
    wall = lambda a, v: [tuple(v if k == a else r.uniform(lo, hi) for k, (lo, hi) in enumerate(((-3, 3), (-1.5, 1.5), (-2, 8)))) for _ in range(1000)]
    pts = [p for a, v in ((0, -3.0), (0, 3.0), (1, -1.5), (1, 1.5), (2, -2.0), (2, 8.0)) for p in wall(a, v)]
    cloud = spark.createDataFrame(pts, "x double, y double, z double")
    got = rails.suggested_directions(cloud, 4).orderBy("rank").collect()
    assert 1 <= len(got) <= 4 and abs(got[0].azimuth) < 90
    assert all(abs((a.azimuth - b.azimuth + 180) % 360 - 180) >= 70 for a in got for b in got if a.rank < b.rank)
    with pytest.raises(ValueError):
        rails.suggested_directions(cloud.limit(10))


def test_upscale_plan(spark):
    r = random.Random(5)
    for sizes, every, partial, cap in (({0: 45, 1: 45}, 1, False, 0), ({0: 45, 1: 90, 2: 30}, 2, True, 9), ({3: 24, 1: 36, 2: 1}, 2, True, 7), ({0: 7}, 1, False, 3)):
        rows = [(g, p, f"{g}_{p}") for g, n in sizes.items() for p in range(n)]
        r.shuffle(rows)
        got = ds.upscale_plan(spark.createDataFrame(rows, "group_id int, pos int, name string"), every, partial, cap).collect()
        kept = [len(range(0, n - (every - 1 if partial else 0), every)) for n in sizes.values()]
        kept = [k for k in kept if k > 0]
        per = math.gcd(*kept)
        most = min(per, cap or per)
        fits = [d for d in range(1, most + 1) if per % d == 0 and d % 4 == 1]
        batch = max(fits) if max(fits) > 1 else max(k for k in range(1, most + 1) if k % 4 == 1)
        assert [tuple(q) for q in got] == [(len(kept), sum(kept), len(set(kept)) == 1, per, batch, per // batch, per % batch)]
    order = spark.createDataFrame([(4, 0, "a"), (4, 1, "b"), (9, 0, "c")], "group_id int, pos int, name string")
    assert ds.upscale_plan(order, view=1).first().frames == 1
    with pytest.raises(IndexError):
        ds.upscale_plan(order, view=2)


def test_stream_sink_resumes_and_never_repeats(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    names = []
    for i in range(4):
        pd.DataFrame({"name": [f"n{i}", f"n{i + 1}"], "pos": [i, i + 1], "v": [float(i), float(i)]}).to_parquet(src / f"{i}.parquet")
        names.append(str(src / f"{i}.parquet"))
    chunks.touch_in_order(names)
    stream = lambda: chunks.chunk_stream(spark, str(src), "name string, pos long, v double")
    expected = spark.createDataFrame([(f"n{i}",) for i in range(5)], "name string")
    sink = chunks.ProgressSink(f"file://{tmp_path}/out", "name", "pos", expected, expected.limit(1))
    chunks.drain(stream(), sink, str(tmp_path / "cp"))
    out = sink.written(spark)
    assert out.count() == 5 and sink.complete(spark) and out.filter("passed").count() == 1
    sink(out.select("name", "pos", "v").limit(2), 3)
    assert sink.written(spark).select("name").distinct().count() == sink.written(spark).count()
    with pytest.raises(ValueError):
        sink(spark.createDataFrame([("zz", 1, 1.0)], "name string, pos long, v double"), 9)
    chunks.drain(stream(), sink, str(tmp_path / "cp"))


def test_stream_average_matches_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    files, values = [], [float(i * 7 % 5) for i in range(12)]
    for k in range(3):
        pd.DataFrame({"k": [1] * 4, "i": range(4 * k, 4 * k + 4), "v": values[4 * k : 4 * k + 4]}).to_parquet(src / f"{k}.parquet")
        files.append(str(src / f"{k}.parquet"))
    chunks.touch_in_order(files)
    got = {}
    s = chunks.average_stream(chunks.chunk_stream(spark, str(src), "k long, i long, v double"), "k", "i", "v", 0.6)
    chunks.drain(s, lambda df, n: got.update({r.i: r.ema for r in df.collect()}), str(tmp_path / "cp"))
    g = None
    for i, x in enumerate(values):
        g = x if g is None else 0.6 * x + 0.4 * g
        assert got[i] == pytest.approx(g)


def test_stride_group_null_groups_and_small_groups(spark):
    df = spark.createDataFrame([("a", i) for i in range(7)] + [(None, i) for i in range(3)] + [("b", 0)], "g string, i int")
    every = {(r.g, r.i) for r in od.stride_group(df, ["g"], ["i"], 3).collect()}
    assert every == {("a", 0), ("a", 3), ("a", 6), (None, 0), ("b", 0)}
    whole = {(r.g, r.i) for r in od.stride_group(df, ["g"], ["i"], 3, drop_partial=True).collect()}
    assert whole == {("a", 0), ("a", 3), (None, 0)}


def test_aspects_without_sizes(spark):
    df = spark.createDataFrame([(1, 100, 50), (2, 100, 60), (3, 0, 50), (4, None, 50), (5, 100, 0)], "k int, w int, h int")
    off = rel.aspect_mismatches(df, F.col("w"), F.col("h"), F.lit(200), F.lit(100))
    assert sorted(r.k for r in off.collect()) == [2, 3]
    same = rel.rescale_groups(df, F.col("w"), F.col("h"), F.lit(200), F.lit(100))
    assert [tuple(r) for r in same.collect()] == [(0.5, 1)]
