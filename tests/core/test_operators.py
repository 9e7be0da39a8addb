import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orbisloom.functions import camera, frames
from orbisloom.operators import aggregates as agg
from orbisloom.operators import ordered as od
from orbisloom.operators import raster as ras
from orbisloom.operators import relational as rel

quick = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def col(spark, values, kind="int"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


@pytest.mark.parametrize("spec,total,want", [("all", 4, [0, 1, 2, 3]), ("0-15", 5, [0, 1, 2, 3, 4]), ("/8", 20, [0, 8, 16]), ("40", 41, [40]), ("40", 40, []), ("0,3,10-12", 12, [0, 3, 10, 11]), ("-2", 9, [0, 1, 2]), ("7-", 9, [7, 8]), ("", 3, []), ("5-2", 9, [])])
def test_frame_ranges(spark, spec, total, want):
    assert spark.range(1).select(frames.spanned(F.lit(spec), F.lit(total)).alias("f")).first().f == want


def test_frame_range_counts_and_errors(spark):
    one = spark.range(1)
    assert len(one.select(frames.spanned(F.lit("0-15,16-/8"), F.lit(81)).alias("f")).first().f) == 25
    assert one.select(frames.listed(F.lit("3, 0,10-12")).alias("f")).first().f == [0, 3, 10, 11, 12]
    for bad in ("x", "3-", "1-2-3"):
        with pytest.raises(Exception):
            one.select(frames.listed(F.lit(bad))).collect()
    for bad in ("x", "/0", "-"):
        with pytest.raises(Exception):
            one.select(frames.spanned(F.lit(bad), F.lit(9))).collect()


@pytest.mark.parametrize("n,cap,want", [(45, 50, 45), (81, 40, 9), (7, 100, 5), (1, 10, 1), (22, 12, 9)])
def test_batch_size(spark, n, cap, want):
    assert spark.range(1).select(frames.batch_size(F.lit(n), F.lit(cap)).alias("b")).first().b == want


@pytest.mark.parametrize("n,every,partial,kept", [(81, 5, False, 17), (81, 5, True, 16), (9, 1, True, 9), (0, 3, True, 0)])
def test_stride(spark, n, every, partial, kept):
    assert od.stride_group(spark.range(n).withColumn("g", F.lit(1)), ["g"], ["id"], every, partial).count() == kept


@quick
@given(st.lists(st.integers(-50, 50), max_size=60))
def test_islands(spark, values):
    got = {(r.first, r.last, r.n) for r in od.gaps_and_islands(col(spark, values).withColumn("g", F.lit(1)), ["g"], "v").collect()}
    want, left = set(), sorted(set(values))
    while left:
        k = 1
        while k < len(left) and left[k] == left[k - 1] + 1:
            k += 1
        want.add((left[0], left[k - 1], k))
        left = left[k:]
    assert got == want


def test_positions_are_dense_over_many_partitions(spark):
    ids = list(range(5000))
    random.Random(0).shuffle(ids)
    got = od.with_position(spark.createDataFrame([(i,) for i in ids], "id long").repartition(7), ["id"], "p").collect()
    assert all(r.p == r.id for r in got) and len(got) == 5000


def test_moving_average_over_chunks(spark):
    values = [random.Random(i).random() for i in range(257)]
    df = spark.createDataFrame([(g, i, v) for g in (1, None) for i, v in enumerate(values)], "g int, i int, v double")
    got = {(r.g, r.i): r.ema for r in od.moving_average(df, ["g"], ["i"], "v", 0.6, chunk=10).collect()}
    e = None
    for i, v in enumerate(values):
        e = v if e is None else 0.6 * v + 0.4 * e
        assert got[1, i] == pytest.approx(e) and got[None, i] == pytest.approx(e)


def test_moving_average_over_levels_and_small_groups(spark):
    r = random.Random(3)
    rows = [(g, i, r.random()) for g in range(40) for i in range(r.choice([1, 2, 3, 90]))]
    df = spark.createDataFrame(rows, "g int, i int, v double").repartition(5)
    got = {(q.g, q.i): q.ema for q in od.moving_average(df, ["g"], ["i"], "v", 0.3, chunk=4).collect()}
    e, last = None, None
    for g, i, v in sorted(rows):
        e = v if g != last else 0.3 * v + 0.7 * e
        last = g
        assert got[g, i] == pytest.approx(e) and (i or got[g, i] == v)
    whole = [q.ema for q in od.moving_average(df, [], ["g", "i"], "v", 1.0).orderBy("g", "i").collect()]
    assert whole == [v for _, _, v in sorted(rows)]


@pytest.mark.parametrize("most", [2, 50_000])
def test_bounds_of_any_number(spark, monkeypatch, most):
    monkeypatch.setattr(od, "BROADCAST_BOUNDS", most)
    r = random.Random(9)
    sizes = [(f"t{i}", r.choice([0, 1, 3, 40])) for i in range(30)] + [("end", 2)]
    bounds, low = [], 0
    for k, n in sizes:
        bounds.append((k, low, low + n))
        low += n
    rows = [(i, r.randrange(-3, low + 10)) for i in range(400)] + [(i, i) for i in range(400, 440)]
    got = od.in_bounds(spark.createDataFrame(rows, "i int, at int").repartition(4), "at", spark.createDataFrame(bounds, "traj string, low int, high int"), "traj")
    assert got.columns[-1] == "traj" and set(got.columns) == {"i", "at", "traj"}
    found = {q.i: q.traj for q in got.collect()}
    assert len(found) == len(rows)
    for i, at in rows:
        assert found[i] == next((k for k, a, b in bounds if a <= at < b), "end")


def test_distance_join_matches_all_pairs(spark):
    r = random.Random(4)
    a = [(i, r.uniform(-3, 3), r.uniform(-3, 3)) for i in range(60)]
    b = [(i, r.uniform(-3, 3), r.uniform(-3, 3)) for i in range(60)]
    got = {(x.i, x.j) for x in rel.distance_join(spark.createDataFrame(a, "i int, x double, y double"), spark.createDataFrame(b, "j int, u double, w double"), [("x", "u"), ("y", "w")], 0.7).collect()}
    assert got == {(i, j) for i, x, y in a for j, u, w in b if math.hypot(x - u, y - w) <= 0.7}


@pytest.mark.parametrize("most", [3, 50_000])
def test_nearest_matches_all_pairs_with_ties(spark, monkeypatch, most):
    monkeypatch.setattr(rel, "BROADCAST_ROWS", most)
    r = random.Random(6)
    pool = [(i, [r.gauss(0, 1) for _ in range(5)]) for i in range(40)]
    pool += [(100 + i, [2 * x for x in v]) for i, v in pool[:10]] + [(200, [0.0] * 5), (300, None)]
    asked = [(f"q{i}", [r.gauss(0, 1) for _ in range(5)]) for i in range(30)] + [("same", pool[3][1]), ("zero", [0.0] * 5), ("null", None)]
    got = rel.nearest_by_cosine(spark.createDataFrame(asked, "k string, v array<double>").repartition(3), spark.createDataFrame(pool, "p int, v array<double>"), "k", "v", "p", block=7).collect()

    def cosine(a, b):
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / n if n else 0.0

    assert len(got) == 32
    for q in got:
        v = dict(asked)[q.k]
        best = max(cosine(v, w) for _, w in pool if w)
        assert q.cosine == pytest.approx(best, abs=1e-12) and q.p == min(p for p, w in pool if w and cosine(v, w) > best - 1e-9)


def test_nearest_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(rel, "BROADCAST_ROWS", 3)
    pool = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(10)] + [(99, [1.0, 0.0])], "p int, v array<double>")
    q = spark.createDataFrame([(1, [2.0, 0.01]), (2, [-1.0, 0.1])], "k int, v array<double>")
    got = {r.k: r.p for r in rel.nearest_by_cosine(q, pool, "k", "v", "p", block=4).collect()}
    assert got == {1: 0, 2: 3}


def test_nested_strip_keeps_order_and_empty_rows(spark):
    df = spark.createDataFrame([(1, [(5, "a"), (6, "b"), (5, "c")]), (2, [(6, "d")]), (3, [])], "k int, t array<struct<i:int,n:string>>")
    got = {r.k: [x.n for x in r.t] for r in rel.strip_nested(df, "k", "t", "i", col(spark, [6]), "v").collect()}
    assert got == {1: ["a", "c"], 2: [], 3: []}


def test_offsets_leave_missing_references(spark):
    old = spark.createDataFrame([(1, 4), (3, -1)], "id int, point int")
    new = spark.createDataFrame([(1, -1), (2, 0)], "id int, point int")
    got = rel.offset_union(old, new, {"id": ["id"], "point": ["point"]})
    assert sorted(tuple(r) for r in got.collect()) == [(1, 4), (3, -1), (4, -1), (5, 4)]


def test_targets_and_separation(spark):
    df = spark.createDataFrame([(1, 0, 0.0, None), (1, 1, 1.0, 9.0), (1, 2, 3.0, None)], "p int, i int, x double, tx double")
    assert [r.tx for r in od.filled_targets(df, ["p"], "i", ["x"], ["tx"]).orderBy("i").collect()] == [1.0, 9.0, 5.0]
    one = spark.range(1).select(od.separated(F.array(*map(F.lit, [0.0, 30.0, 350.0, 90.0, 180.0])), 70.0).alias("a"))
    assert one.first().a == [0.0, 90.0, 180.0]


def test_pose_columns(spark):
    s = math.sqrt(0.5)
    r = camera.rotation(*map(F.lit, (s, 0.0, s, 0.0)))
    t = tuple(map(F.lit, (1.0, 2.0, 3.0)))
    back = camera.inverse(*camera.inverse(r, t))
    row = spark.range(1).select(*camera.centre(r, t), *camera.axis(r), *back[1], camera.angle_degrees(F.lit(1.0000001))).first()
    assert [round(x, 6) for x in row] == [3.0, -2.0, -1.0, -1.0, 0.0, 0.0, 1.0, 2.0, 3.0, 0.0]


def test_panorama_directions_invert(spark):
    g = spark.range(8).select(F.col("id").alias("x"), (F.col("id") % 4).alias("y"))
    u, v = camera.panorama_uv(camera.panorama_direction(F.col("x"), F.col("y"), F.lit(8.0), F.lit(4.0)))
    for r in g.select("x", "y", u.alias("u"), v.alias("v")).collect():
        assert r.u == pytest.approx((r.x + 0.5) / 8) and r.v == pytest.approx((r.y + 0.5) / 4)


def test_rescaled_cameras(spark):
    df = spark.createDataFrame([("SIMPLE_PINHOLE", [100.0, 50.0, 50.0]), ("PINHOLE", [1.0, 2.0, 3.0, 4.0]), ("SIMPLE_RADIAL", [1.0, 2.0, 3.0, 0.1])], "m string, p array<double>")
    even = [tuple(r.c) for r in df.select(camera.rescaled(F.col("m"), F.col("p"), F.lit(2.0), F.lit(2.0)).alias("c")).collect()]
    assert even == [("SIMPLE_PINHOLE", [200.0, 100.0, 100.0]), ("PINHOLE", [2.0, 4.0, 6.0, 8.0]), ("SIMPLE_RADIAL", [2.0, 4.0, 6.0, 0.1])]
    odd = df.filter("m = 'SIMPLE_PINHOLE'").select(camera.rescaled(F.col("m"), F.col("p"), F.lit(1.0), F.lit(3.0)).alias("c")).first().c
    assert tuple(odd) == ("PINHOLE", [100.0, 300.0, 50.0, 150.0])
    with pytest.raises(Exception):
        df.filter("m = 'SIMPLE_RADIAL'").select(camera.rescaled(F.col("m"), F.col("p"), F.lit(1.0), F.lit(3.0))).collect()


def mesh(spark, corners, faces):
    v = spark.createDataFrame([(0, i, *map(float, c)) for i, c in enumerate(corners)], "view int, vid int, x double, y double, z double, w double")
    return spark.createDataFrame([(i, *f) for i, f in enumerate(faces)], "fid int, v0 int, v1 int, v2 int"), v


def test_raster_triangle_and_attribute(spark):
    faces, v = mesh(spark, [(-0.9, -0.9, 0, 1), (0.9, -0.9, 0, 1), (-0.9, 0.9, 0, 1)], [(0, 1, 2)])
    frags = ras.rasterize(faces, v, 8, 8)
    rows = frags.collect()
    assert rows and {r.tri_id for r in rows} == {1} and len(rows) < 64
    out = ras.interpolate(frags, faces, v.select("vid", F.lit(1.0).alias("a")), ["a"]).collect()
    assert all(r.a == pytest.approx(1.0) for r in out)


def test_raster_depth_contest_and_clipping(spark):
    quad = lambda z, w: [(-w, -w, z, w), (w, -w, z, w), (w, w, z, w), (-w, w, z, w)]
    faces, v = mesh(spark, quad(0.5, 2) + quad(-0.5, 1), [(0, 1, 2), (0, 2, 3), (4, 5, 6), (4, 6, 7)])
    rows = ras.rasterize(faces, v, 8, 8).collect()
    assert len(rows) == 64 and {r.tri_id for r in rows} <= {3, 4}
    faces, v = mesh(spark, [(0, 0, 0, -1), (1, 0, 0, -1), (0, 1, 0, -1)], [(0, 1, 2)])
    assert ras.rasterize(faces, v, 4, 4).count() == 0
    faces, v = mesh(spark, [(-1, -1, 0, 2), (1, -1, 0, 2), (0, 1, 0, -1)], [(0, 1, 2)])
    assert ras.rasterize(faces, v, 16, 16).count() > 0


def test_masks(spark):
    px = spark.createDataFrame([(0, y, x, float(y == 0 and x == 0)) for y in range(4) for x in range(4)], "frame int, y int, x int, v double")
    assert ras.dilate(px, "frame", "v", 1, 4, 4).filter("v > 0").count() == 9
    assert ras.neighbours(px, "frame", "v", 1, 4, 4, False, F.max).filter("v > 0").count() == 4
    assert ras.erode(px.withColumn("v", 1 - F.col("v")), "frame", "v", 1, 4, 4).filter("v > 0").count() == 12
    blobs = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (0, 2, 2), (0, 5, 5)], "frame int, y int, x int")
    assert ras.kept_components(blobs, "frame", 2).count() == 3
    holes = px.withColumn("v", F.when((F.col("x") + F.col("y")) % 3 == 0, F.lit(None)).otherwise(2.0))
    assert {r.v for r in ras.push_pull(holes, 4, 4, "v").collect()} == {2.0}
    assert ras.grid_faces(3, 4, spark).count() == 16


def test_seam_columns(spark):
    px = spark.createDataFrame([(0, 0, x, c) for x, c in enumerate([10.0, 20.0, 3.0, 40.0])], "frame int, y int, x int, c double")
    assert {r.x: r.c for r in ras.seam_repaired(px, 2, ["c"]).collect()} == {0: 10.0, 1: 20.0, 2: 30.0, 3: 40.0}


def test_downsample_and_scores(spark):
    pts = spark.createDataFrame([(i, float(i % 40), float(i // 40)) for i in range(1600)], "i int, x double, y double")
    assert 150 <= agg.voxel_downsample(pts, ["x", "y"], 200, "i").count() <= 200
    assert agg.voxel_downsample(pts, ["x", "y"], 5000, "i").count() == 1600
    gains = spark.createDataFrame([("a", 1.5, 0.0), ("a", float("nan"), 0.0), ("b", 1.2, 1.0)], "g string, gain double, drift double")
    assert [(r.g, round(r.score, 3)) for r in agg.ranked_scores(gains, "g", F.col("gain"), F.col("drift")).collect()] == [("a", 0.5), ("b", 0.1)]
    assert agg.common_divisor(col(spark, [12, 18, 30]), "v").first().gcd == 6
