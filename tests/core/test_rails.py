import math
import random

import pytest
from pyspark.sql import functions as F

from orbisloom.operators import rails


@pytest.fixture
def rail(spark):
    return spark.createDataFrame([(0, i, 0.0, 0.0, i / 4, 1.0, 0.0, 0.0) for i in range(5)], "traj int, frame int, x double, y double, z double, rx double, ry double, rz double")


def test_travel_fan_and_spiral(rail):
    assert rails.travel_scaled(rail, 3.0).agg(F.max("z")).first()[0] == pytest.approx(3.0)
    fan = {(r.traj, r.frame): (r.x, r.z) for r in rails.yaw_fan(rail, 4).collect()}
    assert len(fan) == 20 and fan[1, 4] == pytest.approx((1.0, 0.0)) and fan[2, 4] == pytest.approx((0.0, -1.0), abs=1e-9)
    sp = {r.frame: r for r in rails.spiralled(rail, 0.5, 1.0).collect()}
    assert (sp[0].x, sp[0].y) == (0.0, 0.0) and (sp[1].x, sp[1].y) == pytest.approx((-0.5, -0.5)) and (sp[4].x, sp[4].y) == pytest.approx((0.0, 0.0), abs=1e-9)


def test_projection_columns(spark):
    g = spark.range(1)
    one = [F.lit(float(v)) for v in (100, 100, 50, 50, 100, 100)]
    c = g.select(rails.clip_coordinates((F.lit(0.0), F.lit(0.0), F.lit(2.0)), *one, 1.0, 3.0).alias("c")).first().c
    assert (c.x, c.y, c.w) == (0.0, 0.0, 2.0) and abs(c.z / c.w) < 1
    e = g.select(*[x for v in rails.upright_basis((F.lit(0.0), F.lit(0.0), F.lit(2.0))) for x in v]).first()
    assert list(e) == [1, 0, 0, 0, 1, 0, 0, 0, 1]
    px = spark.range(64 * 32).select((F.col("id") % 64).alias("x"), F.floor(F.col("id") / 64).alias("y"))
    p = px.select("x", "y", rails.perspective_lookup(F.col("x"), F.col("y"), 64, 32, 100, 100, 90.0).alias("p")).filter("p.valid").collect()
    assert {r.x for r in p} == set(range(24, 40)) and all(abs(r.p.px - 49.5) <= 49.5 for r in p)


def room(n=1000, seed=0):
    r = random.Random(seed)
    box = ((-3, 3), (-1.5, 1.5), (-2, 8))
    return [tuple(v if k == a else r.uniform(*box[k]) for k in range(3)) for a in range(3) for v in map(float, box[a]) for _ in range(n)]


def test_planned_paths(spark):
    cloud = spark.createDataFrame(room(), "x double, y double, z double").repartition(4)
    rows = rails.planned_paths(cloud, 4).collect()
    assert len(rows) == 16 and {r.label for r in rows} == {"push-in", "arc-sweep", "crane-rise", "pull-back"}
    for r in rows:
        assert -3 < r.x < 3 and -1.5 < r.y < 1.5 and -2 < r.z < 8
        assert (r.tx is None) == (r.orientation == "look_forward")
        if r.i == 0:
            assert math.hypot(r.x, r.z) == 0 and r.y == 0
    push = {r.i: r for r in rows if r.label == "push-in"}
    back = {r.i: math.hypot(r.x, r.z) for r in rows if r.label == "pull-back"}
    assert [back[i] / back[3] for i in range(4)] == pytest.approx([0, 0.35, 0.7, 1], abs=2e-3)  # anchors' places on a path
    assert push[3].z > 1 and abs(push[3].x) < push[3].z
    with pytest.raises(ValueError):
        rails.planned_paths(cloud.limit(10))
