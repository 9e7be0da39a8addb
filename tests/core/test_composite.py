"""Composite parts, components, selection and masks against brute-force versions on small grids."""

import math
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbisloom.operators import aggregates as agg
from orbisloom.operators import components as comp
from orbisloom.operators import composite as cps
from orbisloom.operators import images, lines
from orbisloom.operators import raster as ras
from orbisloom.operators import selection as sel


def table(spark, arrays, names, frames=("a",)):
    h, w = arrays[0].shape
    rows = [(f, y, x, *[float(a[y, x]) * (i + 1) for a in arrays]) for i, f in enumerate(frames) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "frame string, y int, x int, " + ", ".join(f"{n} double" for n in names)).repartition(3)


def array(df, value, h, w, frame="a"):
    out = np.full((h, w), np.nan)
    for r in df.filter(F.col("frame") == frame).collect():
        out[r.y, r.x] = r[value]
    return out


def np_filter(a, kernel):
    r = len(kernel) // 2
    for axis in (0, 1):
        p = np.pad(a, [(r, r) if i == axis else (0, 0) for i in (0, 1)], mode="reflect")
        a = sum(w * np.take(p, range(k, k + a.shape[axis]), axis) for k, w in enumerate(kernel))
    return a


def test_line_filters(spark):
    r = np.random.default_rng(1)
    a, b = r.normal(size=(9, 14)), r.normal(size=(9, 14))
    t = table(spark, [a, b], ["v", "w"], ("a", "z"))
    got = lines.gaussian(t, ["frame"], ["v", "w"], 0.7, 9, 14)
    assert np.allclose(array(got, "v", 9, 14), np_filter(a, lines.gaussian_kernel(0.7)))
    assert np.allclose(array(got, "w", 9, 14, "z"), 2 * np_filter(b, lines.gaussian_kernel(0.7)))
    assert np.allclose(array(lines.box_mean(t, ["frame"], ["v"], 5, 9, 14), "v", 9, 14), np_filter(a, [0.2] * 5))
    p = np.pad(a, 1, mode="reflect")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * a
    assert np.allclose(array(lines.laplacians(t, ["frame"], ["v"], 9, 14), "v_lap", 9, 14), lap)
    # a missing pixel and a null count as 0; a line longer than the kernel's reach reflects more than once
    hole = t.filter("not (y = 2 and x = 3)").withColumn("v", F.when(F.expr("y = 4 and x = 1"), F.lit(None)).otherwise(F.col("v")))
    gone = a.copy()
    gone[2, 3] = gone[4, 1] = 0
    assert np.allclose(array(images.blurred(hole, "frame", "v", 2.0, 9, 14), "v", 9, 14)[8, 13], np_filter_wide(gone, lines.gaussian_kernel(2.0))[8, 13])
    assert lines.gaussian(t.limit(0), ["frame"], ["v"], 1.0, 9, 14).count() == 0


def np_filter_wide(a, kernel):
    r = len(kernel) // 2
    for axis in (0, 1):
        size = a.shape[axis]
        at = lines.mirrored(np.arange(-r, size + r), size)
        a = sum(w * np.take(a, at[k : k + size], axis) for k, w in enumerate(kernel))
    return a


def test_area_reduction_where_sizes_dont_divide(spark):
    a = np.random.default_rng(2).normal(size=(7, 10))
    got = array(lines.area_reduced(table(spark, [a], ["v"]), ["frame"], ["v"], 7, 10, 3, 4), "v", 3, 4)
    for i in range(3):
        for j in range(4):
            cell = a[i * 7 // 3 : -(-(i + 1) * 7 // 3), j * 10 // 4 : -(-(j + 1) * 10 // 4)]
            assert got[i, j] == pytest.approx(cell.mean())


def np_bilinear(a, fy, fx):
    y, x = int(math.floor(fy)), int(math.floor(fx))
    y1, x1 = min(y + 1, a.shape[0] - 1), min(x + 1, a.shape[1] - 1)
    ty, tx = fy - y, fx - x
    return (a[y, x] * (1 - tx) + a[y, x1] * tx) * (1 - ty) + (a[y1, x] * (1 - tx) + a[y1, x1] * tx) * ty


def test_pyramid_and_trilinear_samples(spark):
    r = np.random.default_rng(3)
    a = r.normal(size=(13, 22))
    sizes = cps.level_sizes(13, 22, 3, least_side=2)
    assert sizes == [(13, 22), (6, 11), (3, 5)]
    levels = [a]
    for h, w in sizes[1:]:
        last = levels[-1][: 2 * h, : 2 * w]
        levels.append(last.reshape(h, 2, w, 2).mean(axis=(1, 3)))
    src = table(spark, [a], ["v"])
    p = cps.pyramid(src, ["frame"], ["v"], sizes)
    for k, want in enumerate(levels):
        assert np.allclose(array(p.filter(F.col("level") == k), "v", *want.shape), want)
    h, w = 5, 6
    u, v = r.uniform(0, 1, (h, w)), np.linspace(0.85, 1, h)[:, None] * np.ones((1, w))
    u[:3] = np.linspace(0.1, 0.3, w)  # about a source pixel per target pixel
    u[4, 3] = 1.0
    t = cps.with_detail_level(table(spark, [u, v], ["u", "v"]), ["frame"], (h, w), (13, 22), 3)
    su, sv = u * 22, v * 13
    d = [np.gradient(s, axis=x) for s in (su, sv) for x in (1, 0)]
    d[0], d[1] = (np.where(np.abs(g) > w, 0, g) for g in d[:2])
    lod = np.clip(np.log2(np.maximum(np.maximum(np.hypot(d[0], d[2]), np.hypot(d[1], d[3])), 1)), 0, 2)
    assert np.allclose(array(t, "lod", h, w), lod) and lod.max() > 1 and lod.min() < 1
    got = array(cps.trilinear(t, p.withColumnRenamed("v", "c"), ["frame"], ["c"], sizes), "c", h, w)
    for y in range(h):
        for x in range(w):
            want = 0.0
            for k, lv in enumerate(levels):
                weight = max(0.0, 1 - abs(lod[y, x] - k))
                if weight:
                    want += weight * np_bilinear(lv, v[y, x] * (lv.shape[0] - 1), u[y, x] * (lv.shape[1] - 1))
            assert got[y, x] == pytest.approx(want)


def np_area(a, h, w):
    return np.array([[a[i * a.shape[0] // h : -(-(i + 1) * a.shape[0] // h), j * a.shape[1] // w : -(-(j + 1) * a.shape[1] // w)].mean() for j in range(w)] for i in range(h)])


def np_enlarge(a, h, w):
    at = lambda i, of, to: max((i + 0.5) * to / of - 0.5, 0.0)
    return np.array([[np_bilinear(a, at(y, h, a.shape[0]), at(x, w, a.shape[1])) for x in range(w)] for y in range(h)])


@pytest.mark.parametrize("mode", ["luma", "rgb", "none"])
def test_tone_matched_fill(spark, mode):
    r = np.random.default_rng(4)
    h, w = 12, 40
    source, fill = [r.uniform(50, 200, (h, w)) for _ in range(3)], [r.uniform(20, 90, (h, w)) for _ in range(3)]
    gate = np.zeros((h, w))
    gate[:, :5] = r.uniform(0, 1, (h, 5))  # far from it no open pixel is in reach of the blur
    names = [*"rgb", "fr", "fg", "fb", "gate"]
    t = table(spark, [*source, *fill, gate], names)
    got = cps.tone_matched(t, ["frame"], list("rgb"), None if mode == "none" else ["fr", "fg", "fb"], "gate", (h, w), 20, 2.0, 2.0, mode)
    tw, th = 20, 6
    kernel = lines.gaussian_kernel(1.0)
    m = np_area(gate, th, tw)
    blur = lambda a: np_filter(a, kernel)
    wide = blur(m)
    assert wide.min() == 0
    trust, area = wide / (wide + 1e-3), max(m.sum(), 1e-6)
    bright = lambda cs: 0.299 * cs[0] + 0.587 * cs[1] + 0.114 * cs[2]
    for i, c in enumerate("rgb"):
        s = np_area(bright(source) if mode == "luma" else source[i], th, tw)
        f = np_area(bright(fill) if mode == "luma" else fill[i], th, tw)
        local_s, all_s = blur(s * m) / (wide + 1e-3), (s * m).sum() / area
        if mode == "none":
            want = np_enlarge(trust * local_s + (1 - trust) * all_s, h, w)
        else:
            local = np.clip(local_s / (blur(f * m) / (wide + 1e-3) + 1e-3), 0.5, 2)
            whole = np.clip(all_s / ((f * m).sum() / area + 1e-3), 0.5, 2)
            want = fill[i] * np_enlarge(trust * local + (1 - trust) * whole, h, w)
        assert np.allclose(array(got, f"{c}_fill", h, w), want)
    off = cps.tone_matched(t, ["frame"], list("rgb"), ["fr", "fg", "fb"], "gate", (h, w), 20, 2.0, 2.0, "off")
    assert np.allclose(array(off, "r_fill", h, w), fill[0])


def test_band_fusion(spark):
    r = np.random.default_rng(6)
    h, w = 11, 17
    source, fill = [r.uniform(0, 255, (h, w)) for _ in range(3)], [r.uniform(0, 255, (h, w)) for _ in range(3)]
    fill[0][:, 9:] = source[0][:, 9:] + 3  # agrees on one side
    t = table(spark, [*source, *fill], [*"rgb", "fr", "fg", "fb"])
    b = cps.bands(t, ["frame"], ["r"], 1.0, (h, w)).select((F.col("r_low") + F.col("r_detail") - F.col("r")).alias("d"))
    assert b.agg(F.max(F.abs("d"))).first()[0] < 1e-12
    got = cps.fused(t, ["frame"], list("rgb"), ["fr", "fg", "fb"], (h, w), 1.0, 1.5, 5, 3, 0.1, 0.5, 400.0)
    low = lambda a: np_filter(a, lines.gaussian_kernel(1.0))
    d, f = [a - low(a) for a in source], [a - low(a) for a in fill]
    lap = lambda a: (lambda p: p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * a)(np.pad(a, 1, mode="reflect"))
    box = lambda a, k: np_filter(a, [1 / k] * k)
    scale = np.minimum(1, 1.5 * box(np.mean(np.abs(f), 0), 5) / (box(np.mean(np.abs(d), 0), 5) + 1e-3))
    a, e = lap(np.mean(d, 0)), lap(np.mean(f, 0))
    va, vb = box(a * a, 3) - box(a, 3) ** 2, box(e * e, 3) - box(e, 3) ** 2
    z = (box(a * e, 3) - box(a, 3) * box(e, 3)) / np.sqrt(np.maximum(va * vb, 1e-8))
    strong = np.clip((np.sqrt(np.maximum(va, 0)) + np.sqrt(np.maximum(vb, 0))) / 400, 0, 1)
    s = scale * ((1 - strong) + strong * np.clip((z - 0.1) / 0.4, 0, 1))
    assert s.max() - s.min() > 0.2
    for i, c in enumerate("rgb"):
        assert np.allclose(array(got, f"{c}_fused", h, w), low(fill[i]) + d[i] * s + f[i] * (1 - s))


def np_regrown(depth, tolerance, extend, rounds=None):
    h, w = depth.shape
    far = np.array([[depth[max(0, y - extend) : y + extend + 1, max(0, x - extend) : x + extend + 1].max() for x in range(w)] for y in range(h)])
    known = ~((far - depth) / np.maximum(depth, 1e-6) > tolerance)
    d, donor, done = depth.copy(), np.arange(h * w).reshape(h, w), 0
    while rounds is None or done < rounds:
        new = {}
        for y in range(h):
            for x in range(w):
                if known[y, x]:
                    continue
                best = None
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        sy, sx = (y - dy) % h, (x - dx) % w
                        if known[sy, sx] and d[sy, sx] > 0 and (best is None or d[sy, sx] > best[0]):
                            best = d[sy, sx], donor[sy, sx]
                if best:
                    new[y, x] = best
        done += 1
        if not new:
            break
        for p, (v, o) in new.items():
            d[p], donor[p], known[p] = v, o, True
    return d, donor


@pytest.mark.parametrize("rounds", [None, 1, 3])
def test_background_regrown_over_the_seam(spark, rounds):
    r = np.random.default_rng(8)
    depth = np.round(r.uniform(8, 10, (15, 18)))
    depth[3:13, :6] = 2.0  # a near block at the seam, wider than one round
    depth[3:13, 15:] = 2.0
    depth[0, 0] = 0.0  # fills nothing
    t = table(spark, [depth, np.arange(15 * 18).reshape(15, 18)], ["d", "o"])
    got = cps.regrown(t, ["frame"], "d", ["o"], 0.5, 6, (15, 18), rounds)
    d, donor = np_regrown(depth, 0.5, 6, rounds)
    assert np.array_equal(array(got, "d", 15, 18), d)
    assert np.array_equal(array(got, "o", 15, 18), donor)
    assert got.filter("grown").count() == (donor != np.arange(15 * 18).reshape(15, 18)).sum()
    flat = table(spark, [np.full((4, 5), 3.0)], ["d"])
    assert cps.regrown(flat, ["frame"], "d", [], 0.5, 2, (4, 5)).filter("grown").count() == 0


def np_regions(a):
    h, w = a.shape
    label = np.zeros((h, w), int)
    for y in range(h):
        for x in range(w):
            if a[y, x] and not label[y, x]:
                queue = deque([(y, x)])
                label[y, x] = y * w + x + 1
                while queue:
                    p, q = queue.popleft()
                    for i in range(max(0, p - 1), min(h, p + 2)):
                        for j in range(max(0, q - 1), min(w, q + 2)):
                            if a[i, j] and not label[i, j]:
                                label[i, j] = y * w + x + 1
                                queue.append((i, j))
    return label


def test_regions_against_flood_fill(spark):
    r = np.random.default_rng(9)
    a = r.uniform(size=(40, 60)) < 0.35
    a[5, 5] = True
    rows = [("a", y, x) for y, x in zip(*np.nonzero(a))] + [("a", 5, 5)]
    t = spark.createDataFrame([(f, int(y), int(x)) for f, y, x in rows], "frame string, y int, x int").repartition(3)
    label = np_regions(a)
    for q in comp.labelled(t, "frame").collect():
        assert set(label[q.y, q.x0 : q.x1 + 1]) == {q.label.y * 60 + q.label.x0 + 1}
        assert q.size == (label == label[q.y, q.x0]).sum()
    sizes = np.bincount(label.ravel())
    want = {(y, x) for y, x in zip(*np.nonzero(a)) if sizes[label[y, x]] >= 12}
    assert {(q.y, q.x) for q in comp.kept_components(t, "frame", 12).collect()} == want


def spiral(n):
    """A spiral of n set pixels, one pixel wide."""
    y = x = 0
    dy, dx, out, seen = 0, 1, [], set()
    side = 120
    for _ in range(n):
        out.append((y, x))
        seen.add((y, x))
        ahead = (y + 2 * dy, x + 2 * dx)
        if ahead in seen or not (0 <= y + dy < side and 0 <= x + dx < side):
            dy, dx = dx, -dy
        y, x = y + dy, x + dx
    return out


def test_long_regions_are_whole(spark):
    line = spark.createDataFrame([("a", 3, x) for x in range(80)] + [("b", x, x) for x in range(80)], "frame string, y int, x int")
    assert ras.kept_components(line, "frame", 75).count() == 160
    assert ras.kept_components(line, "frame", 81).count() == 0
    path = spiral(5000)
    assert len(set(path)) == 5000
    one = spark.createDataFrame([("s", y, x) for y, x in path], "frame string, y int, x int")
    assert ras.kept_components(one, "frame", 5000).count() == 5000


def test_components_of_graphs(spark):
    r = np.random.default_rng(10)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(300)] + [(5000, i) for i in range(6000, 6400)]
    edges += [(7, 7), (9999, 9999), (8000, 8001), (8001, 8000), (None, 4)]
    up = {x: x for e in edges if None not in e for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            ra, rb = find(a), find(b)
            up[max(ra, rb)] = min(ra, rb)
    got = comp.components(spark.createDataFrame(edges, "a int, b int").repartition(4)).collect()
    assert len(got) == len(up) and all(q.component == find(q.node) for q in got)
    assert comp.components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_exact_percentiles(spark, monkeypatch):
    r = np.random.default_rng(11)
    v = np.concatenate([r.normal(size=3000), np.full(2500, 1.5), [1e300, -1e300, 5e-324, -0.0, 0.0], np.round(r.normal(size=500), 1)])
    shares = [0.0, 0.03, 0.25, 0.5, 0.777, 0.985, 1.0]
    t = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "v double").repartition(5)
    want = np.percentile(v, [s * 100 for s in shares])
    assert np.allclose(sel.percentiles(t, "v", shares), want, rtol=1e-12)
    monkeypatch.setattr(sel, "FEW", 3)
    monkeypatch.setattr(sel, "BUCKETS", 16)
    assert np.allclose(sel.percentiles(t, "v", shares), want, rtol=1e-12)
    assert sel.percentiles(t.filter("v is null"), "v", [0.5]) == [None]
    groups = [("a", float(x)) for x in v[:1000]] + [("b", 2.0)] + [("c", None)] + [(None, float(x)) for x in range(7)]
    g = spark.createDataFrame(groups, "k string, v double").repartition(4)
    got = {q.k: tuple(q)[1:] for q in sel.group_percentiles(g, ["k"], "v", [0.1, 0.5]).collect()}
    assert set(got) == {"a", "b", None}
    assert got["a"] == pytest.approx((1000, *np.percentile(v[:1000], [10, 50]))) and got["b"] == (1, 2.0, 2.0) and got[None] == pytest.approx((7, 0.6, 3.0))
    assert agg.scene_radius(t.limit(0).select(F.col("v").alias("x")), ["x"]).first()[0] is None


def test_ownership_masks(spark):
    h = w = 8
    owned = np.ones((h, w))
    owned[:, 6:] = 0
    old = np.full((h, w), 255.0)
    old[0, 0] = 0
    t = table(spark, [np.where(owned, 1.0, 9.0), old], ["best", "old"], ("a",))
    t = t.unionByName(t.withColumn("frame", F.lit("z")).withColumn("best", F.lit(9.0)))
    got = ras.ownership_masks(t, "frame", F.lit(True), F.lit(2.0), F.col("best"), "old", 1.0, 1, 0.6, h, w)
    want = old.copy()
    want[:, :5] = 0  # shrunk by one pixel
    share = 1 - (want >= 128).mean()
    assert share > 0.6
    lattice = np.zeros((h, w), bool)
    lattice[::4, ::4] = True
    want[lattice & (old >= 128)] = 255
    assert np.array_equal(array(got, "mask", h, w), want)
    assert np.array_equal(array(got, "mask", h, w, "z"), old)
    report = {q.frame: q for q in ras.mask_report(got, "frame").collect()}
    assert report["a"].capped and not report["z"].capped and report["a"].masked == pytest.approx(1 - (want >= 128).mean())


def test_vanishing_points_within_error_bounds(spark):
    r = np.random.default_rng(12)
    rows = []
    for px, py in ((900.0, 200.0), (-1500.0, 340.0)):
        for _ in range(60):
            x, y = r.uniform(0, 640), r.uniform(0, 480)
            d = np.array([px - x, py - y])
            d = d / np.hypot(*d) * r.uniform(40, 160)
            rows.append(("i", *(float(v) for v in (x, y, x + d[0], y + d[1]) + r.normal(0, 0.2, 4))))
    for k in range(50):  # parallel lines: a point at infinity
        x, y = r.uniform(0, 640), r.uniform(0, 480)
        rows.append(("i", x, y, x + float(r.normal(0, 0.1)), y + 90.0))
    rows += [("i", *map(float, r.uniform(0, 480, 4))) for _ in range(15)] + [("few", 0.0, 0.0, 1.0, 1.0), ("i", 3.0, 3.0, 3.0, 3.0)]
    t = spark.createDataFrame(rows, "image string, x0 double, y0 double, x1 double, y1 double").repartition(4)
    got = images.vanishing_points(t, "image").collect()
    assert {q.image for q in got} == {"i"} and len(got) == 3
    found = [np.array([q.vx, q.vy, q.vw]) for q in got]

    def angle(v, px, py):  # between the directions from the image's middle
        a, b = v[:2] - v[2] * np.array([320, 240]), np.array([px - 320, py - 240])
        return np.degrees(np.arccos(min(1, abs(a @ b) / np.linalg.norm(a) / np.linalg.norm(b))))

    for px, py in ((900, 200), (-1500, 340), (320, 1e9)):
        assert min(angle(v, px, py) for v in found) < 1.0
    near = min((v for v in found), key=lambda v: angle(v, 900, 200))
    assert np.hypot(*(near[:2] / near[2] - [900, 200])) < 40
    again = images.vanishing_points(t.orderBy(F.desc("x0")), "image").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_least_squares_says_when_it_has_no_answer(spark):
    r = np.random.default_rng(13)
    a, x = r.normal(size=(40, 6)), r.normal(size=6)
    entries = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(40) for j in range(6)], "i int, j int, v double")
    rhs = spark.createDataFrame([(i, float(b)) for i, b in enumerate(a @ x)], "i int, b double")
    got = {q.j: q.x for q in images.least_squares(entries, rhs).collect()}
    assert np.allclose([got[j] for j in range(6)], x)
    with pytest.raises(ArithmeticError, match="after 2 rounds"):
        images.least_squares(entries, rhs, rounds=2)
