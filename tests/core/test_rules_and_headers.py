"""Resolution rules, camera rewriting, image headers, fingerprints and stitching."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbisloom.functions import camera
from orbisloom.operators import aggregates as agg
from orbisloom.operators import images, names, rails
from orbisloom.operators import raster as ras
from orbisloom.sources import files


def test_first_candidate_with_files_wins_over_a_sibling(spark):
    c = spark.createDataFrame(
        [(1, "a", 0), (1, "b", 1), (1, "c", 2), (2, "d", 0), (2, "e", 1), (3, "x", 0), (4, "b", 1), (4, "c", 0)], "request int, folder string, priority int"
    )
    f = spark.createDataFrame([("a_lowres",), ("b",), ("b",), ("c",), ("e_lowres",)], "folder string")
    got = {r.request: (r.folder, r.why) for r in names.resolved_folders(c, "request", "folder", "priority", f).collect()}
    assert got == {1: ("b", "files"), 2: ("e", "sibling"), 3: (None, "missing"), 4: ("c", "files")}


def test_rails_are_named_shared_ambiguous_or_missing(spark):
    roots = spark.createDataFrame([("one", "/p", 0), ("one", "/p/_work", 1), ("two", "/q", 0), ("shared", "/s", 0), ("shared", "/t", 1), ("none", "/u", 0)], "request string, root string, priority int")
    rows = [("/p/_work", "rail_7.json"), ("/p", "rail.json"), ("/q", "rail_1.json"), ("/q", "rail_2.json"), ("/t", "rail.json"), ("/s", "rail.json"), ("/u", "other.txt")]
    f = spark.createDataFrame(rows, "folder string, name string")
    pick = lambda r, strict: names.resolved_rails(r, "request", "root", "priority", f, "rail.json", r"^rail_.*\.json$", strict)
    got = {r.request: (r.path, r.why) for r in pick(roots, False).collect()}
    assert got == {"one": ("/p/_work/rail_7.json", "named"), "two": (None, "ambiguous"), "shared": ("/s/rail.json", "shared"), "none": (None, "missing")}
    for bad in ("two", "none"):
        with pytest.raises(Exception, match=f"rail of {bad}"):
            pick(roots.filter(F.col("request") == bad), True).collect()
    assert pick(roots.filter("request = 'one'"), True).first().path == "/p/_work/rail_7.json"


def test_panorama_cameras(spark):
    c = spark.createDataFrame([(1, "SPHERE", [7.0, 1.0, 2.0]), (2, "EQUIRECTANGULAR", [8.0, 4.0]), (3, "PINHOLE", [1.0, 1.0, 2.0, 2.0])], "camera_id int, model string, params array<double>")
    made = camera.equirectangular(F.col("camera_id"), F.col("model"), F.col("params"), F.lit(4096), F.lit(2048))
    got = {r.camera_id: (r.m.model, list(r.m.params)) for r in c.filter("camera_id < 3").select("camera_id", made.alias("m")).collect()}
    assert got == {1: ("EQUIRECTANGULAR", [4096.0, 2048.0]), 2: ("EQUIRECTANGULAR", [8.0, 4.0])}
    with pytest.raises(Exception, match="camera 3 is no panorama: PINHOLE"):
        c.select(made.alias("m")).collect()
    grid = camera.on_sphere_grid(F.col("model"), F.col("params"), F.lit(100), F.lit(50))
    assert [list(r.g) for r in c.orderBy("camera_id").select(grid.alias("g")).collect()] == [[7.0, 50.0, 25.0], [8.0, 4.0], [1.0, 1.0, 2.0, 2.0]]


def jpeg(width, height, progressive=False):
    app = b"\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0" + bytes(9)
    tables = b"\xff\xc4" + struct.pack(">H", 5) + b"abc"
    frame = (b"\xff\xc2" if progressive else b"\xff\xc0") + struct.pack(">HBHHB", 11, 8, height, width, 1) + b"\1\x11\0"
    return b"\xff\xd8" + app + b"\xff" + tables + frame + b"\xff\xda"


def test_header_sizes(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 640, 480)
    vp8x = b"RIFF....WEBPVP8X" + bytes(8) + (1023).to_bytes(3, "little") + (511).to_bytes(3, "little")
    vp8l = b"RIFF....WEBPVP8L" + bytes(4) + b"\x2f" + struct.pack("<I", (300 - 1) | (200 - 1) << 14)
    vp8 = b"RIFF....WEBPVP8 " + bytes(10) + struct.pack("<HH", 320 | 0x4000, 240)
    cases = {
        "a.png": (png, (640, 480)), "b.jpg": (jpeg(800, 600), (800, 600)), "c.JPEG": (jpeg(70_00, 35, True), (7000, 35)), "d.webp": (vp8x, (1024, 512)),
        "e.webp": (vp8l, (300, 200)), "f.webp": (vp8, (320, 240)), "g.bmp": (b"BM" + bytes(16) + struct.pack("<ii", 12, -9), (12, 9)),
        "h.png": (b"\x89", None), "i.jpg": (jpeg(8, 8)[:20], None), "j.jpg": (b"\xff\xd8\xff", None), "k.png": (png[:20], None), "l.png": (b"no image at all", None),
    }
    assert files.header_size(b"GIF89a" + struct.pack("<HH", 5, 6)) == (5, 6)
    for n, (data, want) in cases.items():
        assert files.header_size(data) == want, n
        (tmp_path / n).write_bytes(data)
    assert files.header_size(b"") is None
    (tmp_path / "x.txt").write_bytes(png)
    got = {r.name: None if r.width is None else (r.width, r.height) for r in files.image_sizes(spark, str(tmp_path), ("png", "jpg", "jpeg", "webp", "bmp")).collect()}
    assert got == {n: want for n, (_, want) in cases.items()}


def test_fingerprints_see_rows_not_their_order(spark):
    rows = [("g", i, None if i % 3 else "t") for i in range(50)] + [("h", 1, "")]
    mark = lambda r: {q.k: (q.n, q.fingerprint) for q in agg.fingerprints(spark.createDataFrame(r, "k string, i int, t string").repartition(3), ["k"], ["i", "t"]).collect()}
    first = mark(rows)
    assert mark(rows[::-1]) == first
    for other in (rows[1:], [*rows, rows[0]], [("g", 0, "u"), *rows[1:]], [("g", 0, ""), *rows[1:]]):
        assert mark(other)["g"] != first["g"] and mark(other)["h"] == first["h"]
    assert mark([*rows[:-1], ("h", 1, None)])["h"] != first["h"]


def test_stitching_matches_all_pairs(spark):
    r = np.random.default_rng(3)
    faces = []
    for k in range(12):
        q, _ = np.linalg.qr(r.normal(size=(3, 3)))
        if np.linalg.det(q) < 0:
            q[0] *= -1
        faces.append((f"f{k:02d}", *map(float, q.ravel()), float(r.uniform(60, 200)), float(r.uniform(60, 200)), 45.0, 40.0, 100.0, 80.0))
    schema = "name string, " + ", ".join(f"r{i}{j} double" for i in range(3) for j in range(3)) + ", fx double, fy double, cx double, cy double, w double, h double"
    d = r.normal(size=(600, 3))
    d[:6] = [[1, 1, 1], [-1, 1, 0], [0, 0, -1], [1, 0, 0], [0, -1, 1], [-1, -1, -1]]
    grid = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(d)], "i int, dx double, dy double, dz double")
    got = {q.i: (q.name, q.px, q.py) for q in images.stitched(grid, spark.createDataFrame(faces, schema), ("dx", "dy", "dz")).collect()}
    want = {}
    for i, v in enumerate(d):
        best = None
        for name, *rest in faces:
            m, (fx, fy, cx, cy, w, h) = np.array(rest[:9]).reshape(3, 3), rest[9:]
            x, y, z = m @ v
            if z > 0:
                px, py = fx * x / z + cx, fy * y / z + cy
                if 0 <= px <= w and 0 <= py <= h and (best is None or (-z, name) < best[0]):
                    best = (-z, name), px, py
        if best:
            want[i] = (best[0][1], best[1], best[2])
    assert got.keys() == want.keys() and len(want) > 100
    for i, (name, px, py) in want.items():
        assert got[i][0] == name and math.isclose(got[i][1], px, abs_tol=1e-6) and math.isclose(got[i][2], py, abs_tol=1e-6)


def np_axes(forward):
    z0, x0, out = np.array([0.0, 0.0, 1.0]), np.array([1.0, 0.0, 0.0]), []
    for f in forward:
        n = np.linalg.norm(f)
        z = f / n if n > 1e-8 else z0
        x = np.cross([0.0, 1.0, 0.0], z)
        if np.linalg.norm(x) > 5e-2:
            x = x / np.linalg.norm(x)
        else:
            x = x0 - z * (x0 @ z)
            x = x / np.linalg.norm(x) if np.linalg.norm(x) > 1e-8 else x0
        out.append((x, np.cross(z, x), z))
        z0, x0 = z, x
    return out


def test_axes_are_carried_over_degenerate_frames(spark):
    r = np.random.default_rng(4)
    paths = {
        "a": [*r.normal(size=(5, 3)), [0, 0, 0], [0.01, 1, 0], [0, 2, 0], [0.0, -1, 0.02], [0, 0, 0], *r.normal(size=(3, 3))],
        "up first": [[0, 0, 0], [0, 5, 0.1], [0, 1, 0], [1, 0, 0]],
        "one": [[0, -3, 0]],
        None: [[1, 2, 3], [0, 1, 0]],
    }
    rows = [(p, i, *map(float, f)) for p, fs in paths.items() for i, f in enumerate(fs)]
    frames = spark.createDataFrame(rows, "path string, i int, fx double, fy double, fz double").repartition(3)
    got = rails.oriented(frames, ["path"], "i", (F.col("fx"), F.col("fy"), F.col("fz")))
    assert got.columns == [*frames.columns, "right", "up", "ahead"]
    found = {(q.path, q.i): q for q in got.collect()}
    assert len(found) == len(rows)
    for p, fs in paths.items():
        for i, (x, y, z) in enumerate(np_axes(np.array(fs, float))):
            q = found[p, i]
            assert np.allclose(q.right, x) and np.allclose(q.up, y) and np.allclose(q.ahead, z), (p, i)


def test_semantic_masks_must_fit(spark):
    grid = lambda frames, h, w: spark.createDataFrame([(f, y, x, float((y + x) % 2)) for f in frames for y in range(h) for x in range(w)], "frame string, y int, x int, m double")
    holes = grid("ab", 3, 4)
    fit = ras.semantic_region(grid("q", 3, 4), holes, "frame", "m", 0.5, 0, 3, 4)
    assert fit.count() == 24 and fit.select("frame").distinct().count() == 2
    assert ras.semantic_region(holes, holes, "frame", "m", 0.5, 1, 3, 4).filter("m = 1").count() == 24
    for wrong in (grid("q", 4, 4), grid("abc", 3, 4), grid("ac", 3, 4), grid("ab", 3, 4).filter("not (frame = 'a' and y = 1 and x = 1)")):
        with pytest.raises(ValueError):
            ras.semantic_region(wrong, holes, "frame", "m", 0.5, 0, 3, 4)


def test_masks_come_for_all_views(spark):
    sizes = spark.createDataFrame([("a", 2, 2), ("b", 1, 2), ("c", 1, 1), ("none", 0, 5)], "view string, height int, width int")
    old = spark.createDataFrame([("b", 0, 0, 9), ("b", 0, 1, 0)], "view string, y int, x int, mask int")
    covered = spark.createDataFrame([("a", 0, 1), ("a", 0, 1), ("a", 7, 7)], "view string, y int, x int")
    got = {(q.view, q.y, q.x): (q.mask, q.filler) for q in ras.covered_masks(sizes, old, covered, "view").collect()}
    assert got == {("a", 0, 0): (255, False), ("a", 0, 1): (0, False), ("a", 1, 0): (255, False), ("a", 1, 1): (255, False), ("b", 0, 0): (9, False), ("b", 0, 1): (0, False), ("c", 0, 0): (255, True)}
