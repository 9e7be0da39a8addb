"""Pixel-table metrics, blurs, warps and fills, and the numeric routines behind them."""

from __future__ import annotations

from math import pi

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lines
from .ordered import held
from .raster import sharpness


def repair_metrics(before: DataFrame, after: DataFrame, frame: str, value: str) -> DataFrame:
    """(frame, gain, drift): sharpness after over before (null when that is 0), and the mean absolute change. Frames meet pixel
    by pixel; drift is over the pixels that both have."""
    a, b = (sharpness(d, frame, value).withColumnRenamed("sharpness", n) for d, n in ((before, "_a"), (after, "_b")))
    both = before.select(frame, "y", "x", F.col(value).alias("_u")).join(after.select(frame, "y", "x", F.col(value).alias("_v")), [frame, "y", "x"])
    drift = both.groupBy(frame).agg(F.avg(F.abs(F.col("_u") - F.col("_v"))).alias("drift"))
    gain = F.when(F.col("_a") > 1e-6, F.col("_b") / F.col("_a"))
    return a.join(b, frame).join(drift, frame, "left").select(frame, gain.alias("gain"), "drift")


def scaled_sharpness(pixels: DataFrame, frame: str, value: str, height: int, width: int, most: int = 1024) -> DataFrame:
    """(frame, sharpness) of the grid reduced so that its longer side has at most `most` pixels, so that figures of images of
    different sizes compare; borders are reflected."""
    by = most / max(height, width, most)
    h, w = max(1, int(height * by)), max(1, int(width * by))
    small = pixels if (h, w) == (height, width) else lines.area_reduced(pixels, [frame], [value], height, width, h, w)
    edges = lines.laplacians(small, [frame], [value], h, w)
    return edges.groupBy(frame).agg(F.var_pop(f"{value}_lap").alias("sharpness"))


def blurred(pixels: DataFrame, frame: str, value: str, sigma: float, height: int, width: int) -> DataFrame:
    """A Gaussian blur with reflected borders; a large sigma belongs on a smaller grid."""
    return lines.gaussian(pixels, [frame], [value], sigma, height, width)


def box_feathered(holes: DataFrame, frame: str, value: str, radius: int, height: int, width: int) -> DataFrame:
    """A hole mask with soft edges: the mean over a square window, never below the hard mask."""
    from .raster import neighbours

    soft = neighbours(holes, frame, value, radius, height, width, False, F.avg).withColumnRenamed(value, "_soft")
    return holes.join(soft, [frame, "y", "x"], "left").withColumn(value, F.greatest(F.col(value).cast("double"), F.coalesce("_soft", F.lit(0.0)))).drop("_soft")


def sampled(targets: DataFrame, pixels: DataFrame, u: str, v: str, value: str, height: int, width: int, wrap: bool = True) -> DataFrame:
    """targets with the bilinear value of a pixel table (y, x, value) at u, v in 0..1; u wraps around when asked."""
    t = targets.withColumn("_id", F.struct(*targets.columns)).withColumn("_fx", F.col(u) * width - 0.5).withColumn("_fy", F.col(v) * height - 0.5)
    t = t.withColumn("_x0", F.floor("_fx")).withColumn("_y0", F.floor("_fy"))
    corner = lambda dx, dy: F.struct(
        (F.col("_x0") + dx).alias("x"), (F.col("_y0") + dy).alias("y"), ((1 - F.abs(F.col("_fx") - F.col("_x0") - dx)) * (1 - F.abs(F.col("_fy") - F.col("_y0") - dy))).alias("w")
    )
    four = t.select("_id", F.explode(F.array(*[corner(a, b) for a in (0, 1) for b in (0, 1)])).alias("_c"))
    x = F.pmod(F.col("_c.x"), F.lit(width)) if wrap else F.greatest(F.lit(0), F.least(F.col("_c.x"), F.lit(width - 1)))
    four = four.select("_id", x.cast("int").alias("x"), F.greatest(F.lit(0), F.least(F.col("_c.y"), F.lit(height - 1))).cast("int").alias("y"), "_c.w")
    return four.join(pixels.select("y", "x", value), ["y", "x"]).groupBy("_id").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias(value)).select("_id.*", value)


def stitched(grid: DataFrame, faces: DataFrame, direction: tuple[str, str, str]) -> DataFrame:
    """(grid row, name, px, py): for each direction the face that sees it nearest its own centre (greatest depth, then name),
    and where. faces: name, r00..r22, fx, fy, cx, cy, w, h.

    Directions and faces meet by the cells of a cube around the viewpoint: a face is sent to the cells that the cone around its
    axis can reach, a direction to its own. So the work is that of the pairs that may see each other, for any number of faces."""
    d = [F.col(c) for c in direction]
    cells = 8

    def cell(v: list[Column]) -> list[Column]:
        most = F.greatest(*[F.abs(c) for c in v])
        side = F.when(F.abs(v[0]) == most, F.when(v[0] > 0, 0).otherwise(1)).when(F.abs(v[1]) == most, F.when(v[1] > 0, 2).otherwise(3)).otherwise(F.when(v[2] > 0, 4).otherwise(5))
        over = [F.when(F.abs(v[0]) == most, v[1]).otherwise(v[0]), F.when((F.abs(v[2]) == most) & (F.abs(v[0]) != most) & (F.abs(v[1]) != most), v[1]).otherwise(v[2])]
        place = [F.least(F.floor((F.try_divide(c, most) + 1) / 2 * cells), F.lit(cells - 1)).cast("int") for c in over]
        return [side, *place]

    # the middles of all cells, with the greatest angle from a middle to a corner of its cell
    step = [(k + 0.5) / cells * 2 - 1 for k in range(cells)]
    axes = {0: lambda a, b: (1.0, a, b), 1: lambda a, b: (-1.0, a, b), 2: lambda a, b: (a, 1.0, b), 3: lambda a, b: (a, -1.0, b), 4: lambda a, b: (a, b, 1.0), 5: lambda a, b: (a, b, -1.0)}
    reach = float(np.arctan(np.sqrt(2.0) / cells)) + 1e-6
    middles = []
    for side, at in axes.items():
        for i, a in enumerate(step):
            for j, b in enumerate(step):
                v = np.array(at(a, b)) / np.linalg.norm(at(a, b))
                middles.append(F.struct(F.lit(side).alias("s"), F.lit(i).alias("i"), F.lit(j).alias("j"), *[F.lit(float(c)).alias(n) for c, n in zip(v, "xyz")]))
    corner = lambda x, y: F.sqrt(((x - F.col("cx")) / F.col("fx")) ** 2 + ((y - F.col("cy")) / F.col("fy")) ** 2)
    wide = F.atan(F.greatest(*[corner(x, y) for x in (F.lit(0.0), F.col("w")) for y in (F.lit(0.0), F.col("h"))]))
    near = lambda m: F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), sum(F.col(f"r2{k}") * m[n] for k, n in enumerate("xyz"))))) <= F.col("_wide") + reach
    sent = faces.withColumn("_wide", wide).select("*", F.explode(F.filter(F.array(*middles), near)).alias("_m"))
    sent = sent.select(*faces.columns, F.col("_m.s").alias("_s"), F.col("_m.i").alias("_i"), F.col("_m.j").alias("_j"))
    met = grid.withColumns(dict(zip(("_s", "_i", "_j"), cell(d)))).join(sent, ["_s", "_i", "_j"])
    cam = [sum(F.col(f"r{i}{j}") * d[j] for j in range(3)) for i in range(3)]
    met = met.withColumn("_z", cam[2]).filter("_z > 0").withColumn("px", F.col("fx") * cam[0] / F.col("_z") + F.col("cx")).withColumn("py", F.col("fy") * cam[1] / F.col("_z") + F.col("cy"))
    met = met.filter(F.col("px").between(0, F.col("w")) & F.col("py").between(0, F.col("h")))
    best = F.min(F.struct((-F.col("_z")).alias("z"), "name", "px", "py")).alias("_b")
    return met.groupBy(*grid.columns).agg(best).select(*grid.columns, "_b.name", "_b.px", "_b.py")


def frustum_culled(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Faces that no clip plane rejects outright: not all three corners lie beyond one of its sides. Every face that leaves a
    fragment stays."""
    f = faces
    for i in range(3):
        f = f.join(vertices.select(F.col("vid").alias(f"v{i}"), *[F.col(c).alias(f"_{c}{i}") for c in "xyw"]), f"v{i}")
    out = F.lit(False)
    for c in "xy":
        out = out | ((F.col(f"_{c}0") > F.col("_w0")) & (F.col(f"_{c}1") > F.col("_w1")) & (F.col(f"_{c}2") > F.col("_w2")))
        out = out | ((F.col(f"_{c}0") < -F.col("_w0")) & (F.col(f"_{c}1") < -F.col("_w1")) & (F.col(f"_{c}2") < -F.col("_w2")))
    out = out | ((F.col("_w0") <= 0) & (F.col("_w1") <= 0) & (F.col("_w2") <= 0))
    return f.filter(~out).select(*faces.columns)


def depth_edges(pixels: DataFrame, frame: str, depth: str, tolerance: float, height: int, width: int) -> DataFrame:
    """(frame, y, x, edge): whether the range of depths in the 3 x 3 window, over the pixel's own, is above the tolerance."""
    from .raster import neighbours

    low = neighbours(pixels, frame, depth, 1, height, width, False, F.min).withColumnRenamed(depth, "_low")
    high = neighbours(pixels, frame, depth, 1, height, width, False, F.max).withColumnRenamed(depth, "_high")
    out = pixels.join(low, [frame, "y", "x"]).join(high, [frame, "y", "x"])
    return out.select(frame, "y", "x", F.coalesce(F.try_divide(F.col("_high") - F.col("_low"), F.col(depth)) > tolerance, F.lit(False)).alias("edge"))


def depth_cloud(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """(i, x, y, z, other columns) of a panorama's depth pixels in the cloud's own directions; pixels without depth are left out."""
    from ..functions.camera import cloud_direction

    d = cloud_direction(F.col("x"), F.col("y"), F.lit(float(width)), F.lit(height))
    rest = [c for c in pixels.columns if c not in ("x", "y", "depth")]
    return pixels.filter("depth > 0").select((F.col("y") * width + F.col("x")).alias("i"), *[(a * F.col("depth")).alias(n) for a, n in zip(d, ("cx", "cy", "cz"))], *rest).withColumnsRenamed({"cx": "x", "cy": "y", "cz": "z"})


def encode_uv(u: Column, turns: int) -> Column:
    """struct(c, s, f): a position on a circle as cosine and sine, with its fine phase for `turns` turns."""
    return F.struct(F.cos(u * 2 * pi).alias("c"), F.sin(u * 2 * pi).alias("s"), F.pmod(u * turns, F.lit(1.0)).alias("f"))


def decode_uv(e: Column, turns: int) -> Column:
    """The position whose coarse angle is nearest and whose fine phase fits."""
    coarse = F.pmod(F.atan2(e["s"], e["c"]) / (2 * pi), F.lit(1.0))
    return F.pmod((F.rint(coarse * turns - e["f"]) + e["f"]) / turns, F.lit(1.0))


def agreement(pixels: DataFrame, frame: str, a: str, b: str, radius: int, height: int, width: int, flat: float = 1e-6) -> DataFrame:
    """(frame, y, x, zncc): the correlation of two values over a square window; 1 where both are flat there."""
    from .raster import neighbours

    p = pixels.select(frame, "y", "x", F.struct(F.col(a).alias("a"), F.col(b).alias("b")).alias("_p")).select(frame, "y", "x", *[e.alias(n) for n, e in (("_a", F.col("_p.a")), ("_b", F.col("_p.b")), ("_aa", F.col("_p.a") ** 2), ("_bb", F.col("_p.b") ** 2), ("_ab", F.col("_p.a") * F.col("_p.b")), ("_n", F.lit(1.0)))])
    sums = None
    for c in ("_a", "_b", "_aa", "_bb", "_ab", "_n"):
        s = neighbours(p, frame, c, radius, height, width, False, F.sum)
        sums = s if sums is None else sums.join(s, [frame, "y", "x"])
    va, vb = F.col("_aa") / F.col("_n") - (F.col("_a") / F.col("_n")) ** 2, F.col("_bb") / F.col("_n") - (F.col("_b") / F.col("_n")) ** 2
    cov = F.col("_ab") / F.col("_n") - F.col("_a") * F.col("_b") / F.col("_n") ** 2
    z = F.when((va < flat) & (vb < flat), 1.0).when((va < flat) | (vb < flat), 0.0).otherwise(cov / F.sqrt(F.greatest(va * vb, F.lit(flat * flat))))
    return sums.select(frame, "y", "x", z.alias("zncc"))


#: Entries of a matrix that one task holds, on average; so the number of tasks grows with the matrix.
ENTRIES = 500_000
#: A column with at least this share of the entries is broadcast, so there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 2000


def least_squares(entries: DataFrame, rhs: DataFrame, rounds: int | None = None, tolerance: float = 1e-9) -> DataFrame:
    """(j, x) minimising |Ax - b| for A in coordinates (i, j, v) and b in (i, b), by conjugate gradients on the normal
    equations: each round is two sparse products (a join and an aggregation); of the vectors the driver sees two sums.

    The entries are dealt out once by rows of A, in parts of about ENTRIES, and stay so; a product along the rows moves no
    entry. A column that has many entries gets its value by broadcast, so no task gets all of a dense column; a dense row does lie in one task, whose sort may spill.

    Without `rounds` it goes on until the tolerance is met, at most ten rounds per unknown; then, as after so many `rounds`,
    it raises ArithmeticError, with how far it came, rather than give an answer that isn't one."""
    sizes = held(entries.groupBy("j").agg(F.count(F.lit(1)).alias("_n")))
    total = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    columns, hot = sizes.select("j"), sizes.filter(F.col("_n") >= F.lit(max(2.0, total * HOT_SHARE))).select("j")
    n_hot, n = hot.count(), sizes.count()
    parts = max(entries.sparkSession.sparkContext.defaultParallelism, -(-total // ENTRIES))
    dense = held(entries.join(F.broadcast(hot), "j", "left_semi").select("i", "j", "v").repartition(parts, "i")) if n_hot else None
    sparse = held(entries.join(F.broadcast(hot), "j", "left_anti").select("i", "j", "v").repartition(parts, "i")) if n_hot < n else None
    known = [e for e in (dense, sparse) if e is not None]

    def product(vec: DataFrame, key: str, out: str) -> DataFrame:
        """A vec (from j to i), or the transpose's (from i to j)."""
        met = []
        for e in known:
            side = vec.hint("merge") if key == "i" or e is sparse else F.broadcast(vec.join(F.broadcast(hot), "j", "left_semi"))
            met.append(e.join(side, key).groupBy(out).agg(F.sum(F.col("v") * F.col("x")).alias("x")))
        return met[0] if len(met) == 1 else met[0].unionByName(met[1]).groupBy(out).agg(F.sum("x").alias("x"))

    if not known:
        return columns.select("j", F.lit(0.0).alias("x"))
    r = held(columns.join(product(rhs.select("i", F.col("b").alias("x")), "i", "j"), "j", "left").select("j", F.coalesce("x", F.lit(0.0)).alias("x")))
    p, x = r, held(columns.select("j", F.lit(0.0).alias("x")))
    square = lambda d: d.agg(F.coalesce(F.sum(F.col("x") * F.col("x")), F.lit(0.0))).first()[0]
    rr = first = square(r)
    most, done = rounds if rounds is not None else 10 * n + 10, 0
    while rr > tolerance * tolerance * max(first, 1e-300):
        if done == most:
            raise ArithmeticError(f"after {done} rounds the residual is {(rr / first) ** 0.5:.3g} of the first, not {tolerance:.3g}")
        done += 1
        ap = held(product(p, "j", "i").repartition(parts, "i"))
        alpha = rr / max(square(ap), 1e-300)
        q = product(ap, "i", "j").withColumnRenamed("x", "q")
        step = lambda d, e, f: held(d.join(e, "j", "left").select("j", f.alias("x")))
        x = step(x, p.withColumnRenamed("x", "q"), F.col("x") + alpha * F.coalesce("q", F.lit(0.0)))
        r = step(r, q, F.col("x") - alpha * F.coalesce("q", F.lit(0.0)))
        new = square(r)
        p = step(r, p.withColumnRenamed("x", "q"), F.col("x") + new / max(rr, 1e-300) * F.coalesce("q", F.lit(0.0)))
        rr = new
    return x


def vanishing_points(segments: DataFrame, image: str, rounds: int = 1500, degrees: float = 1.5, least: int = 4, seed: int = 0, most: int = 3) -> DataFrame:
    """(image, k, vx, vy, vw, inliers): up to `most` vanishing points of an image's segments (x0, y0, x1, y1), as homogeneous
    directions, so points at infinity too.

    Pairs of lines are drawn by length, a pair's point is scored by the length of the segments that point at it within
    `degrees`, and the best one is fitted again to all its segments by least squares, weighted by length. An image's
    segments are few, so each image is one group; the draws hang on its segments and the seed alone."""
    limit = np.sin(np.radians(degrees))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rng, out = np.random.default_rng(seed), []
        rows = rows.sort_values(["x0", "y0", "x1", "y1"])
        a, b = rows[["x0", "y0"]].to_numpy(float), rows[["x1", "y1"]].to_numpy(float)
        length = np.hypot(*(b - a).T)
        long_enough = length > 1e-9
        a, b, length = a[long_enough], b[long_enough], length[long_enough]
        line = np.cross(np.c_[a, np.ones(len(a))], np.c_[b, np.ones(len(b))])
        line /= np.hypot(line[:, 0], line[:, 1])[:, None]
        mid, along = (a + b) / 2, (b - a) / length[:, None]

        def close(v: np.ndarray, of: np.ndarray) -> np.ndarray:
            to = v[:2] - v[2] * mid[of]
            off = np.abs(to[:, 0] * along[of, 1] - to[:, 1] * along[of, 0])
            return off < limit * np.maximum(np.hypot(*to.T), 1e-12)

        left = np.arange(len(a))
        while len(out) < most and len(left) >= 6:
            best, got = 0.0, None
            weight = length[left] / length[left].sum()
            for _ in range(rounds):
                i, j = rng.choice(left, 2, replace=False, p=weight)  # long segments give the better directions
                v = np.cross(line[i], line[j])
                if np.linalg.norm(v) < 1e-9:
                    continue
                hit = close(v / np.linalg.norm(v), left)
                score = length[left][hit].sum()
                if hit.sum() >= least and score > best:
                    best, got = score, left[hit]
            if got is None:
                break
            # the point nearest all inlier lines, as a direction, so that one at infinity is found too; the unit of length is the
            # segments' own spread, so that the three coordinates weigh alike
            centre, scale = mid[got].mean(axis=0), max(1.0, float(np.abs(mid[got] - mid[got].mean(axis=0)).max()))
            local = np.c_[line[got, :2], (line[got, 2] + line[got, :2] @ centre) / scale]
            v = np.linalg.svd(local * length[got, None])[2][-1]
            v = np.array([v[0] * scale + centre[0] * v[2], v[1] * scale + centre[1] * v[2], v[2]])
            v /= np.linalg.norm(v)
            v = -v if v[np.flatnonzero(np.abs(v) > 1e-12)[-1]] < 0 else v
            out.append((rows[image].iloc[0], len(out), *v, len(got)))
            left = np.setdiff1d(left, got)
        return pd.DataFrame(out, columns=[image, "k", "vx", "vy", "vw", "inliers"])

    kind = segments.schema[image].dataType.simpleString()
    return segments.groupBy(image).applyInPandas(one, f"{image} {kind}, k int, vx double, vy double, vw double, inliers int")
