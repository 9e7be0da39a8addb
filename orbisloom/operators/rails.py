"""Camera rails and planned paths: tables with a row per frame or anchor.

A rail is (traj, frame, x, y, z, rx, ry, rz): the camera's place in a frame whose y axis points down, and its right axis.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.camera import Vector, cross, dot, unit
from .aggregates import robust_band, sector_ranges
from .ordered import circular_minimum, separated, spline_samples
from .selection import percentiles


def travel_scaled(rail: DataFrame, distance: float) -> DataFrame:
    """Places scaled so that each trajectory's farthest one is at `distance` from the origin; one that never moves stays."""
    far = rail.groupBy("traj").agg(F.max(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)).alias("_far"))
    by = F.when(F.col("_far") > 1e-12, distance / F.col("_far")).otherwise(1.0)
    return rail.join(far, "traj").select(*[(F.col(c) * by).alias(c) if c in ("x", "y", "z") else F.col(c) for c in rail.columns])


def yaw_fan(rail: DataFrame, directions: int) -> DataFrame:
    """The rail turned about the vertical axis by 0, 360 / n, ... degrees; trajectories are numbered on by direction."""
    fan = rail.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(directions - 1)))).withColumn("_a", F.col("_k") * (2 * pi / directions))
    turned = lambda x, z: ((F.cos("_a") * F.col(x) + F.sin("_a") * F.col(z)).alias(x), (F.cos("_a") * F.col(z) - F.sin("_a") * F.col(x)).alias(z))
    (x, z), (rx, rz) = turned("x", "z"), turned("rx", "rz")
    new = {"traj": (F.col("traj") * directions + F.col("_k")).alias("traj"), "x": x, "z": z, "rx": rx, "rz": rz}
    return fan.select(*[new.get(c, F.col(c)) for c in rail.columns])


def spiralled(rail: DataFrame, radius: float, turns: float, phase_degrees: float = 0.0) -> DataFrame:
    """Places moved along a circle of the given radius that passes through the path itself: it leaves upwards (turned by the
    phase) and curls to the camera's left. The first frame doesn't move."""
    last = rail.groupBy("traj").agg(F.max("frame").alias("_last"))
    r = rail.join(last, "traj").withColumn("_p", F.when(F.col("_last") > 0, F.col("frame") / F.col("_last") * (2 * pi * turns)).otherwise(0.0))
    a = phase_degrees * pi / 180
    up, left = (F.lit(0.0), F.lit(-1.0), F.lit(0.0)), tuple(-F.col(c) for c in ("rx", "ry", "rz"))
    out = {}
    for i, c in enumerate("xyz"):
        go, curl = F.cos(F.lit(a)) * up[i] + F.sin(F.lit(a)) * left[i], F.cos(F.lit(a)) * left[i] - F.sin(F.lit(a)) * up[i]
        out[c] = (F.col(c) + radius * (F.sin("_p") * go + (1 - F.cos("_p")) * curl)).alias(c)
    return r.select(*[out.get(c, F.col(c)) for c in rail.columns])


def depth_towards(directions: DataFrame, depths: DataFrame, u: Column, v: Column, height: int, width: int) -> DataFrame:
    """directions with the depth of the panorama pixel (y, x, depth) that they fall into."""
    at = lambda c, n: F.greatest(F.lit(0), F.least(F.floor(c * n), F.lit(n - 1))).cast("int")
    return directions.withColumn("_x", at(u, width)).withColumn("_y", at(v, height)).join(depths.select(F.col("y").alias("_y"), F.col("x").alias("_x"), "depth"), ["_y", "_x"], "left").drop("_x", "_y")


def clip_coordinates(p: Vector, fx: Column, fy: Column, cx: Column, cy: Column, width: Column, height: Column, near: float, far: float) -> Column:
    """struct(x, y, z, w): a point in camera coordinates as the rasterizer wants it."""
    x, y, z = p
    return F.struct(
        (2 * fx / width * x + (2 * cx / width - 1) * z).alias("x"), (2 * fy / height * y + (2 * cy / height - 1) * z).alias("y"),
        ((far + near) / (far - near) * z - 2 * near * far / (far - near)).alias("z"), z.alias("w"),
    )


def upright_basis(up: Vector) -> list[Vector]:
    """Three axes at right angles, the last along `up`; the first is nearest x, or y where up is close to x."""
    e3 = unit(up)
    steep = F.abs(e3[0]) < 0.9
    seed = (F.when(steep, 1.0).otherwise(0.0), F.when(steep, 0.0).otherwise(1.0), F.lit(0.0))
    k = dot(seed, e3)
    e1 = unit(tuple(s - c * k for s, c in zip(seed, e3)))
    return [e1, cross(e3, e1), e3]


def perspective_lookup(x: Column, y: Column, width: int, height: int, source_width: int, source_height: int, hfov: float, yaw: float = 0.0, pitch: float = 0.0) -> Column:
    """struct(px, py, valid): where a panorama pixel lies in a pinhole image that looks to yaw and pitch; valid inside it."""
    lon, lat = (x + 0.5) / width * (2 * pi) - pi, pi / 2 - (y + 0.5) / height * pi
    dx, dy, dz = F.cos(lat) * F.sin(lon), F.sin(lat), F.cos(lat) * F.cos(lon)
    a, b = F.lit(yaw * pi / 180), F.lit(pitch * pi / 180)
    dx, dz = F.cos(a) * dx - F.sin(a) * dz, F.sin(a) * dx + F.cos(a) * dz
    dy, dz = F.cos(b) * dy - F.sin(b) * dz, F.sin(b) * dy + F.cos(b) * dz
    f = source_width / 2 / F.tan(F.lit(hfov * pi / 360))
    px, py = f * F.try_divide(dx, dz) + (source_width - 1) / 2, (source_height - 1) / 2 - f * F.try_divide(dy, dz)
    inside = (dz > 1e-6) & px.between(0, source_width - 1) & py.between(0, source_height - 1)
    return F.struct(px.alias("px"), py.alias("py"), F.coalesce(inside, F.lit(False)).alias("valid"))


#: Where a path's four anchors lie on its length.
FRACTIONS = (0.0, 0.35, 0.7, 1.0)
#: A kind's label, how it looks, which free way its length is a share of, and that share.
LENGTHS = (
    ("push-in", "look_forward", "ahead", 0.65),
    ("arc-sweep", "look_forward", "ahead", 0.45),
    ("crane-rise", "per_point_look", "ahead", 1.0),
    ("pull-back", "per_point_look", "behind", 0.55),
)
#: Each kind's anchors along its length.
ALONG = {"push-in": FRACTIONS, "arc-sweep": FRACTIONS, "crane-rise": (0.0, 0.12, 0.25, 0.35), "pull-back": tuple(-f for f in FRACTIONS)}
#: Each kind's anchors to the right, as shares of a width: SWAY of its length, half of the free way on either
#: side, or its length.
SWAY, HALF = 0.08, 0.5
ASIDE = {
    "push-in": ((0.0, "sway"), (1.0, "sway"), (-1.0, "sway"), (0.3, "sway")),
    "arc-sweep": ((0.0, "right"), (0.7, "right"), (-0.7, "left"), (0.2, "right")),
    "crane-rise": ((0.0, "length"), (0.0, "length"), (0.1, "length"), (0.0, "length")),
    "pull-back": ((0.0, "length"),) * 4,
}
#: Each kind's anchors upwards, as shares of its length; crane-rise goes by its own height.
UPWARDS = {"push-in": (0.0, 0.02, 0.04, 0.03), "arc-sweep": (0.0, 0.03, 0.05, 0.04), "crane-rise": (0.0, 0.5, 1.0, 0.8), "pull-back": (0.0, 0.04, 0.08, 0.12)}
#: Where the kinds that hold their aim look, as a share of the free way ahead; a rise's shares of ceiling and way.
AIM, RISE_OF_CEILING, RISE_OF_WAY = 0.9, 0.55, 0.35
SHRINK, TRIES = 0.85, 6


def oriented(frames: DataFrame, path: list[str], order: str, forward: Vector, upright: float = 5e-2) -> DataFrame:
    """frames with right, up and ahead, arrays of three: the axes of a camera that looks along `forward`, +Y being up.

    A frame whose forward has no length looks as the one before it. Where it looks almost straight up or down, so that the
    world's up says nothing of its roll, the right axis of the frame before is carried on, less what lies along the new
    view. Before the first frame stand the axes of the world. Only runs of such frames are folded, each after the last
    frame that needs nothing from before."""
    line = Window.partitionBy(*path).orderBy(order)
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    long = F.sqrt(dot(forward, forward))
    own = F.when(long > 1e-8, F.array(*[c / long for c in forward]))
    f = frames.withColumn("_z", F.coalesce(F.last(own, ignorenulls=True).over(so_far), F.array(*map(F.lit, (0.0, 0.0, 1.0)))))
    z = tuple(F.col("_z")[i] for i in range(3))
    side = cross((F.lit(0.0), F.lit(1.0), F.lit(0.0)), z)
    reach = F.sqrt(dot(side, side))
    f = f.withColumn("_x", F.when(reach > upright, F.array(*[c / reach for c in side])))
    f = f.withColumn("_run", F.count("_x").over(so_far)).withColumn("_i", F.row_number().over(line))
    runs = f.groupBy(*path, "_run").agg(F.array_sort(F.collect_list(F.struct("_i", "_x", "_z"))).alias("_r"))

    def carried_on(before: Column, z: Column) -> Column:
        along = sum(before[i] * z[i] for i in range(3))
        flat = [before[i] - z[i] * along for i in range(3)]
        size = F.sqrt(sum(c * c for c in flat))
        return F.when(size > 1e-8, F.array(*[c / size for c in flat])).otherwise(before)

    def step(acc: Column, e: Column) -> Column:
        x = F.coalesce(e["_x"], carried_on(acc["x"], e["_z"]))
        return F.struct(x.alias("x"), F.concat(acc["out"], F.array(F.struct(e["_i"].alias("i"), x.alias("x")))).alias("out"))

    start = F.struct(F.array(*map(F.lit, (1.0, 0.0, 0.0))).alias("x"), F.array().cast("array<struct<i:int,x:array<double>>>").alias("out"))
    folded = runs.select(*[F.col(p).alias(f"_p{k}") for k, p in enumerate(path)], F.explode(F.aggregate("_r", start, step)["out"]).alias("_o"))
    same = F.col("_i") == F.col("_o.i")
    for k, p in enumerate(path):
        same = same & F.col(p).eqNullSafe(F.col(f"_p{k}"))
    met = f.join(folded, same)
    x = tuple(F.col("_o.x")[i] for i in range(3))
    return met.select(*frames.columns, F.col("_o.x").alias("right"), F.array(*cross(z, x)).alias("up"), F.col("_z").alias("ahead"))


def open_directions(points: DataFrame, sectors: int = 32) -> tuple[DataFrame, DataFrame]:
    """(sector, clearance, corridor) of a cloud (x, y up, z), and one row (floor, ceiling, margin). Only the middle half of the
    heights counts, unless it has fewer than 100 points."""
    band = robust_band(points, "y")
    middle = points.crossJoin(F.broadcast(band)).filter(F.col("y").between(F.col("floor") + 0.25 * (F.col("ceiling") - F.col("floor")), F.col("ceiling") - 0.25 * (F.col("ceiling") - F.col("floor")))).select("x", "y", "z")
    near = middle if middle.count() >= 100 else points
    middling = percentiles(points, F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2), [0.5])[0]
    scene = band.withColumn("margin", 0.07 * F.lit(middling).cast("double"))
    turned = near.select((-F.col("z")).alias("z"), (-F.col("x")).alias("x"))  # sector 0 begins behind, as azimuths begin at -180 degrees
    ranges = sector_ranges(turned, "z", "x", sectors)
    return circular_minimum(ranges, "sector", "clearance", sectors, "corridor"), scene


def _picked(points: DataFrame, sectors: int) -> tuple[DataFrame, DataFrame]:
    """The scored sectors, and one row of the scene with `picked`, azimuths from the most open one on, at least 70 degrees apart,
    and `clear`, each sector's clearance."""
    if points.count() < 50:
        raise ValueError("a scene needs 50 points or more")
    table, scene = open_directions(points, sectors)
    centre = (F.col("sector") + 0.5) * (360.0 / sectors) - 180.0
    scored = table.withColumn("azimuth", centre).withColumn("score", F.col("corridor") * (1 + 0.15 * F.cos(F.radians("azimuth"))))
    best = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "azimuth"))), lambda x: x["azimuth"])
    order = scored.agg(best.alias("a"), F.map_from_entries(F.collect_list(F.struct("sector", "clearance"))).alias("clear"))  # a row per sector
    return scored, order.select(separated(F.col("a"), 70.0).alias("picked"), "clear").crossJoin(scene)


def suggested_directions(points: DataFrame, count: int = 4, sectors: int = 32) -> DataFrame:
    """(rank, sector, azimuth, reach): up to `count` (8 at most) free directions, the most open first. Needs 50 points."""
    scored, order = _picked(points, sectors)
    picked = order.select(F.posexplode(F.slice("picked", 1, max(1, min(8, count)))).alias("rank", "azimuth"))
    return picked.join(scored.select("azimuth", "sector", F.col("corridor").alias("reach")), "azimuth").select("rank", "sector", "azimuth", "reach")


def planned_paths(points: DataFrame, count: int = 4, sectors: int = 32) -> DataFrame:
    """(path, label, orientation, i, x, y, z, tx, ty, tz): up to 8 paths of four anchors from the origin, the first in the most
    open direction. Anchors stay within the room's heights; a path is shrunk, up to six times, until its spline keeps its
    distance from all points. Needs 50 points."""
    count = max(1, min(8, count))
    _, order = _picked(points, sectors)
    paths = order.withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    paths = paths.withColumn("az", F.get("picked", F.floor(F.col("path") / 4) % F.size("picked")))
    way = lambda d: F.element_at("clear", F.pmod(F.floor((F.col("az") + d + 180.0) / (360.0 / sectors)), F.lit(sectors)).cast("int"))
    paths = paths.select("path", "az", "floor", "ceiling", "margin", way(0.0).alias("ahead"), way(90.0).alias("right"), way(-90.0).alias("left"), way(180.0).alias("behind"))
    rise = F.least(RISE_OF_CEILING * F.col("ceiling"), RISE_OF_WAY * F.col("ahead"))

    def kind(label: str, orientation: str, way: str, share: float) -> Column:
        length = F.col(way) * share
        width = {"sway": length * SWAY, "right": F.col("right") * HALF, "left": F.col("left") * HALF, "length": length}
        height = rise if label == "crane-rise" else length
        anchors = [
            F.struct(F.lit(i).alias("i"), (length * ALONG[label][i]).alias("f"), (width[ASIDE[label][i][1]] * ASIDE[label][i][0]).alias("s"), (height * UPWARDS[label][i]).alias("u"))
            for i in range(len(FRACTIONS))
        ]
        aim = AIM * F.col("ahead") if orientation == "per_point_look" else F.lit(None).cast("double")
        return F.struct(F.lit(label).alias("label"), F.lit(orientation).alias("orientation"), aim.alias("aim"), F.array(*anchors).alias("anchors"))

    paths = paths.withColumn("k", F.get(F.array(*[kind(*x) for x in LENGTHS]), F.col("path") % len(LENGTHS)))
    a = paths.select("path", "az", "floor", "ceiling", "margin", "k.label", "k.orientation", "k.aim", F.inline("k.anchors"))
    sin, cos, h = F.sin(F.radians("az")), F.cos(F.radians("az")), F.col("ceiling") - F.col("floor")
    a = a.withColumn("x", F.col("f") * sin + F.col("s") * cos).withColumn("z", F.col("f") * cos - F.col("s") * sin)
    a = a.withColumn("y", F.greatest(F.col("floor") + 0.15 * h, F.least(F.col("u"), F.col("ceiling") - 0.2 * h)))
    tries = a.withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(TRIES)))).withColumn("_by", F.when(F.col("i") == 0, 1.0).otherwise(F.pow(F.lit(SHRINK), F.col("try"))))
    for c in "xyz":
        tries = tries.withColumn(c, F.col(c) * F.col("_by"))
    curve = spline_samples(tries, ["path", "try"], "i", ["x", "y", "z"], 48).select("path", "try", *[F.col(c).alias(f"c{c}") for c in "xyz"])
    gap = F.sqrt(F.min(sum((F.col(c) - F.col(f"c{c}")) ** 2 for c in "xyz")))
    clear = points.crossJoin(F.broadcast(curve)).groupBy("path", "try").agg(gap.alias("gap"))  # at most 8 * 7 * 48 rows are broadcast
    wide = a.select("path", "margin").distinct()
    chosen = clear.join(wide, "path").groupBy("path").agg(F.coalesce(F.min(F.when(F.col("gap") >= F.col("margin"), F.col("try"))), F.lit(TRIES)).alias("try"))
    out = tries.join(chosen, ["path", "try"])
    aim = lambda c: F.when(F.col("aim").isNotNull(), F.round(c, 3))
    return out.select("path", "label", "orientation", "i", *[F.round(c, 3).alias(c) for c in "xyz"], aim(F.col("aim") * sin).alias("tx"), aim(F.lit(0.0)).alias("ty"), aim(F.col("aim") * cos).alias("tz"))
