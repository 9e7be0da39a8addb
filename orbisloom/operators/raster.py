"""Row-per-fragment rasterization, depth contests, coverage and mask operators over pixel tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import kept_components  # noqa: F401  (a mask operator like those here)
from .ordered import held
from .selection import percentiles

EPS, NEAR_W = 1e-6, 1e-4


def _vertex(prefix: str) -> Column:
    return F.struct(*[F.col(f"{prefix}_{c}").alias(c) for c in "xyzw"], F.col(f"{prefix}_b0").alias("b0"), F.col(f"{prefix}_b1").alias("b1"), F.col(f"{prefix}_b2").alias("b2"))


def _cut(a: Column, b: Column) -> Column:
    """Where the edge from a (in front) to b meets the near plane."""
    t = (a["w"] - F.lit(NEAR_W)) / (a["w"] - b["w"])
    return F.struct(*[(a[c] + (b[c] - a[c]) * t).alias(c) for c in ("x", "y", "z", "w", "b0", "b1", "b2")])


def clipped(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(view, fid, part, a, b, c): each face's triangles in front of the near plane, 0 to 2 of them. Corners carry their
    barycentric weights in the face. part orders whole triangles before those with one corner inside, then with two."""
    v = faces.select("fid", "v0", "v1", "v2")
    for i in range(3):
        corner = vertices.select(F.col("vid").alias(f"v{i}"), *(["view"] if i == 0 else [F.col("view").alias(f"_view{i}")]), *[F.col(c).cast("double").alias(f"p{i}_{c}") for c in "xyzw"])
        v = v.join(corner, f"v{i}") if i == 0 else v.join(corner, (v[f"v{i}"] == corner[f"v{i}"]) & (v["view"] == corner[f"_view{i}"])).drop(corner[f"v{i}"], f"_view{i}")
        for j in range(3):
            v = v.withColumn(f"p{i}_b{j}", F.lit(1.0 if i == j else 0.0))
    v = v.select("view", "fid", *[_vertex(f"p{i}").alias(f"p{i}") for i in range(3)])
    p = [F.col("p0"), F.col("p1"), F.col("p2")]
    inside = [x["w"] > NEAR_W for x in p]
    tri = lambda part, a, b, c: F.struct(F.lit(part).alias("part"), a.alias("a"), b.alias("b"), c.alias("c"))
    out = F.when(inside[0] & inside[1] & inside[2], F.array(tri(0, *p)))
    for i in range(3):
        j, k = (i + 1) % 3, (i + 2) % 3
        out = out.when(inside[i] & ~inside[j] & ~inside[k], F.array(tri(1, p[i], _cut(p[i], p[j]), _cut(p[i], p[k]))))
        out = out.when(inside[i] & inside[j] & ~inside[k], F.array(tri(2, p[i], p[j], _cut(p[j], p[k])), tri(3, p[i], _cut(p[j], p[k]), _cut(p[i], p[k]))))
    return v.select("view", "fid", F.explode(out).alias("_t")).select("view", "fid", "_t.*")


def rasterize(faces: DataFrame, vertices: DataFrame, width: int, height: int) -> DataFrame:
    """(view, y, x, u, v, z, tri_id): the nearest triangle at every covered pixel, tri_id counting from 1.

    Corners are clip coordinates. A triangle's fragments are the pixels of its box, so filters on faces come first; the
    contest for a pixel is one maximum of structs, which combines before the shuffle: the largest 1/w, on ties the
    earliest clip part and the lowest face. Faces whose corners have one w tie exactly, whatever their shapes."""
    t = clipped(faces, vertices)
    for n in "abc":
        t = t.withColumn(f"_{n}x", (F.col(n)["x"] / F.col(n)["w"] * 0.5 + 0.5) * width - 0.5).withColumn(f"_{n}y", (F.col(n)["y"] / F.col(n)["w"] * 0.5 + 0.5) * height - 0.5)
    low = lambda c, most: F.greatest(F.ceil(F.least(f"_a{c}", f"_b{c}", f"_c{c}") - EPS), F.lit(0)).cast("int")
    high = lambda c, most: F.least(F.floor(F.greatest(f"_a{c}", f"_b{c}", f"_c{c}") + EPS), F.lit(most - 1)).cast("int")
    t = t.withColumn("_x0", low("x", width)).withColumn("_x1", high("x", width)).withColumn("_y0", low("y", height)).withColumn("_y1", high("y", height)).filter("_x0 <= _x1 and _y0 <= _y1")
    t = t.withColumn("y", F.explode(F.sequence("_y0", "_y1"))).withColumn("x", F.explode(F.sequence("_x0", "_x1")))
    edge = lambda p, q: (F.col(f"_{q}x") - F.col(f"_{p}x")) * (F.col("y") - F.col(f"_{p}y")) - (F.col(f"_{q}y") - F.col(f"_{p}y")) * (F.col("x") - F.col(f"_{p}x"))
    area = (F.col("_bx") - F.col("_ax")) * (F.col("_cy") - F.col("_ay")) - (F.col("_by") - F.col("_ay")) * (F.col("_cx") - F.col("_ax"))
    t = t.withColumn("_area", area).filter(F.abs("_area") > 1e-12)
    t = t.withColumn("_la", edge("b", "c") / F.col("_area")).withColumn("_lb", edge("c", "a") / F.col("_area")).withColumn("_lc", edge("a", "b") / F.col("_area"))
    t = t.filter((F.col("_la") >= -EPS) & (F.col("_lb") >= -EPS) & (F.col("_lc") >= -EPS))
    one = {n: 1 / F.col(n)["w"] for n in "abc"}
    t = t.withColumn("_inv", one["a"] + F.col("_lb") * (one["b"] - one["a"]) + F.col("_lc") * (one["c"] - one["a"]))  # exact where all corners are equally deep
    bary = lambda b: sum(F.col(f"_l{n}") / F.col(n)["w"] * F.col(n)[b] for n in "abc") / F.col("_inv")
    depth = sum(F.col(f"_l{n}") * F.col(n)["z"] / F.col(n)["w"] for n in "abc")
    best = F.max(F.struct(F.col("_inv").alias("inv"), (-F.col("part")).alias("part"), (-F.col("fid")).alias("fid"), bary("b0").alias("u"), bary("b1").alias("v"), depth.alias("z")))
    return t.groupBy("view", "y", "x").agg(best.alias("_w")).select("view", "y", "x", F.col("_w.u").alias("u"), F.col("_w.v").alias("v"), F.col("_w.z").alias("z"), (1 - F.col("_w.fid")).alias("tri_id"))


def interpolate(fragments: DataFrame, faces: DataFrame, attributes: DataFrame, columns: list[str]) -> DataFrame:
    """Fragments with the attributes of their face's corners, weighted by u, v and 1 - u - v."""
    f = fragments.join(faces.select((F.col("fid") + 1).alias("tri_id"), "v0", "v1", "v2"), "tri_id")
    for i in range(3):
        f = f.join(attributes.select(F.col("vid").alias(f"v{i}"), *[F.col(c).alias(f"_{c}{i}") for c in columns]), f"v{i}")
    w = (F.col("u"), F.col("v"), 1 - F.col("u") - F.col("v"))
    return f.select(*fragments.columns, *[sum(w[i] * F.col(f"_{c}{i}") for i in range(3)).alias(c) for c in columns])


def layered(first: DataFrame, second: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The second layer only where the first has no pixel."""
    return first.select(*keys, *columns).unionByName(second.select(*keys, *columns).join(first.select(*keys), keys, "left_anti"))


def z_buffer(points: DataFrame, x: Column, y: Column, depth: Column, order: Column, keep: list[str]) -> DataFrame:
    """(px, py, keep...): the point of the greatest depth, then order, in every pixel of rounded coordinates."""
    binned = points.select(F.rint(x).cast("int").alias("px"), F.rint(y).cast("int").alias("py"), F.struct(depth.alias("d"), order.alias("o"), *[F.col(k) for k in keep]).alias("_s"))
    return binned.groupBy("px", "py").agg(F.max("_s").alias("_s")).select("px", "py", *[F.col(f"_s.{k}").alias(k) for k in keep])


def cut_spans(faces: DataFrame, vertices: DataFrame, disparity: str, percentile: float = 0.985) -> DataFrame:
    """Faces whose disparity range is at most the given percentile of all faces' ranges."""
    f = faces
    for i in range(3):
        f = f.join(vertices.select(F.col("vid").alias(f"v{i}"), F.col(disparity).alias(f"_d{i}")), f"v{i}")
    f = held(f.withColumn("_span", F.greatest("_d0", "_d1", "_d2") - F.least("_d0", "_d1", "_d2")))  # each pass for the percentile reads it
    return f.filter(F.col("_span") <= F.lit(percentiles(f, "_span", [percentile])[0])).select(*faces.columns)


def ray_grid(df: DataFrame, n: int, width: str, height: str) -> DataFrame:
    """Adds the n * n pixel centres (px, py) of an even grid over each row's image."""
    at = lambda name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    g = df.select("*", at("_gx")).select("*", at("_gy"))
    return g.withColumn("px", (F.col("_gx") + 0.5) / n * F.col(width)).withColumn("py", (F.col("_gy") + 0.5) / n * F.col(height)).drop("_gx", "_gy")


def inside_view(x: Column, y: Column, z: Column, fx: Column, fy: Column, cx: Column, cy: Column, width: Column, height: Column, margin: float) -> Column:
    """Whether a point before the camera projects into the image less a margin, edges included."""
    u, v = F.try_divide(fx * x, z) + cx, F.try_divide(fy * y, z) + cy
    return F.coalesce((z > 0) & u.between(margin, width - margin) & v.between(margin, height - margin), F.lit(False))


def coverage(hits: DataFrame, key: str, ray: list[str], hit: Column) -> DataFrame:
    """(key, coverage): the share of a key's rays that hit any view."""
    return hits.groupBy(key, *ray).agg(F.bool_or(hit).alias("_h")).groupBy(key).agg(F.avg(F.col("_h").cast("double")).alias("coverage"))


def neighbours(pixels: DataFrame, frame: str, value: str, radius: int, height: int, width: int, wrap: bool, how) -> DataFrame:
    """A square window's aggregate, as two one-dimensional passes: every value goes to the rows, then columns, within radius.
    With wrap the borders meet; without, what lies outside doesn't count."""
    out = pixels.select(frame, "y", "x", F.col(value).alias(value))
    for axis, size in (("x", width), ("y", height)):
        moved = F.explode(F.sequence(F.col(axis) - radius, F.col(axis) + radius))
        out = out.select(frame, *[c for c in ("y", "x") if c != axis], moved.alias(axis), value)
        out = out.withColumn(axis, F.pmod(F.col(axis), F.lit(size)).cast("int")) if wrap else out.filter(F.col(axis).between(0, size - 1))
        out = out.groupBy(frame, "y", "x").agg(how(value).alias(value))
    return out


def dilate(pixels: DataFrame, frame: str, value: str, radius: int, height: int, width: int, wrap: bool = True) -> DataFrame:
    return neighbours(pixels, frame, value, radius, height, width, wrap, F.max)


def erode(pixels: DataFrame, frame: str, value: str, radius: int, height: int, width: int) -> DataFrame:
    return neighbours(pixels, frame, value, radius, height, width, False, F.min)


def weighted_mix(holes: Column, region: Column, weight: float) -> Column:
    return F.greatest(F.coalesce(holes, F.lit(0.0)), F.coalesce(region, F.lit(0.0)) * weight)


def semantic_region(semantic: DataFrame, holes: DataFrame, frame: str, value: str, threshold: float, grow: int, height: int, width: int) -> DataFrame:
    """(frame, y, x, value): 1 where the semantic mask is at least `threshold`, grown by `grow` pixels, else 0, for the frames of
    the holes. A mask of one frame stands for all of them; one of other frames, or of another size, raises ValueError."""
    shape = lambda d: d.agg(F.count_distinct(frame), F.max("y"), F.max("x"), F.count(F.lit(1))).first()
    mine, theirs = shape(semantic), shape(holes)
    if tuple(mine[1:3]) != tuple(theirs[1:3]) or mine[3] * theirs[0] != theirs[3] * mine[0] or mine[0] not in (1, theirs[0]):
        raise ValueError(f"the semantic mask is {tuple(mine)}, the holes are {tuple(theirs)} (frames, last y, last x, pixels)")
    hard = semantic.select(frame, "y", "x", (F.col(value) >= threshold).cast("double").alias(value))
    if mine[0] == 1 and theirs[0] > 1:
        frames = holes.select(frame).distinct()
        hard = hard.drop(frame).crossJoin(F.broadcast(frames)) if frames.count() <= 10_000 else holes.select(frame, "y", "x").join(hard.drop(frame), ["y", "x"])
    elif not hard.select(frame).distinct().join(holes.select(frame), frame, "left_anti").isEmpty():
        raise ValueError("the semantic mask has frames that the holes don't have")
    return dilate(hard, frame, value, grow, height, width) if grow > 0 else hard.select(frame, "y", "x", value)


def mixed_masks(holes: DataFrame, region: DataFrame, frame: str, value: str, weight: float, hole_grow: int, height: int, width: int) -> DataFrame:
    """(frame, y, x, mask, union): the holes, grown, and the region at a weight, whichever is more; and the union of the holes as
    they are and the region, for what may be taken from a fill whole."""
    grown = dilate(holes, frame, value, hole_grow, height, width) if hole_grow > 0 else holes
    named = lambda d, n: d.select(frame, "y", "x", F.col(value).alias(n))
    met = named(grown, "_g").join(named(holes, "_h"), [frame, "y", "x"], "left").join(named(region, "_r"), [frame, "y", "x"], "left")
    return met.select(frame, "y", "x", weighted_mix(F.col("_g"), F.col("_r"), weight).alias("mask"), weighted_mix(F.col("_h"), F.col("_r"), 1.0).alias("union"))


def covered_masks(sizes: DataFrame, old: DataFrame, covered: DataFrame, view: str) -> DataFrame:
    """(view, y, x, mask, filler): every view of `sizes` (view, height, width) with a mask: covered pixels (view, y, x) are black,
    others as in the old mask (view, y, x, mask), where the view has one, else white. A view with neither has a white filler,
    as masks come for all views or for none."""
    at = [view, "y", "x"]
    row = F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y")
    whole = sizes.filter("height > 0 and width > 0").select(view, "width", row).select(view, "y", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    has = old.select(view).distinct().withColumn("_old", F.lit(True))
    hit = covered.select(view).distinct().withColumn("_hit", F.lit(True))
    black = covered.select(*at).distinct().withColumn("_black", F.lit(True))
    p = whole.join(has, view, "left").join(hit, view, "left").join(old.select(*at, F.col("mask").alias("_m")), at, "left").join(black, at, "left")
    mask = F.when(F.col("_black"), 0).otherwise(F.coalesce("_m", F.lit(255)))
    return p.select(*at, mask.cast("int").alias("mask"), (F.col("_old").isNull() & F.col("_hit").isNull()).alias("filler"))


def composite(gate: Column, source: Column, fill: Column) -> Column:
    return gate * source + (1 - gate) * fill


def sharpness(pixels: DataFrame, frame: str, value: str) -> DataFrame:
    """(frame, sharpness): the population variance of the five-point Laplacian over inner pixels; no inner pixel gives 0.
    Each pixel sends its value to its neighbours, so there is one aggregation and no self-join."""
    part = lambda dy, dx, w: F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), (F.col(value) * w).alias("s"), F.lit(1).alias("n"))
    sent = pixels.select(frame, F.explode(F.array(part(0, 0, -4.0), part(1, 0, 1.0), part(-1, 0, 1.0), part(0, 1, 1.0), part(0, -1, 1.0))).alias("_p")).select(frame, "_p.*")
    sums = sent.groupBy(frame, "y", "x").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    found = sums.filter("n = 5").groupBy(frame).agg(F.var_pop("s").alias("sharpness"))
    return pixels.select(frame).distinct().join(found, frame, "left").select(frame, F.coalesce("sharpness", F.lit(0.0)).alias("sharpness"))


def seam_repaired(pixels: DataFrame, centre: int, channels: list[str], black: float = 8.0) -> DataFrame:
    """Pixels of the centre column whose channels are all at most `black` get the mean of the pixels left and right of it."""
    donors = pixels.filter(F.col("x").isin(centre - 1, centre + 1)).groupBy("frame", "y").agg(*[F.avg(c).alias(f"_{c}") for c in channels])
    out = pixels.join(donors, ["frame", "y"], "left")
    dark = (F.col("x") == centre) & (F.greatest(*channels) <= black if len(channels) > 1 else F.col(channels[0]) <= black)
    for c in channels:
        out = out.withColumn(c, F.when(dark & F.col(f"_{c}").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)))
    return out.drop(*[f"_{c}" for c in channels])


def push_pull(pixels: DataFrame, height: int, width: int, value: str) -> DataFrame:
    """Fills null values from ever coarser means of the valid ones: each level halves the grid, and a pixel takes the finest
    level that has a value there."""
    level, levels, h, w = pixels.select("frame", "y", "x", F.col(value).alias("v")), 0, height, width
    out = pixels.withColumn("_v", F.col(value))
    while h > 1 or w > 1:
        level = level.groupBy("frame", F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x")).agg(F.avg("v").alias("v"))
        levels, h, w = levels + 1, -(-h // 2), -(-w // 2)
        side = level.select(F.col("frame").alias("_f"), F.col("y").alias("_y"), F.col("x").alias("_x"), F.col("v").alias("_c"))
        out = out.join(side, (out["frame"] == side["_f"]) & (F.shiftright(out["y"], levels) == side["_y"]) & (F.shiftright(out["x"], levels) == side["_x"]), "left").withColumn("_v", F.coalesce("_v", "_c")).drop("_f", "_y", "_x", "_c")
    return out.withColumn(value, F.col("_v")).drop("_v")


def grid_faces(height: int, width: int, spark) -> DataFrame:
    """(fid, v0, v1, v2): two triangles for every cell of a grid whose columns meet at the seam."""
    cells = spark.range(height - 1).select(F.col("id").cast("int").alias("y")).crossJoin(spark.range(width).select(F.col("id").cast("int").alias("x")))
    at = lambda dy, dx: (F.col("y") + dy) * width + (F.col("x") + dx) % width
    two = F.array(F.struct(F.lit(0).alias("k"), at(0, 0).alias("v0"), at(1, 0).alias("v1"), at(0, 1).alias("v2")), F.struct(F.lit(1).alias("k"), at(0, 1).alias("v0"), at(1, 0).alias("v1"), at(1, 1).alias("v2")))
    return cells.select("y", "x", F.explode(two).alias("_t")).select((2 * (F.col("y") * width + F.col("x")) + F.col("_t.k")).cast("int").alias("fid"), "_t.v0", "_t.v1", "_t.v2")


def ownership_masks(
    pixels: DataFrame, view: str, clean: Column, footprint: Column, best: Column, mask: str, ratio: float, shrink: int, most: float, height: int, width: int, every: int = 4,
) -> DataFrame:
    """(view, y, x, mask, owned, capped): masks with the pixels blacked out that another view owns at equal or better sampling.

    A clean pixel is owned where the best footprint on its surface is at most `ratio` of its own; owned regions shrink by
    `shrink` pixels, within the frame. A view of which more than `most` would then be masked (below 128) is capped: a lattice
    of every `every`-th pixel that was alive stays alive, so that no mask is all black."""
    p = pixels.select(view, "y", "x", F.col(mask).alias("_old"), F.coalesce(clean & (best <= footprint * ratio), F.lit(False)).cast("int").alias("_own"))
    if shrink > 0:
        p = p.drop("_own").join(erode(p, view, "_own", shrink, height, width), [view, "y", "x"])
    p = p.withColumn("_new", F.when(F.col("_own") == 1, F.lit(0)).otherwise(F.col("_old")))
    shares = p.groupBy(view).agg((1 - F.avg((F.col("_new") >= 128).cast("double"))).alias("_share"))
    p = p.join(shares.select(view, (F.col("_share") > most).alias("capped")), view)
    alive = F.col("capped") & (F.col("y") % every == 0) & (F.col("x") % every == 0) & (F.col("_old") >= 128)
    return p.select(view, "y", "x", F.when(alive, F.lit(255)).otherwise(F.col("_new")).cast("int").alias("mask"), (F.col("_own") == 1).alias("owned"), "capped")


def mask_report(masks: DataFrame, view: str) -> DataFrame:
    """(view, masked, capped): the share of each view's pixels that are masked."""
    return masks.groupBy(view).agg((1 - F.avg((F.col("mask") >= 128).cast("double"))).alias("masked"), F.bool_or("capped").alias("capped"))
