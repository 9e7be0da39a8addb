"""Parts of a composite frame: mip pyramids with level-of-detail sampling, tone-matched fills, frequency-split fusion and the
background regrown behind depth edges."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import lines
from .ordered import held

#: Weights of red, green and blue in brightness.
LUMA = (0.299, 0.587, 0.114)


def level_sizes(height: int, width: int, most: int, least_side: int = 64) -> list[tuple[int, int]]:
    """Sizes of a pyramid's levels: halved (an odd last line is dropped) while the shorter side is above least_side."""
    sizes = [(height, width)]
    while min(sizes[-1]) > least_side and len(sizes) < most:
        sizes.append((sizes[-1][0] // 2, sizes[-1][1] // 2))
    return sizes


def pyramid(pixels: DataFrame, keys: list[str], values: list[str], sizes: list[tuple[int, int]]) -> DataFrame:
    """(keys, level, y, x, values): level 0 is the grid itself, each further one the means of the 2 x 2 cells of the one before.

    A pixel adds up in its cell of every level, so one aggregation, which combines before the shuffle, makes all levels: a
    mean of equal-sized means is the mean of all. Pixels that a level before has dropped don't reach the next."""
    level = lambda k: F.struct(F.lit(k).alias("level"), F.shiftright(F.col("y"), k).alias("y"), F.shiftright(F.col("x"), k).alias("x"))
    inside = lambda k: (F.shiftright(F.col("y"), k) < sizes[k][0]) & (F.shiftright(F.col("x"), k) < sizes[k][1])
    cells = F.array_compact(F.array(*[F.when(inside(k), level(k)) for k in range(len(sizes))]))
    spread = pixels.select(*keys, *values, F.explode(cells).alias("_c")).select(*keys, *values, "_c.*")
    return spread.groupBy(*keys, "level", "y", "x").agg(*[F.avg(v).alias(v) for v in values])


def _slope(value: Column, lines_of: list[str], order: str, size: int) -> Column:
    """The gradient along a line: central inside, one-sided at its ends."""
    w = Window.partitionBy(*lines_of).orderBy(order)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    ends = F.coalesce(after - value, value - before, F.lit(0.0))
    return F.when(before.isNotNull() & after.isNotNull(), (after - before) / 2).otherwise(ends)


def with_detail_level(targets: DataFrame, keys: list[str], size: tuple[int, int], source: tuple[int, int], levels: int) -> DataFrame:
    """targets (keys, y, x, u, v) with `lod`: the base-2 logarithm of how many source pixels one target pixel spans, from 0 to
    the last level. Jumps of u by more than the target's width in source pixels are the seam and don't count."""
    su, sv = F.col("u") * source[1], F.col("v") * source[0]
    rows, columns = [*keys, "y"], [*keys, "x"]
    t = targets.withColumns({"_ux": _slope(su, rows, "x", size[1]), "_vx": _slope(sv, rows, "x", size[1])})
    t = t.withColumns({"_uy": _slope(su, columns, "y", size[0]), "_vy": _slope(sv, columns, "y", size[0])})
    seamless = lambda c: F.when(F.abs(c) > size[1], F.lit(0.0)).otherwise(F.col(c))
    span = F.greatest(F.sqrt(seamless("_ux") ** 2 + F.col("_vx") ** 2), F.sqrt(seamless("_uy") ** 2 + F.col("_vy") ** 2))
    lod = F.least(F.log2(F.greatest(span, F.lit(1.0))), F.lit(float(levels - 1)))
    return t.withColumn("lod", lod).drop("_ux", "_vx", "_uy", "_vy")


def minification_confidence(targets: DataFrame, keys: list[str], size: tuple[int, int], source: tuple[int, int], low: float, high: float, scale: float = 1.0) -> DataFrame:
    """targets (keys, y, x, u, v) with `confidence`: 1 where a target pixel spans at most `low` source pixels, 0 from `high` on,
    and linear between. The span is the greater of the steps of u along x and of v along y, times scale; steps of u of more
    than half the source are the seam and don't count. Differentiate a smoothed field: noise counts as steps."""
    across = F.abs(_slope(F.col("u") * source[1], [*keys, "y"], "x", size[1]))
    down = F.abs(_slope(F.col("v") * source[0], [*keys, "x"], "y", size[0]))
    t = targets.withColumns({"_gu": across, "_gv": down})
    span = F.greatest(F.when(F.col("_gu") > source[1] / 2, F.lit(0.0)).otherwise(F.col("_gu")), F.col("_gv")) * scale
    share = (high - span) / max(high - low, 1e-6)
    return t.withColumn("confidence", F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))).drop("_gu", "_gv")


def smoothed_field(targets: DataFrame, keys: list[str], sigma: float, size: tuple[int, int]) -> DataFrame:
    """(keys, y, x, u, v) of a look-up field after a Gaussian blur; u wraps, so it is blurred as a point of the unit circle."""
    turn = 2 * pi
    t = targets.select(*keys, "y", "x", F.cos(F.col("u") * turn).alias("_c"), F.sin(F.col("u") * turn).alias("_s"), "v")
    out = lines.gaussian(t, keys, ["_c", "_s", "v"], sigma, *size)
    return out.select(*keys, "y", "x", F.pmod(F.atan2("_s", "_c") / turn, F.lit(1.0)).alias("u"), "v")


def trilinear(targets: DataFrame, levels: DataFrame, keys: list[str], values: list[str], sizes: list[tuple[int, int]]) -> DataFrame:
    """targets (keys, y, x, u, v, lod, ...) with the values of a pyramid at u, v (0 and 1 are the centres of the outer pixels),
    blended bilinearly within the two levels next to lod and linearly between them. Borders are held."""
    size = lambda d: F.element_at(F.array(*[F.lit(s[d]) for s in sizes]), F.col("level") + 1)
    q = lines.quads(levels, [*keys, "level"], values, size(0) - 1, size(1) - 1)
    q = q.select(*keys, "level", F.col("y").alias("_qy"), F.col("x").alias("_qx"), "q")
    low = F.floor("lod").cast("int")
    two = F.array(F.struct(low.alias("level"), (1 - (F.col("lod") - low)).alias("w")), F.struct((low + 1).alias("level"), (F.col("lod") - low).alias("w")))
    asked = targets.select(*keys, "y", "x", "u", "v", F.explode(F.filter(two, lambda e: e["w"] > 0)).alias("_l")).select(*keys, "y", "x", "u", "v", "_l.*")
    held_in = lambda c, d: F.least(F.greatest(F.col(c) * (size(d) - 1), F.lit(0.0)), (size(d) - 1).cast("double"))
    asked = asked.withColumns({"_fy": held_in("v", 0), "_fx": held_in("u", 1)})
    asked = asked.withColumns({"_qy": F.floor("_fy").cast("int"), "_qx": F.floor("_fx").cast("int")})
    met = asked.join(q, [*keys, "level", "_qy", "_qx"])
    fy, fx = F.col("_fy") - F.col("_qy"), F.col("_fx") - F.col("_qx")
    parts = met.groupBy(*keys, "y", "x").agg(*[F.sum(F.col("w") * lines.blended(F.col("q"), v, fy, fx)).alias(v) for v in values])
    return targets.join(parts, [*keys, "y", "x"], "left")


def tone_matched(
    frames: DataFrame, keys: list[str], source: list[str], fill: list[str] | None, gate: str, size: tuple[int, int],
    work_width: int, sigma: float, clamp: float, mode: str = "luma", floor: float = 1e-3,
) -> DataFrame:
    """frames (keys, y, x, source, fill and gate columns) with a column <source>_fill each: what goes into the holes of the gate.

    The gain from fill to source is measured where the gate is open, on a grid of work_width, as a normalised convolution:
    blurred weight times value over blurred weight. Where no open pixel is in reach of the blur, `trust` fades it into the
    gain of the whole frame. Both are clamped to 1 / clamp .. clamp. Mode luma has one gain of the brightness for all columns,
    rgb one each, off none. Without fill the source itself is spread into the holes."""
    names = [f"{s}_fill" for s in source]
    if fill and mode == "off":
        return frames.withColumns({n: F.col(f).cast("double") for n, f in zip(names, fill)})
    wide = min(work_width or size[1], size[1])
    high = max(2, round(size[0] * wide / size[1]))
    spread = max(1.0, sigma * wide / size[1])
    bright = lambda cs: sum(F.col(c) * w for c, w in zip(cs, LUMA))
    luma = fill is not None and mode == "luma"
    if luma and len(source) != len(LUMA):
        raise ValueError("brightness needs three columns")
    s = {"_s0": bright(source)} if luma else {f"_s{i}": F.col(c) for i, c in enumerate(source)}
    f = {} if not fill else {"_f0": bright(fill)} if luma else {f"_f{i}": F.col(c) for i, c in enumerate(fill)}
    gated = frames.select(*keys, "y", "x", F.least(F.greatest(F.col(gate).cast("double"), F.lit(0.0)), F.lit(1.0)).alias("_m"), *[e.alias(n) for n, e in (s | f).items()])
    values = [*s, *f]
    small = lines.area_reduced(gated, keys, ["_m", *values], *size, high, wide)
    small = small.select(*keys, "y", "x", "_m", *[(F.col(v) * F.col("_m")).alias(v) for v in values])
    whole = small.groupBy(*keys).agg(F.greatest(F.sum("_m"), F.lit(1e-6)).alias("_area"), *[F.sum(v).alias(f"_all{v}") for v in values])
    near = lines.gaussian(small, keys, ["_m", *values], spread, high, wide).join(whole, keys)
    trust = F.col("_m") / (F.col("_m") + floor)
    local = lambda v: F.col(v) / (F.col("_m") + 1e-3)
    common = lambda v: F.col(f"_all{v}") / F.col("_area")
    within = lambda c: F.least(F.greatest(c, F.lit(1.0 / clamp)), F.lit(clamp))
    out = {}
    for i in range(len(s)):
        if fill:
            here, everywhere = local(f"_s{i}") / (local(f"_f{i}") + 1e-3), common(f"_s{i}") / (common(f"_f{i}") + 1e-3)
            out[f"_g{i}"] = trust * within(here) + (1 - trust) * within(everywhere)
        else:
            out[f"_g{i}"] = trust * local(f"_s{i}") + (1 - trust) * common(f"_s{i}")
    gains = near.select(*keys, "y", "x", *[e.alias(n) for n, e in out.items()])
    met = lines.enlarged(gains, frames, keys, list(out), (high, wide), size)
    gain = lambda i: F.col(f"_g{0 if luma else i}")
    return met.withColumns({n: F.col(fill[i]) * gain(i) if fill else gain(i) for i, n in enumerate(names)}).drop(*out)


def bands(frames: DataFrame, keys: list[str], values: list[str], sigma: float, size: tuple[int, int]) -> DataFrame:
    """frames with <value>_low and <value>_detail each: a Gaussian blur and what it leaves. The two add up to the value."""
    low = lines.gaussian(frames, keys, values, sigma, *size).withColumnsRenamed({v: f"{v}_low" for v in values})
    met = frames.join(low, [*keys, "y", "x"])
    return met.withColumns({f"{v}_detail": F.col(v) - F.col(f"{v}_low") for v in values})


def fused(
    frames: DataFrame, keys: list[str], source: list[str], fill: list[str], size: tuple[int, int], low_sigma: float, detail_gain: float = 1.5,
    energy_window: int = 15, edge_window: int = 9, edge_low: float = 0.1, edge_high: float = 0.5, edge_energy: float = 4.0,
) -> DataFrame:
    """frames with <source>_fused each: the low band of the fill, with the detail of the source where the fill bears it out and
    the fill's own detail elsewhere.

    The share s of the source's detail falls where it is stronger than detail_gain times the fill's detail around, and where
    both have edges (Laplacians of energy) that don't correlate over edge_window. So the result is never less than the fill."""
    f = bands(frames, keys, [*source, *fill], low_sigma, size)
    mean = lambda cs: sum(cs) / len(cs)
    a, b = ([F.col(f"{c}_detail") for c in cs] for cs in (source, fill))
    f = held(f)
    m = f.select(*keys, "y", "x", mean(a).alias("_a"), mean(b).alias("_b"), mean([F.abs(c) for c in a]).alias("_ea"), mean([F.abs(c) for c in b]).alias("_eb"))
    energy = lines.box_mean(m, keys, ["_ea", "_eb"], energy_window, *size)
    edges = lines.laplacians(m, keys, ["_a", "_b"], *size).select(*keys, "y", "x", F.col("_a_lap").alias("_a"), F.col("_b_lap").alias("_b"))
    edges = edges.withColumns({"_aa": F.col("_a") ** 2, "_bb": F.col("_b") ** 2, "_ab": F.col("_a") * F.col("_b")})
    edges = lines.box_mean(edges, keys, ["_a", "_b", "_aa", "_bb", "_ab"], edge_window, *size)
    va, vb = F.col("_aa") - F.col("_a") ** 2, F.col("_bb") - F.col("_b") ** 2
    z = (F.col("_ab") - F.col("_a") * F.col("_b")) / F.sqrt(F.greatest(va * vb, F.lit(1e-8)))
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    agree = unit((z - edge_low) / max(edge_high - edge_low, 1e-3))
    strong = unit((F.sqrt(F.greatest(va, F.lit(0.0))) + F.sqrt(F.greatest(vb, F.lit(0.0)))) / edge_energy)
    scale = F.least(F.lit(1.0), detail_gain * F.col("_eb") / (F.col("_ea") + 1e-3))
    share = edges.join(energy, [*keys, "y", "x"]).select(*keys, "y", "x", (scale * ((1 - strong) + strong * agree)).alias("_s"))
    met = f.join(share, [*keys, "y", "x"])
    out = {
        f"{s}_fused": F.col(f"{w}_low") + F.col(f"{s}_detail") * F.col("_s") + F.col(f"{w}_detail") * (1 - F.col("_s")) for s, w in zip(source, fill)
    }
    return met.withColumns(out).select(*frames.columns, *out)


def regrown(
    pixels: DataFrame, keys: list[str], depth: str, carried: list[str], tolerance: float, extend: int, size: tuple[int, int], rounds: int | None = None,
) -> DataFrame:
    """pixels with `grown` (whether it was replaced), and with the depth and the carried columns of the background where a pixel
    is the near side of a depth edge: more than `tolerance` of its depth nearer than the farthest pixel within `extend`.

    The near pixels are cleared and filled again from their eight neighbours, the farthest first (of equal ones the lowest
    and rightmost), round after round; both axes wrap. Rounds go on until nothing changes or, with `rounds`, so many times.
    What no round reaches stays as it was. A pixel that is filled in a round had no filled neighbour before, so only the
    pixels of the last round can fill the next: they alone are sent out, and only they and those of the round before are
    looked at for what is filled already. Depths of 0 and below fill nothing."""
    at = [*keys, "y", "x"]
    names = [depth, *carried]
    from .raster import neighbours

    height, width = size
    single = keys if len(keys) == 1 else ["_frame"]
    keyed = pixels if len(keys) == 1 else pixels.withColumn("_frame", F.struct(*keys))
    far = neighbours(keyed, single[0], depth, extend, height, width, False, F.max).withColumnRenamed(depth, "_far")
    near = (F.col("_far") - F.col(depth)) / F.greatest(F.col(depth), F.lit(1e-6)) > tolerance
    marked = keyed.join(far, [single[0], "y", "x"]).withColumn("_near", F.coalesce(near, F.lit(False))).drop("_far")
    if single != keys:
        marked = marked.drop("_frame")
    marked = held(marked)
    unknown = marked.filter("_near").select(*at).repartition(*at).persist()

    def around(dy: int, dx: int) -> Column:
        y, x = F.pmod(F.col("y") + dy, F.lit(height)), F.pmod(F.col("x") + dx, F.lit(width))
        return F.struct(y.cast("int").alias("y"), x.cast("int").alias("x"), F.lit(-3 * dy - dx).alias("o"))

    eight = F.explode(F.array(*[around(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx])).alias("_c")
    rim = unknown.select(*keys, eight).select(*keys, "_c.y", "_c.x").distinct()
    last, before, filled, done = marked.filter("not _near").select(*at, *names).join(rim, at, "left_semi"), None, [], 0
    try:
        while rounds is None or done < rounds:
            sent = last.filter(F.col(depth) > 0).select(*keys, eight, *names)
            offer = F.struct(F.col(depth).alias("_d"), F.col("_c.o").alias("_o"), *carried)
            best = sent.select(*keys, "_c.y", "_c.x", offer.alias("_b")).groupBy(*at).agg(F.max("_b").alias("_b"))
            for known in (last, before) if filled else ():
                best = best if known is None else best.join(known.select(*at), at, "left_anti")
            new = held(best.join(unknown, at).select(*at, F.col("_b._d").alias(depth), *[F.col(f"_b.{c}").alias(c) for c in carried]))
            done += 1
            if new.isEmpty():
                break
            last, before = new, last if filled else None
            filled.append(new)
    finally:
        unknown.unpersist()
    if not filled:
        return marked.select(*pixels.columns, F.lit(False).alias("grown"))
    all_filled = filled[0]
    for f in filled[1:]:
        all_filled = all_filled.unionByName(f)
    put = all_filled.select(*at, *[F.col(c).alias(f"_new_{i}") for i, c in enumerate(names)], F.lit(True).alias("grown"))
    out = marked.join(put, at, "left").withColumn("grown", F.coalesce("grown", F.lit(False)))
    out = out.withColumns({c: F.when(F.col("grown"), F.col(f"_new_{i}")).otherwise(F.col(c)) for i, c in enumerate(names)})
    return out.select(*pixels.columns, "grown")
