"""Registered queries of the image, solver, name and plan operators, over the pixel grid of line items and the other tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import camera
from ..operators import composite as cps
from ..operators import images as im
from ..operators import lines, names
from ..operators import raster as ras
from ..operators import relational as rel
from . import datasets
from .catalogue import query
from .composite_catalogue import _GRID, _SLOPE, HEIGHT, SIZE, WIDTH, _filter_sql, _grid

#: The window of three by three pixels around each, cut off at the borders.
_NEAR = "g a JOIN g b ON b.frame = a.frame AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1"


@query(f"WITH {_GRID}, {_filter_sql('bl', 'g', ['r'], lines.gaussian_kernel(0.7), HEIGHT, WIDTH)} SELECT frame, y, x, round(r, 5) AS r FROM bl")
def blurred_grid(t):
    return im.blurred(_grid(t), "frame", "r", 0.7, *SIZE).select("frame", "y", "x", F.round("r", 5).alias("r"))


@query(f"WITH {_GRID} SELECT a.frame, a.y, a.x, round(greatest(a.gate, avg(b.gate)), 6) AS gate FROM {_NEAR} GROUP BY a.frame, a.y, a.x, a.gate")
def feathered_gate(t):
    out = im.box_feathered(_grid(t).select("frame", "y", "x", "gate"), "frame", "gate", 1, *SIZE)
    return out.select("frame", "y", "x", F.round("gate", 6).alias("gate"))


@query(f"""
    WITH {_GRID}, w AS (SELECT a.frame, a.y, a.x, avg(b.r) AS ma, avg(b.fr) AS mb, avg(b.r * b.r) AS aa, avg(b.fr * b.fr) AS bb, avg(b.r * b.fr) AS ab FROM {_NEAR} GROUP BY 1, 2, 3),
    v AS (SELECT frame, y, x, aa - ma * ma AS va, bb - mb * mb AS vb, ab - ma * mb AS cov FROM w)
    SELECT frame, y, x, round(CASE WHEN va < 1e-6 AND vb < 1e-6 THEN 1.0 WHEN va < 1e-6 OR vb < 1e-6 THEN 0.0 ELSE cov / sqrt(greatest(va * vb, 1e-12)) END, 5) AS zncc FROM v""")
def window_agreement(t):
    return im.agreement(_grid(t), "frame", "r", "fr", 1, *SIZE).select("frame", "y", "x", F.round("zncc", 5).alias("zncc"))


_SHARP = f"""SELECT frame, var_pop(l) AS s FROM (SELECT frame, y, x, lag({{c}}) OVER r + lead({{c}}) OVER r + lag({{c}}) OVER k + lead({{c}}) OVER k - 4 * {{c}} AS l
    FROM g WINDOW r AS (PARTITION BY frame, y ORDER BY x), k AS (PARTITION BY frame, x ORDER BY y)) WHERE y BETWEEN 1 AND {HEIGHT - 2} AND x BETWEEN 1 AND {WIDTH - 2} GROUP BY 1"""


@query(f"""
    WITH {_GRID}, u AS ({_SHARP.format(c="r")}), v AS ({_SHARP.format(c="fr")}), d AS (SELECT frame, avg(abs(r - fr)) AS drift FROM g GROUP BY 1)
    SELECT frame, round(v.s / u.s, 5) AS gain, round(drift, 5) AS drift FROM u JOIN v USING (frame) JOIN d USING (frame)""")
def repair_gain(t):
    g = _grid(t)
    side = lambda c: g.select("frame", "y", "x", F.col(c).alias("v"))
    out = im.repair_metrics(side("r"), side("fr"), "frame", "v")
    return out.select("frame", F.round("gain", 5).alias("gain"), F.round("drift", 5).alias("drift"))


def _push_pull_sql() -> str:
    levels, size, k = "", list(SIZE), 0
    while max(size) > 1:
        k += 1
        before = f"l{k - 1}" if k > 1 else "(SELECT frame, y, x, CASE WHEN gate = 1 THEN r END AS v FROM g)"
        levels += f", l{k} AS (SELECT frame, y // 2 AS y, x // 2 AS x, avg(v) AS v FROM {before} GROUP BY 1, 2, 3)"
        size = [-(-s // 2) for s in size]
    joins = " ".join(f"LEFT JOIN l{j} ON l{j}.frame = g.frame AND l{j}.y = g.y >> {j} AND l{j}.x = g.x >> {j}" for j in range(1, k + 1))
    return f"WITH {_GRID}{levels} SELECT g.frame, g.y, g.x, round(coalesce(CASE WHEN gate = 1 THEN r END, {', '.join(f'l{j}.v' for j in range(1, k + 1))}), 5) AS r FROM g {joins}"


@query(_push_pull_sql())
def pyramid_filled(t):
    holes = _grid(t).select("frame", "y", "x", F.when(F.col("gate") == 1, F.col("r")).alias("r"))
    return ras.push_pull(holes, *SIZE, "r").select("frame", "y", "x", F.round("r", 5).alias("r"))


@query(f"WITH {_GRID} SELECT a.frame, a.y, a.x, coalesce((max(b.g) - min(b.g)) / nullif(a.g, 0) > 3, false) AS edge FROM {_NEAR} GROUP BY a.frame, a.y, a.x, a.g")
def depth_edge_mask(t):
    return im.depth_edges(_grid(t), "frame", "g", 3.0, *SIZE)


@query(f"WITH {_GRID} SELECT a.frame, a.y, a.x, min(b.gate) AS gate FROM {_NEAR} GROUP BY 1, 2, 3")
def eroded_gate(t):
    return ras.erode(_grid(t), "frame", "gate", 1, *SIZE)


@query(f"WITH {_GRID} SELECT frame, y, x, CASE WHEN gate = 1 THEN r ELSE fr END AS r FROM g")
def layered_frames(t):
    g = _grid(t)
    first = g.filter("gate = 1").select("frame", "y", "x", "r")
    return ras.layered(first, g.select("frame", "y", "x", F.col("fr").alias("r")), ["frame", "y", "x"], ["r"])


@query(f"WITH {_GRID} SELECT frame, y, x, round(gate * r + (1 - gate) * fr, 6) AS r FROM g")
def gated_frames(t):
    return _grid(t).select("frame", "y", "x", F.round(ras.composite(F.col("gate"), F.col("r"), F.col("fr")), 6).alias("r"))


@query(f"""
    WITH {_GRID}, t AS (SELECT c_custkey, (c_custkey % 97) / 97.0::DOUBLE AS u, (c_custkey % 53) / 53.0::DOUBLE AS v FROM customer),
    p AS (SELECT *, u * {WIDTH} - 0.5 AS fx, v * {HEIGHT} - 0.5 AS fy FROM t),
    c AS (SELECT c_custkey, ((floor(fx)::INT + dx) % {WIDTH} + {WIDTH}) % {WIDTH} AS x, greatest(0, least({HEIGHT - 1}, floor(fy)::INT + dy)) AS y,
                 (1 - abs(fx - floor(fx) - dx)) * (1 - abs(fy - floor(fy) - dy)) AS w FROM p, range(2) a(dx), range(2) b(dy))
    SELECT c_custkey, round(sum(w * r) / sum(w), 5) AS r FROM c JOIN g ON g.frame = 0 AND g.y = c.y AND g.x = c.x GROUP BY 1""")
def bilinear_samples(t):
    k = F.col("c_custkey")
    targets = t("customer").select("c_custkey", (k % 97 / 97.0).alias("u"), (k % 53 / 53.0).alias("v"))
    out = im.sampled(targets, _grid(t).filter("frame = 0").select("y", "x", "r"), "u", "v", "r", *SIZE)
    return out.select("c_custkey", F.round("r", 5).alias("r"))


@query("SELECT c_custkey, (c_custkey % 1009)::DOUBLE AS place FROM customer")
def phase_round_trip(t):
    u = F.col("c_custkey") % 1009 / 1009.0
    return t("customer").select("c_custkey", (F.round(im.decode_uv(im.encode_uv(u, 16), 16) * 1009) % 1009).cast("double").alias("place"))


@query("""
    WITH e AS (SELECT o_orderkey AS i, extract(year FROM o_orderdate)::DOUBLE - 1990 AS a, (o_custkey % 17)::DOUBLE AS b, o_totalprice::DOUBLE / 1000 AS y FROM orders),
    s AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS bt FROM e)
    SELECT 1 AS j, round((ay * bb - bt * ab) / (aa * bb - ab * ab), 5) AS x FROM s UNION ALL SELECT 2, round((bt * aa - ay * ab) / (aa * bb - ab * ab), 5) FROM s""")
def least_squares_fit(t):
    o = t("orders")
    pairs = F.explode(F.array(F.struct(F.lit(1).alias("j"), (F.year("o_orderdate") - 1990).cast("double").alias("v")), F.struct(F.lit(2).alias("j"), (F.col("o_custkey") % 17).cast("double").alias("v"))))
    entries = o.select(F.col("o_orderkey").alias("i"), pairs.alias("e")).select("i", "e.j", "e.v")
    out = im.least_squares(entries, o.select(F.col("o_orderkey").alias("i"), (F.col("o_totalprice").cast("double") / 1000).alias("b")))
    return out.select("j", F.round("x", 5).alias("x"))


@query("""
    WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
    s AS (SELECT conv_id, count(*) AS n FROM t WHERE i % 2 = 0 AND i < n - 1 GROUP BY 1),
    d AS (SELECT count(*) AS views, sum(n)::BIGINT AS frames, min(n) = max(n) AS uniform, min(n) AS least FROM s),
    p AS (SELECT views, frames, uniform, (SELECT max(k)::INT FROM range(1, (SELECT least + 1 FROM d)) r(k) WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.n % k <> 0)) AS per_view FROM d),
    b AS (SELECT *, coalesce((SELECT max(k) FROM range(5, least(per_view, 9) + 1) r(k) WHERE per_view % k = 0 AND k % 4 = 1), least(per_view, 9) - (least(per_view, 9) - 1) % 4)::INT AS batch FROM p)
    SELECT views, frames, uniform, per_view, batch, (per_view // batch)::INT AS chunks, (per_view % batch)::INT AS tail FROM b""")
def upscale_batches(t):
    order = t("conversations").select(F.col("conv_id").alias("group_id"), F.col("turn").alias("pos"), F.col("turn").alias("name"))
    return datasets.upscale_plan(order, 2, True, 9)


@query("""
    WITH c AS (SELECT n_nationkey AS request, p_partkey % 5 AS priority, p_brand || (p_partkey % 3) AS folder FROM nation, part WHERE p_partkey % 25 = n_nationkey),
    f AS (SELECT DISTINCT p_brand || CASE WHEN p_size % 2 = 0 THEN '0' ELSE '1_lowres' END AS folder FROM part WHERE p_size > 48),
    r AS (SELECT request, priority, folder, folder IN (SELECT folder FROM f) AS own, folder || '_lowres' IN (SELECT folder FROM f) AS side FROM c),
    b AS (SELECT request, min(CASE WHEN own OR side THEN {'second': NOT own, 'p': priority, 'f': folder} END) AS b FROM r GROUP BY 1)
    SELECT request, b.f AS folder, CASE WHEN b IS NULL THEN 'missing' WHEN b.second THEN 'sibling' ELSE 'files' END AS why FROM b""")
def folder_choice(t):
    p = t("part")
    wanted = p.join(t("nation"), F.col("p_partkey") % 25 == F.col("n_nationkey"))
    wanted = wanted.select(F.col("n_nationkey").alias("request"), (F.col("p_partkey") % 5).alias("priority"), F.concat("p_brand", (F.col("p_partkey") % 3).cast("string")).alias("folder"))
    files = p.filter("p_size > 48").select(F.concat("p_brand", F.when(F.col("p_size") % 2 == 0, "0").otherwise("1_lowres")).alias("folder"))
    return names.resolved_folders(wanted, "request", "folder", "priority", files)


@query("""
    SELECT s_suppkey, 'EQUIRECTANGULAR' AS model, [2.0 * s_suppkey, s_suppkey]::DOUBLE[] AS params, [s_suppkey + 0.5, 1024, 512]::DOUBLE[] AS on_grid FROM supplier""")
def panorama_cameras(t):
    s = F.col("s_suppkey")
    c = t("supplier").select("s_suppkey", F.when(s % 2 == 0, "SPHERE").otherwise("EQUIRECTANGULAR").alias("model"), (s * 2.0).alias("w"), s.cast("double").alias("h"))
    sphere = F.array(s + F.lit(0.5).cast("double"), F.col("w"), F.col("h"))
    params = F.when(F.col("model") == "SPHERE", sphere).otherwise(F.array("w", "h"))
    made = camera.equirectangular(s, F.col("model"), params, F.col("w"), F.col("h"))
    grid = camera.on_sphere_grid(F.lit("SPHERE"), sphere, F.lit(2048), F.lit(1024))
    return c.select("s_suppkey", made["model"].alias("model"), made["params"].alias("params"), grid.alias("on_grid"))


_FIELD = "SELECT frame, y, x, ((x * x * (1 + y % 3)) % 101) / 101.0::DOUBLE AS u, ((y * y) % 53) / 52.0::DOUBLE AS v FROM g"


def _field(t):
    u, v = F.col("x") * F.col("x") * (1 + F.col("y") % 3) % 101 / 101.0, F.col("y") * F.col("y") % 53 / 52.0
    return _grid(t).select("frame", "y", "x", u.alias("u"), v.alias("v"))


@query(f"""
    WITH {_GRID}, t AS ({_FIELD}), s AS (SELECT *, abs({_SLOPE.format(c=f"(u * {WIDTH})", w="rw")}) AS gu, abs({_SLOPE.format(c=f"(v * {HEIGHT})", w="cw")}) AS gv
        FROM t WINDOW rw AS (PARTITION BY frame, y ORDER BY x), cw AS (PARTITION BY frame, x ORDER BY y))
    SELECT frame, y, x, round(least(greatest((8 - greatest(CASE WHEN gu > {WIDTH / 2} THEN 0 ELSE gu END, gv) * 1.5) / 6, 0), 1), 6) AS confidence FROM s""")
def warp_confidence(t):
    out = cps.minification_confidence(_field(t), ["frame"], SIZE, SIZE, 2.0, 8.0, 1.5)
    return out.select("frame", "y", "x", F.round("confidence", 6).alias("confidence"))


@query(f"""
    WITH {_GRID}, t AS ({_FIELD}), c AS (SELECT frame, y, x, cos(u * 6.283185307179586) AS c, sin(u * 6.283185307179586) AS s, v FROM t),
    {_filter_sql("bl", "c", ["c", "s", "v"], lines.gaussian_kernel(0.6), HEIGHT, WIDTH)}, o AS (SELECT frame, y, x, atan2(s, c) / 6.283185307179586 AS a, v FROM bl)
    SELECT frame, y, x, round(CASE WHEN a < 0 THEN a + 1 ELSE a END, 5) AS u, round(v, 5) AS v FROM o""")
def smoothed_lookup(t):
    out = cps.smoothed_field(_field(t), ["frame"], 0.6, SIZE)
    return out.select("frame", "y", "x", F.round("u", 5).alias("u"), F.round("v", 5).alias("v"))


@query(f"""
    WITH {_GRID}, s AS (SELECT y, x, (fr >= 40)::INT::DOUBLE AS v FROM g WHERE frame = 0),
    d AS (SELECT f.frame, (s.y + dy + {HEIGHT}) % {HEIGHT} AS y, (s.x + dx + {WIDTH}) % {WIDTH} AS x, max(v) AS r FROM s, (SELECT DISTINCT frame FROM g) f, range(-1, 2) a(dy), range(-1, 2) b(dx) GROUP BY 1, 2, 3),
    h AS (SELECT g.frame, (g.y + dy + {HEIGHT}) % {HEIGHT} AS y, (g.x + dx + {WIDTH}) % {WIDTH} AS x, max(gate) AS m FROM g, range(-2, 3) a(dy), range(-2, 3) b(dx) GROUP BY 1, 2, 3)
    SELECT g.frame, g.y, g.x, greatest(h.m, d.r * 0.4)::DOUBLE AS mask, greatest(gate, d.r) AS "union" FROM g JOIN d USING (frame, y, x) JOIN h USING (frame, y, x)""")
def semantic_masks(t):
    g = _grid(t)
    holes = g.select("frame", "y", "x", F.col("gate").alias("m"))
    region = ras.semantic_region(g.filter("frame = 0").select("frame", "y", "x", F.col("fr").alias("m")), holes, "frame", "m", 40.0, 1, *SIZE)
    return ras.mixed_masks(holes, region, "frame", "m", 0.4, 2, *SIZE)


@query(f"""
    WITH {_GRID}, c1 AS (SELECT frame, r, x, unnest(range(y::BIGINT * 20 // {HEIGHT}, ceil((y + 1)::DOUBLE * 20 / {HEIGHT})::BIGINT)) AS cy FROM g),
    c2 AS (SELECT frame, r, cy, unnest(range(x::BIGINT * 4 // {WIDTH}, ceil((x + 1)::DOUBLE * 4 / {WIDTH})::BIGINT)) AS cx FROM c1),
    s AS (SELECT frame, cy AS y, cx AS x, avg(r) AS r FROM c2 GROUP BY 1, 2, 3),
    l AS (SELECT a.frame, a.y, a.x, sum(b.r) - 4 * any_value(a.r) AS l FROM s a, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) o(dy, dx) JOIN s b ON b.frame = a.frame
        AND b.y = CASE a.y + dy WHEN -1 THEN 1 WHEN 20 THEN 18 ELSE a.y + dy END AND b.x = CASE a.x + dx WHEN -1 THEN 1 WHEN 4 THEN 2 ELSE a.x + dx END GROUP BY 1, 2, 3)
    SELECT frame, round(var_pop(l), 4) AS sharpness FROM l GROUP BY 1""")
def reduced_sharpness(t):
    out = im.scaled_sharpness(_grid(t).select("frame", "y", "x", "r"), "frame", "r", *SIZE, most=20)
    return out.select("frame", F.round("sharpness", 4).alias("sharpness"))


@query("""
    WITH s AS (SELECT n_nationkey AS view, 2 + n_nationkey % 4 AS height, 3 + n_nationkey % 2 AS width FROM nation),
    o AS (SELECT s_nationkey AS view, s_suppkey % 6 AS y, s_suppkey % 5 AS x, min((s_acctbal > 0)::INT * 255) AS mask FROM supplier WHERE s_nationkey % 3 <> 1 GROUP BY ALL),
    c AS (SELECT DISTINCT c_nationkey AS view, c_custkey % 3 AS y, c_custkey % 2 AS x FROM customer WHERE c_nationkey % 5 < 2),
    w AS (SELECT view, y, x FROM s, range(height) a(y), range(width) b(x))
    SELECT view, y::INT AS y, x::INT AS x, CASE WHEN c.view IS NOT NULL THEN 0 ELSE coalesce(o.mask, 255) END::INT AS mask,
           view NOT IN (SELECT view FROM o) AND view NOT IN (SELECT view FROM c) AS filler FROM w LEFT JOIN o USING (view, y, x) LEFT JOIN c USING (view, y, x)""")
def coverage_masks(t):
    n = F.col("n_nationkey")
    sizes = t("nation").select(n.alias("view"), (2 + n % 4).cast("int").alias("height"), (3 + n % 2).cast("int").alias("width"))
    where = [F.col("s_nationkey").alias("view"), (F.col("s_suppkey") % 6).cast("int").alias("y"), (F.col("s_suppkey") % 5).cast("int").alias("x")]
    old = t("supplier").filter("s_nationkey % 3 <> 1").groupBy(*where).agg(F.min((F.col("s_acctbal") > 0).cast("int") * 255).alias("mask"))
    covered = t("customer").filter("c_nationkey % 5 < 2").select(F.col("c_nationkey").alias("view"), (F.col("c_custkey") % 3).cast("int").alias("y"), (F.col("c_custkey") % 2).cast("int").alias("x"))
    return ras.covered_masks(sizes, old, covered, "view")


@query("""
    SELECT p_partkey, p_size FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_tax > 0.07) AND p_size NOT IN (3, 7, 40)
    ORDER BY p_partkey LIMIT 100""")
def usable_parts(t):
    sized = t("lineitem").filter("l_tax > 0.07").select(F.col("l_partkey").alias("p_partkey"))
    return rel.usable_views(t("part").select("p_partkey", "p_size"), sized, "p_partkey", "p_size", [3, 7, 40], 100)
