"""Registered queries of the composite, component, selection and mask operators over a pixel grid made of line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import components as comp
from ..operators import composite as cps
from ..operators import lines
from ..operators import raster as ras
from ..operators import selection as sel
from .catalogue import query

#: The grid: two frames of HEIGHT rows (quantities) by WIDTH columns (discounts).
HEIGHT, WIDTH = 50, 11
SIZE = (HEIGHT, WIDTH)
LEVELS = cps.level_sizes(HEIGHT, WIDTH, 3, least_side=2)

_GRID = """g AS (SELECT (l_linenumber > 2)::INT AS frame, (l_quantity - 1)::INT AS y, round_even(l_discount * 100, 0)::INT AS x,
    max(l_extendedprice) / 1000 AS r, min(l_extendedprice) / 1000 AS g, max(l_tax) * 100 AS b, max(l_orderkey % 97) / 2.0 AS fr,
    min(l_partkey % 89) / 2.0 AS fg, max(l_suppkey % 83) / 2.0 AS fb, (sum(l_partkey) % 10 < 4)::INT::DOUBLE AS gate FROM lineitem GROUP BY ALL)"""


def _grid(t):
    li = t("lineitem")
    where = [(F.col("l_linenumber") > 2).cast("int").alias("frame"), (F.col("l_quantity") - 1).cast("int").alias("y"), F.rint(F.col("l_discount") * 100).cast("int").alias("x")]
    half = lambda how, c, m: how(F.col(c) % m) / 2.0
    return li.groupBy(*where).agg(
        (F.max("l_extendedprice") / 1000).alias("r"), (F.min("l_extendedprice") / 1000).alias("g"), (F.max("l_tax") * 100).alias("b"),
        half(F.max, "l_orderkey", 97).alias("fr"), half(F.min, "l_partkey", 89).alias("fg"), half(F.max, "l_suppkey", 83).alias("fb"),
        (F.sum("l_partkey") % 10 < 4).cast("int").cast("double").alias("gate"),
    )


def _mirror(at: str, size: int) -> str:
    p = 2 * (size - 1)
    m = f"(((({at}) % {p}) + {p}) % {p})"
    return f"CASE WHEN {m} < {size} THEN {m} ELSE {p} - {m} END"


def _filter_sql(name: str, source: str, values: list[str], kernel: list[float], height: int, width: int) -> str:
    """CTEs that give `name` the separable filter of `source`."""
    r = len(kernel) // 2
    weights = ", ".join(f"({k - r}, {w!r})" for k, w in enumerate(kernel))
    sums = ", ".join(f"sum(w * b.{v}) AS {v}" for v in values)
    return f"""{name}_k(d, w) AS (VALUES {weights}),
        {name}_x AS (SELECT a.frame, a.y, a.x, {sums} FROM {source} a, {name}_k k JOIN {source} b ON b.frame = a.frame AND b.y = a.y
            AND b.x = {_mirror("a.x + k.d", width)} GROUP BY 1, 2, 3),
        {name} AS (SELECT a.frame, a.y, a.x, {sums} FROM {name}_x a, {name}_k k JOIN {name}_x b ON b.frame = a.frame AND b.x = a.x
            AND b.y = {_mirror("a.y + k.d", height)} GROUP BY 1, 2, 3)"""


def _levels_sql() -> str:
    parts = [f"SELECT frame, {k} AS level, y >> {k} AS y, x >> {k} AS x, avg(r) AS r, avg(g) AS g FROM g WHERE y >> {k} < {h} AND x >> {k} < {w} GROUP BY 1, 3, 4" for k, (h, w) in enumerate(LEVELS)]
    return "lv AS (" + " UNION ALL ".join(parts) + ")"


@query(f"WITH {_GRID}, {_levels_sql()} SELECT frame, level::INT AS level, y::INT AS y, x::INT AS x, round(r, 6) AS r, round(g, 6) AS g FROM lv")
def mip_levels(t):
    out = cps.pyramid(_grid(t), ["frame"], ["r", "g"], LEVELS)
    return out.select("frame", "level", "y", "x", F.round("r", 6).alias("r"), F.round("g", 6).alias("g"))


_SLOPE = """CASE WHEN lag({c}) OVER {w} IS NULL THEN coalesce(lead({c}) OVER {w} - {c}, 0) WHEN lead({c}) OVER {w} IS NULL THEN {c} - lag({c}) OVER {w}
    ELSE (lead({c}) OVER {w} - lag({c}) OVER {w}) / 2 END"""


@query(f"""
    WITH {_GRID}, {_levels_sql()}, sz(level, h, w) AS (VALUES {", ".join(f"({k}, {h}, {w})" for k, (h, w) in enumerate(LEVELS))}),
    t AS (SELECT frame, y, x, ((x * x * (1 + y % 3)) % 101) / 100.0::DOUBLE AS u, ((y * y) % 53) / 52.0::DOUBLE AS v FROM g),
    s AS (SELECT *, {_SLOPE.format(c=f"(u * {WIDTH})", w="rw")} AS ux, {_SLOPE.format(c=f"(v * {HEIGHT})", w="rw")} AS vx,
                 {_SLOPE.format(c=f"(u * {WIDTH})", w="cw")} AS uy, {_SLOPE.format(c=f"(v * {HEIGHT})", w="cw")} AS vy
          FROM t WINDOW rw AS (PARTITION BY frame, y ORDER BY x), cw AS (PARTITION BY frame, x ORDER BY y)),
    f AS (SELECT frame, y, x, u, v, least(log2(greatest(greatest(
              sqrt((CASE WHEN abs(ux) > {WIDTH} THEN 0 ELSE ux END) ** 2 + vx ** 2), sqrt((CASE WHEN abs(uy) > {WIDTH} THEN 0 ELSE uy END) ** 2 + vy ** 2)), 1.0)), {len(LEVELS) - 1}.0) AS lod FROM s),
    q AS (SELECT f.*, sz.level, 1 - abs(lod - sz.level) AS lw, v * (h - 1) AS fy, u * (w - 1) AS fx, h, w FROM f, sz WHERE abs(lod - sz.level) < 1),
    c AS (SELECT q.frame, q.y, q.x, q.lod, lw * (CASE WHEN dy = 0 THEN 1 - (fy - floor(fy)) ELSE fy - floor(fy) END) * (CASE WHEN dx = 0 THEN 1 - (fx - floor(fx)) ELSE fx - floor(fx) END) AS wt,
                 level, least(floor(fy)::INT + dy, h - 1) AS py, least(floor(fx)::INT + dx, w - 1) AS px FROM q, range(2) a(dy), range(2) b(dx))
    SELECT c.frame, c.y, c.x, round(c.lod, 6) AS lod, round(sum(wt * lv.r), 5) AS r FROM c JOIN lv ON lv.frame = c.frame AND lv.level = c.level AND lv.y = c.py AND lv.x = c.px
    GROUP BY c.frame, c.y, c.x, c.lod""")
def mip_samples(t):
    g = _grid(t)
    u = ((F.col("x") * F.col("x") * (1 + F.col("y") % 3)) % 101) / 100.0
    targets = g.select("frame", "y", "x", u.alias("u"), (((F.col("y") * F.col("y")) % 53) / 52.0).alias("v"))
    targets = cps.with_detail_level(targets, ["frame"], SIZE, SIZE, len(LEVELS))
    out = cps.trilinear(targets, cps.pyramid(g, ["frame"], ["r"], LEVELS), ["frame"], ["r"], LEVELS)
    return out.select("frame", "y", "x", F.round("lod", 6).alias("lod"), F.round("r", 5).alias("r"))


TONE_WIDTH, TONE_SIGMA, TONE_CLAMP = 5, 3.0, 2.0
_TONE_HEIGHT = round(HEIGHT * TONE_WIDTH / WIDTH)


def _tone_sql(gains: str, values: str, names: list[str], outputs: str) -> str:
    h, w = _TONE_HEIGHT, TONE_WIDTH
    sums = ", ".join(f"avg({n}) AS {n}" for n in ["m", *names])
    gated = ", ".join(f"{n} * m AS {n}" for n in names)
    totals = ", ".join(f"sum({n}) AS all_{n}" for n in names)
    cell = lambda c, size, to: f"unnest(range(({c}::BIGINT * {to} // {size}), ceil(({c} + 1)::DOUBLE * {to} / {size})::BIGINT))"
    kernel = lines.gaussian_kernel(max(1.0, TONE_SIGMA * TONE_WIDTH / WIDTH))
    sigma = _filter_sql("bl", "sm", ["m", *names], kernel, h, w)
    corner = lambda c: f"greatest((g.{c[0]} + 0.5) * {c[1]}.0 / {c[2]} - 0.5, 0)"
    return f"""
    WITH {_GRID}, v AS (SELECT frame, y, x, gate AS m, {values} FROM g),
    c1 AS (SELECT *, {cell("y", HEIGHT, h)} AS cy FROM v), c2 AS (SELECT *, {cell("x", WIDTH, w)} AS cx FROM c1),
    ar AS (SELECT frame, cy::INT AS y, cx::INT AS x, {sums} FROM c2 GROUP BY 1, 2, 3), sm AS (SELECT frame, y, x, m, {gated} FROM ar),
    al AS (SELECT frame, greatest(sum(m), 1e-6) AS area, {totals} FROM sm GROUP BY frame), {sigma},
    ga AS (SELECT bl.frame, bl.y, bl.x, {gains} FROM bl JOIN al USING (frame)),
    pt AS (SELECT g.*, {corner(("y", h, HEIGHT))} AS fy, {corner(("x", w, WIDTH))} AS fx FROM g),
    co AS (SELECT pt.*, least(floor(fy)::INT + dy, {h - 1}) AS qy, least(floor(fx)::INT + dx, {w - 1}) AS qx,
                  (CASE WHEN dy = 0 THEN 1 - (fy - floor(fy)) ELSE fy - floor(fy) END) * (CASE WHEN dx = 0 THEN 1 - (fx - floor(fx)) ELSE fx - floor(fx) END) AS wt
           FROM pt, range(2) a(dy), range(2) b(dx))
    SELECT co.frame, co.y, co.x, {outputs} FROM co JOIN ga ON ga.frame = co.frame AND ga.y = co.qy AND ga.x = co.qx
    GROUP BY co.frame, co.y, co.x, co.fr, co.fg, co.fb"""


_RATIO = "m / (m + 0.001) * least(greatest((s / (m + 0.001)) / (f / (m + 0.001) + 0.001), 0.5), 2.0) + (1 - m / (m + 0.001)) * least(greatest((all_s / area) / (all_f / area + 0.001), 0.5), 2.0) AS gain"
_SPREAD = "m / (m + 0.001) * (s / (m + 0.001)) + (1 - m / (m + 0.001)) * (all_s / area) AS gain"


@query(_tone_sql(_RATIO, "0.299 * r + 0.587 * g + 0.114 * b AS s, 0.299 * fr + 0.587 * fg + 0.114 * fb AS f", ["s", "f"],
    ", ".join(f"round(co.f{c} * sum(wt * ga.gain), 4) AS {c}_fill" for c in "rgb")))
def tone_fill(t):
    out = cps.tone_matched(_grid(t), ["frame"], ["r", "g", "b"], ["fr", "fg", "fb"], "gate", SIZE, TONE_WIDTH, TONE_SIGMA, TONE_CLAMP)
    return out.select("frame", "y", "x", *[F.round(f"{c}_fill", 4).alias(f"{c}_fill") for c in "rgb"])


@query(_tone_sql(_SPREAD, "r AS s", ["s"], "round(sum(wt * ga.gain), 5) AS r_fill"))
def tone_spread(t):
    out = cps.tone_matched(_grid(t), ["frame"], ["r"], None, "gate", SIZE, TONE_WIDTH, TONE_SIGMA, TONE_CLAMP)
    return out.select("frame", "y", "x", F.round("r_fill", 5).alias("r_fill"))


FUSE = {"low_sigma": 0.5, "energy_window": 5, "edge_window": 3, "edge_energy": 40.0}


def _fuse_sql() -> str:
    six = [f"{p}{c}" for p in ("", "f") for c in "rgb"]
    low = _filter_sql("lo", "g", six, lines.gaussian_kernel(FUSE["low_sigma"]), *SIZE)
    mean = lambda p, how: "(" + " + ".join(how.format(f"g.{p}{c} - lo.{p}{c}") for c in "rgb") + ") / 3"
    box = lambda name, source, values, k: _filter_sql(name, source, values, [1 / k] * k, *SIZE)
    near = lambda v: f"""(SELECT sum(n.{v}) FROM (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) o(dy, dx) JOIN m n ON n.frame = m.frame
        AND n.y = {_mirror("m.y + o.dy", HEIGHT)} AND n.x = {_mirror("m.x + o.dx", WIDTH)}) - 4 * m.{v}"""  # noqa: E731
    out = ", ".join(f"round(lo.f{c} + (g.{c} - lo.{c}) * s + (g.f{c} - lo.f{c}) * (1 - s), 4) AS {c}_fused" for c in "rgb")
    return f"""
    WITH {_GRID}, {low},
    m AS (SELECT g.frame, g.y, g.x, {mean("", "{}")} AS a, {mean("f", "{}")} AS b, {mean("", "abs({})")} AS ea, {mean("f", "abs({})")} AS eb FROM g JOIN lo USING (frame, y, x)),
    {box("en", "m", ["ea", "eb"], FUSE["energy_window"])},
    la AS (SELECT frame, y, x, {near("a")} AS a, {near("b")} AS b FROM m), sq AS (SELECT *, a * a AS aa, b * b AS bb, a * b AS ab FROM la),
    {box("ed", "sq", ["a", "b", "aa", "bb", "ab"], FUSE["edge_window"])},
    va AS (SELECT frame, y, x, aa - a * a AS va, bb - b * b AS vb, ab - a * b AS cov FROM ed),
    sc AS (SELECT frame, y, x, least(greatest((cov / sqrt(greatest(va * vb, 1e-8)) - 0.1) / 0.4, 0), 1) AS agree,
                  least(greatest((sqrt(greatest(va, 0)) + sqrt(greatest(vb, 0))) / {FUSE["edge_energy"]}, 0), 1) AS strong FROM va),
    sh AS (SELECT frame, y, x, least(1.0, 1.5 * eb / (ea + 0.001)) * ((1 - strong) + strong * agree) AS s FROM sc JOIN en USING (frame, y, x))
    SELECT g.frame, g.y, g.x, {out} FROM g JOIN lo USING (frame, y, x) JOIN sh USING (frame, y, x)"""


@query(_fuse_sql())
def band_fusion(t):
    out = cps.fused(_grid(t), ["frame"], ["r", "g", "b"], ["fr", "fg", "fb"], SIZE, **FUSE)
    return out.select("frame", "y", "x", *[F.round(f"{c}_fused", 4).alias(f"{c}_fused") for c in "rgb"])


REGROW_ROUNDS = 3


def _regrow_sql() -> str:
    steps, now = "", "st"
    for k in range(REGROW_ROUNDS):
        steps += f""", b{k} AS (SELECT u.frame, u.y, u.x, arg_max(n.d, n.d * 1000 - 3 * dy - dx) AS d, arg_max(n.c, n.d * 1000 - 3 * dy - dx) AS c
            FROM {now} u, range(-1, 2) a(dy), range(-1, 2) b(dx) JOIN {now} n ON n.frame = u.frame AND n.y = (u.y - dy + {HEIGHT}) % {HEIGHT} AND n.x = (u.x - dx + {WIDTH}) % {WIDTH}
            WHERE NOT u.known AND n.known AND n.d > 0 GROUP BY 1, 2, 3),
        s{k} AS (SELECT st.frame, st.y, st.x, coalesce(b.d, st.d) AS d, coalesce(b.c, st.c) AS c, known OR b.d IS NOT NULL AS known, grown OR b.d IS NOT NULL AS grown
            FROM {now} st LEFT JOIN b{k} b USING (frame, y, x))"""
        now = f"s{k}"
    return f"""
    WITH {_GRID}, d AS (SELECT frame, y, x, floor(r)::DOUBLE AS d, fr AS c FROM g),
    fa AS (SELECT a.frame, a.y, a.x, max(b.d) AS far FROM d a JOIN d b ON b.frame = a.frame AND abs(b.y - a.y) <= 2 AND abs(b.x - a.x) <= 2 GROUP BY 1, 2, 3),
    st AS (SELECT d.*, NOT ((far - d.d) / greatest(d.d, 1e-6) > 0.25) AS known, false AS grown FROM d JOIN fa USING (frame, y, x)){steps}
    SELECT frame, y, x, d, c, grown FROM {now}"""


@query(_regrow_sql())
def background_regrown(t):
    g = _grid(t).select("frame", "y", "x", F.floor("r").cast("double").alias("d"), F.col("fr").alias("c"))
    return cps.regrown(g, ["frame"], "d", ["c"], 0.25, 2, SIZE, rounds=REGROW_ROUNDS)


@query(f"""
    WITH RECURSIVE {_GRID}, p AS (SELECT frame, y, x, y * {WIDTH} + x AS id FROM g WHERE gate = 1),
    e AS (SELECT a.frame, a.id, b.id AS id2 FROM p a JOIN p b ON b.frame = a.frame AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1),
    r AS (SELECT frame, id, id2 FROM e UNION SELECT r.frame, r.id, e.id2 FROM r JOIN e ON e.frame = r.frame AND e.id = r.id2)
    SELECT frame, (id // {WIDTH})::INT AS y, (id % {WIDTH})::INT AS x FROM r GROUP BY frame, id HAVING count(*) >= 9""")
def large_regions(t):
    return comp.kept_components(_grid(t).filter("gate = 1"), "frame", 9)


@query(f"""
    WITH RECURSIVE {_GRID}, p AS (SELECT frame, y, x, y * {WIDTH} + x AS id FROM g WHERE gate = 1),
    e AS (SELECT a.frame, a.id, b.id AS id2 FROM p a JOIN p b ON b.frame = a.frame AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1),
    r AS (SELECT frame, id, id2 FROM e UNION SELECT r.frame, r.id, e.id2 FROM r JOIN e ON e.frame = r.frame AND e.id = r.id2),
    l AS (SELECT frame, id, min(id2) AS root, count(*) AS size FROM r GROUP BY 1, 2)
    SELECT frame, (root // {WIDTH})::INT AS y, (root % {WIDTH})::INT AS x, size FROM l WHERE id = root""")
def region_sizes(t):
    runs = comp.labelled(_grid(t).filter("gate = 1"), "frame")
    return runs.groupBy("label").agg(F.max("size").alias("size")).select("label.frame", "label.y", F.col("label.x0").alias("x"), "size")


@query(f"""
    WITH p AS (SELECT l_linenumber AS view, floor(l_quantity / 4)::INT AS y, round_even(l_discount * 100, 0)::INT AS x, max(l_extendedprice) AS fp, avg(l_extendedprice) AS best,
                      min(l_tax) < 0.03 AS clean, CASE WHEN min(l_partkey % 11) = 0 THEN 0 ELSE 255 END AS old FROM lineitem GROUP BY ALL),
    o AS (SELECT *, coalesce(clean AND best <= fp * 0.9, false)::INT AS raw FROM p),
    e AS (SELECT a.view, a.y, a.x, min(b.raw) AS own FROM o a JOIN o b ON b.view = a.view AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 GROUP BY 1, 2, 3),
    n AS (SELECT view, y, x, old, own, CASE WHEN own = 1 THEN 0 ELSE old END AS new FROM o JOIN e USING (view, y, x)),
    s AS (SELECT view, 1 - avg((new >= 128)::INT) > 0.65 AS capped FROM n GROUP BY 1)
    SELECT view, y, x, CASE WHEN capped AND y % 4 = 0 AND x % 4 = 0 AND old >= 128 THEN 255 ELSE new END::INT AS mask, own = 1 AS owned, capped FROM n JOIN s USING (view)""")
def ownership(t):
    where = [F.col("l_linenumber").alias("view"), F.floor(F.col("l_quantity") / 4).cast("int").alias("y"), F.rint(F.col("l_discount") * 100).cast("int").alias("x")]
    p = t("lineitem").groupBy(*where).agg(
        F.max("l_extendedprice").alias("fp"), F.avg("l_extendedprice").alias("best"), (F.min("l_tax") < 0.03).alias("clean"),
        F.when(F.min(F.col("l_partkey") % 11) == 0, 0).otherwise(255).alias("old"),
    )
    return ras.ownership_masks(p, "view", F.col("clean"), F.col("fp"), F.col("best"), "old", 0.9, 1, 0.65, 13, 11)


@query("""
    SELECT o_orderpriority, count(*) AS n, round(quantile_cont(o_totalprice::DOUBLE, 0.1), 4) AS low, round(quantile_cont(o_totalprice::DOUBLE, 0.5), 4) AS middle,
           round(quantile_cont(o_totalprice::DOUBLE, 0.985), 4) AS high FROM orders GROUP BY 1""")
def group_percentiles(t):
    out = sel.group_percentiles(t("orders"), ["o_orderpriority"], "o_totalprice", [0.1, 0.5, 0.985])
    return out.select("o_orderpriority", "n", *[F.round(f"p{i}", 4).alias(c) for i, c in enumerate(("low", "middle", "high"))])


@query("SELECT share, round(CASE share WHEN 0.25 THEN quantile_cont(l_extendedprice::DOUBLE, 0.25) WHEN 0.5 THEN quantile_cont(l_extendedprice::DOUBLE, 0.5) ELSE quantile_cont(l_extendedprice::DOUBLE, 0.985) END, 4) AS price FROM lineitem, (VALUES (0.25::DOUBLE), (0.5), (0.985)) s(share) GROUP BY share")
def price_percentiles(t):
    li, shares = t("lineitem"), [0.25, 0.5, 0.985]
    rows = [(s, round(v, 4)) for s, v in zip(shares, sel.percentiles(li, "l_extendedprice", shares))]
    return li.sparkSession.createDataFrame(rows, "share double, price double")


@query("""
    WITH f AS (SELECT DISTINCT l_partkey, l_suppkey, l_linenumber FROM lineitem),
    s AS (SELECT l_partkey, l_suppkey, l_linenumber, greatest(a.p_retailprice, b.p_retailprice, c.p_retailprice) - least(a.p_retailprice, b.p_retailprice, c.p_retailprice) AS span
          FROM f JOIN part a ON a.p_partkey = l_partkey JOIN part b ON b.p_partkey = l_suppkey JOIN part c ON c.p_partkey = l_linenumber),
    q AS (SELECT quantile_cont(span::DOUBLE, 0.9) AS most FROM s)
    SELECT l_partkey AS v0, l_suppkey AS v1, l_linenumber::BIGINT AS v2 FROM s, q WHERE span <= most""")
def cut_by_span(t):
    corners = [F.col(c).cast("long").alias(f"v{i}") for i, c in enumerate(("l_partkey", "l_suppkey", "l_linenumber"))]
    vertices = t("part").select(F.col("p_partkey").alias("vid"), F.col("p_retailprice").cast("double").alias("d"))
    return ras.cut_spans(t("lineitem").select(*corners).distinct(), vertices, "d", 0.9)


@query("SELECT l_returnflag AS stage, round(sum(l_quantity)::DOUBLE, 4) AS total, round(sum(l_quantity)::DOUBLE / 49, 6) AS per_frame, round(sum(l_quantity)::DOUBLE / (SELECT sum(l_quantity)::DOUBLE FROM lineitem), 9) AS share FROM lineitem GROUP BY 1")
def stage_shares(t):
    li = t("lineitem").select(F.col("l_returnflag").alias("stage"), F.col("l_quantity").cast("double").alias("seconds"))
    out = agg.stage_totals(li, ["stage"], "seconds", 49)
    return out.select("stage", F.round("total", 4).alias("total"), F.round("per_frame", 6).alias("per_frame"), F.round("share", 9).alias("share"))
