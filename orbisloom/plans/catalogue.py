"""The catalogue of registered queries over the star-schema and event tables, each with its SQL oracle.

Every query applies one operator, with the tables' columns in the place of camera, image and point columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import camera, frames, keys
from ..operators import aggregates as agg
from ..operators import ordered as od
from ..operators import raster as ras
from ..operators import relational as rel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function (t -> DataFrame), where t(name) reads a table, under its own name."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: table(spark, sf_dir, name))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return run

    return register


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["stride_group"](spark, sf_dir)


@query("""
    SELECT event_id, event_type FROM (
        SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    WHERE i % 5 = 0 AND i < n - 4""")
def stride_group(t):
    return od.stride_group(t("events"), ["event_type"], ["ts", "event_id"], 5, drop_partial=True).select("event_id", "event_type")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def orphan_anti(t):
    urgent = t("orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return rel.orphans(t("customer").select("c_custkey"), urgent, "c_custkey")


@query("SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09)")
def present_semi(t):
    sold = t("lineitem").filter("l_discount > 0.09").select(F.col("l_partkey").alias("p_partkey"))
    return rel.present(t("part").select("p_partkey", "p_brand"), sold, "p_partkey")


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.doc_id IS NOT NULL AS in_left, l.doc_id IS NOT NULL AS in_right FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def audit_both(t):
    return rel.audit(t("documents"), t("labels"), "doc_id")


@query("""
    SELECT count(*) AS n, round(avg(l_quantity), 4) AS l_quantity, round(avg(l_discount), 4) AS l_discount FROM lineitem
    GROUP BY round_even(l_quantity / 0.5, 0), round_even(l_discount / 0.5, 0) ORDER BY count(*) DESC, min(l_orderkey * 10 + l_linenumber) LIMIT 1""")
def densest_bucket(t):
    li = t("lineitem").withColumn("ord", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return agg.densest_bucket(li, ["l_quantity", "l_discount"], 0.5, "ord").select("n", F.round("l_quantity", 4).alias("l_quantity"), F.round("l_discount", 4).alias("l_discount"))


@query("""
    SELECT bin::INT AS bin, e[bin + 1] AS low, e[bin + 2] AS high, count(*) AS n FROM (
        SELECT [0.0::DOUBLE, 0.01, 0.03, 0.05, 0.08, 0.2] AS e, len(list_filter(e, lambda x: l_discount >= x)) - 1 AS bin FROM lineitem WHERE l_discount < 0.2)
    GROUP BY ALL""")
def hist_edges(t):
    return agg.histogram(t("lineitem"), "l_discount", [0.0, 0.01, 0.03, 0.05, 0.08, 0.2])


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY count(*) DESC, min(o_orderkey) LIMIT 1")
def majority_mode(t):
    return agg.majority(t("orders"), ["o_orderpriority"], "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority <> (SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY count(*) DESC, min(o_orderkey) LIMIT 1)")
def deviants(t):
    return agg.deviants(t("orders"), ["o_orderpriority"], "o_orderkey").select("o_orderkey")


@query("""
    SELECT o_orderstatus, min(o_custkey) AS first, max(o_custkey) AS last, count(*) AS n FROM (
        SELECT o_orderstatus, o_custkey, o_custkey - row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) AS g FROM (SELECT DISTINCT o_orderstatus, o_custkey FROM orders))
    GROUP BY o_orderstatus, g""")
def gaps_islands(t):
    return od.gaps_and_islands(t("orders"), ["o_orderstatus"], "o_custkey")


@query("""
    WITH m AS (SELECT max(n_nationkey) AS k FROM nation WHERE n_regionkey < 2)
    SELECT n_nationkey, n_name FROM nation WHERE n_regionkey < 2 UNION ALL SELECT (n_nationkey + k)::INT, n_name FROM nation, m WHERE n_regionkey >= 2""")
def offset_union(t):
    n = t("nation").select("n_nationkey", "n_name", "n_regionkey")
    old, new = (n.filter(c).drop("n_regionkey") for c in ("n_regionkey < 2", "n_regionkey >= 2"))
    return rel.offset_union(old, new, {"n_nationkey": ["n_nationkey"]})


@query("""
    WITH s AS (SELECT n_regionkey, count(*) AS size FROM nation WHERE n_regionkey < 4 GROUP BY 1), b AS (SELECT n_regionkey, sum(size) OVER (ORDER BY n_regionkey) AS high, sum(size) OVER (ORDER BY n_regionkey) - size AS low FROM s)
    SELECT n_nationkey, coalesce((SELECT b.n_regionkey FROM b WHERE n_nationkey >= low AND n_nationkey < high), (SELECT max_by(n_regionkey, high) FROM b)) AS traj FROM nation""")
def traj_range(t):
    n = t("nation")
    sizes = n.filter("n_regionkey < 4").groupBy(F.col("n_regionkey").alias("traj")).agg(F.count(F.lit(1)).alias("size"))
    return od.in_bounds(n.select("n_nationkey"), "n_nationkey", od.cumulative_bounds(sizes, "traj", "size"), "traj")


@query("""
    SELECT e.event_id, m.mark FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS mark FROM events WHERE event_type = 'view' GROUP BY 1, 2) m
    ON e.user_id = m.user_id AND e.ts >= m.ts WHERE e.event_type <> 'view'""")
def asof_bounds(t):
    e = t("events")
    marks = e.filter("event_type = 'view'").select("user_id", "ts", F.col("value").alias("mark"))
    return od.as_of(e.filter("event_type <> 'view'"), marks, ["user_id"], "ts", "mark").select("event_id", "mark")


@query("""
    WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), q AS (SELECT * FROM u WHERE label = 1), p AS (SELECT * FROM u WHERE label = 0)
    SELECT vec_id, near_id, round(cosine, 4) AS cosine FROM (
        SELECT q.vec_id, p.vec_id AS near_id, list_cosine_similarity(q.v, p.v) AS cosine, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.v, p.v) DESC, p.vec_id) AS r FROM q, p)
    WHERE r = 1""")
def nearest_axis(t):
    e = t("embeddings")
    out = rel.nearest_by_cosine(e.filter("label = 1"), e.filter("label = 0").withColumnRenamed("vec_id", "near_id"), "vec_id", "embedding", "near_id")
    return out.select("vec_id", "near_id", F.round("cosine", 4).alias("cosine"))


@query("""
    SELECT user_id, round(list_reduce(list(value ORDER BY ts, event_id), lambda g, x: 0.6 * x + 0.4 * g), 4) AS ema FROM events GROUP BY user_id""")
def ema(t):
    e = od.moving_average(t("events"), ["user_id"], ["ts", "event_id"], "value", 0.6)
    return e.groupBy("user_id").agg(F.round(F.max_by("ema", F.struct("ts", "event_id")), 4).alias("ema"))


@query("""
    WITH p AS (SELECT l_quantity - 25.5 AS x, l_extendedprice / 1000 - 30 AS y FROM lineitem),
    s AS (SELECT ((trunc(atan2(y, x) / 6.283185307179586 * 32)::INT % 32 + 32) % 32)::INT AS sector, quantile_cont(sqrt(x * x + y * y), 0.1) AS q, count(*) AS n FROM p GROUP BY 1),
    f AS (SELECT sector, CASE WHEN n >= 3 THEN q END AS q FROM s), m AS (SELECT coalesce(median(q), 1.0) AS m FROM f),
    c AS (SELECT r.i::INT AS sector, coalesce(f.q, m.m) AS clearance FROM range(32) r(i) LEFT JOIN f ON f.sector = r.i, m)
    SELECT a.sector, round(a.clearance, 4) AS clearance, round(min(b.clearance), 4) AS corridor FROM c a JOIN c b ON (b.sector - a.sector + 33) % 32 < 3 GROUP BY a.sector, a.clearance""")
def sector_corridor(t):
    p = t("lineitem").select((F.col("l_quantity") - 25.5).alias("x"), (F.col("l_extendedprice") / 1000 - 30).alias("y"))
    c = od.circular_minimum(agg.sector_ranges(p, "x", "y"), "sector", "clearance", 32, "corridor")
    return c.select("sector", F.round("clearance", 4).alias("clearance"), F.round("corridor", 4).alias("corridor"))


@query("""
    SELECT px, py, l_orderkey, l_linenumber FROM (
        SELECT round_even(l_quantity / 50 * 31, 0)::INT AS px, round_even(l_discount * 150, 0)::INT AS py, l_orderkey, l_linenumber,
               row_number() OVER (PARTITION BY round_even(l_quantity / 50 * 31, 0), round_even(l_discount * 150, 0) ORDER BY l_tax DESC, l_orderkey * 10 + l_linenumber DESC) AS r FROM lineitem) WHERE r = 1""")
def zbuffer(t):
    li = t("lineitem")
    return ras.z_buffer(li, F.col("l_quantity") / 50 * 31, F.col("l_discount") * 150, F.col("l_tax"), F.col("l_orderkey") * 10 + F.col("l_linenumber"), ["l_orderkey", "l_linenumber"])


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def json_seq(t):
    return t("events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT l_orderkey, count(*) FILTER (l_suppkey % 3 <> 0) AS n FROM lineitem GROUP BY 1")
def track_strip(t):
    gone = t("supplier").filter("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return rel.strip_tracks(t("lineitem"), "l_orderkey", "l_suppkey", gone)


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_suppkey % 3 <> 0 GROUP BY 1")
def trim_keep(t):
    gone = t("supplier").filter("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return rel.strip_tracks(t("lineitem"), "l_orderkey", "l_suppkey", gone, keep_empty=False)


@query("SELECT l_orderkey, count(*) FILTER (l_suppkey % 3 <> 0) = 0 AS emptied, string_agg(l_suppkey::VARCHAR, ',' ORDER BY l_linenumber, l_suppkey) FILTER (l_suppkey % 3 <> 0) AS suppliers FROM lineitem GROUP BY 1")
def strip_nested(t):
    tracks = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("track"))
    out = rel.strip_nested(tracks, "l_orderkey", "track", "l_suppkey", t("supplier").filter("s_suppkey % 3 = 0"), "s_suppkey")
    text = F.array_join(F.transform("track", lambda x: x["l_suppkey"].cast("string")), ",")
    return out.select("l_orderkey", (F.size("track") == 0).alias("emptied"), F.nullif(text, F.lit("")).alias("suppliers"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN p_size <= 25 THEN l_partkey ELSE -1 END AS l_partkey FROM lineitem JOIN part ON p_partkey = l_partkey")
def dangling_null(t):
    points = t("part").filter("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"))
    return rel.dangling_to(t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), points, "l_partkey")


@query("""
    WITH d AS (SELECT o_orderpriority, sha256('["=' || o_orderkey || '","' || coalesce('=' || o_orderstatus, '-') || '"]') AS h FROM orders),
    s AS (SELECT o_orderpriority, count(*) AS n, sum(('0x' || h[1:15])::BIGINT) AS a, sum(('0x' || h[16:30])::BIGINT) AS b, sum(('0x' || h[31:45])::BIGINT) AS c,
                 sum(('0x' || h[46:60])::BIGINT) AS d FROM d GROUP BY 1)
    SELECT o_orderpriority, n, sha256(concat_ws(',', n, a, b, c, d)) AS fingerprint FROM s""")
def fingerprint(t):
    return agg.fingerprints(t("orders"), ["o_orderpriority"], ["o_orderkey", "o_orderstatus"])


@query("""
    WITH d AS (SELECT s_nationkey, min(s_suppkey) AS first FROM supplier GROUP BY 1)
    SELECT s_suppkey, id AS camera_id FROM supplier JOIN (SELECT s_nationkey, row_number() OVER (ORDER BY first) AS id FROM d) USING (s_nationkey)""")
def dedupe_alloc(t):
    return rel.dense_ids(t("supplier").select("s_suppkey", "s_nationkey"), ["s_nationkey"], "s_suppkey", "camera_id").select("s_suppkey", F.col("camera_id").cast("long").alias("camera_id"))


@query("""
    WITH e AS (SELECT c_nationkey AS k, round(c_acctbal)::BIGINT AS b, min(c_custkey) AS id FROM customer GROUP BY 1, 2), top AS (SELECT max(c_custkey) AS m FROM customer),
    w AS (SELECT s_suppkey, s_nationkey AS k, round(s_acctbal)::BIGINT AS b FROM supplier),
    f AS (SELECT k, b, row_number() OVER (ORDER BY min(s_suppkey)) AS n FROM w WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.k = w.k AND e.b = w.b) GROUP BY 1, 2)
    SELECT s_suppkey, coalesce(e.id, m + f.n)::BIGINT AS camera_id FROM w LEFT JOIN e ON e.k = w.k AND e.b = w.b LEFT JOIN f ON f.k = w.k AND f.b = w.b, top""")
def reuse_or_allocate(t):
    near = lambda c: F.round(c).cast("long").alias("b")
    have = t("customer").select(F.col("c_nationkey").alias("k"), near("c_acctbal"), F.col("c_custkey").alias("camera_id"))
    want = t("supplier").select("s_suppkey", F.col("s_nationkey").alias("k"), near("s_acctbal"), F.lit(None).cast("long").alias("camera_id"))
    return rel.reuse_or_allocate(want, have, [F.col("k"), F.col("b")], "camera_id", "s_suppkey").select("s_suppkey", F.col("camera_id").cast("long").alias("camera_id"))


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus <> 'F'")
def clone_split(t):
    return rel.split_users(t("orders"), "o_custkey", F.col("o_orderstatus") == "F")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def furthest(t):
    return od.rank_by_displacement(t("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"], 50)


@query("SELECT event_id FROM (SELECT event_id, coalesce(CASE WHEN value < 5 THEN NULL ELSE value / 100 END, 1.0) AS r FROM events) ORDER BY r, event_id LIMIT 50")
def top_damage(t):
    e = t("events").withColumn("ratio", F.when(F.col("value") < 5, F.lit(None)).otherwise(F.col("value") / 100))
    return od.rank_by_damage(e, "ratio", ["event_id"], 50).select("event_id")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) - 1 AS i FROM orders) WHERE i % 7 = 0")
def every_nth_global(t):
    return od.every_nth(t("orders").select("o_orderpriority", "o_orderkey"), ["o_orderpriority", "o_orderkey"], 7).select("o_orderkey")


@query("""
    WITH n AS (SELECT count(*) AS n FROM orders), p AS (SELECT DISTINCT round_even(j * ((n - 1)::DOUBLE / 99), 0)::BIGINT AS i FROM range(100) r(j), n)
    SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) JOIN p USING (i)""")
def even_sample(t):
    return od.even_sample(t("orders").select("o_orderkey"), ["o_orderkey"], 100)


@query("SELECT text, conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY conv_id, turn) AS r FROM conversations) WHERE r = 1")
def dedupe_order(t):
    return od.first_occurrence(t("conversations").select("text", "conv_id", "turn"), "text", ["conv_id", "turn"])


@query("""
    WITH f AS (SELECT DISTINCT unnest(list_concat(list_concat(range(0, 3), range(4, 100, 9)), [40])) AS frame) SELECT l_orderkey, l_linenumber FROM lineitem JOIN f ON l_orderkey = frame WHERE frame < 100""")
def dsl_frames(t):
    li = t("lineitem")
    spec = li.sparkSession.range(1).select(F.explode(frames.spanned(F.lit("0-2,4-/9,40"), F.lit(100))).alias("f")).select(F.col("f").cast("long").alias("l_orderkey"))
    return rel.present(li.select("l_orderkey", "l_linenumber"), spec, "l_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, count(*) FILTER (l_quantity >= 30) OVER (PARTITION BY l_orderkey) AS k FROM lineitem) WHERE k >= 3")
def ring_rule(t):
    return agg.whole_group_rule(t("lineitem"), "l_orderkey", F.col("l_quantity") >= 30, 3).select("l_orderkey", "l_linenumber")


@query("""
    SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '2-HIGH') AS high, count(*) FILTER (o_orderpriority = '5-LOW') AS low FROM orders GROUP BY 1""")
def pivot_backends(t):
    p = t("orders").groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"]).agg(F.count(F.lit(1)))
    return p.select("o_orderstatus", *[F.coalesce(F.col(f"`{a}`"), F.lit(0)).cast("long").alias(b) for a, b in (("1-URGENT", "urgent"), ("2-HIGH", "high"), ("5-LOW", "low"))])


@query("""
    SELECT l_suppkey, count(*) AS n, round(avg(CASE WHEN l_discount > 0 THEN l_quantity / 25 END), 4) AS mean_gain, round(avg(l_tax), 4) AS mean_drift,
           round(avg(CASE WHEN l_discount > 0 THEN l_quantity / 25 END) - 1 - 0.1 * avg(l_tax), 4) AS score FROM lineitem GROUP BY 1""")
def score_rank(t):
    gain = F.when(F.col("l_discount") > 0, F.col("l_quantity") / 25).otherwise(F.lit(float("nan")))
    out = agg.ranked_scores(t("lineitem"), "l_suppkey", gain, F.col("l_tax"))
    return out.select("l_suppkey", "n", *[F.round(c, 4).alias(c) for c in ("mean_gain", "mean_drift", "score")])


@query("SELECT list_reduce(list(n), lambda a, b: gcd(a, b))::BIGINT AS gcd FROM (SELECT 6 * count(*) AS n FROM lineitem GROUP BY l_orderkey)")
def divisor(t):
    return agg.common_divisor(t("lineitem").groupBy("l_orderkey").agg((6 * F.count(F.lit(1))).alias("n")), "n")


@query("""
    SELECT o_orderkey, coalesce((SELECT max(d) FROM range(1, 101) r(d) WHERE n % d = 0 AND d % 4 = 1 AND d <= 61), 1)::BIGINT AS divisor FROM (SELECT l_orderkey AS o_orderkey, 15 * count(*) AS n FROM lineitem GROUP BY 1)""")
def divisor_4n1(t):
    n = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((15 * F.count(F.lit(1))).cast("int").alias("n"))
    return n.select("o_orderkey", frames.largest_divisor_4n1(F.col("n"), F.lit(61)).cast("long").alias("divisor"))


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a, supplier b WHERE a.s_suppkey < b.s_suppkey AND (a.s_acctbal - b.s_acctbal) ** 2 + (a.s_nationkey - b.s_nationkey) ** 2 <= 150 * 150")
def dist_join(t):
    s = t("supplier")
    a, b = (s.select(F.col("s_suppkey").alias(n), F.col("s_acctbal").alias(f"x{n}"), F.col("s_nationkey").alias(f"y{n}")) for n in "ab")
    return rel.distance_join(a, b, [("xa", "xb"), ("ya", "yb")], 150).filter("a < b").select("a", "b")


@query("""
    WITH o AS (SELECT n_nationkey AS b FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation) WHERE i % 3 = 0)
    SELECT r_regionkey AS a, b FROM region, o UNION ALL SELECT x.r_regionkey, y.r_regionkey FROM region x, region y WHERE x.r_regionkey < y.r_regionkey""")
def pair_gen(t):
    return rel.generated_pairs(t("region"), t("nation"), "r_regionkey", "n_nationkey", 3)


@query(r"""
    WITH p AS (SELECT page_id, regexp_extract(url, '://[^/]*(/[^?#]*)', 1) AS path FROM pages), l AS (SELECT * FROM p WHERE page_id % 2 = 0), r AS (SELECT * FROM p WHERE page_id % 2 = 1),
    e AS (SELECT path, max(page_id) AS m FROM r GROUP BY 1), s AS (SELECT regexp_replace(regexp_replace(path, '^.*/', ''), '\.[^.]*$', '') AS k, max(page_id) AS m FROM r GROUP BY 1),
    d AS (SELECT regexp_replace(path, '[^0-9]', '', 'g') AS k, min(page_id) AS m FROM r WHERE regexp_replace(path, '[^0-9]', '', 'g') <> '' GROUP BY 1)
    SELECT l.page_id, coalesce(e.m, s.m, d.m) AS match_id, CASE WHEN e.m IS NOT NULL THEN 0 WHEN s.m IS NOT NULL THEN 1 WHEN d.m IS NOT NULL THEN 2 END AS level FROM l LEFT JOIN e ON e.path = l.path
    LEFT JOIN s ON s.k = regexp_replace(regexp_replace(l.path, '^.*/', ''), '\.[^.]*$', '') LEFT JOIN d ON d.k = regexp_replace(l.path, '[^0-9]', '', 'g')""")
def fallback_match(t):
    p = t("pages").select("page_id", F.regexp_extract("url", r"://[^/]*(/[^?#]*)", 1).alias("path"))
    left, right = p.filter("page_id % 2 = 0"), p.filter("page_id % 2 = 1").select(F.col("page_id").alias("match_id"), "path", F.col("page_id").alias("ord"))
    ks = [F.col("path"), keys.stem(F.col("path")), keys.first_number(F.col("path"))]
    return rel.fallback_match(left, right, ks, ks, "match_id", "ord", [True, True, False]).select("page_id", "match_id", "level")


@query("""
    SELECT coalesce(a.i, b.i)::BIGINT AS position, c_custkey, s_suppkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer) a
    FULL JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey DESC) - 1 AS i FROM supplier) b ON a.i = b.i""")
def zip_join(t):
    return rel.zip_join(t("customer").select("c_custkey"), t("supplier").select("s_suppkey"), ["c_custkey"], [F.desc("s_suppkey")])


@query("SELECT l_orderkey, count(*) AS claims FROM (SELECT l_partkey, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY 1) GROUP BY 1")
def scatter_min(t):
    return agg.first_claims(t("lineitem"), "l_partkey", "l_orderkey")


@query("""
    SELECT count(*) AS n, round(quantile_cont(r, 0.5), 4) AS scale, round((quantile_cont(r, 0.75) - quantile_cont(r, 0.25)) / quantile_cont(r, 0.5), 4) AS spread
    FROM (SELECT l_extendedprice / p_retailprice AS r FROM lineitem JOIN part ON p_partkey = l_partkey) WHERE r > 0""")
def scale_fit(t):
    j = t("lineitem").join(t("part").hint("merge"), F.col("p_partkey") == F.col("l_partkey"))  # part grows with lineitem: no broadcast through the driver
    return agg.scale_fit(j, F.col("l_extendedprice") / F.col("p_retailprice")).select("n", F.round("scale", 4).alias("scale"), F.round("spread", 4).alias("spread"))


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY floor(l_quantity / 5), floor(l_discount / 0.02) ORDER BY l_orderkey * 10 + l_linenumber) AS r FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem)) WHERE r = 1".replace("l_discount / 0.02", "(l_discount * 250) / 5"))
def voxel_fixed(t):
    li = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_discount") * 250).alias("d"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return agg.voxels(li, ["l_quantity", "d"], 5.0, "ord").select("l_orderkey", "l_linenumber")


@query()
def voxel_bisect(t):
    li = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_discount") * 250).alias("d"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return agg.voxel_downsample(li, ["l_quantity", "d"], 200, "ord").select("l_orderkey", "l_linenumber")


@query("""
    WITH a AS (SELECT n_regionkey AS path, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS k, count(*) OVER (PARTITION BY n_regionkey) AS m, (n_nationkey * 7 % 11)::DOUBLE AS p FROM nation),
    s AS (SELECT path, j, j * (m - 1) / 47.0::DOUBLE AS u, least(floor(j * (m - 1) / 47.0::DOUBLE)::INT, m - 2) AS k, m FROM (SELECT DISTINCT path, m FROM a), range(48) r(j)),
    g AS (SELECT s.path, s.j, s.u - s.k AS t, coalesce(a0.p, 2 * a1.p - a2.p) AS p0, a1.p AS p1, a2.p AS p2, coalesce(a3.p, 2 * a2.p - a1.p) AS p3 FROM s JOIN a a1 ON a1.path = s.path AND a1.k = s.k JOIN a a2 ON a2.path = s.path AND a2.k = s.k + 1
          LEFT JOIN a a0 ON a0.path = s.path AND a0.k = s.k - 1 LEFT JOIN a a3 ON a3.path = s.path AND a3.k = s.k + 2)
    SELECT path, j::INT AS j, round(0.5 * (2 * p1 + (p2 - p0) * t + (2 * p0 - 5 * p1 + 4 * p2 - p3) * t * t + (3 * p1 - p0 - 3 * p2 + p3) * t * t * t), 4) AS p FROM g""")
def spline(t):
    a = t("nation").select(F.col("n_regionkey").alias("path"), "n_nationkey", (F.col("n_nationkey") * 7 % 11).cast("double").alias("p"))
    return od.spline_samples(a, ["path"], "n_nationkey", ["p"], 48).select("path", "j", F.round("p", 4).alias("p"))


@query("""
    WITH g AS (SELECT n_nationkey AS k, (gx + 0.5) / 7 * 1000 AS px, (gy + 0.5) / 7 * 1000 AS py FROM nation, range(7) a(gx), range(7) b(gy)),
    v AS (SELECT s_nationkey AS k, s_acctbal / 1000 AS z FROM supplier),
    h AS (SELECT g.k, px, py, bool_or(coalesce(CASE WHEN z > 0 THEN (400 * (px / 1000 - 0.5) / z + 500) BETWEEN 8 AND 992 AND (400 * (py / 1000 - 0.5) / z + 500) BETWEEN 8 AND 992 END, false)) AS hit FROM g JOIN v USING (k) GROUP BY ALL)
    SELECT k, round(avg(hit::INT), 4) AS coverage FROM h GROUP BY k""")
def coverage_grid(t):
    size = t("nation").select(F.col("n_nationkey").alias("k"), F.lit(1000.0).alias("w"))
    rays = ras.ray_grid(size, 7, "w", "w").join(t("supplier").select(F.col("s_nationkey").alias("k"), (F.col("s_acctbal") / 1000).alias("z")), "k")
    c = [F.lit(float(x)) for x in (400, 400, 500, 500, 1000, 1000)]
    hit = ras.inside_view(F.col("px") / 1000 - 0.5, F.col("py") / 1000 - 0.5, F.col("z"), *c, 8)
    return ras.coverage(rays, "k", ["px", "py"], hit).select("k", F.round("coverage", 4).alias("coverage"))


@query("SELECT user_id, (CASE WHEN i = 0 THEN 0 ELSE (i + 3) // 4 END)::BIGINT AS g, round(avg(value), 4) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events) GROUP BY 1, 2")
def chunk_mean(t):
    from pyspark.sql import Window

    e = t("events").withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    return e.groupBy("user_id", od.latent_group(F.col("i")).alias("g")).agg(F.round(F.avg("value"), 4).alias("mean"))


@query("SELECT l_orderkey, l_linenumber, greatest(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0 END, CASE WHEN l_quantity >= 25 THEN 0.5 ELSE 0.0 END)::DOUBLE AS mask FROM lineitem")
def mask_mix(t):
    hole = F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)
    region = F.when(F.col("l_quantity") >= 25, 1.0).otherwise(0.0)
    return t("lineitem").select("l_orderkey", "l_linenumber", ras.weighted_mix(hole, region, 0.5).alias("mask"))


_PIXELS = "p AS (SELECT l_linenumber AS frame, floor(l_quantity / 4)::INT AS y, round_even(l_discount * 100, 0)::INT AS x, max(l_tax) AS v FROM lineitem GROUP BY ALL)"


def _pixels(t):
    li = t("lineitem")
    return li.groupBy(F.col("l_linenumber").alias("frame"), F.floor(F.col("l_quantity") / 4).cast("int").alias("y"), F.rint(F.col("l_discount") * 100).cast("int").alias("x")).agg(F.max("l_tax").alias("v"))


@query(f"""
    WITH {_PIXELS}, s AS (SELECT a.frame, -4 * a.v + b.v + c.v + d.v + e.v AS l FROM p a JOIN p b ON b.frame = a.frame AND b.y = a.y - 1 AND b.x = a.x JOIN p c ON c.frame = a.frame AND c.y = a.y + 1 AND c.x = a.x
        JOIN p d ON d.frame = a.frame AND d.y = a.y AND d.x = a.x - 1 JOIN p e ON e.frame = a.frame AND e.y = a.y AND e.x = a.x + 1)
    SELECT f.frame, round(coalesce(var_pop(l), 0), 6) AS sharpness FROM (SELECT DISTINCT frame FROM p) f LEFT JOIN s ON s.frame = f.frame GROUP BY 1""")
def sharp_pixels(t):
    return ras.sharpness(_pixels(t), "frame", "v").select("frame", F.round("sharpness", 6).alias("sharpness"))


@query(f"""
    WITH {_PIXELS} SELECT a.frame, ((a.y + dy + 13) % 13)::INT AS y, ((a.x + dx + 11) % 11)::INT AS x, max(a.v) AS v FROM p a, range(-1, 2) r(dy), range(-1, 2) s(dx) GROUP BY 1, 2, 3""")
def dilate_wrap(t):
    return ras.dilate(_pixels(t), "frame", "v", 1, 13, 11)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) ORDER BY o_orderkey LIMIT 5")
def queue_head(t):
    done = t("lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return rel.remaining(t("orders").select("o_orderkey"), done, "o_orderkey", "o_orderkey", 5)


@query("SELECT c_custkey, CASE WHEN s_acctbal IS NULL OR c_nationkey < 5 THEN c_acctbal ELSE s_acctbal END AS c_acctbal FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def prior_values(t):
    prior = t("supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"))
    return rel.prior_values(t("customer").select("c_custkey", "c_acctbal", "c_nationkey"), prior, "c_custkey", ["c_acctbal"], F.col("c_nationkey") < 5).select("c_custkey", "c_acctbal")


@query("SELECT threshold, (SELECT count(*) FROM lineitem WHERE l_discount >= threshold) / (SELECT count(*) FROM lineitem)::DOUBLE AS share FROM (SELECT unnest([0.02::DOUBLE, 0.05, 0.08]) AS threshold)")
def threshold_shares(t):
    return agg.threshold_shares(t("lineitem"), "l_discount", [0.02, 0.05, 0.08])


@query("WITH m AS (SELECT median(l_quantity) AS a, median(l_tax) AS b FROM lineitem) SELECT round(sqrt(max((l_quantity - a) ** 2 + (l_tax - b) ** 2)), 6) AS radius FROM lineitem, m")
def scene_radius(t):
    return agg.scene_radius(t("lineitem"), ["l_quantity", "l_tax"]).select(F.round("radius", 6).alias("radius"))


@query("SELECT round(least(quantile_cont(v, 0.03), -0.05), 6) AS floor, round(greatest(quantile_cont(v, 0.97), 0.05), 6) AS ceiling FROM (SELECT value / 100 - 0.5 AS v FROM events)")
def robust_band(t):
    out = agg.robust_band(t("events").select((F.col("value") / 100 - 0.5).alias("v")), "v")
    return out.select(F.round("floor", 6).alias("floor"), F.round("ceiling", 6).alias("ceiling"))


@query("SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS held FROM events")
def carry_forward(t):
    e = t("events").withColumn("v", F.when(F.col("event_type") == "purchase", F.col("value")))
    return od.carried(e, ["user_id"], "event_id", "v", "held").select("user_id", "event_id", "held")


@query("""
    SELECT s_suppkey, round(degrees(2 * atan(1920 / (2 * fx))), 4) AS hfov, round(fx, 4) AS fx FROM (SELECT s_suppkey, (18 + s_suppkey % 50) / 36.0::DOUBLE * 1920 AS fx FROM supplier)""")
def lens_fov(t):
    s = t("supplier").select("s_suppkey", camera.lens((18 + F.col("s_suppkey") % 50).cast("double"), F.lit(36.0), F.lit(1920.0), F.lit(1080.0)).alias("l"))
    return s.select("s_suppkey", F.round("l.hfov", 4).alias("hfov"), F.round("l.fx", 4).alias("fx"))


@query("""
    WITH q AS (SELECT c_custkey, cos(c_custkey / 10.0) AS w, sin(c_custkey / 10.0) AS z, (c_acctbal / 1000)::DOUBLE AS tx, (c_nationkey)::DOUBLE AS ty FROM customer)
    SELECT c_custkey, round(-((1 - 2 * z * z) * tx + 2 * w * z * ty), 3) AS x, round(-(-2 * w * z * tx + (1 - 2 * z * z) * ty), 3) AS y FROM q""")
def camera_centre(t):
    c = t("customer")
    r = camera.rotation(F.cos(F.col("c_custkey") / 10.0), F.lit(0.0), F.lit(0.0), F.sin(F.col("c_custkey") / 10.0))
    x, y, _ = camera.centre(r, (F.col("c_acctbal") / 1000, F.col("c_nationkey").cast("double"), F.lit(0.0)))
    return c.select("c_custkey", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("""
    WITH split AS (SELECT o_custkey AS k FROM orders GROUP BY 1 HAVING bool_or(o_orderstatus = 'F') AND bool_or(o_orderstatus <> 'F')),
    new AS (SELECT k, (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY k) AS id FROM split JOIN customer ON c_custkey = k)
    SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' AND id IS NOT NULL THEN id ELSE o_custkey END AS camera_id FROM orders LEFT JOIN new ON k = o_custkey""")
def clone_repoint(t):
    images = t("orders").select("o_orderkey", F.col("o_custkey").alias("camera_id"), "o_orderstatus")
    cameras = t("customer").select(F.col("c_custkey").alias("camera_id"), "c_name")
    return rel.cloned_cameras(cameras, images, "camera_id", F.col("o_orderstatus") == "F")[1].select("o_orderkey", "camera_id")


@query("""
    WITH split AS (SELECT o_custkey AS k FROM orders GROUP BY 1 HAVING bool_or(o_orderstatus = 'F') AND bool_or(o_orderstatus <> 'F'))
    SELECT c_custkey AS camera_id, c_name FROM customer UNION ALL
    SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY k), c_name FROM split JOIN customer ON c_custkey = k""")
def clone_cameras(t):
    images = t("orders").select("o_orderkey", F.col("o_custkey").alias("camera_id"), "o_orderstatus")
    cameras = t("customer").select(F.col("c_custkey").alias("camera_id"), "c_name")
    return rel.cloned_cameras(cameras, images, "camera_id", F.col("o_orderstatus") == "F")[0]


@query("""
    SELECT l_orderkey, l_linenumber FROM lineitem JOIN part ON p_partkey = l_partkey
    WHERE abs((l_quantity / (l_linenumber * 7)) / (p_size / 10.0::DOUBLE) - 1) > 0.01""")
def aspect_mismatch(t):
    j = t("lineitem").join(t("part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    return rel.aspect_mismatches(j, F.col("l_quantity"), F.col("l_linenumber") * 7, F.col("p_size"), F.lit(10)).select("l_orderkey", "l_linenumber")


@query("""
    SELECT round_even(l_quantity / p_size, 3) AS ratio, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey
    WHERE abs((l_quantity / l_linenumber) / (p_size / 5.0::DOUBLE) - 1) <= 0.01 GROUP BY 1""")
def rescale_ratio(t):
    j = t("lineitem").join(t("part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    return rel.rescale_groups(j, F.col("l_quantity"), F.col("l_linenumber"), F.col("p_size"), F.lit(5))


#: Not from the reference, but built into Spark: grouping sets and event-time windows.
@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def extra_rollup(t):
    return t("lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def extra_hourly(t):
    w = t("events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("hour"), "event_type", "n")
