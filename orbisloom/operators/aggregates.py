"""Aggregations: modes, histograms, robust statistics, voxels, sectors and scores."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import even_sample, held
from .selection import group_percentiles, percentiles


def densest_bucket(df: DataFrame, columns: list[str], edge: float | Column, order: str) -> DataFrame:
    """(n, mean of each column): the fullest cell of rint(x / edge), the one with the smallest `order` on ties."""
    keys = [F.rint(F.col(c) / edge).alias(f"_k{i}") for i, c in enumerate(columns)]
    cells = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"), *[F.avg(c).alias(c) for c in columns])
    return cells.orderBy(F.desc("n"), "_first").limit(1).select("n", *columns)


def extent(df: DataFrame, columns: list[str]) -> DataFrame:
    """The longest side of the bounding box; 1 for a single row."""
    spans = df.agg(F.count(F.lit(1)).alias("n"), *[(F.max(c) - F.min(c)).alias(c) for c in columns])
    widest = F.greatest(*columns) if len(columns) > 1 else F.col(columns[0])
    return spans.select(F.when(F.col("n") <= 1, F.lit(1.0)).otherwise(widest.cast("double")).alias("extent"))


def scene_radius(df: DataFrame, columns: list[str]) -> DataFrame:
    """The greatest distance from the point of the columns' medians; null without rows."""
    middle = [percentiles(df, c, [0.5])[0] for c in columns]
    square = sum((F.col(c) - F.lit(m)) ** 2 for c, m in zip(columns, middle))
    return df.agg(F.sqrt(F.max(square)).alias("radius"))


def histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """(bin, low, high, n): rows in each half-open bin, those with rows only. The bin is found by counting edges, not by a join."""
    number = sum(F.when(F.col(value) >= F.lit(e), 1).otherwise(0) for e in edges) - 1
    low = F.element_at(F.array(*map(F.lit, map(float, edges))), F.col("bin") + 1)
    high = F.element_at(F.array(*map(F.lit, map(float, edges))), F.col("bin") + 2)
    inside = df.filter((F.col(value) >= F.lit(edges[0])) & (F.col(value) < F.lit(edges[-1])))
    return inside.groupBy(number.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n")).select("bin", low.alias("low"), high.alias("high"), "n")


def majority(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The commonest value of the keys and its count; on ties the one seen first."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first")).orderBy(F.desc("n"), "_first").limit(1).drop("_first")


def deviants(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows that don't have the commonest value."""
    top = majority(df, keys, order).drop("n")
    return df.join(F.broadcast(top), keys, "left_anti")  # one row


def whole_group_rule(df: DataFrame, group: str, hit: Column, least: int) -> DataFrame:
    """Rows of groups in which at least so many rows are hits."""
    full = df.groupBy(group).agg(F.count_if(hit).alias("_h")).filter(F.col("_h") >= least).select(group)
    return df.join(full, group, "left_semi")


def common_divisor(sizes: DataFrame, size: str) -> DataFrame:
    """The greatest common divisor of a column of positive whole numbers; no rows for an empty table.

    Each pass takes the least remainder by the divisor so far, which it then shares; so the divisor halves at least with
    each pass, and one is right when it leaves no remainder."""
    spark = sizes.sparkSession
    divisor = sizes.agg(F.min(size)).first()[0]
    if divisor is None:
        return spark.range(0).select(F.col("id").alias("gcd"))
    while True:
        rest = F.col(size) % divisor
        least = sizes.agg(F.min(F.when(rest > 0, rest))).first()[0]
        if least is None:
            return spark.range(1).select(F.lit(int(divisor)).cast("long").alias("gcd"))
        divisor = gcd(int(divisor), int(least))


def scale_fit(df: DataFrame, ratio: Column, least: int = 20) -> DataFrame:
    """(n, scale, spread): median and quartile range over median of the positive ratios; null with fewer than `least`.

    The ratios are held, as each pass for the percentiles would join the tables behind them again."""
    good = held(df.select(ratio.cast("double").alias("_r")).filter("_r > 0"))
    low, middle, high = percentiles(good, "_r", [0.25, 0.5, 0.75])
    fine = F.col("n") >= least
    spread = (F.lit(high) - F.lit(low)) / F.lit(middle)
    return good.agg(F.count(F.lit(1)).alias("n")).select("n", F.when(fine, F.lit(middle)).alias("scale"), F.when(fine, spread).alias("spread"))


def mean_direction(df: DataFrame, columns: list[str]) -> DataFrame:
    """The mean of the columns and its length, which is 1 where all rows agree."""
    means = df.agg(*[F.avg(c).alias(c) for c in columns])
    return means.withColumn("strength", F.sqrt(sum(F.col(c) * F.col(c) for c in columns)))


def first_claims(hits: DataFrame, item: str, order: str) -> DataFrame:
    """(order, claims): how many items each takes first, when takers come in order."""
    return hits.groupBy(item).agg(F.min(order).alias(order)).groupBy(order).agg(F.count(F.lit(1)).alias("claims"))


def threshold_shares(df: DataFrame, value: str, thresholds: list[float]) -> DataFrame:
    """(threshold, share) of rows whose value is at least each threshold, in one pass."""
    counts = df.agg(F.count(value).alias("n"), *[F.count_if(F.col(value) >= t).alias(f"t{i}") for i, t in enumerate(thresholds)])
    rows = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.try_divide(F.col(f"t{i}"), F.col("n")).alias("share")) for i, t in enumerate(thresholds)]))
    return counts.select(rows.alias("_r")).select("_r.*")


def ranked_scores(df: DataFrame, group: str, gain: Column, drift: Column) -> DataFrame:
    """(group, n, mean_gain, mean_drift, score) by descending (gain - 1) - 0.1 * drift; NaN gains don't count."""
    g = F.nanvl(gain.cast("double"), F.lit(None).cast("double"))
    out = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(g).alias("mean_gain"), F.avg(drift).alias("mean_drift"))
    return out.withColumn("score", (F.col("mean_gain") - 1) - 0.1 * F.col("mean_drift")).orderBy(F.desc_nulls_last("score"), group)


def sector_of(x: Column, y: Column, sectors: int = 32) -> Column:
    """The sector of an azimuth: truncated towards zero, then wrapped."""
    return F.pmod((F.atan2(y, x) / F.lit(6.283185307179586) * sectors).cast("int"), F.lit(sectors))


def sector_ranges(points: DataFrame, x: str, y: str, sectors: int = 32, share: float = 0.1, least: int = 3) -> DataFrame:
    """(sector, clearance): a low percentile of the range in each sector; sectors with few points get the median of the
    others, or 1 when there is none."""
    r = F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y))
    ranges = points.select(sector_of(F.col(x), F.col(y), sectors).alias("sector"), r.alias("_r"))
    found = group_percentiles(ranges, ["sector"], "_r", [share])
    found = found.select("sector", F.when(F.col("n") >= least, F.col("p0")).alias("_p"))
    middle = found.agg(F.coalesce(F.median("_p"), F.lit(1.0)).alias("_m"))
    every = points.sparkSession.range(sectors).select(F.col("id").cast("int").alias("sector"))
    return every.join(found, "sector", "left").crossJoin(F.broadcast(middle)).select("sector", F.coalesce("_p", "_m").alias("clearance"))  # one row per sector


def voxels(points: DataFrame, columns: list[str], edge: float, order: str) -> DataFrame:
    """The row of the smallest `order` in each cube of the given edge."""
    from .ordered import first_per_key

    cell = points.select("*", *[F.floor(F.col(c) / F.lit(float(edge))).alias(f"_v{i}") for i, c in enumerate(columns)])
    return first_per_key(cell, [f"_v{i}" for i in range(len(columns))], [order]).select(*points.columns)


def voxel_downsample(points: DataFrame, columns: list[str], budget: int, order: str, rounds: int = 20) -> DataFrame:
    """About `budget` rows, one per voxel, by bisection of the edge (geometric midpoints); an even sample of the best try
    if that is still too many. Every round is one distinct count over the points, of which the driver sees a number."""
    total = points.count()
    if total <= budget:
        return points
    ends = [percentiles(points, c, [0.01, 0.99]) for c in columns]
    span = max(max(high - low for low, high in ends), 1e-9)
    low, high, tolerance, best = span / 4096, span, max(1, budget // 40), None
    for _ in range(rounds):
        edge = (low * high) ** 0.5
        n = points.select(*[F.floor(F.col(c) / F.lit(edge)) for c in columns]).distinct().count()
        if best is None or abs(n - budget) < abs(best[1] - budget):
            best = edge, n
        if abs(n - budget) <= tolerance:
            break
        low, high = (edge, high) if n > budget else (low, edge)
    out = voxels(points, columns, best[0], order)
    return even_sample(out, [order], budget, half_even=False) if best[1] > budget else out


def robust_band(points: DataFrame, value: str) -> DataFrame:
    """(floor, ceiling): the 3rd and 97th percentile, the floor at most -0.05 and the ceiling at least 0.05."""
    low, high = percentiles(points, value, [0.03, 0.97])
    return points.sparkSession.range(1).select(F.least(F.lit(low), F.lit(-0.05)).alias("floor"), F.greatest(F.lit(high), F.lit(0.05)).alias("ceiling"))


def stage_totals(metrics: DataFrame, stage: list[str], seconds: str, frames: int) -> DataFrame:
    """Total seconds per stage, per frame, and as a share of all."""
    out = metrics.groupBy(*stage).agg(F.sum(seconds).alias("total"))
    whole = out.agg(F.sum("total").alias("_all"))
    return out.crossJoin(F.broadcast(whole)).select(*stage, "total", (F.col("total") / frames).alias("per_frame"), F.try_divide("total", "_all").alias("share"))


def fingerprints(df: DataFrame, group: list[str], content: list[str]) -> DataFrame:
    """(group, n, fingerprint): changes when a row of the group comes, goes or changes; the rows' order doesn't count.

    The 256-bit digests of the rows are added up in four parts of 60 bits, which combine before the shuffle, and the sums and
    the number of rows are hashed again. So no task gathers a group, and a group's mark can be brought up to date by adding.
    Nulls differ from empty texts."""
    text = F.to_json(F.array(*[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in content]))
    parts = [F.conv(F.substring(F.sha2(text, 256), 15 * k + 1, 15), 16, 10).cast("decimal(38,0)") for k in range(4)]
    sums = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *[F.sum(p).alias(f"_s{k}") for k, p in enumerate(parts)])
    mark = F.sha2(F.concat_ws(",", F.col("n").cast("string"), *[F.col(f"_s{k}").cast("string") for k in range(4)]), 256)
    return sums.select(*group, "n", mark.alias("fingerprint"))
