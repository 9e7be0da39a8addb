"""Exact percentiles by distributed selection: no task and no buffer ever holds a column.

A column of numbers is searched by ranges. Each pass cuts the ranges that still hold a rank that is asked for into BUCKETS
parts and counts the rows of each part, so the rows stay where they are and only counts move. A range is done when it holds
one value, and a double has 64 bits, so there are at most seven passes; most columns need two or three.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import with_position

#: Parts of a range in a pass, and rows of a range that are sorted at once where no more are left in it.
BUCKETS, FEW = 1024, 4096


def _counted(df: DataFrame, value: str, low: float, high: float) -> list[tuple[float, float, int]]:
    """(least, greatest, rows) of the parts of [low, high] that have rows, in order."""
    wide = high / BUCKETS - low / BUCKETS
    part = F.least(F.floor((F.col(value) / BUCKETS - low / BUCKETS) / F.lit(wide) * BUCKETS), F.lit(BUCKETS - 1)) if wide > 0 else F.lit(0)
    inside = df.filter(F.col(value).between(low, high)).groupBy(part.alias("_part"))
    rows = inside.agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(F.lit(1)).alias("n")).collect()  # at most BUCKETS
    return sorted((r.low, r.high, r.n) for r in rows)


def order_statistics(df: DataFrame, value: str, ranks: Sequence[int]) -> dict[int, float]:
    """The values at the given ranks (from 0) of a column of finite doubles without nulls."""
    ends = df.agg(F.min(value), F.max(value), F.count(F.lit(1))).first()
    if ends[2] == 0:
        return {}
    found, open_ranges = {}, [(ends[0], ends[1], ends[2], 0, sorted(set(ranks)))]
    while open_ranges:
        low, high, n, before, wanted = open_ranges.pop()
        if low == high:
            found.update(dict.fromkeys(wanted, low))
        elif n <= FEW:
            few = sorted(r[0] for r in df.filter(F.col(value).between(low, high)).select(value).collect())  # at most FEW
            found.update({k: few[k - before] for k in wanted})
        else:
            for least, most, count in _counted(df, value, low, high):
                here = [k for k in wanted if before <= k < before + count]
                if here:
                    open_ranges.append((least, most, count, before, here))
                before += count
    return found


def percentiles(df: DataFrame, value: str | Column, shares: Sequence[float]) -> list[float | None]:
    """Exact percentiles with linear interpolation between neighbours; nulls and NaN don't count, and of nothing they are null.

    The input is read once a pass: hold it first if it is costly."""
    column = value if isinstance(value, Column) else F.col(value)
    clean = df.select(column.cast("double").alias("_v")).filter("_v is not null and not isnan(_v) and abs(_v) < double('infinity')")
    n = clean.count()
    if not n:
        return [None] * len(shares)
    places = [s * (n - 1) for s in shares]
    at = order_statistics(clean, "_v", [k for p in places for k in (int(p), min(int(p) + 1, n - 1))])
    out = []
    for p in places:
        low, high, part = at[int(p)], at[min(int(p) + 1, n - 1)], p - int(p)
        out.append(low if part == 0 else (1 - part) * low + part * high)
    return out


def group_percentiles(df: DataFrame, group: list[str], value: str, shares: Sequence[float]) -> DataFrame:
    """(group, n, p0, p1, ...): exact percentiles in each group; nulls don't count.

    Rows are numbered over (group, value) by a range sort, which cuts a large group into many parts; a percentile is one or
    two rows of known numbers."""
    keys = [F.col(g) for g in group]
    at = with_position(df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")), [*group, "_v"], "_i")
    sizes = at.groupBy(*keys).agg(F.min("_i").alias("_first"), F.count(F.lit(1)).alias("n"))
    rows = F.array(*[F.lit(float(s)) for s in shares])
    wanted = sizes.select(*keys, "n", "_first", F.posexplode(rows).alias("_k", "_share"))
    place = F.col("_share") * (F.col("n") - 1)
    wanted = wanted.withColumns({"_low": F.floor(place), "_part": place - F.floor(place)})
    asked = wanted.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "n", "_k", "_part", F.explode(F.array(
        F.struct((F.col("_first") + F.col("_low")).alias("_i"), (1 - F.col("_part")).alias("w")),
        F.struct((F.col("_first") + F.least(F.col("_low") + 1, F.col("n") - 1)).alias("_i"), F.col("_part").alias("w")),
    )).alias("_a"))
    met = asked.select("*", "_a._i", "_a.w").drop("_a").join(at.select("_i", "_v"), "_i")
    names = [f"_g{i}" for i in range(len(group))]
    part = lambda k: F.sum(F.when(F.col("_k") == k, F.col("w") * F.col("_v"))).alias(f"p{k}")
    out = met.groupBy(*names, "n").agg(*[part(k) for k in range(len(shares))])
    return out.select(*[F.col(x).alias(g) for x, g in zip(names, group)], "n", *[f"p{k}" for k in range(len(shares))])
