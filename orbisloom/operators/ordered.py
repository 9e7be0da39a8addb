"""Order-aware operators: positions, strides, ranks, gaps and islands, bounds, folds, fills and sampling."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Ranges up to this number are broadcast; more are sorted in among the rows.
BROADCAST_BOUNDS = 50_000


def held(df: DataFrame) -> DataFrame:
    """df evaluated once: a reliable checkpoint where a checkpoint folder is set, else a cache on memory and disk."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is not None:
        return df.checkpoint()
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def with_position(df: DataFrame, order: list[str | Column], name: str = "position") -> DataFrame:
    """Numbers all rows from 0 in the given order, which must be unique, without bringing them to one task.

    The rows are range-sorted; a row's number is its place within its partition plus the sizes of those before it (a table
    with a row per partition). The sorted rows are held, because a second sort may cut the ranges elsewhere."""
    marked = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    marked = held(marked.withColumn("_part", F.shiftright("_at", 33).cast("int")).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = marked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")  # a row per partition
    return marked.join(F.broadcast(before), "_part").withColumn(name, F.col("_at") + F.col("_before")).drop("_at", "_part", "_before")


def stride_group(df: DataFrame, group: list[str], order: list[str], every: int, drop_partial: bool = False) -> DataFrame:
    """Every n-th row of each group in order. With drop_partial a row stays only when a whole stride follows it (itself
    included)."""
    if every < 1:
        raise ValueError("every must be 1 or more")
    # places over (group, order) less the group's first place, so that a large group is dealt over many tasks
    at = with_position(df, [*group, *order], "_i")
    keys = [F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]
    sizes = at.groupBy(*keys).agg(F.min("_i").alias("_first"), F.count(F.lit(1)).alias("_n"))
    same = F.lit(True)
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    at = at.join(sizes, same).withColumn("_i", F.col("_i") - F.col("_first"))
    keep = F.col("_i") % every == 0
    if drop_partial:
        keep = keep & (F.col("_i") < F.col("_n") - (every - 1))
    return at.filter(keep).select(*df.columns)


def every_nth(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return with_position(df, order, "_i").filter(F.col("_i") % n == 0).drop("_i")


def top(df: DataFrame, order: list[Column | str], k: int) -> DataFrame:
    """The first k rows; all of them, sorted, when k is 0. Order needs a tie-break of its own."""
    return df.orderBy(*order).limit(k) if k else df.orderBy(*order)


def rank_by_damage(df: DataFrame, ratio: str, order: list[str], k: int) -> DataFrame:
    """Ascending by ratio, where a missing one (null or NaN) counts as 1."""
    return top(df, [F.coalesce(F.nanvl(F.col(ratio).cast("double"), F.lit(None)), F.lit(1.0)), *order], k)


def rank_by_displacement(df: DataFrame, distance: str, order: list[str], k: int) -> DataFrame:
    return top(df, [F.col(distance).desc(), *order], k)


def first_per_key(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key, the first in order; by a minimum of structs, so it combines before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    asc = [F.col(o) if isinstance(o, str) else o for o in order]
    best = F.min(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(asc)], *[F.col(c) for c in rest])).alias("_best")
    return df.groupBy(*key).agg(best).select(*key, *[F.col(f"_best.{c}").alias(c) for c in rest]).select(*df.columns)


def gaps_and_islands(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, first, last, n): maximal runs of consecutive whole numbers, repeats ignored."""
    # places over (group, value): value less place is the same within a run, and a large group is dealt over many tasks
    at = with_position(df.select(*group, value).distinct(), [*group, value], "_i")
    runs = at.withColumn("_run", F.col(value) - F.col("_i")).drop("_i")
    return runs.groupBy(*group, "_run").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count(F.lit(1)).alias("n")).drop("_run")


def cumulative_bounds(sizes: DataFrame, order: str, size: str) -> DataFrame:
    """Adds `low` and `high`: the half-open range that each row takes of the running total; for small tables of lengths."""
    high = F.sum(size).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return sizes.withColumn("high", high).withColumn("low", F.col("high") - F.col(size))


def in_bounds(rows: DataFrame, at: str, bounds: DataFrame, key: str) -> DataFrame:
    """rows with the key of the range that holds `at`; what lies in none, as beyond the end, gets the last range's. Ranges don't
    overlap. Up to BROADCAST_BOUNDS of them are broadcast; more are sorted in among the rows."""
    last = bounds.agg(F.max_by(key, "high").alias("_last"))
    b = bounds.select(key, "low", "high").filter("high > low")
    if b.count() <= BROADCAST_BOUNDS:
        hit = rows.join(F.broadcast(b), (F.col(at) >= F.col("low")) & (F.col(at) < F.col("high")), "left")
    else:
        begun = b.select(F.col("low").alias(at), F.struct(key, "high").alias("_b"))
        met = latest_before(rows, begun, at, "_b")
        hit = met.withColumn(key, F.when(F.col(at) < F.col("_b.high"), F.col(f"_b.{key}"))).withColumns({"low": F.lit(None), "high": F.lit(None)}).drop("_b")
    hit = hit.crossJoin(F.broadcast(last))  # one row
    return hit.withColumn(key, F.coalesce(F.col(key), F.col("_last"))).drop("low", "high", "_last")


def latest_before(rows: DataFrame, marks: DataFrame, at: str, value: str) -> DataFrame:
    """rows with `value` of the latest mark (at, value) at or before `at`; null when there is none.

    Both are range-sorted together; a row takes the last mark of its own part, or else what the parts before end with, a table
    with a row per part. Marks have different places and no null values."""
    left = rows.withColumn("_side", F.lit(1)).withColumn(value, F.lit(None).cast(marks.schema[value].dataType))
    both = left.unionByName(marks.select(at, value).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    both = held(both.orderBy(at, "_side").withColumn("_part", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id()))
    ends = both.groupBy("_part").agg(F.max_by(value, F.when(F.col("_side") == 0, F.col("_n"))).alias("_end"))
    before = F.last("_end", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select("_part", before.alias("_before"))  # a row per part
    own = F.last(value, ignorenulls=True).over(Window.partitionBy("_part").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_own", own).filter("_side = 1").join(F.broadcast(ends), "_part")
    return found.withColumn(value, F.coalesce("_own", "_before")).drop("_side", "_part", "_n", "_own", "_before")


def as_of(rows: DataFrame, marks: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """rows with `value` of the latest mark at or before `at` within the same `by`; null when there is none. A union sorted
    once: no range join. Of marks at one moment the largest value counts."""
    left = rows.withColumn("_side", F.lit(1)).withColumn(f"_{value}", F.lit(None).cast(marks.schema[value].dataType))
    right = marks.groupBy(*by, at).agg(F.max(value).alias(f"_{value}")).withColumn("_side", F.lit(0))
    both = left.unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(f"_{value}", ignorenulls=True).over(w)).filter("_side = 1").drop("_side", f"_{value}")


def _carried_through(steps: DataFrame, fan: int) -> DataFrame:
    """(i, in): what comes in to each step of a sequence numbered without gaps.

    A step (i, first, last, x, rate, sum) belongs to the groups first to last and makes rate * in + sum of what comes in: the
    result of the step before if that ends in its own first group, else x. Steps in a row are such a step again, so `fan` of
    them at a time are made one until few are left, and what comes in is handed down again."""
    n = steps.count()
    run = steps.groupBy(F.floor(F.col("i") / fan).alias("up")).agg(F.array_sort(F.collect_list(F.struct("i", "first", "last", "x", "rate", "sum"))).alias("run"))
    one, rest = F.col("run")[0], F.slice("run", 2, fan)

    def joined(a: Column, b: Column) -> Column:
        on = a["last"].eqNullSafe(b["first"])
        rate = F.when(on, a["rate"] * b["rate"]).otherwise(F.lit(0.0))
        total = F.when(on, b["rate"] * a["sum"] + b["sum"]).otherwise(b["rate"] * b["x"] + b["sum"])
        return F.struct(a["i"].alias("i"), a["first"].alias("first"), b["last"].alias("last"), a["x"].alias("x"), rate.alias("rate"), total.alias("sum"))

    if n > fan:
        runs = held(run)
        whole = runs.select("up", F.aggregate(rest, one, joined).alias("w")).select(F.col("up").alias("i"), "w.first", "w.last", "w.x", "w.rate", "w.sum")
        run = runs.join(_carried_through(whole, fan).withColumnRenamed("i", "up"), "up")
    else:
        run = run.withColumn("in", one["x"])
    start = F.struct(F.col("in").alias("g"), one["first"].alias("last"), F.array().cast("array<double>").alias("ins"))

    def taken(acc: Column, e: Column) -> Column:
        g = F.when(acc["last"].eqNullSafe(e["first"]), acc["g"]).otherwise(e["x"])
        return F.struct((e["rate"] * g + e["sum"]).alias("g"), e["last"].alias("last"), F.concat(acc["ins"], F.array(g)).alias("ins"))

    pairs = F.arrays_zip(F.transform("run", lambda e: e["i"]).alias("i"), F.aggregate("run", start, taken)["ins"].alias("in"))
    return run.select(F.explode(pairs).alias("p")).select("p.i", "p.in")


def moving_average(df: DataFrame, group: list[str], order: list[str], value: str, weight: float, name: str = "ema", chunk: int = 64) -> DataFrame:
    """Exponential moving average in order, g = weight * x + (1 - weight) * g, the first value of a group as it is.

    Rows are numbered over all groups and handed on in chunks of `chunk`, chunks of chunks and so on, whatever the groups'
    sizes: no task ever gathers a group, and a row's work doesn't grow with its group."""
    at = with_position(df, [*group, *order], "_i")
    key = F.struct(*group) if group else F.lit(1)
    x, keep = F.col(value).cast("double"), 1.0 - weight
    steps = at.select(F.col("_i").alias("i"), key.alias("first"), key.alias("last"), x.alias("x"), F.lit(keep).alias("rate"), (weight * x).alias("sum"))
    come = _carried_through(steps, chunk).withColumnRenamed("i", "_i")
    g = F.when(F.col("in") == x, x).otherwise(weight * x + keep * F.col("in"))  # what comes in to a group's first value is that value
    return at.join(come, "_i").withColumn(name, g).drop("_i", "in")


def circular_minimum(df: DataFrame, index: str, value: str, size: int, name: str) -> DataFrame:
    """The least value of each of `size` sectors and its two neighbours around the circle; nulls don't count."""
    steps = df.select(F.explode(F.array(*[F.pmod(F.col(index) + d, F.lit(size)) for d in (-1, 0, 1)])).alias(index), F.col(value).alias("_v"))
    return df.join(steps.groupBy(index).agg(F.min("_v").alias(name)), index, "left")


def separated(items: Column, least: float, turn: float = 360.0) -> Column:
    """Of an array of angles, in order, those at least `least` from all accepted before (around the circle)."""
    apart = lambda a, b: F.abs(F.pmod(a - b + turn / 2, F.lit(turn)) - turn / 2)
    return F.aggregate(items, F.array().cast("array<double>"), lambda acc, x: F.when(F.forall(acc, lambda q: apart(q, x) >= least), F.concat(acc, F.array(x))).otherwise(acc))


def filled_targets(df: DataFrame, path: list[str], order: str, positions: list[str], targets: list[str]) -> DataFrame:
    """Missing targets become the next anchor's position; the last one's goes on in the direction that it was reached."""
    w = Window.partitionBy(*path).orderBy(order)
    for p, t in zip(positions, targets):
        ahead, behind = F.lead(p).over(w), F.lag(p).over(w)
        df = df.withColumn(t, F.coalesce(F.col(t), ahead, 2 * F.col(p) - behind, F.col(p)))
    return df


def carried(df: DataFrame, group: list[str], order: str, value: str, name: str) -> DataFrame:
    """The last value that isn't null, up to each row."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def even_sample(df: DataFrame, order: list[str], m: int, half_even: bool = True) -> DataFrame:
    """At most m rows spread evenly over all, the first and last included; all of them when there are no more than m."""
    n = df.count()
    if n <= m:
        return df
    spark = df.sparkSession
    j = F.col("id").cast("double") * (F.lit(n - 1) / F.lit(max(1, m - 1)))
    picks = spark.range(m).select((F.rint(j) if half_even else F.floor(j)).cast("long").alias("_i")).distinct()
    return with_position(df, order, "_i").join(F.broadcast(picks), "_i").drop("_i")  # m rows


def chunk_index(index: Column, size: int) -> Column:
    return F.floor(index / size)


def latent_group(index: Column, size: int = 4) -> Column:
    """The first alone, then groups of `size`."""
    return F.when(index == 0, F.lit(0)).otherwise(F.floor((index + size - 1) / size)).cast("long")


def gradient(df: DataFrame, group: list[str], order: str, value: str, name: str, wrap: float | None = None) -> DataFrame:
    """Central differences, one-sided at the ends; steps of more than half of `wrap` are jumps across a seam and count 0."""
    w = Window.partitionBy(*group).orderBy(order)
    ahead, behind = F.lead(value).over(w), F.lag(value).over(w)
    g = F.when(ahead.isNull(), F.col(value) - behind).when(behind.isNull(), ahead - F.col(value)).otherwise((ahead - behind) / 2)
    if wrap:
        g = F.when(F.abs(g) > wrap / 2, F.lit(0.0)).otherwise(g)
    return df.withColumn(name, g)


def spline_samples(anchors: DataFrame, path: list[str], order: str, values: list[str], n: int) -> DataFrame:
    """(path, j, values): n points of a uniform Catmull-Rom spline through each path's anchors, both ends reflected; a line
    for two anchors. Samples meet their anchors in an equi-join on the segment."""
    from ..functions.camera import spline_point

    w = Window.partitionBy(*path).orderBy(order)
    a = anchors.withColumn("_k", F.row_number().over(w) - 1).withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy(*path)))
    for v in values:
        before, after, after2 = F.lag(v).over(w), F.lead(v).over(w), F.lead(v, 2).over(w)
        a = a.withColumn(f"_{v}0", F.coalesce(before, 2 * F.col(v) - after)).withColumn(f"_{v}2", after).withColumn(f"_{v}3", F.coalesce(after2, 2 * after - F.col(v)))
    segments = a.filter(F.col("_k") < F.col("_m") - 1)
    u = lambda j, m: j * (m - 1) / F.lit(float(max(1, n - 1)))
    counts = anchors.groupBy(*path).agg(F.count(F.lit(1)).alias("_m2")).filter("_m2 > 1").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    counts = counts.withColumn("_u", u(F.col("j"), F.col("_m2"))).withColumn("_k", F.least(F.floor("_u"), F.col("_m2") - 2).cast("int")).withColumn("_t", F.col("_u") - F.col("_k"))
    met = counts.join(segments.drop("_m"), [*path, "_k"])
    point = lambda v: F.when(F.col("_m2") == 2, F.col(v) + (F.col(f"_{v}2") - F.col(v)) * F.col("_t")).otherwise(spline_point(F.col(f"_{v}0"), F.col(v), F.col(f"_{v}2"), F.col(f"_{v}3"), F.col("_t")))
    return met.select(*path, "j", *[point(v).alias(v) for v in values])


def first_occurrence(items: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of repeated keys the first in order stays."""
    return first_per_key(items, [key], order)
