"""Filters over whole lines of pixel grids: blurs, differences and box means as one pass along each axis.

A line (a row or a column of a frame) is gathered into arrays by Spark and comes to numpy as a row of a matrix, with the
other lines of its batch. So a pass shuffles each pixel once, whatever the width of the filter, and a task holds a batch of
lines. A grid is whole: pixels that are missing, and nulls, count as 0 and come back as pixels.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Matrices = dict[str, np.ndarray]


def gaussian_kernel(sigma: float) -> list[float]:
    """Weights of a Gaussian over an odd width of about eight sigma, which add up to 1."""
    radius = max(1, int(ceil(sigma * 4)))
    w = [exp(-(k * k) / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def mirrored(at: np.ndarray, size: int) -> np.ndarray:
    """Positions beyond the border, reflected without repeating the edge."""
    period = max(1, 2 * (size - 1))
    at = at % period
    return np.where(at < size, at, period - at)


def along(grid: DataFrame, keys: list[str], axis: str, size: int, values: list[str], made: list[str], how: Callable[[Matrices], Matrices]) -> DataFrame:
    """(keys, y, x, made): how() of the matrices of `values`, a line along `axis` per row of a matrix and `size` columns."""
    other = "x" if axis == "y" else "y"
    by = [*keys, other]
    place = F.struct(F.col(axis).cast("int").alias("_at"), *[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(f"_v{i}") for i, v in enumerate(values)])
    lines = grid.groupBy(*by).agg(F.collect_list(place).alias("_line"))
    lines = lines.select(*by, F.col("_line._at").alias("_at"), *[F.col(f"_line._v{i}").alias(f"_v{i}") for i in range(len(values))])

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            at = batch.column("_at")
            lengths = np.diff(at.offsets.to_numpy())
            flat = np.repeat(np.arange(n), lengths) * size + at.flatten().to_numpy()
            matrices = {}
            for i, v in enumerate(values):
                matrix = np.zeros(n * size)
                matrix[flat] = batch.column(f"_v{i}").flatten().to_numpy()
                matrices[v] = matrix.reshape(n, size)
            found = how(matrices)
            owner = pa.array(np.repeat(np.arange(n), size))
            columns = [batch.column(k).take(owner) for k in by]
            columns += [pa.array(np.tile(np.arange(size, dtype=np.int32), n)), *(pa.array(np.ascontiguousarray(found[m]).ravel()) for m in made)]
            yield pa.RecordBatch.from_arrays(columns, [*by, axis, *made])

    types = {f.name: f.dataType.simpleString() for f in grid.schema}
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in by), f"`{axis}` int", *(f"`{m}` double" for m in made)])
    return lines.mapInArrow(run, schema).select(*keys, "y", "x", *made)


def both_ways(grid: DataFrame, keys: list[str], values: list[str], height: int, width: int, how: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """A separable filter: how() along x and then along y, for every value."""
    step = lambda m: {v: how(a) for v, a in m.items()}
    out = along(grid, keys, "x", width, values, values, step)
    return along(out, keys, "y", height, values, values, step)


def weighted(kernel: list[float]) -> Callable[[np.ndarray], np.ndarray]:
    """The weighted sum over a window around each place, with reflected borders."""
    r = len(kernel) // 2

    def how(a: np.ndarray) -> np.ndarray:
        size, out = a.shape[1], np.zeros_like(a)
        wide = a[:, mirrored(np.arange(-r, size + r), size)]
        for k, w in enumerate(kernel):
            out += w * wide[:, k : k + size]
        return out

    return how


def gaussian(grid: DataFrame, keys: list[str], values: list[str], sigma: float, height: int, width: int) -> DataFrame:
    return both_ways(grid, keys, values, height, width, weighted(gaussian_kernel(sigma)))


def box_mean(grid: DataFrame, keys: list[str], values: list[str], window: int, height: int, width: int) -> DataFrame:
    """The mean over a square window of odd width, with reflected borders."""
    return both_ways(grid, keys, values, height, width, weighted([1 / window] * window))


def laplacians(grid: DataFrame, keys: list[str], values: list[str], height: int, width: int) -> DataFrame:
    """The grid's values with a column <value>_lap each: the five-point Laplacian, with reflected borders."""
    second = weighted([1.0, -2.0, 1.0])
    across = [f"{v}_lap" for v in values]
    out = along(grid, keys, "x", width, values, [*values, *across], lambda m: m | {f"{v}_lap": second(m[v]) for v in values})
    down = lambda m: m | {f"{v}_lap": m[f"{v}_lap"] + second(m[v]) for v in values}
    return along(out, keys, "y", height, [*values, *across], [*values, *across], down)


def area_reduced(grid: DataFrame, keys: list[str], values: list[str], height: int, width: int, to_height: int, to_width: int) -> DataFrame:
    """(keys, y, x, values): means over the cells of a smaller grid. A cell takes every pixel that it touches, so where the sizes
    don't divide, a pixel on a border counts in both cells. Combines before the shuffle."""
    def cells(at: str, size: int, to: int) -> Column:
        first = F.floor(F.col(at).cast("long") * to / size)
        last = F.ceil((F.col(at).cast("long") + 1) * to / size) - 1
        return F.explode(F.sequence(first.cast("int"), last.cast("int")))

    spread = grid.select(*keys, cells("y", height, to_height).alias("_cy"), "x", *values).select(*keys, "_cy", cells("x", width, to_width).alias("_cx"), *values)
    return spread.groupBy(*keys, F.col("_cy").alias("y"), F.col("_cx").alias("x")).agg(*[F.avg(v).alias(v) for v in values])


def quads(grid: DataFrame, keys: list[str], values: list[str], last_y: Column, last_x: Column) -> DataFrame:
    """(keys, y, x, q): for each cell an array of four structs of its own values and those right, below and both (its own
    again beyond the last row or column). With it, a bilinear sample takes one look-up."""
    own = F.struct(*values)
    slot = lambda dy, dx: F.struct((F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.lit(2 * dy + dx).alias("k"), own.alias("v"))
    again_y, again_x = F.col("y") == last_y, F.col("x") == last_x
    extra = lambda dy, dx, k, when: F.when(when, F.struct((F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.lit(k).alias("k"), own.alias("v")))
    sent = F.array(
        slot(0, 0), slot(0, 1), slot(1, 0), slot(1, 1),
        extra(0, 0, 1, again_x), extra(1, 0, 3, again_x), extra(0, 0, 2, again_y), extra(0, 1, 3, again_y), extra(0, 0, 3, again_x & again_y),
    )
    rows = grid.select(*keys, F.explode(F.array_compact(sent)).alias("_s")).select(*keys, "_s.y", "_s.x", "_s.k", "_s.v").filter("y >= 0 and x >= 0")
    out = rows.groupBy(*keys, "y", "x").agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(f"_q{k}") for k in range(4)])
    return out.select(*keys, "y", "x", F.array(*[f"_q{k}" for k in range(4)]).alias("q"))


def blended(q: Column, value: str, fy: Column, fx: Column) -> Column:
    """The bilinear value within a quad, fy and fx from 0 to 1."""
    top = q[0][value] * (1 - fx) + q[1][value] * fx
    return top * (1 - fy) + (q[2][value] * (1 - fx) + q[3][value] * fx) * fy


def enlarged(small: DataFrame, targets: DataFrame, keys: list[str], values: list[str], small_size: tuple[int, int], size: tuple[int, int]) -> DataFrame:
    """targets (keys, y, x, ...) with the values of a smaller grid at the pixel centres, bilinear, edges held."""
    q = quads(small, keys, values, F.lit(small_size[0] - 1), F.lit(small_size[1] - 1))
    q = q.select(*keys, F.col("y").alias("_qy"), F.col("x").alias("_qx"), "q")
    at = lambda c, to, of: F.greatest((F.col(c) + 0.5) * (to / of) - 0.5, F.lit(0.0))
    t = targets.withColumns({"_fy": at("y", small_size[0], size[0]), "_fx": at("x", small_size[1], size[1])})
    t = t.withColumns({"_qy": F.floor("_fy").cast("int"), "_qx": F.floor("_fx").cast("int")})
    met = t.join(q, [*keys, "_qy", "_qx"])
    fy, fx = F.col("_fy") - F.col("_qy"), F.col("_fx") - F.col("_qx")
    return met.select(*targets.columns, *[blended(F.col("q"), v, fy, fx).alias(v) for v in values])
