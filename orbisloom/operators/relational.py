"""Joins, audits, nested-array filters and identifier work. Every operator takes column names and returns a DataFrame."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import with_position

#: A side of a nested-loop join is broadcast only up to so many rows; beyond it the join is dealt out by blocks.
BROADCAST_ROWS = 50_000


def audit(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every key of either side with in_left and in_right. Null keys of a side are one key, equal to the other side's."""
    a = left.select(key).distinct().withColumn("in_left", F.lit(True))
    b = right.select(F.col(key).alias("_k")).distinct().withColumn("in_right", F.lit(True))
    both = a.join(b, a[key].eqNullSafe(b["_k"]), "full_outer")
    return both.select(F.coalesce(F.col(key), F.col("_k")).alias(key), F.coalesce("in_left", F.lit(False)).alias("in_left"), F.coalesce("in_right", F.lit(False)).alias("in_right"))


def present(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_semi")


def orphans(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_anti")


def split_users(links: DataFrame, owner: str, kept: Column) -> DataFrame:
    """Owners with both kept and other links."""
    return links.groupBy(owner).agg(F.bool_or(kept).alias("_a"), F.bool_or(~kept).alias("_b")).filter("_a and _b").select(owner)


def cloned_cameras(cameras: DataFrame, images: DataFrame, camera_id: str, kept: Column) -> tuple[DataFrame, DataFrame]:
    """(cameras, images): a camera that both kept and other images use gets a copy, numbered beyond the largest id in the order
    of ids, to which its other images point. Images without a camera in the table stay as they are."""
    split = cameras.join(split_users(images, camera_id, kept), camera_id, "left_semi").select(camera_id)
    top = cameras.agg(F.coalesce(F.max(camera_id), F.lit(0)).alias("_top"))
    placed = with_position(split, [camera_id], "_n").crossJoin(F.broadcast(top))
    new = placed.select(F.col(camera_id).alias("_old"), (F.col("_top") + F.col("_n") + 1).cast(cameras.schema[camera_id].dataType).alias("_new"))
    copies = cameras.join(new, F.col(camera_id) == F.col("_old")).withColumn(camera_id, F.col("_new")).select(*cameras.columns)
    moved = images.join(new, (F.col(camera_id) == F.col("_old")) & ~kept, "left")
    return cameras.unionByName(copies), moved.withColumn(camera_id, F.coalesce("_new", camera_id)).select(*images.columns)


def aspect_mismatches(frames: DataFrame, width: Column, height: Column, ref_width: Column, ref_height: Column, tolerance: float = 0.01) -> DataFrame:
    """Frames whose aspect is off from the reference's by more than a share; a null size or a height of 0 is no mismatch."""
    aspect = lambda w, h: w.cast("double") / F.nullif(h.cast("double"), F.lit(0.0))
    return frames.filter(F.abs(aspect(width, height) / F.nullif(aspect(ref_width, ref_height), F.lit(0.0)) - 1) > tolerance)


def rescale_groups(frames: DataFrame, width: Column, height: Column, ref_width: Column, ref_height: Column, tolerance: float = 0.01) -> DataFrame:
    """(ratio, n): frames of the reference's aspect by how much wider they are, rounded to 3 places (half to even)."""
    sizes = frames.select(*[c.cast("double").alias(n) for c, n in zip((width, height, ref_width, ref_height), ("w", "h", "rw", "rh"))])
    sizes = sizes.filter("w > 0 AND h > 0 AND rw > 0 AND rh > 0").filter(F.abs((F.col("w") / F.col("h")) / (F.col("rw") / F.col("rh")) - 1) <= tolerance)
    return sizes.groupBy(F.bround(F.col("w") / F.col("rw"), 3).alias("ratio")).agg(F.count(F.lit(1)).alias("n"))


def strip_tracks(tracks: DataFrame, key: str, member: str, gone: DataFrame, keep_empty: bool = True) -> DataFrame:
    """(key, n): members that stay of each track after those in `gone` (same column name) are taken out; tracks that become
    empty stay with n = 0, or go."""
    marked = tracks.join(gone.select(member).distinct().withColumn("_gone", F.lit(True)), member, "left")
    out = marked.groupBy(key).agg(F.count(F.when(F.col("_gone").isNull(), F.lit(1))).alias("n"))
    return out if keep_empty else out.filter("n > 0")


def strip_nested(df: DataFrame, key: str, array_col: str, field: str, gone: DataFrame, gone_col: str) -> DataFrame:
    """The same on a nested array of structs, of rows with a unique key: elements whose field is in `gone` are taken out, the
    order stays, and a null array becomes an empty one."""
    items = df.select(F.col(key).alias("_key"), F.posexplode(array_col).alias("_pos", "_item"))
    out = gone.select(F.col(gone_col).alias("_gone")).distinct()
    items = items.join(out, F.col("_item")[field] == F.col("_gone"), "left_anti")
    kept = items.groupBy("_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_item"))), lambda x: x["_item"]).alias("_kept"))
    empty = F.array().cast(df.schema[array_col].dataType)
    return df.join(kept, F.col(key) == F.col("_key"), "left").withColumn(array_col, F.coalesce("_kept", empty)).select(*df.columns)


def filter_sequences(sequences: Column, gone: Column) -> Column:
    """Nested lists without the names in the array `gone`; lists that become empty go."""
    return F.filter(F.transform(sequences, lambda s: F.filter(s, lambda n: ~F.array_contains(gone, n))), lambda s: F.size(s) > 0)


def dangling_to(observations: DataFrame, points: DataFrame, id_col: str, none: int = -1) -> DataFrame:
    """Observations whose point is gone get `none`; those that had none keep it."""
    there = points.select(F.col(id_col).alias("_id")).distinct()
    out = observations.join(there, observations[id_col] == there["_id"], "left")
    return out.withColumn(id_col, F.coalesce(F.col("_id"), F.lit(none).cast(observations.schema[id_col].dataType))).drop("_id")


def offset_union(old: DataFrame, new: DataFrame, ids: dict[str, list[str]]) -> DataFrame:
    """old, and new with its identifiers moved beyond old's: ids maps each identifier column to the columns of new that refer
    to it (itself too). Negative and null references stay. The offsets are old's maxima, 0 for an empty table."""
    tops = old.agg(*[F.greatest(F.coalesce(F.max(c), F.lit(0)), F.lit(0)).alias(f"_top_{c}") for c in ids])
    moved = new.crossJoin(F.broadcast(tops))  # one row
    for c, refers in ids.items():
        for r in refers:
            moved = moved.withColumn(r, F.when(F.col(r) >= 0, F.col(r) + F.col(f"_top_{c}")).otherwise(F.col(r)).cast(old.schema[r].dataType))
    return old.unionByName(moved.select(*old.columns))


def dense_ids(df: DataFrame, signature: list[str | Column], order: str, name: str = "new_id", first: int = 1) -> DataFrame:
    """df with a number for each distinct signature, in the order of the signatures' first use. `order` must be unique."""
    keys = [F.col(s) if isinstance(s, str) else s for s in signature]
    df = df.withColumn("_sig", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]))
    uses = df.groupBy("_sig").agg(F.min(order).alias("_first"))
    numbered = with_position(uses, ["_first"], name).withColumn(name, F.col(name) + first).drop("_first")
    numbered = numbered.withColumnRenamed("_sig", "_sig2")
    return df.join(numbered, df["_sig"].eqNullSafe(numbered["_sig2"])).drop("_sig", "_sig2")


def usable_views(views: DataFrame, sizes: DataFrame, name: str, frame: str, kept: list[int], limit: int = 0) -> DataFrame:
    """Views whose size is known, in order of name, without those of the kept frames (a view without a frame isn't kept back); the
    first `limit` of them, all for 0."""
    back = F.coalesce(F.col(frame).isin(kept), F.lit(False)) if kept else F.lit(False)
    found = present(views, sizes, name).filter(~back).orderBy(name)
    return found.limit(limit) if limit else found


def reuse_or_allocate(wanted: DataFrame, existing: DataFrame, signature: list[Column], id_col: str, order: str) -> DataFrame:
    """wanted with the id of an existing row of equal signature (the smallest), else new ids beyond the largest, by first use."""
    keyed = lambda d: d.withColumn("_sig", F.to_json(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(signature)])))
    known = keyed(existing).groupBy("_sig").agg(F.min(id_col).alias("_id"))
    found = keyed(wanted.drop(id_col)).join(known, "_sig", "left")
    fresh = with_position(found.filter("_id is null").groupBy("_sig").agg(F.min(order).alias("_first")), ["_first"], "_n").drop("_first")
    top = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_top"))
    out = found.join(fresh, "_sig", "left").crossJoin(F.broadcast(top))
    return out.withColumn(id_col, F.coalesce("_id", F.col("_top") + F.col("_n") + 1)).drop("_sig", "_id", "_n", "_top")


def _packed(rows: DataFrame, key: str, vector: str, block: int, prefix: str) -> DataFrame:
    """(<prefix>block, <prefix>keys, <prefix>flat): rows in order of key, `block` of them to a row, with all their numbers."""
    at = with_position(rows.select(F.col(key).alias("_k"), F.col(vector).cast("array<double>").alias("_v")), ["_k"], "_n")
    blocks = at.groupBy(F.floor(F.col("_n") / block).alias(f"{prefix}block")).agg(F.array_sort(F.collect_list(F.struct("_n", "_k", "_v"))).alias("_rows"))
    return blocks.select(f"{prefix}block", F.col("_rows._k").alias(f"{prefix}keys"), F.flatten("_rows._v").alias(f"{prefix}flat"))


def nearest_by_cosine(queries: DataFrame, pool: DataFrame, key: str, vector: str, pool_key: str, block: int = 1024) -> DataFrame:
    """(key, pool_key, cosine): for each query the pool row of the largest dot product of unit vectors, the smallest pool key
    on ties (to 12 digits). A vector without length has cosines of 0. Vectors are as long as each other; null ones are left out.

    Both sides are packed into blocks, and each pair of blocks is one product of matrices of which only the best of each query
    goes on. A small pool's blocks are broadcast, a large one's are dealt to all blocks of queries."""
    q = _packed(queries.filter(F.col(vector).isNotNull()), key, vector, block, "q")
    p = _packed(pool.filter(F.col(vector).isNotNull()), pool_key, vector, block, "p")
    n = pool.count()
    if n <= BROADCAST_ROWS:
        met = q.crossJoin(F.broadcast(p))
    else:
        met = q.withColumn("pblock", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // block)))).join(p, "pblock")

    def units(keys: pa.Array, flat: pa.Array, i: int) -> tuple[pa.Array, np.ndarray]:
        names = keys[i].values
        rows = flat[i].values.to_numpy(zero_copy_only=False).reshape(len(names), -1)
        size = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
        return names, rows / np.where(size > 0, size, 1.0)

    def run(batches):
        for batch in batches:
            sides = [batch.column(c) for c in ("qkeys", "qflat", "pkeys", "pflat")]
            for i in range(batch.num_rows):
                (asked, a), (names, b) = units(*sides[:2], i), units(*sides[2:], i)
                cosine = a @ b.T
                best = np.round(cosine, 12).argmax(axis=1)  # the first in order of key
                found = cosine[np.arange(len(a)), best]
                yield pa.RecordBatch.from_arrays([asked, names.take(pa.array(best)), pa.array(found)], [key, pool_key, "cosine"])

    kinds = queries.schema[key].dataType.simpleString(), pool.schema[pool_key].dataType.simpleString()
    best = met.select("qkeys", "qflat", "pkeys", "pflat").mapInArrow(run, f"`{key}` {kinds[0]}, `{pool_key}` {kinds[1]}, cosine double")
    first = F.min(F.struct((-F.round("cosine", 12)).alias("d"), F.col(pool_key).alias("p"))).alias("_b")
    return best.groupBy(key).agg(first, F.max("cosine").alias("cosine")).select(key, F.col("_b.p").alias(pool_key), "cosine")


def distance_join(left: DataFrame, right: DataFrame, columns: list[tuple[str, str]], most: float) -> DataFrame:
    """Pairs whose points lie within `most` (inclusive) of each other: both sides are cut into cells of that size, so only
    neighbouring cells meet in an equi-join. columns pairs the coordinates; names must differ between the sides."""
    if most <= 0:
        raise ValueError("the distance must be above 0")
    cell = lambda c: F.floor(F.col(c) / F.lit(float(most))).cast("long")
    a = left
    b = right.withColumn("_step", F.explode(F.array(*[F.array(*map(F.lit, s)) for s in product((-1, 0, 1), repeat=len(columns))])))
    for i, (x, y) in enumerate(columns):
        a, b = a.withColumn(f"_c{i}", cell(x)), b.withColumn(f"_c{i}", cell(y) + F.col("_step")[i])
    keys = [f"_c{i}" for i in range(len(columns))]
    square = sum((F.col(x) - F.col(y)) * (F.col(x) - F.col(y)) for x, y in columns)
    return a.join(b.drop("_step"), keys).filter(square <= most * most).drop(*keys)


def generated_pairs(new: DataFrame, old: DataFrame, new_key: str, old_key: str, stride: int) -> DataFrame:
    """(a, b): every new key with every stride-th old one (by key order), and all unordered pairs of new keys."""
    strided = with_position(old.select(F.col(old_key).alias("b")), ["b"], "_n").filter(F.col("_n") % stride == 0).drop("_n")
    fresh = new.select(F.col(new_key).alias("a"))
    return fresh.crossJoin(strided).union(fresh.join(fresh.select(F.col("a").alias("b")), F.col("a") < F.col("b")))


def fallback_match(left: DataFrame, right: DataFrame, left_keys: list[Column], right_keys: list[Column], right_id: str, order: str, last_wins: list[bool]) -> DataFrame:
    """left with right_id and `level`: the right row that matches on the first level possible (level 0, 1, ...), null when none
    does. Each level first keeps one right row for a key: the one of the smallest `order`, or the largest."""
    out = left
    for i, (a, b, last) in enumerate(zip(left_keys, right_keys, last_wins)):
        pick = (F.max_by if last else F.min_by)(right_id, order)
        one = right.select(b.alias(f"_k{i}"), right_id, order).filter(F.col(f"_k{i}").isNotNull()).groupBy(f"_k{i}").agg(pick.alias(f"_m{i}"))
        out = out.withColumn(f"_l{i}", a).join(one, F.col(f"_l{i}") == F.col(f"_k{i}"), "left").drop(f"_l{i}", f"_k{i}")
    found = [F.col(f"_m{i}") for i in range(len(left_keys))]
    level = F.coalesce(*[F.when(m.isNotNull(), F.lit(i)) for i, m in enumerate(found)])
    return out.select(*left.columns, F.coalesce(*found).alias(right_id), level.alias("level"))


def zip_join(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows of both sides side by side by their position; `position` counts from 0 and either side is null beyond its end."""
    return with_position(left, left_order, "position").join(with_position(right, right_order, "position"), "position", "full_outer")


def prior_values(rows: DataFrame, prior: DataFrame, key: str, columns: list[str], refresh: Column) -> DataFrame:
    """Columns taken from an earlier row of the same key, except where `refresh` is true or there is none."""
    old = prior.select(key, *[F.col(c).alias(f"_old_{c}") for c in columns]).dropDuplicates([key]).withColumn("_had", F.lit(True))
    out = rows.join(old, key, "left")
    for c in columns:
        out = out.withColumn(c, F.when(refresh | F.col("_had").isNull(), F.col(c)).otherwise(F.col(f"_old_{c}")))
    return out.drop("_had", *[f"_old_{c}" for c in columns])


def remaining(todo: DataFrame, done: DataFrame, key: str, order: str, limit: int | None = None) -> DataFrame:
    """What isn't done yet, in order; the head of the queue with a limit."""
    out = orphans(todo, done, key)
    return out.orderBy(order).limit(limit) if limit else out
