"""Renaming, remapping, picking and reporting over tables of names and documents."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import first_per_key


def renamed_keys(keys: DataFrame, key: str, suffixes: dict[str, str]) -> DataFrame:
    """keys with `new_key`: the first suffix that fits is replaced, null where none does."""
    out = F.lit(None).cast("string")
    for old, new in reversed(list(suffixes.items())):
        out = F.when(F.col(key).endswith(old), F.concat(F.expr(f"substring(`{key}`, 1, length(`{key}`) - {len(old)})"), F.lit(new))).otherwise(out)
    return keys.withColumn("new_key", out)


def module_paths(keys: DataFrame, key: str, patterns: list[tuple[str, str]]) -> DataFrame:
    """Distinct paths after a chain of replacements."""
    path = F.col(key)
    for pattern, to in patterns:
        path = F.regexp_replace(path, pattern, to)
    return keys.select(path.alias("path")).distinct()


def remapped_ids(nodes: DataFrame, id_col: str, allowed: DataFrame, allowed_col: str, old_prefix: str, new_prefix: str) -> DataFrame:
    """nodes with `status` and `new_id`: ids of the old prefix are mapped when the new one is allowed, else dropped; others are
    skipped."""
    new = F.concat(F.lit(new_prefix), F.expr(f"substring(`{id_col}`, {len(old_prefix) + 1})"))
    n = nodes.withColumn("_new", F.when(F.col(id_col).startswith(old_prefix), new))
    n = n.join(allowed.select(F.col(allowed_col).alias("_ok")).distinct(), F.col("_new") == F.col("_ok"), "left")
    status = F.when(F.col("_new").isNull(), "skipped").when(F.col("_ok").isNull(), "dropped").otherwise("mapped")
    return n.withColumn("status", status).withColumn("new_id", F.when(F.col("_ok").isNotNull(), F.col("_new")).otherwise(F.col(id_col))).drop("_new", "_ok")


def remap_documents(docs: DataFrame, text: str, mapping: dict[str, str], fields: tuple[str, ...] = ("type", "class_type")) -> DataFrame:
    """docs with `moved`: ids in the named fields anywhere in a JSON document are replaced by the mapping and counted. Invalid
    JSON stays as it is with a null count."""

    def walk(x, n):
        if isinstance(x, dict):
            for k, v in list(x.items()):
                if k in fields and isinstance(v, str) and v in mapping:
                    x[k] = mapping[v]
                    n[0] += 1
                else:
                    walk(v, n)
        elif isinstance(x, list):
            for v in x:
                walk(v, n)

    def run(frames):
        for f in frames:
            out, moved = [], []
            for t in f[text]:
                try:
                    data, n = json.loads(t), [0]
                    walk(data, n)
                    out.append(json.dumps(data) if n[0] else t)
                    moved.append(n[0])
                except (TypeError, ValueError):
                    out.append(t)
                    moved.append(None)
            yield f.assign(**{text: out, "moved": pd.array(moved, "Int64")})

    schema = ", ".join([*(f"`{c.name}` {c.dataType.simpleString()}" for c in docs.schema), "moved long"])
    return docs.mapInPandas(run, schema)


def complete_folders(files: DataFrame, folder: str, name: str, wanted: list[str], priority: Column) -> DataFrame:
    """The folders that hold all files wanted, the first by priority on top."""
    full = files.filter(F.col(name).isin(wanted)).groupBy(folder).agg(F.count_distinct(name).alias("_n")).filter(F.col("_n") == len(wanted)).drop("_n")
    return full.orderBy(priority, folder)


def resolved_folders(candidates: DataFrame, request: str, folder: str, priority: str, files: DataFrame, sibling: str = "_lowres") -> DataFrame:
    """(request, folder, why): for each request the first candidate by priority that holds files (`files`), else the first that has a
    folder of its name and `sibling` with files (`sibling`), else null (`missing`). files has a column `folder`."""
    have = files.select(F.col("folder").alias("_have")).distinct()
    c = candidates.join(have, F.col(folder) == F.col("_have"), "left").withColumn("_own", F.col("_have").isNotNull()).drop("_have")
    c = c.join(have, F.concat(F.col(folder), F.lit(sibling)) == F.col("_have"), "left").withColumn("_side", F.col("_have").isNotNull()).drop("_have")
    best = F.min(F.when(F.col("_own") | F.col("_side"), F.struct((~F.col("_own")).alias("_second"), F.col(priority).alias("_p"), F.col(folder).alias("_f"))))
    out = c.groupBy(request).agg(best.alias("_b"))
    why = F.when(F.col("_b").isNull(), "missing").when(F.col("_b._second"), "sibling").otherwise("files")
    return out.select(request, F.col("_b._f").alias(folder), why.alias("why"))


def resolved_rails(roots: DataFrame, request: str, root: str, priority: str, files: DataFrame, shared: str, named: str, strict: bool = True) -> DataFrame:
    """(request, path, why): the rail under a request's roots. Of files (folder, name): the one whose name fits the pattern
    `named`; without any, the one called `shared` in the first root by priority, which may be another's and is marked so.

    Several named ones are ambiguous and none at all is missing: both fail the query when strict, else the path is null."""
    met = roots.join(files.select(F.col("folder").alias("_folder"), "name"), F.col(root) == F.col("_folder"), "left")
    path = F.concat_ws("/", root, "name")
    fits, common = F.coalesce(F.col("name").rlike(named), F.lit(False)), F.coalesce(F.col("name") == shared, F.lit(False))
    out = met.groupBy(request).agg(
        F.count_distinct(F.when(fits, path)).alias("_n"), F.min(F.when(fits, path)).alias("_named"),
        F.min(F.when(common, F.struct(F.col(priority).alias("_p"), path.alias("_path")))).alias("_shared"),
    )
    why = F.when(F.col("_n") == 1, "named").when(F.col("_n") > 1, "ambiguous").when(F.col("_shared").isNotNull(), "shared").otherwise("missing")
    out = out.select(request, F.when(F.col("_n") == 1, F.col("_named")).when(F.col("_n") == 0, F.col("_shared._path")).alias("path"), why.alias("why"))
    if not strict:
        return out
    wrong = F.raise_error(F.concat(F.lit("rail of "), F.col(request).cast("string"), F.lit(": "), F.col("why")))
    return out.withColumn("path", F.when(F.col("why").isin("ambiguous", "missing"), wrong.cast("string")).otherwise(F.col("path")))


def largest_model(models: DataFrame, by: str, folder: str) -> DataFrame:
    """The row of the largest `by` (a count of images, or a file size), the first folder on ties."""
    return models.orderBy(F.desc(by), folder).limit(1)


def latest_outputs(frames: DataFrame, stem: str, outputs: DataFrame, name: str) -> DataFrame:
    """(stem, name): the last output by name whose name is the stem followed by `_` or a dot; null without any."""
    key = F.regexp_extract(F.col(name), r"^(.*?)(?:_[^_]*)?\.[^.]*$", 1)
    last = outputs.groupBy(key.alias("_stem")).agg(F.max(name).alias(name))
    return frames.join(last, F.col(stem) == F.col("_stem"), "left").select(stem, name)


def observed_points(observations: DataFrame, images: DataFrame, points: DataFrame) -> DataFrame:
    """Points that any of the images sees; ids of 0 and below don't count."""
    seen = observations.filter("point3d_id > 0").join(images.select("image_id"), "image_id", "left_semi").select("point3d_id").distinct()
    return points.join(seen, "point3d_id", "left_semi")


def first_backups(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Backups of which the first for a key is never replaced."""
    return existing.unionByName(new.join(existing.select(key), key, "left_anti").dropDuplicates([key]))


def merged_manifests(manifests: list[DataFrame], name: str) -> DataFrame:
    """The distinct names of all, in order."""
    out = manifests[0].select(name)
    for m in manifests[1:]:
        out = out.unionByName(m.select(name))
    return out.distinct().orderBy(name)


def removable(sources: DataFrame, staged: DataFrame, keys: list[str]) -> DataFrame:
    """Source files of which a staged copy of the same size exists."""
    return sources.join(staged.select(*keys), keys, "left_semi")


def changed_knobs(old: Column, new: Column) -> Column:
    """Names whose values differ between two maps of texts, or that only one has; sorted."""
    same = F.transform(F.array_intersect(F.map_entries(old), F.map_entries(new)), lambda e: e["key"])
    return F.array_sort(F.array_except(F.array_union(F.map_keys(old), F.map_keys(new)), same))


def markdown_table(df: DataFrame, order: list[str]) -> DataFrame:
    """One text column: a Markdown table's lines, in order."""
    cols = df.columns
    head = df.sparkSession.createDataFrame([(0, "| " + " | ".join(cols) + " |"), (1, "|" + " --- |" * len(cols))], "_i int, line string")
    from .ordered import with_position

    body = with_position(df, order, "_i").select((F.col("_i") + 2).cast("int").alias("_i"), F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]), F.lit(" |")).alias("line"))
    return head.union(body).orderBy("_i").select("line")


def deduplicated_names(rows: DataFrame, name: str, order: str) -> DataFrame:
    return first_per_key(rows, [name], [order])
