"""Exact dedup: a tree-merge of sorted digest runs, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, join_groups

#: Each round merges 2**RADIX_BITS runs into one; there are as many rounds as it takes to bring all runs together.
RADIX_BITS = 4


def merge_runs(rows: DataFrame, radix_bits: int = RADIX_BITS) -> DataFrame:
    """Merges (digest, check, id) rows into one row per digest: min_id, max_id and group_size.

    Each input partition is a run, on a lane of its own; lanes are numbered with digits of radix_bits bits, in as many
    rounds as there are digits. In round r the lanes that differ only in digit r exchange their runs: an entry goes to the
    lane that has the digest's digit r there, and that lane merges the 2**radix_bits sorted runs that arrive. After the
    last round a digest stands on the lane of its own digits and nowhere else. Identifiers are kept as the smallest and
    largest struct of id and check; structs have Spark sort and merge (SortAggregate) on both sides of each exchange, so
    a run leaves its lane sorted and with one entry per digest, and no lane holds more than its share of the digests.

    At every level the entries that meet must agree in `check`, a second and independent hash of the text; otherwise the
    query fails instead of merging different texts. An empty table gives an empty result. rows is read twice.
    """
    radix = 2**radix_bits
    several = rows.select(F.spark_partition_id().alias("run")).agg(F.coalesce(F.max("run"), F.lit(0)) + 1).first()[0]
    rounds = 1
    while radix**rounds < several:
        rounds += 1
    entry = F.struct("id", "check")
    runs = rows.select("digest", entry.alias("lo"), entry.alias("hi"), F.lit(1).cast("long").alias("n"), F.spark_partition_id().alias("lane"))
    home = F.pmod(F.xxhash64("digest"), F.lit(radix**rounds)).cast("int")
    for r in range(rounds):
        step = radix**r
        digit = lambda c, s=step: F.floor(c / F.lit(s)).cast("int") % F.lit(radix)
        to = (F.col("lane") - digit(F.col("lane")) * step + digit(home) * step).cast("int")
        merged = runs.withColumn("lane", to).groupBy("lane", "digest").agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"), F.min("lo.check").alias("c0"), F.max("hi.check").alias("c1"),
            F.min("hi.check").alias("c2"), F.max("lo.check").alias("c3"),
        )
        agree = (F.col("c0") == F.col("c1")) & (F.col("c0") == F.col("c2")) & (F.col("c0") == F.col("c3"))
        count = F.when(agree, F.col("n")).otherwise(F.raise_error(F.lit("different texts have one digest")).cast("long"))
        runs = merged.select("digest", "lo", "hi", count.alias("n"), "lane")
    return runs.select("digest", F.col("lo.id").alias("min_id"), F.col("hi.id").alias("max_id"), F.col("n").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after lower-casing A-Z; a null text counts as empty, so empty and null texts
    are one group. keep is "smallest" or "largest": which identifier of a group stays. Rows that repeat both identifier
    and text share one decision, and count singly in group_size. A null identifier never wins over another; a group
    of null identifiers only is kept. An empty table gives an empty result. Other columns are ignored.
    """
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = cut(docs.select(F.col(id_col).alias("id"), F.sha2(norm, 256).alias("digest"), F.xxhash64(norm).alias("check")))
    groups = cut(merge_runs(rows))
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    several = groups.filter("group_size > 1").select("digest", F.col("max_id" if keep == "largest" else "min_id").alias("keep_id"), "group_size")
    out = join_groups(rows.select("id", "digest"), several, "digest", "group_size", total)
    keep_id = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return out.select(
        F.col("id").alias(id_col), keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep_id.eqNullSafe(F.col("id")).alias("kept"), F.col("digest").alias("text_sha256"),
    )


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of docs that exact_dedup() keeps, with all their columns.

    Null and empty texts are one group; long texts count whole. Rows that repeat both id and text stay or go together; a
    null id goes where its group has another. An empty table stays empty, and columns may have any names.
    """
    out = exact_dedup(docs.select(id_col, text_col), id_col, text_col, keep).filter("not kept")
    gone = out.select(F.col(id_col).alias("gone_id"), F.col("text_sha256").alias("gone_digest"))
    digest = F.sha2(ascii_lower(F.coalesce(docs[text_col], F.lit(""))), 256)
    return docs.join(gone, (docs[id_col].eqNullSafe(gone["gone_id"])) & (digest == gone["gone_digest"]), "left_anti")
