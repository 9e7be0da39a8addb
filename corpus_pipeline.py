"""The corpus pipeline: documents in, packed sequences out. Each stage is written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbisloom.llm import exact_dedup, near_dup, toxicity
from orbisloom.llm.common import fresh_path
from orbisloom.llm.packing import pack_documents
from orbisloom.llm.substring import remove_repeats


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents predicted toxic go."""
    scored = toxicity.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), prefix="__toxic_")
    return scored.filter("__toxic_predicted = 0").select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of equal texts the row with the largest doc_id stays."""
    return exact_dedup.kept_documents(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of each near-duplicate group the document with the smallest doc_id stays."""
    return near_dup.kept_documents(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: passages that repeat go from the texts; texts without any are left as they are."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = remove_repeats(docs, keep=others, keep_text=True, prefix="__repeat_")
    shorter = F.col("__repeat_n_removed") > 0
    out = cut.withColumn("text", F.when(shorter, F.col("__repeat_kept")).otherwise(F.col("text")))
    if "n_chars" in others:
        out = out.withColumn("n_chars", F.when(shorter, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the documents that are left, packed."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dup", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("packing", pack_sequences),
]

#: Neither votes of nearest neighbours nor signatures and packing are SQL; tests/llm compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each but the last keeps is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
