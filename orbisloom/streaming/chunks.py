"""Chunked file streams, an idempotent sink with resumable progress, and keyed averages on a stream."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def chunk_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 1, glob: str = "*.parquet") -> DataFrame:
    """A bounded pull stream over a folder's files, so many at a time. Files come by modification time: writers that need an
    order must give increasing times, or readers must order by a column of the rows."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", glob).parquet(folder)


class ProgressSink:
    """Writes each micro-batch once and remembers which keys are done.

    A batch goes to `folder`/data/batch=N, replaced as a whole if it runs again, so a batch that was cut off leaves nothing
    twice. A key that an earlier batch wrote is passed over, and of a key within a batch the first in order counts. With
    `names` (a table of expected keys) other keys fail the batch, and complete() tells whether all are there."""

    def __init__(self, folder: str, key: str, order: str, names: DataFrame | None = None, passthrough: DataFrame | None = None):
        self.folder, self.key, self.order, self.names, self.passthrough = folder.rstrip("/"), key, order, names, passthrough

    def _data(self, spark: SparkSession) -> DataFrame | None:
        path = f"{self.folder}/data"
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
        return spark.read.option("basePath", path).parquet(f"{path}/batch=*") if there else None

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if self.names is not None and not batch.join(self.names.select(self.key), self.key, "left_anti").isEmpty():
            raise ValueError("the stream has keys that aren't expected")
        rest = [c for c in batch.columns if c != self.key]
        first = F.min(F.struct(F.col(self.order).alias("_o"), *rest)).alias("_r")
        new = batch.groupBy(self.key).agg(first).select(self.key, *[F.col(f"_r.{c}").alias(c) for c in rest])
        done = self._data(spark)
        if done is not None:
            new = new.join(done.filter(F.col("batch") != number).select(self.key), self.key, "left_anti")
        if self.passthrough is not None:
            flags = self.passthrough.select(self.key).distinct().withColumn("passed", F.lit(True))
            new = new.join(flags, self.key, "left").withColumn("passed", F.coalesce("passed", F.lit(False)))
        new.write.mode("overwrite").parquet(f"{self.folder}/data/batch={number}")

    def written(self, spark: SparkSession) -> DataFrame | None:
        found = self._data(spark)
        return None if found is None else found.drop("batch")

    def complete(self, spark: SparkSession) -> bool:
        found = self.written(spark)
        return self.names is not None and found is not None and self.names.join(found, self.key, "left_anti").isEmpty()


def drain(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs the stream over all that is there now, and stops; a later call with the same checkpoint goes on behind it."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def distinct_stream(stream: DataFrame, key: str) -> DataFrame:
    """Each key once, across batches; the state holds every key."""
    return stream.dropDuplicates([key])


def average_stream(stream: DataFrame, key: str, order: str, value: str, weight: float) -> DataFrame:
    """(key, order, ema) with the average carried from batch to batch, one state per key. Batches must come in order; rows
    within a batch are ordered here."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        g = state.get[0] if state.exists else None
        rows = pd.concat(frames).sort_values(order)
        out = []
        for x in rows[value]:
            g = x if g is None else weight * x + (1 - weight) * g
            out.append(g)
        state.update((float(g),))
        yield pd.DataFrame({key: [k[0]] * len(out), order: rows[order].to_numpy(), "ema": out})

    types = {f.name: f.dataType.simpleString() for f in stream.schema}
    schema = f"{key} {types[key]}, {order} {types[order]}, ema double"
    return stream.select(key, order, F.col(value).cast("double")).groupBy(key).applyInPandasWithState(step, schema, "ema double", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, at: str, group: str, late: str = "10 minutes", length: str = "5 minutes") -> DataFrame:
    """Counts by event-time window with a watermark. Not from the reference, but built into Spark."""
    return stream.withWatermark(at, late).groupBy(F.window(at, length).alias("w"), group).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), group, "n")


def touch_in_order(files: list[str], start: float = 1_700_000_000.0) -> None:
    """Gives files increasing modification times, so that a stream reads them in this order."""
    for i, f in enumerate(files):
        os.utime(f, (start + i, start + i))
