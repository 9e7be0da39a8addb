"""Registered queries of the streaming operators: streams over the tables' files, run over all that is there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..streaming.growth import GrowingModel
from ..streaming.stale import COMPLETE, NEW_RUN, OTHER_TARGET, ROCKS, numbered_runs
from .catalogue import ORACLE_SQL, QUERIES

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; a temporary one only in local mode, where no checkpoint folder is set."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="orbisloom-")
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def batch_runs(rows: DataFrame, key: str, order: str) -> DataFrame:
    """What numbered_runs gives, for a table in which the number of frames changes with a run's segment only: a segment begins
    with requeue 0 or another target, and is cut into runs of its number of frames."""
    line = Window.partitionBy(key).orderBy(order)
    before = F.lag("target").over(line)
    hard = F.when(before.isNull(), "").when(F.col("requeue") == 0, NEW_RUN).when(before != F.col("target"), OTHER_TARGET)
    r = rows.withColumn("_why", hard).withColumn("_segment", F.sum(F.col("_why").isNotNull().cast("int")).over(line))
    segment = Window.partitionBy(key, "_segment").orderBy(order)
    r = r.withColumns({"_at": F.row_number().over(segment) - 1, "_total": F.first("total").over(segment)})
    position = F.when(F.col("_total") > 0, F.col("_at") % F.col("_total")).otherwise(F.col("_at").cast("long"))
    r = r.withColumn("position", position)
    why = F.when(F.col("_why").isNotNull(), F.nullif("_why", F.lit(""))).when(F.col("position") == 0, COMPLETE)
    return r.select("*", why.alias("dropped"), F.sum((F.col("position") == 0).cast("long")).over(line).alias("run"))


def stale_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_folder(spark, "runs")
    events = table_stream(spark, sf_dir, "events")
    asked = events.select(
        F.col("event_type").alias("node"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 37 == 0, 0).otherwise(1).alias("requeue"),
        F.floor(F.col("event_id") / 250).cast("string").alias("target"), (F.length("event_type") + 3).cast("long").alias("total"),
    )
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        write = numbered_runs(asked, "node", "seq").writeStream.format("parquet").option("path", out)
        write.option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema("node string, seq long, run long, position long, dropped string").parquet(out)


def grown_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as images, a camera for each pair of priority and status, by two micro-batches of which the first runs twice."""
    grow = GrowingModel(shared_folder(spark, "grown"), ["o_orderpriority", "o_orderstatus"], ["o_totalprice"], name="o_orderkey", order="o_orderkey")
    stream = table_stream(spark, sf_dir, "orders")

    def grown(batch: DataFrame, number: int) -> None:
        late = F.col("o_orderdate") >= F.to_date(F.lit("1996-01-01"))
        grow(batch.filter(~late), 2 * number)
        grow(batch.filter(~late), 2 * number)
        grow(batch, 2 * number + 1)

    stream.writeStream.foreachBatch(grown).option("checkpointLocation", shared_folder(spark, "grown-progress")).trigger(availableNow=True).start().awaitTermination()
    met = grow.images(spark).join(grow.cameras(spark), "camera_id")
    return met.select("o_orderkey", F.col("image_id").cast("long").alias("image_id"), F.col("camera_id").cast("long").alias("camera_id"), "o_orderpriority", "o_orderstatus", "o_totalprice")


QUERIES["stale_runs"] = stale_runs
ORACLE_SQL["stale_runs"] = """
    WITH e AS (SELECT event_type AS node, event_id AS seq, event_id % 37 = 0 AS first, event_id // 250 AS target, length(event_type) + 3 AS total FROM events),
    h AS (SELECT *, lag(target) OVER w IS NULL AS begins, first OR lag(target) OVER w <> target AS hard FROM e WINDOW w AS (PARTITION BY node ORDER BY seq)),
    s AS (SELECT *, sum((begins OR hard)::INT) OVER (PARTITION BY node ORDER BY seq) AS segment FROM h),
    p AS (SELECT *, (row_number() OVER (PARTITION BY node, segment ORDER BY seq) - 1) % total AS position FROM s)
    SELECT node, seq, sum((position = 0)::INT) OVER (PARTITION BY node ORDER BY seq)::BIGINT AS run, position::BIGINT AS position,
           CASE WHEN position = 0 AND NOT begins THEN CASE WHEN NOT hard THEN 'complete' WHEN first THEN 'new run' ELSE 'other target' END END AS dropped FROM p"""
QUERIES["grown_model"] = grown_model
ORACLE_SQL["grown_model"] = """
    WITH o AS (SELECT *, o_orderdate::DATE >= DATE '1996-01-01' AS late FROM orders),
    i AS (SELECT *, row_number() OVER (ORDER BY late, o_orderkey) AS image_id FROM o),
    c AS (SELECT o_orderpriority, o_orderstatus, row_number() OVER (ORDER BY min(late::INT), min(CASE WHEN late THEN NULL ELSE o_orderkey END), min(o_orderkey)) AS camera_id FROM o GROUP BY 1, 2)
    SELECT o_orderkey, image_id, camera_id, o_orderpriority, o_orderstatus, o_totalprice FROM i JOIN c USING (o_orderpriority, o_orderstatus)"""
