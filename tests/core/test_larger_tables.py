"""Queries against their SQL on small tables with the keys, ties and shares that larger tables have."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from orbisloom.operators import aggregates as agg
from orbisloom.operators import images


def _cell(x):
    return None if x is None else round(float(x), 9) if isinstance(x, (int, float)) else str(x)


def same_as_sql(spark, folder, query, **tables):
    """Runs the query and its SQL over the tables (name -> (schema, rows)) and compares all rows."""
    db = duckdb.connect()
    for name, (schema, rows) in tables.items():
        path = f"{folder}/{name}.parquet"
        spark.createDataFrame(rows, schema).write.parquet(path)
        db.execute(f"create view {name} as select * from '{path}/*.parquet'")
    got = [tuple(map(_cell, r)) for r in entry.queries()[query](spark, str(folder)).collect()]
    want = [tuple(map(_cell, r)) for r in db.execute(entry.oracle_sql()[query]).fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return got


def test_names_of_numbers_longer_than_their_field(spark, tmp_path):
    events = [(i,) for i in (0, 1, 599_999, 600_000, 600_037, 1_573_470, 6_000_001)]
    rows = same_as_sql(spark, tmp_path, "face_names", events=("event_id long", events))
    assert (600_037.0, 10_000.0, 1.0, None) in rows


def test_padded_keys_longer_than_their_field(spark, tmp_path):
    orders = [(i, "1-URGENT") for i in (7, 999_999_999, 1_000_000_000, 12_345_678_901)]
    same_as_sql(spark, tmp_path, "short_hashes", orders=("o_orderkey long, o_orderpriority string", orders))


def test_faces_of_equal_depth_go_to_the_lowest(spark, tmp_path):
    suppliers = [(i + 1000 * k,) for i in range(1, 60) for k in range(40)]
    rows = same_as_sql(spark, tmp_path, "raster_contest", supplier=("s_suppkey long", suppliers))
    assert len(rows) > 400


def test_ratios_are_computed_once_and_parts_not_broadcast(spark, monkeypatch):
    seen, joined = spark.sparkContext.accumulator(0), []

    def count(x):
        seen.add(1)
        return x

    counted = F.udf(count, "double").asNondeterministic()  # so that a filter doesn't repeat it
    df = spark.range(1, 20_001).select(F.col("id").cast("double").alias("v"))
    assert agg.scale_fit(df, counted("v")).first().scale == 10_000.5
    assert seen.value == 20_000
    monkeypatch.setattr(agg, "scale_fit", lambda df, ratio: joined.append(df) or df.select(F.lit(1).alias("n"), F.lit(1.0).alias("scale"), F.lit(1.0).alias("spread")))
    entry.queries()["scale_fit"](spark, "/root/testdata/sf0.001")
    assert "BroadcastHashJoin" not in joined[0]._jdf.queryExecution().sparkPlan().toString()


def test_least_squares_deals_out_dense_columns(spark, monkeypatch):
    r, kept, hold = np.random.default_rng(3), [], images.held
    a = np.where((np.arange(300)[:, None] % 20 == np.arange(20)) | (np.arange(20) < 2), r.normal(size=(300, 20)), 0.0)
    b = r.normal(size=300)
    entries = spark.createDataFrame([(i, j, float(a[i, j])) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(a)))], "i int, j int, v double")
    rhs = spark.createDataFrame(list(enumerate(b.tolist())), "i int, b double")
    monkeypatch.setattr(images, "held", lambda df: kept.append(hold(df)) or kept[-1])
    for share in (1 / 2000, 0.1, 1.0):  # all columns dense, two of twenty, none
        kept.clear()
        monkeypatch.setattr(images, "HOT_SHARE", share, raising=False)
        got = {q.j: q.x for q in images.least_squares(entries, rhs).collect()}
        assert np.allclose([got[j] for j in range(20)], np.linalg.lstsq(a, b, rcond=None)[0], atol=1e-6)
        dealt = [d.groupBy(F.spark_partition_id().alias("p")).count().collect() for d in kept if d.columns == ["i", "j", "v"]]
        assert len(dealt) == (2 if share == 0.1 else 1) and all(max(q["count"] for q in d) < 0.5 * sum(q["count"] for q in d) for d in dealt)
