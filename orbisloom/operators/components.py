"""Connected components of graphs and of pixel masks, without a bound on rounds or on a component's size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import held


def _mark(edges: DataFrame) -> tuple:
    """A number of edges and a checksum of them: equal only where nothing changed."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _starred(edges: DataFrame) -> DataFrame:
    """Each node's greater neighbours, linked to the least of its neighbours and itself; edges (a, b) have a > b."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_a"), F.least("a", "_m").alias("_m"))
    return both.filter("b > a").join(least, F.col("a") == F.col("_a")).select(F.col("b").alias("a"), F.col("_m").alias("b"))


def _gathered(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours, linked to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("_m")).withColumnRenamed("a", "_a")
    met = edges.join(least, F.col("a") == F.col("_a"))
    return met.select(F.col("b").alias("a"), F.col("_m").alias("b")).filter("a != b").unionByName(least.select(F.col("_a").alias("a"), F.col("_m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of the undirected edges (a, b); component is the least node that can be reached.

    Large and small stars in turn: links go to ever smaller nodes until every node is linked to its component's least one.
    The number of rounds grows with the logarithm of the nodes, and goes on until a round changes nothing. Least neighbours
    combine before the shuffle; a node with very many links is a skewed join key, which adaptive execution splits. Links of a
    node with itself, and repeated ones, are allowed; null nodes are left out."""
    pairs = edges.select("a", "b").filter("a is not null and b is not null")
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    now = held(pairs.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(now)
    while True:
        now = held(_gathered(_starred(now).distinct()).distinct())
        new = _mark(now)
        if new == mark:
            break
        mark = new
    root = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return nodes.join(root, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def row_runs(pixels: DataFrame, frame: str) -> DataFrame:
    """(frame, y, x0, x1): the runs of set pixels along each row. Repeated pixels count once."""
    line = Window.partitionBy(frame, "y").orderBy("x")
    p = pixels.select(frame, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).distinct()
    p = p.withColumn("_g", F.col("x") - F.row_number().over(line))
    return p.groupBy(frame, "y", "_g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_g")


def run_links(runs: DataFrame, frame: str) -> DataFrame:
    """(a, b): runs of neighbouring rows that touch, corners included; a run is the struct (frame, y, x0).

    Two runs touch when the lower one's place before its start lies in the upper one, or the upper one's start, or a place
    next to it, in the lower one. So each run asks one place of the row above and three of the row below, and a row answers in
    the order of x with the last run that began: a window over a row, no join."""
    node = F.struct(frame, "y", "x0")
    ask = lambda dy, dx: F.struct((F.col("y") + dy).alias("y"), (F.col("x0") + dx).alias("x"))
    asked = runs.select(frame, node.alias("_by"), F.explode(F.array(ask(-1, -1), ask(1, -1), ask(1, 0), ask(1, 1))).alias("_p"))
    asked = asked.select(frame, F.col("_p.y").alias("y"), F.col("_p.x").alias("x"), F.lit(1).alias("kind"), "_by", F.lit(None).cast("int").alias("x1"))
    own = runs.select(frame, "y", F.col("x0").alias("x"), F.lit(0).alias("kind"), node.alias("_by"), "x1")
    row = Window.partitionBy(frame, "y").orderBy("x", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begun = F.last(F.when(F.col("kind") == 0, F.struct("_by", "x1")), ignorenulls=True).over(row)
    met = own.unionByName(asked).withColumn("_begun", begun).filter("kind = 1 and _begun.x1 >= x")
    return met.select(F.col("_begun._by").alias("a"), F.col("_by").alias("b"))


def labelled(pixels: DataFrame, frame: str) -> DataFrame:
    """(frame, y, x0, x1, label, size): the runs of set pixels with their 8-connected region, named by its first run, and the
    number of the region's pixels."""
    runs = held(row_runs(pixels, frame))
    found = components(run_links(runs, frame))
    r = runs.withColumn("_node", F.struct(frame, "y", "x0")).join(found, F.col("_node") == F.col("node"), "left")
    r = held(r.select(frame, "y", "x0", "x1", F.coalesce("component", "_node").alias("label")))
    sizes = r.groupBy("label").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("size"))
    return r.join(sizes, "label").select(frame, "y", "x0", "x1", "label", "size")


def kept_components(pixels: DataFrame, frame: str, least: int) -> DataFrame:
    """Set pixels (frame, y, x) of 8-connected regions of at least `least` pixels."""
    kept = labelled(pixels, frame).filter(F.col("size") >= least)
    return kept.select(frame, "y", F.explode(F.sequence("x0", "x1")).alias("x"))
