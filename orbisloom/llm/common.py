"""What the training-data operators share: the shared folder, word handling and joins that survive hot keys."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The characters that separate words: the class [\x20\x09-\x0D].
SPACE = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where that is unset."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        where = f"file://{tempfile.mkdtemp(prefix='orbisloom-')}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lets Arrow batches between the JVM and Python have at most so many rows, as rows here hold whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/orbisloom-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder; for slim tables that are read more than once."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """As cut(), but as a Parquet table, which is smaller on disk; for tables with long binary columns."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that later expressions reuse: a Generate stands between, so Catalyst can't copy the expression into each use."""
    return df.select("*", F.explode(F.array(value)).alias(name))


#: Groups with at least this share of the rows are hot. There can be no more than 1 / HOT_SHARE of them, so a broadcast of them is bounded.
HOT_SHARE = 1 / 2000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left join of rows with groups (one row for each key, of which size rows exist in a table of total rows).

    The few hot groups (at most 1 / HOT_SHARE, whatever the input) are broadcast, so that their rows stay where they
    are; the others are joined by a shuffle, in which no key has more than HOT_SHARE of the rows. rows is read twice.
    """
    hot = F.col(size) >= F.lit(max(2.0, total * HOT_SHARE))
    extra = [c for c in groups.columns if c != key]
    hot_groups, cold_groups = groups.filter(hot), groups.filter(~hot)
    found = rows.join(F.broadcast(hot_groups), key)
    rest = rows.join(F.broadcast(hot_groups.select(key)), key, "left_anti").join(cold_groups, key, "left")
    return found.select(*rows.columns, *extra).unionByName(rest.select(*rows.columns, *extra))


class Memo(dict):
    """Maps words (bytes) to a 64-bit hash, each computed once. Emptied beyond `most` entries, so memory is bounded."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of n consecutive word hashes: a polynomial over 2^64 of scrambled words, scrambled again.

    Built by doubling, so the cost is log2(n) passes over the array."""
    if len(h) < n:
        return h[:0]
    base = 0x9E3779B97F4A7C15 | 1
    power, run, size, out, done = base, mixed(h), 1, None, 0
    left = n
    while True:
        if left & 1:
            # out covers `done` words from each start; the next `size` words follow it
            out = run if out is None else out[: len(run) - done] * np.uint64(power) + run[done:] if done else run
            done += size
        left >>= 1
        if not left:
            return mixed(out)
        run = run[:-size] * np.uint64(power) + run[size:]
        size, power = 2 * size, power * power % 2**64


def texts_of(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes; null counts as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def pieces(batch, column: str, most: int = 4_000_000):
    """Slices of an Arrow batch with about `most` bytes of text each, so that Python objects for words stay bounded."""
    import pyarrow as pa
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to
