"""Best-fit packing: the plan is made once from counts by length, then every piece looks up its place.

The driver sees one number for each length (at most `capacity` of them), never a document. Pieces are ranked within
their length over (length, bucket) groups, so no length, however common, is ranked in one task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import WordBpe, codec
from .common import pieces, small_batches, written

CAPACITY = 2048
#: Rows that one (length, bucket) group should hold at most on average.
BUCKET_ROWS = 20_000


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset, number): pieces of a length with `number` consecutive ranks go
    to as many consecutive sequences, at one offset.

    Lengths above a third of the capacity stand at most twice in a sequence: from the longest down, each is matched with
    the longest such partner that still fits. All smaller lengths, from the longest down, go to the smallest gap that
    takes them, and open new sequences only when none does. Equal lengths are placed together, so the work depends on
    the capacity and not on the number of pieces.
    """
    left = {n: c for n, c in counts.items() if c}
    gaps: list[list] = [[] for _ in range(capacity + 1)]
    third = capacity // 3
    for n in sorted((x for x in left if x > third), reverse=True):
        mate = min(capacity - n, n)
        while left[n]:
            while mate > third and (not left.get(mate) or mate == n and left[n] < 2):
                mate -= 1
            if mate > third:
                c = left[n] // 2 if mate == n else min(left[n], left[mate])
                left[n] -= c
                left[mate] -= c
                gaps[capacity - n - mate].append(((((), n), mate), c))
            else:
                gaps[capacity - n].append((((), n), left[n]))
                left[n] = 0
    for n in sorted((x for x in left if x <= third), reverse=True):
        gap = n
        while left[n]:
            while gap <= capacity and not gaps[gap]:
                gap += 1
            if gap > capacity:
                fit = capacity // n
                for items, c in ((fit, left[n] // fit), (left[n] % fit, 1)):
                    if items and c:
                        chain: tuple = ()
                        for _ in range(items):
                            chain = (chain, n)
                        gaps[capacity - items * n].append((chain, c))
                left[n] = 0
            else:
                chain, c = gaps[gap].pop()
                used = min(c, left[n])
                left[n] -= used
                if used < c:
                    gaps[gap].append((chain, c - used))
                gaps[gap - n].append(((chain, n), used))
                gap = n if gap - n >= n else gap
    rank, sequence, rows = dict.fromkeys(counts, 0), 0, []
    for gap, groups in enumerate(gaps):
        for chain, c in groups:
            offset = capacity - gap
            while chain:
                chain, n = chain
                offset -= n
                rows.append((n, rank[n], sequence, offset, c))
                rank[n] += c
            sequence += c
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def tokenised_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): each document's ids and one end id, cut into pieces of `capacity`."""

    def run(batches):
        tool = codec(WordBpe, path)
        for batch in batches:
            for part in pieces(batch, text_col, 2_000_000):
                flat, lens = tool.encode([t or "" for t in part.column(text_col).to_pylist()])
                ends = np.cumsum(lens)
                flat = np.insert(flat, ends, end_id).astype("<u4")
                lens = lens + 1
                first = np.cumsum(lens) - lens
                count = -(-lens // capacity)
                doc = np.repeat(np.arange(len(lens)), count)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = number * capacity
                length = np.minimum(lens[doc] - start, capacity)
                at = first[doc] + start
                crc = [zlib.crc32(flat[a : a + n].tobytes()) for a, n in zip(at.tolist(), length.tolist())]
                columns = [part.column(id_col).take(pa.array(doc)), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(flat)), pa.int32()), pa.array(flat.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, [id_col, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])
        tool.reset()

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def pack(items: DataFrame, order: list[str], length_col: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to every row: rows of a sequence lie one after the other, at most `capacity` in all.

    order names columns that fix the rank among rows of one length (rows equal in them may swap places, which changes
    nothing). Lengths must be between 1 and capacity; another one fails the query. An empty table stays empty. items is
    read three times, so it should be a written table.
    """
    found = items.groupBy(length_col).count().collect()
    counts = {r[0]: r[1] for r in found}
    if any(n is None or not 1 <= n <= capacity for n in counts):
        raise ValueError(f"lengths must be between 1 and {capacity}")
    rows = plan(counts, capacity)
    spark = items.sparkSession
    shared = spark.sparkContext.broadcast((rows[:, 0] << 40 | rows[:, 1], rows[:, 1:4]))  # as many rows as the plan has steps, which the capacity bounds
    buckets = max(1, -(-sum(counts.values()) // BUCKET_ROWS))
    keyed = items.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    keyed = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy(length_col, "_bucket").orderBy(*order)) - 1)
    before = items.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")).groupBy(length_col, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = before.withColumn("_before", F.sum("_n").over(Window.partitionBy(length_col).orderBy("_bucket")) - F.col("_n")).drop("_n")
    ranked = keyed.join(before, [length_col, "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_before", "_bucket")
    ranked = ranked.select(*items.columns, "_rank")

    names = items.columns

    def place(batches):
        keys, values = shared.value
        for batch in batches:
            n, r = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (length_col, "_rank"))
            at = np.searchsorted(keys, n << 40 | r, "right") - 1
            first, sequence, offset = values[at].T
            columns = [batch.column(c) for c in names] + [pa.array(sequence + r - first), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema), "sequence_id long, offset long"])
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset), a row per piece of every document.

    A null or empty text is one piece, its end id. Only documents longer than the capacity are cut. Repeated rows are
    packed each; columns other than the two named are ignored.
    """
    items = written(tokenised_pieces(docs, path, id_col, text_col, capacity=capacity), "pieces")
    return pack(items, [id_col, "piece"], "length", capacity)
