"""Blocks of documents as rows, and the counts over a whole corpus of the 56-bit keys that each block holds.

A corpus is written once as a table with a row per block: some megabytes of text, coded as arrays. Whatever follows reads
that table, so a block is the same in every pass and on every retry, however the scan was split.

A block asks for its distinct keys with their local counts, as sorted arrays in a row per bucket of keys; a bucket adds
up the counts of all blocks and answers each of them in the order that it sent. So a key that is everywhere costs a block
one entry, and numpy does the merging, Spark the dealing out. A block sends rows for those buckets only in which it has
keys, so there are never more rows than distinct keys of blocks, whatever the numbers of blocks and buckets.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, small_batches, written

#: Bytes of text in a block; a longer document is a block of its own.
BLOCK_BYTES = 8_000_000
#: Bytes of keys that one bucket should hold on average.
BUCKET_BYTES = 8_000_000


def pack_bytes(data) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unpack_bytes(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_array(a: np.ndarray) -> bytes:
    """An array of numbers, all first bytes before all second ones and so on, as high bytes are mostly alike."""
    return pack_bytes(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T).tobytes())


def unpack_array(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(unpack_bytes(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as the first one and the steps to each next one."""
    return pack_array(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_array(data, np.uint64), dtype=np.uint64)


def block_table(docs: DataFrame, passed: list[str], text_col: str, encode: Callable, fields: str, name: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A written table with a row per block: block, n_bytes, rows (structs of the passed columns, a struct per document)
    and the binary columns that `fields` names, which encode(texts, rows) returns as a list.

    A block holds consecutive documents of a scan partition, block_bytes of text or one longer document.
    """
    extra = [f.strip().split()[0] for f in fields.split(",")]
    kinds = ", ".join(f"`{c}`: {docs.schema[c].dataType.simpleString()}" for c in passed)

    def run(batches):
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def row():
            table = pa.Table.from_batches(held).combine_chunks()
            data = table.column("__text").cast(pa.large_binary()).to_pylist()
            structs = pa.StructArray.from_arrays([table.column(c).combine_chunks() for c in passed], passed)
            columns = [pa.array([(part << 33) + number], pa.int64()), pa.array([size], pa.int64())]
            columns.append(pa.ListArray.from_arrays(pa.array([0, len(structs)], pa.int32()), structs))
            columns += [pa.array([x], pa.binary()) for x in encode(data, table)]
            return pa.RecordBatch.from_arrays(columns, ["block", "n_bytes", "rows", *extra])

        for batch in batches:
            for piece in pieces(batch, "__text", block_bytes):
                n = pc.sum(pc.binary_length(piece.column("__text").cast(pa.large_binary()))).as_py() or 0
                if held and size + n > block_bytes:
                    yield row()
                    held, size, number = [], 0, number + 1
                held.append(piece)
                size += n
        if held and sum(x.num_rows for x in held):
            yield row()

    small_batches(docs.sparkSession)
    source = docs.select(*passed, F.col(text_col).alias("__text"))
    return written(source.mapInArrow(run, f"block long, n_bytes long, rows array<struct<{kinds}>>, {fields}"), name)


def buckets_for(key_bytes: float) -> int:
    return int(key_bytes / BUCKET_BYTES) + 1


def bucket_of(keys: np.ndarray, count: int) -> np.ndarray:
    """By the high bits, so that sorted keys come in bucket order."""
    return ((keys >> np.uint64(24)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)


def parts(keys: np.ndarray, count: int) -> tuple[list[int], list[int]]:
    """The buckets in which sorted keys fall, and where each begins in them (with the end)."""
    bucket = bucket_of(keys, count)
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    return bucket[starts].tolist(), [*starts.tolist(), len(keys)]


REQUEST = "block long, bucket int, keys binary, counts binary"


def request(block: int, keys: np.ndarray, counts: np.ndarray, count: int) -> pa.RecordBatch:
    """Rows for a block's sorted distinct keys and their local counts (up to 2^31)."""
    buckets, at = parts(keys, count)
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
    columns = (
        [block] * len(buckets),
        buckets,
        [pack_keys(keys[x:y]) for x, y in zip(at[:-1], at[1:])],
        [pack_array(counts[x:y].astype(np.int32)) for x, y in zip(at[:-1], at[1:])],
    )
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["block", "bucket", "keys", "counts"])


def answered(requests: DataFrame, answer: Callable, total: Callable | None = None) -> DataFrame:
    """For every request row one row (block, bucket, answer): answer(keys, counts over all blocks) gives an array over the
    bucket's distinct keys, of which each block gets the entries of its own keys.

    With total(keys, counts), an integer array, each bucket also gives a row of block -1 with that array."""

    def merge(table: pa.Table) -> pa.Table:
        keys = [unpack_keys(x) for x in table.column("keys").to_pylist()]
        counts = np.concatenate([unpack_array(x, np.int32) for x in table.column("counts").to_pylist()])
        ends = np.cumsum([len(k) for k in keys]).tolist()
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        sizes = [len(k) for k in keys]
        del keys
        sums = np.bincount(inverse, counts, minlength=len(distinct)).astype(np.int64)
        del counts
        values = answer(distinct, sums)[inverse]
        rows = [pack_array(values[e - n : e]) for e, n in zip(ends, sizes)]
        blocks, buckets = table.column("block").to_pylist(), table.column("bucket").to_pylist()
        if total:
            rows.append(np.asarray(total(distinct, sums), np.int64).tobytes())
            blocks, buckets = [*blocks, -1], [*buckets, buckets[0]]
        return pa.table({"block": pa.array(blocks, pa.int64()), "bucket": pa.array(buckets, pa.int32()), "answer": pa.array(rows, pa.binary())})

    return requests.groupBy("bucket").applyInArrow(merge, "block long, bucket int, answer binary")


def read_answers(table: pa.Table, keys: np.ndarray, count: int, kind) -> np.ndarray:
    """A block's answers in the order of its sorted distinct keys; an answer that is missing fails the query."""
    buckets, at = parts(keys, count)
    found = dict(zip(table.column("bucket").to_pylist(), table.column("answer").to_pylist()))
    if found.keys() != set(buckets):
        raise ValueError("a bucket's answer is missing")
    return np.concatenate([unpack_array(found[b], kind) for b in buckets]) if buckets else np.empty(0, kind)
