"""Deterministic sharded WARC archives: a writer with revisit records, and a reader that checks what it reads."""

from __future__ import annotations

import base64
import bisect
import hashlib
import uuid
import zlib
from urllib.parse import quote, unquote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, join_groups, small_batches

#: A file is closed once it has this many compressed bytes.
ROLL_BYTES = 32_000_000
#: Bytes of payload in a shard of a large archive; a small one is cut finer, into at most FEW_SHARDS.
SHARD_BYTES, SMALL_SHARD_BYTES, FEW_SHARDS = 512_000_000, 2_000_000, 64
#: Every record carries this date, so that the same rows give the same bytes.
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def name_of(page_id: str | None, nth: int = 0) -> str:
    """A record's identifier: rows that repeat an id are numbered, a null id has a scheme of its own."""
    kind, value = ("null", "") if page_id is None else ("page", quote(page_id, safe="-"))
    return f"<urn:x-{kind}:{value}{f';{nth}' if nth else ''}>"


def id_of(name: str) -> str | None:
    return unquote(name[len("<urn:x-page:") : -1].partition(";")[0]) if name.startswith("<urn:x-page:") else None


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, nth: int = 0, date: str = DATE) -> bytes:
    """One record as a gzip member. Lengths and digests are made anew from the payload; a revisit leaves the payload out."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": name_of(page_id, nth),
        "WARC-Date": date,
        "WARC-Target-URI": quote(url or "", safe="%/:=&?~#+!$,;'@()*[]"),
        "WARC-Payload-Digest": f"sha1:{sha1_base32(payload)}",
        "WARC-Block-Digest": f"sha1:{sha1_base32(block)}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if revisit:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": name_of(refers_to)}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def revisits(slim: DataFrame, min_bytes: int) -> DataFrame:
    """(id, digest, refers_to) of the rows (id, digest, bytes) whose payload, of at least min_bytes, a smaller id has too."""
    groups = cut(slim.filter(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.min("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    return join_groups(slim.select("id", "digest"), groups, "digest", "n", slim.count()).filter("id > refers_to").select("id", "digest", "refers_to")


def shards_for(payload_bytes: int) -> int:
    """How many shards so many bytes of payload take: by the bytes alone, so that another cluster writes the same files."""
    return max(1, min(FEW_SHARDS, -(-payload_bytes // SMALL_SHARD_BYTES)), -(-payload_bytes // SHARD_BYTES))


def boundaries(ids: DataFrame, shards: int) -> list:
    """The ids at which shards begin: of each of `shards` equal shares of the sorted ids the first one, exactly.

    Ids are ranked by a range sort and the sizes of its parts, so where the sort happens to cut does not matter. A number
    per part and an id per shard come to the driver."""
    count = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = cut(ids.filter("id is not null").select("id").repartitionByRange(count, "id").withColumn("part", F.spark_partition_id()))
    sizes = sorted((r["part"], r["count"]) for r in parts.groupBy("part").count().collect())
    total, before = sum(n for _, n in sizes), 0
    offsets = []
    for p, n in sizes:
        offsets.append((p, before))
        before += n
    starts = ids.sparkSession.createDataFrame(offsets, "part int, before long")
    rank = F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1 + F.col("before")
    share = lambda r: F.floor(r * shards / F.lit(max(1, total)))
    first = parts.join(F.broadcast(starts), "part").withColumn("rank", rank).filter((F.col("rank") > 0) & (share(F.col("rank")) > share(F.col("rank") - 1)))
    return sorted({r.id for r in first.select("id").collect()})


def write_warc(pages: DataFrame, out: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "payload", min_revisit_bytes: int = 0, roll_bytes: int = ROLL_BYTES, shards: int | None = None) -> DataFrame:
    """Writes a record per page to numbered .warc.gz files under `out` and returns the manifest, a row per file.

    Rows are sorted into ranges of ids at exact boundaries, so the same rows give the same files, byte by byte, however
    the input is split; without `shards` their number follows from the payload's bytes. A task writes its range into files named by range and number, each under a temporary name first and
    then renamed; one that runs again replaces files by equal ones. `out`/manifest is written last, by Spark's own
    commit, and what failed attempts have left goes then; readers open only files that the manifest lists.

    Of equal payloads that with the smallest id is a response and the others revisit it. A null payload counts as
    empty, a null url as an empty one; a null id sorts first and is always a response, and rows that repeat the smallest
    id are responses too; their records are numbered. Ids are kept as text, so an empty one stays empty. An empty table
    gives an empty manifest; other columns are ignored. Paths are those pyarrow's file systems can open.
    """
    spark = pages.sparkSession
    pages = pages.withColumn(payload_col, F.coalesce(F.col(payload_col), F.lit(b"")))
    slim = cut(pages.select(F.col(id_col).alias("id"), F.sha2(F.col(payload_col), 256).alias("digest"), F.octet_length(payload_col).alias("bytes")))
    known = revisits(slim, min_revisit_bytes)
    count = shards or shards_for(slim.agg(F.coalesce(F.sum(F.col("bytes").cast("long")), F.lit(0))).first()[0])
    bounds = boundaries(slim, count)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        there = ids.notna().to_numpy()
        found = np.zeros(len(ids), np.int32)
        found[there] = [bisect.bisect_right(bounds, x) for x in ids[there].tolist()]
        return pd.Series(found)

    ids = F.col(id_col).cast("long" if pages.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long") else "string")
    data = pages.select(F.col(id_col).alias("id"), range_of(ids).alias("range"), F.sha2(F.col(payload_col), 256).alias("digest"), F.lit(1).alias("kind"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).alias("payload"), F.lit(None).cast("string").alias("refers_to"))
    notes = known.select("id", range_of(F.col("id").cast(data.schema["id"].dataType)).alias("range"), "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), F.col("refers_to").cast("string"))
    ranged = data.unionByName(notes).repartitionById(count, F.col("range")).sortWithinPartitions("range", "id", "digest", "kind", "url")

    def write(batches):
        fs, root = pa.fs.FileSystem.from_uri(out)
        fs.create_dir(f"{root}/temporary", recursive=True)
        fs.create_dir(f"{root}/data", recursive=True)
        stream, now, note, done = None, "", None, []
        part = number = size = records = nth = 0
        last: object = ()
        digest = hashlib.sha256()

        def close():
            stream.close()
            name = f"data/range-{part:06d}-{number:05d}.warc.gz"
            fs.move(now, f"{root}/{name}")
            done.append((name, records, size, digest.hexdigest()))

        for batch in batches:
            columns = [batch.column(c) for c in ("id", "digest", "kind", "url", "payload", "refers_to", "range")]
            for k in range(batch.num_rows):  # one payload at a time
                i, sha, kind, url, payload, refers_to, at = (c[k].as_py() for c in columns)
                if stream is not None and at != part:
                    close()
                    stream = None
                if at != part:
                    part, number = at, 0
                if kind == 0:
                    note = ((i, sha), refers_to)
                    continue
                if stream is None:
                    now = f"{root}/temporary/{part}-{number}-{uuid.uuid4().hex}"
                    stream, size, records, digest = fs.open_output_stream(now, compression=None), 0, 0, hashlib.sha256()
                nth, last = (nth + 1 if last == i else 0), i
                member = record(None if i is None else str(i), url, payload, note[1] if note and note[0] == (i, sha) else None, nth)
                stream.write(member)
                digest.update(member)
                size, records = size + len(member), records + 1
                if size >= roll_bytes:
                    close()
                    stream, number = None, number + 1
        if stream is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done) if done else [[]] * 4, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["file", "records", "bytes", "sha256"])

    small_batches(spark, 500)
    ranged.mapInArrow(write, "file string, records long, bytes long, sha256 string").write.parquet(f"{out}/manifest")
    fs, root = pa.fs.FileSystem.from_uri(out)
    if fs.get_file_info(f"{root}/temporary").type != pa.fs.FileType.NotFound:
        fs.delete_dir(f"{root}/temporary")
    return spark.read.parquet(f"{out}/manifest")


def members(stream, step: int = 1 << 20):
    """The records of a .warc.gz stream, each inflated; one record is in memory at a time."""
    unpack, parts = zlib.decompressobj(31), []
    while chunk := stream.read(step):
        while chunk:
            parts.append(unpack.decompress(chunk))
            chunk = unpack.unused_data
            if unpack.eof:
                yield b"".join(parts)
                unpack, parts = zlib.decompressobj(31), []
            else:
                break
    if parts and any(parts):
        raise ValueError("the archive ends within a record")


def parse(data: bytes) -> tuple[dict[str, str], int, bytes]:
    """A record's WARC fields, the payload's full length and the payload (empty for a revisit); lengths and digests are checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    if f"sha1:{sha1_base32(block)}" != fields["WARC-Block-Digest"] or fields["WARC-Type"] == "response" and (f"sha1:{sha1_base32(payload)}" != fields["WARC-Payload-Digest"] or len(payload) != length):
        raise ValueError(f"record {fields['WARC-Record-ID']} doesn't match its digests")
    return fields, length, payload


def read_warc(spark: SparkSession, out: str, with_payload: bool = True) -> DataFrame:
    """(id, url, record_type, payload_digest, payload_bytes, refers_to[, payload]) of every record in the manifest's files, ids as strings.

    A null url comes back empty. A record that is cut short, or doesn't match its lengths or digests, and a file with another
    number of records than its manifest says fail the query. An empty manifest gives an empty result."""
    files = spark.read.parquet(f"{out}/manifest")
    schema = "id string, url string, record_type string, payload_digest string, payload_bytes long, refers_to string" + ", payload binary" * with_payload

    def read(batches):
        fs, root = pa.fs.FileSystem.from_uri(out)
        for batch in batches:
            for file in batch.to_pylist():
                rows, count, held = [], 0, 0
                with fs.open_input_stream(f"{root}/{file['file']}", compression=None) as stream:
                    for data in members(stream):
                        fields, length, payload = parse(data)
                        row = (id_of(fields["WARC-Record-ID"]), unquote(fields["WARC-Target-URI"]), fields["WARC-Type"], fields["WARC-Payload-Digest"][5:], length, id_of(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None)
                        rows.append((*row, payload) if with_payload else row)
                        count, held = count + 1, held + (len(payload) if with_payload else 100)
                        if held > 4_000_000:
                            yield batch_of(rows)
                            rows, held = [], 0
                if count != file["records"]:
                    raise ValueError(f"{file['file']} has {count} records; the manifest says {file['records']}")
                if rows:
                    yield batch_of(rows)

    kinds = [pa.string()] * 4 + [pa.int64(), pa.string()] + [pa.binary()] * with_payload
    names = [x.split()[0] for x in schema.split(", ")]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)

    tasks = min(100_000, max(1, files.count()))  # a number of its own, or the few manifest rows are put into one task
    return files.select("file", "records").repartition(tasks, "file").mapInArrow(read, schema)
