"""COLMAP binary models as a Python data source (reading) and as files written from DataFrames.

A model file can't be split, because its records have no fixed length: one file is one partition.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.camera import MODELS
from ..operators.ordered import held

SCHEMAS = {
    "cameras": "camera_id int, model string, model_id int, width long, height long, params array<double>",
    "images": "image_id int, qw double, qx double, qy double, qz double, tx double, ty double, tz double, camera_id int, name string, observations array<struct<x:double,y:double,point3d_id:long>>",
    "points3d": "point3d_id long, x double, y double, z double, r short, g short, b short, error double, track array<struct<image_id:int,idx:int>>",
}
_BY_ID = {i: (name, n) for i, name, n in MODELS}
_BY_NAME = {name: (i, n) for i, name, n in MODELS}


def _take(f, layout: str) -> tuple:
    size = struct.calcsize("<" + layout)
    data = f.read(size)
    if len(data) != size:
        raise ValueError("the file ends within a record")
    return struct.unpack("<" + layout, data)


def _name(f) -> str:
    out = bytearray()
    while (c := f.read(1)) != b"\0":
        if not c:
            raise ValueError("the file ends within a name")
        out += c
    return out.decode("utf-8", "replace")


def read_cameras(f) -> Iterator[tuple]:
    for _ in range(_take(f, "Q")[0]):
        camera_id, model_id, width, height = _take(f, "iiQQ")
        if model_id not in _BY_ID:
            raise KeyError(f"unknown camera model {model_id}")
        name, n = _BY_ID[model_id]
        yield camera_id, name, model_id, width, height, list(_take(f, f"{n}d"))


def read_images(f, names_only: bool = False) -> Iterator[tuple]:
    for _ in range(_take(f, "Q")[0]):
        image_id, *pose, camera_id = _take(f, "i7di")
        name, count = _name(f), _take(f, "Q")[0]
        if names_only:
            f.seek(24 * count, os.SEEK_CUR)
            yield image_id, *pose, camera_id, name, None
        else:  # ids are read as whole numbers, so those beyond 2^53 stay exact
            yield image_id, *pose, camera_id, name, list(struct.iter_unpack("<ddq", f.read(24 * count)))


def read_points(f) -> Iterator[tuple]:
    for _ in range(_take(f, "Q")[0]):
        point_id, x, y, z, r, g, b, error, count = _take(f, "Qddd3BdQ")
        yield point_id, x, y, z, r, g, b, error, list(struct.iter_unpack("<ii", f.read(8 * count)))


READERS = {"cameras": read_cameras, "images": read_images, "points3d": read_points}


class ModelSource(DataSource):
    """spark.read.format("colmap").option("kind", "cameras" | "images" | "points3d").load(file). Option names_only skips poses' observations."""

    @classmethod
    def name(cls) -> str:
        return "colmap"

    def schema(self) -> str:
        return SCHEMAS[self.options["kind"]]

    def reader(self, schema) -> DataSourceReader:
        return ModelReader(self.options["kind"], self.options["path"].split(","), self.options.get("names_only", "false").lower() == "true")


class ModelReader(DataSourceReader):
    def __init__(self, kind: str, paths: list[str], names_only: bool):
        self.kind, self.paths, self.names_only = kind, paths, names_only

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition) -> Iterator[tuple]:
        with open(partition.value.removeprefix("file://"), "rb") as f:
            yield from read_images(f, True) if self.kind == "images" and self.names_only else READERS[self.kind](f)


def read_model(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The three tables of a model folder."""
    spark.dataSource.register(ModelSource)
    files = {"cameras": "cameras.bin", "images": "images.bin", "points3d": "points3D.bin"}
    return {kind: spark.read.format("colmap").option("kind", kind).load(f"{folder}/{file}") for kind, file in files.items()}


def record_count(spark: SparkSession, file: str) -> DataFrame:
    """(path, n): the number of records a model file announces, from its first bytes; 0 when there are too few."""
    from ..functions.keys import little_endian_long

    content = F.col("content")
    return spark.read.format("binaryFile").load(file).select("path", F.when(F.octet_length(content) >= 8, little_endian_long(content, 1)).otherwise(0).alias("n"))


def _fields(struct_value):
    """The fields of a struct in order: a row's, or a dictionary's as Arrow gives it."""
    return struct_value.values() if isinstance(struct_value, dict) else struct_value


def _camera_bytes(r) -> bytes:
    model_id, n = _BY_NAME[r.model]
    if len(r.params) != n:
        raise ValueError(f"camera {r.camera_id}: {r.model} has {n} parameters, not {len(r.params)}")
    return struct.pack(f"<iiQQ{n}d", r.camera_id, model_id, r.width, r.height, *r.params)


def _image_bytes(r) -> bytes:
    seen = r.observations or []
    return struct.pack("<i7di", r.image_id, r.qw, r.qx, r.qy, r.qz, r.tx, r.ty, r.tz, r.camera_id) + r.name.encode() + b"\0" + struct.pack("<Q", len(seen)) + b"".join(struct.pack("<ddq", *_fields(o)) for o in seen)


def _point_bytes(r) -> bytes:
    track = r.track or []
    return struct.pack("<Qddd3BdQ", r.point3d_id, r.x, r.y, r.z, r.r, r.g, r.b, r.error, len(track)) + b"".join(struct.pack("<ii", *_fields(t)) for t in track)


_WRITERS = {"cameras": ("camera_id", _camera_bytes, "cameras.bin"), "images": ("image_id", _image_bytes, "images.bin"), "points3d": ("point3d_id", _point_bytes, "points3D.bin")}


def write_model(tables: dict[str, DataFrame], folder: str) -> None:
    """Writes the tables given, each sorted by id, to a temporary name that is then renamed.

    Tasks encode the sorted parts; sums of the parts' sizes say where each begins, and tasks write them there, into one file
    that all can reach. So the driver sees sizes only, and a task that runs again writes the same bytes at the same place."""
    os.makedirs(folder, exist_ok=True)
    for kind, df in tables.items():
        key, to_bytes, file = _WRITERS[kind]
        target = os.path.join(folder, file)

        def encoded(batches, to_bytes=to_bytes):
            part = TaskContext.get().partitionId()
            for number, frame in enumerate(batches):
                rows = [to_bytes(Row(**r)) for r in frame.to_pylist()]
                if rows:
                    out = [[part], [number], [len(rows)], [b"".join(rows)]]
                    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.large_binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["part", "number", "n", "data"])

        blocks = held(df.orderBy(key).mapInArrow(encoded, "part int, number int, n long, data binary"))
        before = F.sum("size").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1))
        places = blocks.select("part", "number", "n", F.octet_length("data").cast("long").alias("size"))
        places = places.withColumn("start", F.coalesce(before, F.lit(0)) + 8)  # sizes only, a row per batch of records
        total = places.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
        part_file = target + ".tmp"
        with open(part_file, "wb") as f:
            f.write(struct.pack("<Q", total[0]))
            f.truncate(8 + total[1])

        def put(batches, part_file=part_file):
            for frame in batches:
                for start, data in zip(frame.column("start").to_pylist(), frame.column("data").to_pylist()):
                    with open(part_file, "r+b") as f:
                        f.seek(start)
                        f.write(data)
                yield pa.RecordBatch.from_arrays([pa.array([frame.num_rows], pa.int64())], ["n"])

        placed = blocks.select("part", "number", "data").join(places.select("part", "number", "start"), ["part", "number"])
        placed.select("start", "data").mapInArrow(put, "n long").agg(F.sum("n")).collect()
        blocks.unpersist()
        os.replace(part_file, target)
