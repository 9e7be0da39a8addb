"""Listings, markers, rails, anchors and manifests."""

from __future__ import annotations

import json
import os
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import IMAGE_TYPES, png_size

MARKER = (
    "kind string, marker_version int, images_subdir string, image_order string, faces_per_frame int, num_frames int, num_images int, "
    "trajectory_lengths array<int>, sequences array<array<string>>, hires_views int, pruned_faces int, removed_views int, sfm_resolution array<int>"
)


def listing(spark: SparkSession, folder: str, types: tuple[str, ...] = IMAGE_TYPES) -> DataFrame:
    """(path, name, length) of the image files in a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), "length").filter(F.lower(name).rlike(r"\.(" + "|".join(types) + ")$"))


def png_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """(name, width, height) of PNG files by their headers; null sizes for files that are none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), png_size(F.col("content")).alias("s")).select("name", "s.width", "s.height")


def header_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) of a PNG, GIF, BMP, WebP or JPEG file by its header; None for what is none of them or cut off."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR":
            return struct.unpack(">II", data[16:24])
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return struct.unpack("<HH", data[6:10])
        if data[:2] == b"BM":
            width, height = struct.unpack("<ii", data[18:26])
            return width, abs(height)
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            kind = data[12:16]
            if kind == b"VP8X":
                return tuple(int.from_bytes(data[k : k + 3], "little") + 1 for k in (24, 27)) if len(data) >= 30 else None
            if kind == b"VP8L":
                bits = struct.unpack("<I", data[21:25])[0]
                return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
            if kind == b"VP8 ":
                return tuple(n & 0x3FFF for n in struct.unpack("<HH", data[26:30]))
        if data[:2] == b"\xff\xd8":
            at = 2
            while data[at] == 0xFF:
                code = data[at + 1]
                if code == 0xFF or code == 0x01 or 0xD0 <= code <= 0xD7:  # padding, and markers without a length
                    at += 1 if code == 0xFF else 2
                elif 0xC0 <= code <= 0xCF and code not in (0xC4, 0xC8, 0xCC):
                    height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                    return width, height
                else:
                    at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    except (struct.error, IndexError):
        pass
    return None


def image_sizes(spark: SparkSession, folder: str, types: tuple[str, ...] = IMAGE_TYPES) -> DataFrame:
    """(name, width, height) of image files by their headers, without decoding; null sizes for files that can't be told. Spark's
    reader leaves out empty files."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    files = files.filter(F.lower("name").rlike(r"\.(" + "|".join(types) + ")$"))

    def run(frames):
        for f in frames:
            found = [header_size(bytes(c)) or (None, None) for c in f["content"]]
            yield pd.DataFrame({"name": f["name"], "width": pd.array([w for w, _ in found], "Int64"), "height": pd.array([h for _, h in found], "Int64")})

    return files.mapInPandas(run, "name string, width long, height long")


def read_marker(spark: SparkSession, file: str) -> DataFrame:
    """The marker as one row; all null when the file is missing or no JSON."""
    if not os.path.exists(file.removeprefix("file://")):
        text = spark.range(1).select(F.lit("{}").alias("value"))
    else:
        text = spark.read.text(file, wholetext=True)
    return text.select(F.from_json("value", MARKER).alias("m")).select("m.*")


def marker_sequences(marker: DataFrame) -> DataFrame:
    """(seq_id, pos, name) of a marker's nested sequences."""
    return marker.select(F.posexplode("sequences").alias("seq_id", "s")).select("seq_id", F.posexplode("s").alias("pos", "name"))


def write_json(data: dict, file: str) -> None:
    """Replaces a small JSON document in one step."""
    with open(file + ".tmp", "w", encoding="utf-8") as f:
        json.dump(data, f, indent=1)
    os.replace(file + ".tmp", file)


def rail(text: DataFrame, column: str = "value") -> DataFrame:
    """(frame_idx, m array of 16) of a nested list of 4 x 4 matrices; another shape fails the query."""
    rows = text.select(F.posexplode(F.from_json(column, "array<array<array<double>>>")).alias("frame_idx", "rows"))
    good = (F.size("rows") == 4) & F.forall("rows", lambda r: F.size(r) == 4)
    return rows.select("frame_idx", F.when(good, F.flatten("rows")).otherwise(F.raise_error(F.lit("a rail holds 4 x 4 matrices")).cast("array<double>")).alias("m"))


def anchors(text: DataFrame, column: str = "value", strict: bool = True) -> DataFrame:
    """(i, x, y, z, tx, ty, tz) of lines with 3 or 6 numbers, or a JSON list of such rows; # begins a comment.

    Fewer than two rows, or another number of numbers, fail the query, or give no rows when not strict."""
    t = F.col(column)
    parsed = F.coalesce(F.from_json(t, "array<array<double>>"), F.array().cast("array<array<double>>"))
    lines = F.filter(F.transform(F.split(t, "\n"), lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, "#.*", ""), r"[,;\s]+", " "))), lambda s: s != "")
    rows = F.when(F.trim(t).startswith("["), parsed).otherwise(F.transform(lines, lambda s: F.transform(F.split(s, " "), lambda n: n.try_cast("double"))))
    fine = (F.size(rows) >= 2) & F.forall(rows, lambda r: F.size(r).isin(3, 6) & ~F.exists(F.slice(r, 1, 3), lambda n: n.isNull()))
    bad = F.raise_error(F.lit("anchors need two rows or more of 3 or 6 numbers")) if strict else F.lit(None)
    out = text.select(F.posexplode(F.when(fine, rows).otherwise(bad.cast("array<array<double>>"))).alias("i", "r"))
    return out.select("i", *[F.nanvl(F.get("r", F.lit(k)), F.lit(None).cast("double")).alias(n) for k, n in enumerate(("x", "y", "z", "tx", "ty", "tz"))])


def anchor_text(x: Column, y: Column, z: Column) -> Column:
    return F.format_string("%.3f, %.3f, %.3f", x, y, z)
