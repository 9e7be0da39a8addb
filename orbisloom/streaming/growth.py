"""A model that grows by micro-batches: versions of its tables that share what a batch hasn't touched.

Images are dealt by a hash of their name into parts. A batch reads and rewrites only the parts in which it has new names; a
version is a small document that names the folder, the rows and the fingerprint of every part. Writing that document is the
commit: a batch that is cut off leaves the version before it, and the same batch run again does nothing twice. Readers of an
old version aren't disturbed.
"""

from __future__ import annotations

import hashlib
import json

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import first_per_key, with_position
from ..sources.writeback import opened, put_bytes, read_note, there


class GrowingModel:
    """Tables `images` (image_id, camera_id, name, rest) and `cameras` (camera_id, signature) in a folder.

    As a foreachBatch sink it appends a batch's new names with ids behind the greatest, reusing the camera of an equal
    signature or adding one. Names that are there already, and those that a batch repeats (the first by `order` stays), are
    passed over. Null names are left out."""

    def __init__(self, folder: str, signature: list[str], rest: list[str], name: str = "name", order: str = "name", parts: int = 16):
        self.folder, self.signature, self.rest = folder.rstrip("/"), signature, rest
        self.name, self.order, self.parts = name, order, parts

    def versions(self) -> list[int]:
        fs, path = opened(f"{self.folder}/versions")
        if not there(fs, path):
            return []
        names = [i.base_name for i in fs.get_file_info(pafs.FileSelector(path)) if not i.base_name.startswith(".")]
        return sorted(int(n.removesuffix(".json")) for n in names)

    def version(self, number: int | None = None) -> dict | None:
        """The document of a version, the latest by default."""
        known = self.versions()
        if not known:
            return None
        fs, path = opened(f"{self.folder}/versions/{known[-1] if number is None else number:08d}.json")
        return read_note(fs, path)

    def images(self, spark: SparkSession, number: int | None = None) -> DataFrame | None:
        v = self.version(number)
        return None if v is None else spark.read.parquet(*sorted(p["path"] for p in v["parts"].values()))

    def cameras(self, spark: SparkSession, number: int | None = None) -> DataFrame | None:
        v = self.version(number)
        return None if v is None else spark.read.parquet(*v["cameras"])

    def fingerprint(self, number: int | None = None) -> str | None:
        """Changes when any row of the images does, and only then; what was derived from another one is out of date."""
        v = self.version(number)
        if v is None:
            return None
        return hashlib.sha256(json.dumps(sorted((k, p["rows"], p["mark"]) for k, p in v["parts"].items())).encode()).hexdigest()

    @staticmethod
    def _marks(spark: SparkSession, path: str) -> dict[str, dict]:
        """Folder, rows and fingerprint of each part that was written; at most `parts`."""
        put = spark.read.parquet(path)
        mark = F.sum(F.xxhash64(*[c for c in put.columns if c != "_bucket"]).cast("decimal(38,0)")).cast("string")
        rows = put.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"), mark.alias("mark")).collect()
        return {str(r["_bucket"]): {"path": f"{path}/_bucket={r['_bucket']}", "rows": r.n, "mark": r.mark} for r in rows}

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark, now = batch.sparkSession, self.version() or {"version": 0, "batch": -1, "parts": {}, "cameras": [], "images": 0, "n_cameras": 0}
        if number <= now["batch"]:
            return
        cols = [self.name, *self.signature, *self.rest]
        part = F.pmod(F.xxhash64(self.name), F.lit(self.parts)).cast("int")
        extra = [self.order] if self.order not in cols else []
        first = first_per_key(batch.filter(F.col(self.name).isNotNull()).select(*cols, *extra), [self.name], [self.order]).select(*cols)
        new = first.withColumn("_bucket", part).persist()
        try:
            touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())  # at most `parts`
            old_paths = [now["parts"][str(p)]["path"] for p in touched if str(p) in now["parts"]]
            old = spark.read.parquet(*old_paths) if old_paths else None
            added = new if old is None else new.join(old.select(self.name), self.name, "left_anti")
            to = f"{self.folder}/data/{now['version'] + 1:08d}"
            known = spark.read.parquet(*now["cameras"]) if now["cameras"] else None
            wanted = added.groupBy(*self.signature).agg(F.min(self.name).alias("_first"))
            same = lambda a, b: [a[s].eqNullSafe(b[s]) for s in self.signature]
            if known is not None:
                wanted = wanted.join(known, same(wanted, known), "left_anti")
            fresh = with_position(wanted, ["_first"], "_i")
            fresh = fresh.select((F.col("_i") + now["n_cameras"] + 1).cast("int").alias("camera_id"), *self.signature)
            fresh.write.mode("overwrite").parquet(f"{to}/cameras")
            cameras = [*now["cameras"], f"{to}/cameras"]
            every = spark.read.parquet(*cameras).alias("_c")
            numbered = with_position(added, [self.name], "_i").withColumn("image_id", (F.col("_i") + now["images"] + 1).cast("int"))
            met = numbered.join(every, same(numbered, every))
            rows = met.select("image_id", "camera_id", numbered[self.name], *[numbered[r] for r in self.rest], "_bucket")
            if old is not None:
                rows = rows.unionByName(old.withColumn("_bucket", part))
            rows.write.mode("overwrite").partitionBy("_bucket").parquet(f"{to}/images")
            changed = self._marks(spark, f"{to}/images") if touched else {}
        finally:
            new.unpersist()
        merged = now["parts"] | changed
        after = {
            "version": now["version"] + 1, "batch": number, "parts": merged, "cameras": cameras,
            "images": sum(p["rows"] for p in merged.values()), "n_cameras": spark.read.parquet(*cameras).count(),
        }
        fs, path = opened(f"{self.folder}/versions/{after['version']:08d}.json")
        put_bytes(fs, path, json.dumps(after).encode())
