"""Files written back to a folder of frames, in steps that can be finished or undone at any moment.

A write is staged first: tasks put the files under the folder's journal and a manifest says what is there. Until its commit
note is written, nothing of the folder has changed and discard() forgets it. The note is the commit: from then on every step
(backups, replacement, clearing, marker) only moves or copies single files that are not in place yet, so finish() may be cut
off and called again. recover() does one or the other for whatever an earlier process has left.

The first backup of a file is never replaced, so restore() gives back what was there before any write. Files are moved by
tasks, a share of the names each; the driver sees names, counts and the note, never contents.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JOURNAL, NOTE = ".writeback", "commit.json"
MODES = ("replace", "whole", "clear", "side")
Step = Callable[[str], None]


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in folder or folder.startswith("file:"):
        return pafs.FileSystem.from_uri(folder)
    return pafs.LocalFileSystem(), os.path.abspath(folder)


def there(fs: pafs.FileSystem, path: str) -> bool:
    return fs.get_file_info(path).type != pafs.FileType.NotFound


def put_bytes(fs: pafs.FileSystem, path: str, data: bytes) -> None:
    """Writes a file in one step, under a temporary name first."""
    folder, name = path.rsplit("/", 1)
    fs.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(data)
    fs.move(part, path)


def read_note(fs: pafs.FileSystem, path: str) -> dict:
    with fs.open_input_stream(path) as f:
        return json.loads(f.read())


def names_in(spark: SparkSession, folder: str) -> DataFrame:
    """(name) of the files in a folder, without hidden ones; empty where there is no such folder. The driver lists the names, as
    Spark's own file index does, but with the empty files that that leaves out."""
    fs, path = opened(folder)
    if not there(fs, path):
        return spark.createDataFrame([], "name string")
    found = fs.get_file_info(pafs.FileSelector(path))
    rows = [(i.base_name,) for i in found if i.type == pafs.FileType.File and not i.base_name.startswith(".")]
    return spark.createDataFrame(rows, "name string")


@dataclass(frozen=True)
class Staged:
    folder: str
    run: str

    @property
    def home(self) -> str:
        return f"{self.folder.rstrip('/')}/{JOURNAL}/{self.run}"

    def manifest(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.home}/manifest")


def _each(names: DataFrame, work: Callable[[pafs.FileSystem, str], None], folder: str) -> None:
    """Calls work(file system, name) for every name, in tasks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = opened(folder)
        for frame in frames:
            for name in frame["name"]:
                work(fs, name)
            yield pd.DataFrame({"n": [len(frame)]})

    names.select("name").mapInPandas(run, "n long").agg(F.sum("n")).collect()


def stage(frames: DataFrame, folder: str, name: str = "name", content: str = "content") -> Staged:
    """Puts the files (name, bytes) under the folder's journal. Names must be plain and each there once; else ValueError, and
    nothing is left behind."""
    staged = Staged(folder, uuid.uuid4().hex)
    home = opened(staged.home)[1]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = opened(folder)
        for part in parts:
            rows = []
            for n, data in zip(part["name"], part["content"]):
                if not n or "/" in n or n.startswith("."):
                    raise ValueError(f"no plain file name: {n!r}")
                put_bytes(fs, f"{home}/staged/{n}", bytes(data))
                rows.append((n, len(data), hashlib.sha256(data).hexdigest()))
            yield pd.DataFrame(rows, columns=["name", "bytes", "sha256"])

    rows = frames.select(F.coalesce(F.col(name), F.lit("")).alias("name"), F.coalesce(F.col(content), F.lit(b"")).alias("content"))
    try:
        rows.mapInPandas(run, "name string, bytes long, sha256 string").write.parquet(f"{staged.home}/manifest")
        twice = staged.manifest(frames.sparkSession).groupBy("name").count().filter("count > 1").limit(3).collect()
        if twice:
            raise ValueError(f"names that are there more than once: {[r.name for r in twice]}")
    except BaseException:
        discard(staged)
        raise
    return staged


def discard(staged: Staged) -> None:
    """Forgets a write that isn't committed."""
    fs, home = opened(staged.home)
    if there(fs, f"{home}/{NOTE}"):
        raise ValueError("the write is committed: finish it")
    if there(fs, home):
        fs.delete_dir(home)


def _checked(spark: SparkSession, staged: Staged, mode: str, backup: str | None) -> None:
    new = staged.manifest(spark).select("name")
    if mode == "clear" or mode == "side":
        return
    if not backup:
        raise ValueError("this mode needs a backup folder")
    have = names_in(spark, staged.folder)
    if mode == "whole":
        fs, path = opened(backup)
        have = names_in(spark, backup) if there(fs, path) else have
        n, m = new.count(), have.count()
        if n != m:
            raise ValueError(f"{n} files for {m} originals: nothing is moved")
    missing = [r.name for r in new.join(have, "name", "left_anti").limit(3).collect()]
    if missing:
        raise ValueError(f"without an original: {missing}: nothing is moved")


def commit(
    spark: SparkSession, staged: Staged, mode: str = "replace", backup: str | None = None, target: str | None = None,
    marker: tuple[str, dict] | None = None, on_step: Step = lambda step: None,
) -> None:
    """Puts staged files in place.

    replace: each takes the place of an original, which is backed up the first time. whole: all originals are replaced, and
    their number must be the same (that of the backup, on later runs). clear: the folder has the staged files and no others
    afterwards, without a backup. side: the files go to the folder `target` and this one stays as it is. A marker is a small
    JSON file that is replaced last. Where the checks fail, ValueError is raised and the write is discarded. on_step hears
    the name of each step before it is taken."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    if mode == "side" and not target:
        raise ValueError("side needs a target folder")
    try:
        on_step("check")
        _checked(spark, staged, mode, backup)
    except ValueError:
        discard(staged)
        raise
    fs, home = opened(staged.home)
    on_step("note")
    note = {"mode": mode, "backup": backup, "target": target or staged.folder, "marker": marker}
    put_bytes(fs, f"{home}/{NOTE}", json.dumps(note).encode())
    finish(spark, staged, on_step)


def _copied(fs: pafs.FileSystem, source: str, to: str) -> None:
    """A copy under a temporary name that then takes its own; none where there is one already."""
    if there(fs, to) or not there(fs, source):
        return
    folder, name = to.rsplit("/", 1)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    fs.copy_file(source, part)
    fs.move(part, to)


def _moved(fs: pafs.FileSystem, source: str, to: str) -> None:
    if there(fs, source):
        fs.move(source, to)
    elif not there(fs, to):
        raise FileNotFoundError(f"neither {source} nor {to} is there")


def finish(spark: SparkSession, staged: Staged, on_step: Step = lambda step: None) -> None:
    """Takes the steps of a committed run that are left."""
    fs, home = opened(staged.home)
    note = read_note(fs, f"{home}/{NOTE}")
    folder, mode = opened(staged.folder)[1], note["mode"]
    backup = opened(note["backup"])[1] if note.get("backup") else None
    if mode == "restore":
        on_step("put back")
        _each(names_in(spark, note["backup"]), lambda f, n: _moved(f, f"{backup}/{n}", f"{folder}/{n}"), staged.folder)
        on_step("drop backup")
        if there(fs, backup):
            fs.delete_dir(backup)
    elif mode == "remove":
        fs.create_dir(backup, recursive=True)
        on_step("move")
        _each(staged.manifest(spark), lambda f, n: f.move(f"{folder}/{n}", f"{backup}/{n}") if there(f, f"{folder}/{n}") else None, staged.folder)
    else:
        names, target = staged.manifest(spark), opened(note["target"])[1]
        fs.create_dir(target, recursive=True)
        if mode in ("replace", "whole"):
            fs.create_dir(backup, recursive=True)
            on_step("backup")
            _each(names, lambda f, n: _copied(f, f"{folder}/{n}", f"{backup}/{n}"), staged.folder)
        on_step("put")
        _each(names, lambda f, n: _moved(f, f"{home}/staged/{n}", f"{target}/{n}"), staged.folder)
        if mode == "clear":
            on_step("clear")
            keep = names.select("name")
            if note.get("marker"):
                keep = keep.unionByName(spark.createDataFrame([(note["marker"][0],)], "name string"))
            old = names_in(spark, staged.folder).join(keep, "name", "left_anti")
            _each(old, lambda f, n: f.delete_file(f"{folder}/{n}") if there(f, f"{folder}/{n}") else None, staged.folder)
        if note.get("marker"):
            on_step("marker")
            put_bytes(fs, f"{target}/{note['marker'][0]}", json.dumps(note["marker"][1], indent=1).encode())
    on_step("done")
    fs.delete_dir(home)


def _noted(spark: SparkSession, folder: str, note: dict, names: DataFrame | None, on_step: Step) -> None:
    staged = Staged(folder, uuid.uuid4().hex)
    fs, home = opened(staged.home)
    if names is not None:
        names.select("name").distinct().write.parquet(f"{staged.home}/manifest")
    on_step("note")
    put_bytes(fs, f"{home}/{NOTE}", json.dumps(note).encode())
    finish(spark, staged, on_step)


def remove(spark: SparkSession, names: DataFrame, folder: str, backup: str, on_step: Step = lambda step: None) -> None:
    """Moves the files named to the backup; names without a file are passed over. restore() brings them back."""
    _noted(spark, folder, {"mode": "remove", "backup": backup}, names, on_step)


def restore(spark: SparkSession, folder: str, backup: str, on_step: Step = lambda step: None) -> int:
    """Puts every file of the backup back in its place and drops the backup; how many there were. 0 without a backup."""
    n = names_in(spark, backup).count()
    if n:
        _noted(spark, folder, {"mode": "restore", "backup": backup}, None, on_step)
    return n


def recover(spark: SparkSession, folder: str) -> dict[str, str]:
    """Finishes the committed runs that a folder's journal holds and discards the others; what was done, by run."""
    fs, path = opened(f"{folder.rstrip('/')}/{JOURNAL}")
    done = {}
    if not there(fs, path):
        return done
    for info in sorted(fs.get_file_info(pafs.FileSelector(path)), key=lambda i: i.mtime_ns or 0):
        staged = Staged(folder, info.base_name)
        if there(fs, f"{info.path}/{NOTE}"):
            finish(spark, staged)
            done[staged.run] = "finished"
        else:
            discard(staged)
            done[staged.run] = "discarded"
    return done
