"""Write-back with a failure at each step, restore, growth by micro-batches and stale runs."""

import os

import pytest

from orbisloom.plans.stream_catalogue import batch_runs
from orbisloom.sources import writeback as wb
from orbisloom.streaming.chunks import chunk_stream, drain, touch_in_order
from orbisloom.streaming.growth import GrowingModel
from orbisloom.streaming.stale import ROCKS, numbered_runs


def seen(folder):
    return {n: (folder / n).read_bytes() for n in os.listdir(folder) if not n.startswith(".") and (folder / n).is_file()} if folder.exists() else {}


def frames(spark, rows):
    return spark.createDataFrame(rows, "name string, content binary").repartition(3)


@pytest.fixture
def originals(tmp_path):
    folder = tmp_path / "images"
    folder.mkdir()
    for i in range(6):
        (folder / f"f+{i} é%20.png").write_bytes(b"old %d" % i if i != 1 else b"")  # an empty file is a file
    return folder


class Stop(Exception):
    pass


def stop_at(step):
    def hear(now):
        if now == step:
            raise Stop(step)

    return hear


NAMES = [f"f+{i} é%20.png" for i in range(6)]


@pytest.mark.parametrize("step", ["check", "note", "backup", "put", "done", None])
def test_replacement_is_whole_before_and_after_each_step(spark, tmp_path, originals, step):
    old, backup = seen(originals), tmp_path / "backup"
    new = {NAMES[1]: b"new 1", NAMES[4]: b""}
    staged = wb.stage(frames(spark, list(new.items())), str(originals))
    assert seen(originals) == old
    if step:
        with pytest.raises(Stop):
            wb.commit(spark, staged, "replace", str(backup), on_step=stop_at(step))
        if step in ("check", "note", "backup", "put"):
            assert seen(originals) == old
        done = wb.recover(spark, str(originals))
        assert list(done.values()) == (["discarded"] if step in ("check", "note") else ["finished"])
        if step in ("check", "note"):
            assert seen(originals) == old and seen(backup) == {}
            return
    else:
        wb.commit(spark, staged, "replace", str(backup))
    assert seen(originals) == old | new and seen(backup) == {n: old[n] for n in new}
    assert wb.recover(spark, str(originals)) == {}
    if step:
        return
    # the first backup stays when a file is replaced again
    wb.commit(spark, wb.stage(frames(spark, [(NAMES[1], b"newer")]), str(originals)), "replace", str(backup))
    assert seen(originals)[NAMES[1]] == b"newer" and seen(backup)[NAMES[1]] == old[NAMES[1]]
    assert wb.restore(spark, str(originals), str(backup)) == 2
    assert seen(originals) == old and not backup.exists()
    assert wb.restore(spark, str(originals), str(backup)) == 0


@pytest.mark.parametrize("step", ["put back", "drop backup", "done"])
def test_restore_goes_on_where_it_stopped(spark, tmp_path, originals, step):
    old, backup = seen(originals), tmp_path / "backup"
    wb.commit(spark, wb.stage(frames(spark, [(n, b"new") for n in NAMES[:3]]), str(originals)), "replace", str(backup))
    if step == "put back":  # some files are back already
        (originals / NAMES[0]).write_bytes((backup / NAMES[0]).read_bytes())
        (backup / NAMES[0]).unlink()
    with pytest.raises(Stop):
        wb.restore(spark, str(originals), str(backup), on_step=stop_at(step))
    assert list(wb.recover(spark, str(originals)).values()) == ["finished"]
    assert seen(originals) == old and not backup.exists()


def test_checks_come_before_anything_moves(spark, tmp_path, originals):
    old, backup = seen(originals), tmp_path / "backup"
    for rows, mode, words in (
        ([("other.png", b"x")], "replace", "without an original"),
        ([(NAMES[0], b"x")], "whole", "1 files for 6 originals"),
        ([(NAMES[0], b"x"), (NAMES[0], b"y")], "replace", "more than once"),
        ([("../up.png", b"x")], "replace", "no plain file name"),
        ([(None, b"x")], "replace", "no plain file name"),
    ):
        with pytest.raises(Exception, match=words):
            wb.commit(spark, wb.stage(frames(spark, rows), str(originals)), mode, str(backup))
        assert seen(originals) == old and not backup.exists()
        assert not os.listdir(originals / ".writeback")


def test_whole_clear_side_and_remove(spark, tmp_path, originals):
    old, low = seen(originals), tmp_path / "images_lowres"
    big = lambda k: frames(spark, [(n, b"big %d" % k) for n in NAMES])
    wb.commit(spark, wb.stage(big(1), str(originals)), "whole", str(low))
    wb.commit(spark, wb.stage(big(2), str(originals)), "whole", str(low))  # again: the originals stay the first ones
    assert seen(low) == old and set(seen(originals).values()) == {b"big 2"}
    side = tmp_path / "side"
    wb.commit(spark, wb.stage(frames(spark, [("x.png", b"side")]), str(originals)), "side", target=str(side))
    assert seen(side) == {"x.png": b"side"} and len(seen(originals)) == 6
    gone = spark.createDataFrame([(NAMES[0],), (NAMES[5],), ("absent",), (NAMES[0],)], "name string")
    with pytest.raises(Stop):
        wb.remove(spark, gone, str(originals), str(tmp_path / "removed"), on_step=stop_at("done"))
    wb.recover(spark, str(originals))
    assert set(seen(originals)) == set(NAMES[1:5])
    assert wb.restore(spark, str(originals), str(tmp_path / "removed")) == 2
    assert set(seen(originals)) == set(NAMES)
    # a dataset of panoramas: what was there goes, the marker comes last
    with pytest.raises(Stop):
        wb.commit(spark, wb.stage(frames(spark, [("p_1.png", b"p"), (NAMES[2], b"q")]), str(originals)), "clear", marker=("m.json", {"kind": "pending"}), on_step=stop_at("marker"))
    wb.recover(spark, str(originals))
    assert set(seen(originals)) == {"p_1.png", NAMES[2], "m.json"} and b"pending" in seen(originals)["m.json"]


SCHEMA = "name string, model string, width int, pose double"


def batches(spark):
    first = [(f"i{k}", "PINHOLE", 100 + k % 3, float(k)) for k in range(40)]
    second = [("i3", "PINHOLE", 100, 99.0)] + [(f"j{k}", "SPHERE" if k % 2 else "PINHOLE", 100, float(k)) for k in range(7)]
    third = [("k0", None, 5, 0.0), ("k0", None, 5, 1.0), (None, "x", 1, 1.0)]
    return [spark.createDataFrame(rows, SCHEMA).repartition(2) for rows in (first, second, third)]


def test_growth_by_batches_is_the_whole_in_one(spark, tmp_path, monkeypatch):
    grow = GrowingModel(str(tmp_path / "m"), ["model", "width"], ["pose"], order="pose", parts=8)
    assert grow.images(spark) is None and grow.fingerprint() is None
    a, b, c = batches(spark)
    grow(a, 0)
    one = grow.fingerprint()
    before = {k: p["path"] for k, p in grow.version()["parts"].items()}
    grow(a, 0)  # the same batch again
    assert grow.versions() == [1]

    # killed just before the commit
    from orbisloom.streaming import growth

    with monkeypatch.context() as m:
        m.setattr(growth, "put_bytes", lambda *x: (_ for _ in ()).throw(Stop()))
        with pytest.raises(Stop):
            grow(b, 1)
    assert grow.versions() == [1] and grow.images(spark).count() == 40 and grow.fingerprint() == one
    grow(b, 1)
    grow(c, 2)
    got = {r.name: r for r in grow.images(spark).collect()}
    cameras = {r.camera_id: (r.model, r.width) for r in grow.cameras(spark).collect()}
    assert len(got) == 48 and got["i3"].pose == 3.0 and got["k0"].pose == 0.0
    assert sorted(r.image_id for r in got.values()) == list(range(1, 49))
    assert len(cameras) == len(set(cameras.values())) == 5 and sorted(cameras) == [1, 2, 3, 4, 5]
    assert all(cameras[got[f"i{k}"].camera_id] == ("PINHOLE", 100 + k % 3) for k in range(40))
    assert cameras[got["j1"].camera_id] == ("SPHERE", 100) and got["j0"].camera_id == got["i0"].camera_id
    # what the last batch hasn't touched is shared, old versions are as they were
    after = {k: p["path"] for k, p in grow.version()["parts"].items()}
    assert sum(before[k] == after[k] for k in before) > 0 and grow.images(spark, 1).count() == 40 and grow.fingerprint(1) == one
    assert len({grow.fingerprint(n) for n in grow.versions()}) == 3
    fourth = spark.createDataFrame([("i1", "PINHOLE", 100, 5.0)], SCHEMA)
    grow(fourth, 3)
    assert grow.fingerprint() == grow.fingerprint(3)


def test_growth_as_a_stream(spark, tmp_path):
    files = tmp_path / "in"
    for k, b in enumerate(batches(spark)):
        b.coalesce(1).write.mode("append").parquet(str(files))
        paths = sorted((str(p) for p in files.glob("*.parquet")), key=os.path.getmtime)
    touch_in_order(paths)
    grow = GrowingModel(str(tmp_path / "m"), ["model", "width"], ["pose"], order="pose")
    for _ in range(2):  # the second time there is nothing new
        drain(chunk_stream(spark, str(files), SCHEMA), grow, str(tmp_path / "ck"))
    assert grow.images(spark).count() == 48 and len(grow.versions()) == 3


RUNS = "node string, seq long, requeue int, target string, total long"


def test_stale_runs_are_dropped_over_restarts(spark, tmp_path):
    rows = []
    for node in ("a", "b"):
        seq = 0
        for requeue, target, n in ((0, "t1", 3), (1, "t1", 4), (0, "t1", 2), (1, "t2", 3), (1, "t2", 9), (0, "t2", 1), (0, "t2", 1)):
            for k in range(n):
                rows.append((node, seq, requeue if k == 0 else 1, target, 5 if node == "a" else None))
                seq += 1
    files = tmp_path / "in"
    paths = []
    for k in range(0, len(rows) // 2, 4):  # a file, and so a batch, for every four steps of both nodes
        part = [r for r in rows if k <= r[1] < k + 4]
        spark.createDataFrame(part, RUNS).coalesce(1).write.mode("append").parquet(str(files))
        new = sorted({str(p) for p in files.glob("*.parquet")} - set(paths))
        paths += new
    touch_in_order(paths)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
        half = paths[: len(paths) // 2]
        rest = [p for p in paths if p not in half]
        for p in rest:  # the second half comes after a restart
            os.rename(p, p + ".later")
        for later in (False, True):
            if later:
                for p in rest:
                    os.rename(p + ".later", p)
            q = numbered_runs(chunk_stream(spark, str(files), RUNS), "node", "seq")
            q.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted(map(tuple, spark.read.parquet(out).select("node", "seq", "run", "position", "dropped").collect()))
    want, state = [], {}
    for node, seq, requeue, target, total in sorted(rows):
        run, to, most, written = state.get(node, (0, None, None, 0))
        why = None
        if run:
            why = "new run" if requeue == 0 else "other target" if target != to else "complete" if most and written >= most else None
        if not run or why:
            run, to, most, written = run + 1, target, total, 0
        want.append((node, seq, run, written, why))
        state[node] = (run, to, most, written + 1)
    assert got == want
    assert {w[4] for w in want} == {None, "new run", "other target", "complete"}
    # the same rule on a table, where totals hold for a run's whole segment
    table = spark.createDataFrame([r for r in rows if r[0] == "a"], RUNS)
    batch = sorted(map(tuple, batch_runs(table, "node", "seq").select("node", "seq", "run", "position", "dropped").collect()))
    assert batch == [w for w in want if w[0] == "a"]
