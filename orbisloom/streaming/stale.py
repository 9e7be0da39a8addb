"""Runs of a stream with state that outlives them: what a run that broke off has left is found out and dropped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NEW_RUN, OTHER_TARGET, COMPLETE = "new run", "other target", "complete"


class RunStates(StatefulProcessor):
    """Per node: the run's number, its target, how many frames it should have and how many came.

    A row belongs to the run at hand unless that is stale: the row says that its run is the first of a queue (requeue 0), or
    goes to another target, or the run has all its frames. Then the state is cleared and a new run begins, which takes its
    target and its number of frames from the row. A null number of frames is never complete."""

    def __init__(self, key: str, order: str, types: dict[str, str]):
        self.key, self.order, self.types = key, order, types

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.runs = handle.getValueState("runs", "n long")
        self.target = handle.getValueState("target", f"target {self.types['target']}, total long")
        self.written = handle.getValueState("written", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(rows).sort_values(self.order)
        run = self.runs.get()[0] if self.runs.exists() else 0
        target, total = self.target.get() if self.target.exists() else (None, None)
        written, open_run, out = self.written.get()[0] if self.written.exists() else 0, self.target.exists(), []
        for at, requeue, to, frames in zip(batch[self.order], batch["requeue"], batch["target"], batch["total"]):
            why = None
            if open_run:
                why = NEW_RUN if requeue == 0 else OTHER_TARGET if to != target else COMPLETE if total is not None and written >= total else None
            if why:
                open_run = False
            if not open_run:
                run, written, target, total, open_run = run + 1, 0, to, None if pd.isna(frames) or frames <= 0 else int(frames), True
            out.append((key[0], at, run, written, why))
            written += 1
        self.runs.update((run,))
        self.target.update((target, total))
        self.written.update((written,))
        yield pd.DataFrame(out, columns=[self.key, self.order, "run", "position", "dropped"])

    def close(self) -> None:
        pass


def numbered_runs(stream: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order, run, position, dropped) for rows of key, order, requeue, target and total: each row's run, its place there
    and, on a run's first row, why the state of the run before was dropped. Batches must come in order; rows within a batch
    are ordered here. Needs the RocksDB state store."""
    types = {f.name: f.dataType.simpleString() for f in stream.schema}
    schema = f"`{key}` {types[key]}, `{order}` {types[order]}, run long, position long, dropped string"
    asked = stream.select(key, order, "requeue", "target", "total")
    return asked.groupBy(key).transformWithStateInPandas(RunStates(key, order, types), schema, "Append", "None")
