"""Reservoirs over streams: each run's state persists across batches and episodes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor

from braidwork.operators.logs import positions
from braidwork.operators.sequence import Leaky, fed


def reservoir(seed: int, units: int, inputs: int, leak: float = 0.3, radius: float = 0.9, kind: type[Leaky] = Leaky) -> Leaky:
    """A reservoir of a kind, which says how weights begin, with its spectral radius set."""
    w, w_in = kind.initial(np.random.default_rng(seed), units, inputs)
    return kind(w * (radius / np.abs(np.linalg.eigvals(w)).max()), w_in, leak)


class Ordered(StatefulProcessor):
    """Folds each run's rows in the order of ``nth``, whatever batches they come in.

    A value state holds the next place and the reservoirs' vector. Rows that come too early wait in a list state;
    where a gap isn't filled within ``patience`` (milliseconds), a timer lets the rows behind it pass in order. Rows
    whose place is past are repeats and go.
    """

    def __init__(self, reservoirs: list[Leaky], observed: int | None, reset: bool, skip: bool, patience: int):
        self.reservoirs, self.observed, self.reset, self.skip, self.patience = reservoirs, observed, reset, skip, patience
        self.cuts = np.cumsum([len(r.w) for r in reservoirs])

    def init(self, handle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "next long, fresh boolean, x array<double>")
        self.early = handle.getListState("early", _ROW)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        own = [r for pdf in rows for r in pdf[_NAMES].itertuples(index=False, name=None)]
        yield self._passed(key, [*own, *(tuple(r) for r in self.early.get())], timerValues, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._passed(key, [tuple(r) for r in self.early.get()], timerValues, True)

    def _passed(self, key: tuple, rows: list[tuple], timer, overdue: bool) -> pd.DataFrame:
        following, fresh, x = self.at.get() if self.at.exists() else (0, True, np.zeros(self.cuts[-1]))
        x, out, waiting = np.asarray(x, float), [], []
        for nth, step, id_, u, done in sorted(rows, key=lambda r: r[0]):
            if nth < following:
                continue
            if nth > following and not overdue:
                waiting.append((int(nth), int(step), int(id_), [float(v) for v in u], bool(done)))
                continue
            parts = self._updated(x, np.asarray(u, float))
            x, following = np.concatenate(parts), int(nth) + 1
            seen = np.concatenate([p[: self.observed] for p in parts])
            out.append((key[0], int(nth), int(step), int(id_), fresh, list(map(float, u)), (np.concatenate([seen, u]) if self.skip else seen).tolist()))
            fresh = bool(self.reset and done)
            if fresh:
                x = np.zeros(len(x))
        self.at.update((following, fresh, x.tolist()))
        for timer_at in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer_at)
        if waiting:
            self.early.put(waiting)
            self.handle.registerTimer(timer.getCurrentProcessingTimeInMs() + self.patience)
        else:
            self.early.clear()
        return pd.DataFrame(out, columns=["run", "nth", "step", "id", "fresh", "u", "context"])

    def _updated(self, x: np.ndarray, u: np.ndarray) -> list[np.ndarray]:
        widths = [r.w_in.shape[1] for r in self.reservoirs]
        if any(len(u) != n for n in widths):
            raise ValueError(f"an input has {len(u)} numbers, the reservoirs take {widths}")
        return [r.update(own, u) for r, own in zip(self.reservoirs, np.split(x, self.cuts[:-1]), strict=True)]

    def close(self) -> None:
        pass


_ROW = "nth long, step long, id long, u array<double>, done boolean"
_NAMES = ["nth", "step", "id", "u", "done"]


def contexts(events: DataFrame, reservoirs: list[Leaky], observed: int | None = None, reset: bool = False, skip: bool = False, patience: int = 3_600_000) -> DataFrame:
    """``run, nth, step, id, fresh, u, context`` for streaming rows ``run, nth, step, id, u, done``.

    ``nth`` counts a run's rows from 0; batches may bring them in any order and more than once. Contexts of several
    reservoirs are joined end to end; ``observed`` shows only the first units of each; ``reset`` empties a run's state
    after an episode's end, and ``fresh`` marks the rows that start from an empty one; ``skip`` appends the input.
    """
    kind = events.schema["run"].dataType.simpleString()
    shape = f"run {kind}, nth long, step long, id long, fresh boolean, u array<double>, context array<double>"
    return events.groupBy("run").transformWithStateInPandas(Ordered(reservoirs, observed, reset, skip, patience), shape, "Append", "ProcessingTime")


def inputs(events: DataFrame) -> DataFrame:
    """``run, step, id, u, done`` from the events table, batch or stream; the step is the time of the event in microseconds.

    The input is the observation (value), a neutral action and the reward (1 for a purchase).
    """
    reward = (F.col("event_type") == "purchase").cast("double")
    step = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.filter("user_id is not null").select(F.col("user_id").alias("run"), step.alias("step"), F.col("event_id").alias("id"), fed(F.array(F.log1p("value")), F.array(F.lit(0.0)), reward).alias("u"), (F.col("event_type") == "purchase").alias("done"))


def numbered(events: DataFrame) -> DataFrame:
    """``inputs`` of a table with ``nth``, each row's place in its run."""
    return positions(inputs(events), "run", by=("step", "id")).withColumnRenamed("pos", "nth")


#: What a run to the end needs: a state store for processors with several states, its changes written as logs, and no
#: batches without rows, which a processor with timers would ask for without end.
_ENDING = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def finished(writer: DataStreamWriter, spark: SparkSession) -> None:
    """Run a stream on all that is there now; the session's own settings are set again after it."""
    before = {k: spark.conf.get(k, None) for k in _ENDING}
    for k, v in _ENDING.items():
        spark.conf.set(k, v)
    try:
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_once(stream: DataFrame, path: str) -> DataFrame:
    """All that is there now through the stream into Parquet under ``path``, and the table read back."""
    finished(stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint"), stream.sparkSession)
    return stream.sparkSession.read.parquet(f"{path}/out")


def recorder(path: str) -> Callable[[DataFrame, int], None]:
    """What writes a batch's rows to the folder of its number: a batch that comes again replaces its own rows."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def tapped(stream: DataFrame, path: str, record: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Inputs, contexts and fresh starts of a stream recorded under ``path``, exactly once, and the record read back."""
    record = record or recorder(f"{path}/tap")
    finished(stream.writeStream.foreachBatch(record).option("checkpointLocation", f"{path}/checkpoint"), stream.sparkSession)
    return stream.sparkSession.read.parquet(f"{path}/tap")
