"""Chains' histories as a stream: files that are added to a folder are read once each; every chain's rolling figures are kept as state, and a restart of the query goes
on from the checkpoint.

A chain may be reset and begin anew (a run each, from seq 1). Its figures then begin anew too; rows of an earlier run, and rows up to the last seq that has been seen, come late: they change nothing, but are
counted. Rows carry the number of their run, or null: then a first row that is another than the run's own first one begins the next run, and the rows that follow it in its file belong to that.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ROWS = "chain_id long, seq long, iteration long, total double, is_worse boolean, accepted boolean, run long"
#: A row for each row of the history that counts; and one with null seq for each micro-batch in which `late` rows of the chain were passed over.
OUT = "chain_id long, run long, seq long, iteration long, rate double, best double, best_iteration long, late long"
_OUT = Row(*[c.split()[0] for c in OUT.split(", ")])
RECENT, LEAST_SEEN = 200, 10
PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read(spark: SparkSession, path: str, files_at_once: int = 1) -> DataFrame:
    """Files in order of their times. A chain's rows of one time have to be in one file, or in one micro-batch."""
    return spark.readStream.schema(ROWS).option("maxFilesPerTrigger", files_at_once).parquet(path)


def numbered_runs(x: pd.DataFrame, run: int, last: int, first: float | None) -> np.ndarray:
    """The run of each row, in the order of their coming; run, last and first: where the chain is, and its run's first total."""
    own = x.run.to_numpy(float)
    out = np.where(np.isnan(own), -1, own).astype(np.int64)
    unknown = np.flatnonzero(out < 0)
    seq, total = x.seq.to_numpy(np.int64), x.total.to_numpy(float)
    for i in unknown.tolist():
        if seq[i] == 1:
            if last and total[i] != first:
                run += 1
            last, first = max(last, 1), total[i]
        out[i] = run
    return out


class Follow(StatefulProcessor):
    """Acceptance of the last worse proposals and the best accepted total, row by row. Chains are many and have few rows in a micro-batch, so a chain takes one read and one write of its state and no table of its own."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("chain", "run long, last long, first double, best double, best_iteration long, recent string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        """A chain's rows of one micro-batch, a few numbers each, have to be put in order of seq."""
        run, last, first, best, best_at, recent = self.now.get() or (0, 0, None, None, None, "")
        bits, late = deque(map(int, recent), RECENT), 0
        ones = sum(bits)
        by_run: dict[int, list] = {}
        now, met, begun = run, last, first
        for r in rows:  # as numbered_runs has it
            _, seq, _, total, _, _, own = r
            if own is None or own < 0:
                if seq == 1:
                    if met and total != begun:
                        now += 1
                    met, begun = max(met, 1), total
                own = now
            by_run.setdefault(own, []).append(r)
        for number in sorted(by_run):
            own = by_run[number]
            if number < run:
                late += len(own)
                continue
            if number > run:
                run, last, first, best, best_at, ones = number, 0, None, None, None, 0
                bits.clear()
            own.sort(key=lambda r: r[1])
            for _, seq, iteration, total, is_worse, accepted, _ in own:
                if seq <= last:
                    late += 1
                    continue
                last = seq
                if seq == 1:
                    first = total
                if is_worse:
                    ones += bool(accepted) - (bits[0] if len(bits) == RECENT else 0)
                    bits.append(int(bool(accepted)))
                if accepted and total is not None and (best is None or total < best):
                    best, best_at = total, iteration
                yield _OUT(key[0], run, seq, iteration, ones / len(bits) if len(bits) >= LEAST_SEEN else None, best, best_at, None)
        self.now.update((run, last, first, best, best_at, "".join(map(str, bits))))
        if late:
            yield _OUT(key[0], run, None, None, None, None, None, late)

    def close(self) -> None:
        pass


def figures(stream: DataFrame) -> DataFrame:
    return stream.select(*[c.split()[0] for c in ROWS.split(", ")]).groupBy("chain_id").transformWithState(statefulProcessor=Follow(), outputStructType=OUT, outputMode="Append", timeMode="None")


def start(stream: DataFrame, out: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Appends to a Parquet folder; without an interval it takes what is there and stops. State of this kind stands in RocksDB, which the session is set to while the query starts."""
    w = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
    conf = stream.sparkSession.conf
    was = conf.get(PROVIDER)
    conf.set(PROVIDER, ROCKS)
    try:
        return (w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)).start()
    finally:
        conf.set(PROVIDER, was)


def finished(query: StreamingQuery, seconds: float) -> None:
    """Waits for a query that stops by itself. One that hasn't by then is stopped, which is an error, as is a failure of its own: what it has written is not all."""
    ended = query.awaitTermination(seconds)
    if query.exception():
        raise query.exception()
    if not ended:
        query.stop()
        raise TimeoutError(f"the stream has not ended in {seconds} seconds")
