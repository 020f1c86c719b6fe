"""Incremental forms: folders in batches with restart, known-molecule history, and running metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery


def folder_batches(spark: SparkSession, path: str, schema: str, write: Callable[[DataFrame, int], None], checkpoint: str, files: int = 3, fmt: str = "json") -> StreamingQuery:
    """Runs `write(batch, number)` on the folder's new files, `files` at a time, and stops. Started again with the same checkpoint it goes on behind the last complete batch."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(fmt).load(path)
    query = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def new_molecules(rows: DataFrame, ts: str | None = None, delay: str = "1 hour") -> DataFrame:
    """First sight of each smiles; with a time column the history is kept for `delay` only, so state stays bounded."""
    if ts is None:
        return rows.dropDuplicates(["smiles"])
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["smiles"])


def running_means(rows: DataFrame, key: str = "event_type", ts: str = "ts", value: str = "value", window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Count, sum and mean of a value by key and time window, with late rows up to `delay`."""
    timed = rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    out = timed.groupBy(key, F.window(ts, window).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return out.select(key, F.col("w.start").alias("start"), "n", "total", "mean")


class LastValues(StatefulProcessor):
    """Per key the last `size` values by (ts, id) and a count; a key without rows for `keep_ms` of event time gives its last numbers once more, closed, and its state goes."""

    def __init__(self, size: int, keep_ms: int, key: str, value: str):
        self.size, self.keep_ms, self.key, self.value = size, keep_ms, key, value

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "ts array<timestamp>, id array<long>, v array<double>, n long")

    def _row(self, key: tuple, v: list[float], n: int, closed: bool) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]], "n": [n], "median": [sorted(v)[(len(v) + 1) // 2 - 1]], "mean": [sum(v) / len(v)], "max": [max(v)], "closed": [closed]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ts, ids, v, n = self.held.get() if self.held.exists() else ([], [], [], 0)
        all_ = list(zip(ts, ids, v))
        for batch in rows:
            n += len(batch)
            all_ += zip(batch["ts"].dt.to_pydatetime(), batch["event_id"].astype(int), batch[self.value].astype(float))
            all_ = sorted(all_, key=lambda x: (x[0].timestamp(), x[1]))[-self.size :]
        self.held.update(([t for t, *_ in all_], [int(i) for _, i, _ in all_], [float(x) for *_, x in all_], n))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(all_[-1][0].timestamp() * 1000) + self.keep_ms)
        yield self._row(key, [x for *_, x in all_], n, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, _, v, n = self.held.get()
        self.held.clear()
        yield self._row(key, list(v), n, True)

    def close(self) -> None:
        pass


def last_values(rows: DataFrame, size: int = 20, key: str = "event_type", value: str = "value", keep: str = "30 days", delay: str = "1 hour") -> DataFrame:
    """(key, n, median, mean, max, closed) of the last `size` values of a key in order of (ts, event_id), after each batch that has some of it.

    State is `size` values and a count a key, in the RocksDB state store, which the session must use. A key without a row for `keep` of event time ends: its numbers come once more as `closed` and its state goes, so that keys which
    stop do not stay. A row for it later begins a new count. Rows later than `delay` behind the latest are dropped, as with any watermark.
    """
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    timed = rows.withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", key, "ts", value).withWatermark("ts", delay)
    return timed.groupBy(key).transformWithStateInPandas(LastValues(size, keep_ms, key, value), f"{key} string, n long, median double, mean double, max double, closed boolean", "update", "EventTime")


def two_sinks(stream: DataFrame, split: Callable[[DataFrame], dict[str, DataFrame]], root: str, checkpoint: str) -> StreamingQuery:
    """Runs the stream to its end into several tables at once: split(batch) gives a frame by table name, results and rejects, say.

    Each table's rows of batch n are the folder `<root>/<table>/batch=n`, written by overwriting, and when all tables have theirs the batch gets a row in `<root>/_done`. A batch that stopped between two tables is done again by
    the restarted query, with the same rows under the same number, so it replaces what it left. read_done() shows finished batches only: tables never differ in what they have seen.
    """
    def write(batch: DataFrame, n: int) -> None:
        held = batch.persist()
        try:
            for name, rows in split(held).items():
                rows.write.mode("overwrite").parquet(f"{root}/{name}/batch={n}")
            batch.sparkSession.createDataFrame([(n,)], "done long").write.mode("overwrite").parquet(f"{root}/_done/batch={n}")
        finally:
            held.unpersist()

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def read_done(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table `name` of two_sinks(): rows of finished batches, with `batch`."""
    done = spark.read.parquet(f"{root}/_done").select("batch")
    return spark.read.option("basePath", f"{root}/{name}").parquet(f"{root}/{name}/batch=*").join(done, "batch")


def molecules_new_to(history: str, stream: DataFrame, checkpoint: str, key: str = "smiles") -> StreamingQuery:
    """Adds to the table at `history` the stream's molecules that it does not have: the first sight of each across all runs, with no state in the stream.

    Each batch is de-duplicated and anti-joined with the folders of batches before it, and overwrites its own, so that a batch done again after a crash gives the same rows. A history belongs to its checkpoint, which numbers the batches through all runs.
    """
    def write(batch: DataFrame, n: int) -> None:
        spark, new = batch.sparkSession, batch.dropDuplicates([key])
        if n > 0:
            before = spark.read.parquet(history).filter(F.col("batch") < n).select(key)
            new = new.join(before, key, "left_anti")
        new.write.mode("overwrite").parquet(f"{history}/batch={n}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
