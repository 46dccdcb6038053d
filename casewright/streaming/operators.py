"""Streams: request limits, lock-outs, document ingest, audit counts; each with its batch form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def request_limits(requests: DataFrame, *, window: str = "1 minute", most: int = 100, late: str = "10 minutes", key: str = "user_id", ts: str = "ts") -> DataFrame:
    """(window_start, key, n, over_limit): requests in tumbling windows; the same for a stream and a table."""
    marked = requests.withWatermark(ts, late) if requests.isStreaming else requests
    counted = marked.groupBy(F.window(ts, window), F.col(key)).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), key, "n", (F.col("n") > most).alias("over_limit"))


def activity(audit: DataFrame, *, window: str = "1 hour", late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """(window_start, action, n): audit rows by action and time."""
    marked = audit.withWatermark(ts, late) if audit.isStreaming else audit
    counted = marked.groupBy(F.window(ts, window), "action").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), "action", "n")


def lockouts(attempts: DataFrame, *, failures: int = 5, minutes: int = 15, idle: str | None = None) -> DataFrame:
    """(user_id, event_id, ts, run, locked_until): attempts that lock a user: the fifth and later failures in a row.

    A success ends a run; the end of a lock doesn't; with `idle` (an interval) a longer pause does. attempts: (user_id,
    event_id, ts, success boolean). Gaps and islands: the running number of run ends names the run.
    """
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ends = F.col("success")
    if idle:
        ends = ends | F.coalesce(F.col("ts") > F.lag("ts").over(w) + F.expr(f"INTERVAL {idle}"), F.lit(False))
    runs = attempts.withColumn("_end", ends).withColumn("_island", F.sum(F.col("_end").cast("int")).over(w)).filter(~F.col("success"))
    n = F.row_number().over(Window.partitionBy("user_id", "_island").orderBy("ts", "event_id"))
    return runs.withColumn("run", n).filter(F.col("run") >= failures).select("user_id", "event_id", "ts", "run", _locked(minutes))


def _locked(minutes: int):
    return (F.col("ts") + F.expr(f"INTERVAL {minutes} MINUTES")).alias("locked_until")


class LockoutProcessor(StatefulProcessor):
    """A user's attempts in the order of time, whatever batch brings them.

    They wait in a list until the watermark has passed them, when a timer takes them in order; of what is done only the
    length of the run and the time of the last attempt stay, and nothing once a success has ended the run or `idle`
    microseconds have passed, so the state is bounded by the attempts within the watermark and the runs within `idle`.
    """

    def __init__(self, failures: int, idle: int):
        self.failures, self.idle = failures, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us bigint, event_id bigint, success boolean")
        self.run = handle.getValueState("run", "length int, last bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            found = list(zip(frame["us"].tolist(), frame["event_id"].tolist(), frame["success"].tolist()))
            self.waiting.appendList(found)
            for at in {us // 1000 + 1 for us, _, _ in found}:
                self.handle.registerTimer(at)
        yield pd.DataFrame({"user_id": [], "event_id": [], "us": [], "run": []})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = expiredTimerInfo.getExpiryTimeInMs() * 1000
        waiting = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        length, last = tuple(self.run.get()) if self.run.exists() else (0, None)
        due, out = sorted(r for r in waiting if r[0] < passed), []
        for us, event, success in due:
            length = 0 if success else 1 if last is not None and us - last > self.idle else length + 1
            last = us
            if length >= self.failures:
                out.append((key[0], event, us, length))
        rest = [r for r in waiting if r[0] >= passed]
        if due:
            self.waiting.put(rest) if rest else self.waiting.clear()
        if length and not (not due and last is not None and passed > last + self.idle):
            self.run.update((length, last))
            if due:
                self.handle.registerTimer((last + self.idle) // 1000 + 2)
        elif self.run.exists():
            self.run.clear()
        yield pd.DataFrame(out, columns=["user_id", "event_id", "us", "run"])

    def close(self) -> None:
        pass


def lockouts_stream(attempts: DataFrame, *, failures: int = 5, minutes: int = 15, late: str = "10 minutes", idle_seconds: int = 86_400) -> DataFrame:
    """lockouts() of a stream, with `idle` = idle_seconds: rows come when the watermark, `late` behind the newest attempt,
    has passed them, in the order of time, not of arrival; attempts later than that are dropped.

    Needs RocksDB as the store of states (spark.sql.streaming.stateStore.providerClass).
    """
    timed = attempts.withWatermark("ts", late).select("user_id", "event_id", "ts", F.unix_micros("ts").alias("us"), "success")
    found = timed.groupBy("user_id").transformWithStateInPandas(LockoutProcessor(failures, idle_seconds * 1_000_000), "user_id bigint, event_id bigint, us bigint, run int", "Append", "EventTime")
    return found.select("user_id", "event_id", F.timestamp_micros("us").alias("ts"), "run").select("*", _locked(minutes))


def ingest(documents: DataFrame, path: str, checkpoint: str, *, kinds: dict | None = None, size: int = 100_000, overlap: int = 5_000, window: int = 5_000, every: int = 10):
    """Start a query over a stream of documents (case_id, file, doc_id, text): chunks and mention counts under `path`.

    A micro-batch writes its chunks and its counts (case_id, kind, name, file, mentions) under its number, then a ledger
    row that makes them count; a repeated batch writes the same folders again. Each `every`-th batch also writes the
    counts up to it as one snapshot, so reading merges one snapshot and fewer than `every` batches.
    """
    from casewright.operators.extract import document_frequency, mentions, name_files
    from casewright.operators.text import chunk_text

    def merge(batch: DataFrame, number: int) -> None:
        spark, held = batch.sparkSession, batch.persist()
        try:
            chunk_text(held, size=size, overlap=overlap, window=window).write.mode("overwrite").parquet(f"{path}/chunks/batch={number}")
            name_files(document_frequency(mentions(held, kinds=kinds))).write.mode("overwrite").parquet(f"{path}/counts/batch={number}")
            whole = (number + 1) % every == 0
            if whole:
                earlier = _counted(spark, path, number) if number else None
                mine = spark.read.parquet(f"{path}/counts/batch={number}")
                _summed(mine if earlier is None else earlier.unionByName(mine)).write.mode("overwrite").parquet(f"{path}/snapshots/upto={number}")
            done = held.agg(F.count("*").alias("n_docs")).withColumn("has_snapshot", F.lit(whole))
            done.coalesce(1).write.mode("overwrite").parquet(f"{path}/ledger/batch={number}")
        finally:
            held.unpersist()

    return documents.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("case_id", "kind", "name", "file").agg(F.sum("mentions").alias("mentions"))


def _counted(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """Counts of the ledger's batches (numbered below `before`): the last snapshot and the batches after it."""
    ledger = spark.read.parquet(f"{path}/ledger")
    if before is not None:
        ledger = ledger.filter(F.col("batch") < before)
    last = ledger.filter("has_snapshot").agg(F.max("batch")).first()[0]
    fresh = ledger.filter(F.col("batch") > (-1 if last is None else last)).select("batch")
    rows = spark.read.parquet(f"{path}/counts").filter(F.col("batch") > (-1 if last is None else last)).join(fresh, "batch", "left_semi").drop("batch")
    return rows if last is None else rows.unionByName(spark.read.parquet(f"{path}/snapshots/upto={last}"))


def merged_counts(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, kind, name, mentions, n_files) of everything that ingest() has taken in so far."""
    return _summed(_counted(spark, path)).groupBy("case_id", "kind", "name").agg(F.sum("mentions").alias("mentions"), F.count("*").alias("n_files"))


def ingested_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of the batches in the ledger."""
    done = spark.read.parquet(f"{path}/ledger").select("batch")
    return spark.read.parquet(f"{path}/chunks").join(done, "batch", "left_semi").drop("batch")
