"""Stateful streams: active-only de-duplication of jobs, ledgers as views, retention.

A key's job is shared only while it runs: an event of the key's end releases it.  The
state is one small value a key, so time-based de-duplication would be wrong, and the
state of ended keys is deleted.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from tessera.operators.catalog import latest
from tessera.operators.evaluation import null_safe_join
from tessera.session import scratch_root, ship_package
from tessera.sources import store

OUTPUT = "content_key string, event_id long, outcome string, job_id long"


class ActiveJobs(StatefulProcessor):
    """For each submission: a new job, or the running job of its content key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.active = handle.getValueState("active", StructType([StructField("job_id", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        job = int(self.active.get()[0]) if self.active.exists() else None
        out = []
        for event_id, kind in zip(events["event_id"], events["event"], strict=True):
            if kind == "submit":
                outcome = "shared" if job is not None else "new"
                job = int(event_id) if job is None else job
                out.append((key[0], int(event_id), outcome, job))
            elif job is not None:
                out.append((key[0], int(event_id), "released", job))
                job = None
        if job is None:
            self.active.clear()
        else:
            self.active.update((job,))
        if out:
            yield pd.DataFrame(out, columns=["content_key", "event_id", "outcome", "job_id"])

    def close(self) -> None:
        pass


def active_jobs_stream(events: DataFrame) -> DataFrame:
    """events (streaming): content_key, event_id, ts, event in (submit, end)."""
    return events.groupBy("content_key").transformWithStateInPandas(statefulProcessor=ActiveJobs(), outputStructType=OUTPUT, outputMode="Append", timeMode="None")


def active_jobs_batch(events: DataFrame) -> DataFrame:
    """The same outcome over a finished log: a submission is new if it follows an end or nothing."""
    w = Window.partitionBy("content_key").orderBy("ts", "event_id")
    rows = events.withColumn("_p", F.lag("event").over(w))
    rows = rows.withColumn("outcome", F.when(F.col("event") == "submit", F.when(F.coalesce("_p", F.lit("end")) == "end", "new").otherwise("shared")).when(F.col("_p") == "submit", "released"))
    rows = rows.withColumn("job_id", F.last(F.when(F.col("outcome") == "new", F.col("event_id")), ignorenulls=True).over(w))
    return rows.where("outcome is not null").select("content_key", "event_id", "outcome", "job_id")


def run_available(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over what is there, into Parquet in the shared folder, and reads it."""
    ship_package(spark)
    base = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = stream.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if before:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
        else:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def materialise_ledger(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], sequence: Sequence[str]):
    """A stream of actions kept as the latest action of each key, versioned by batch (T5).

    Each batch merges into the table the batch before it wrote and writes a new version,
    so a batch that runs twice writes the same version twice.  Of versions the last two
    stay: a batch that runs again needs the one before it.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        whole = batch
        if number:
            whole = spark.read.schema(batch.schema).parquet(f"{path}/version={number - 1}").unionByName(batch)
        latest(whole, keys, sequence).select(*batch.columns).write.mode("overwrite").parquet(f"{path}/version={number}")
        if number > 1:
            store.delete(spark, f"{path}/version={number - 2}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def retain_terminal(jobs: DataFrame, ended: Column, order: Sequence[str], keep: int = 64) -> DataFrame:
    """Running jobs and the last ``keep`` ended ones by submission."""
    last = jobs.where(ended).orderBy(*[F.col(c).desc() for c in order]).limit(keep)
    return jobs.where(~ended).unionByName(last)


def once_per_key(df: DataFrame, keys: Sequence[str], work) -> DataFrame:
    """Runs costly work on one row of each key and joins the results back (T4).

    ``work`` takes a DataFrame of distinct keys and adds columns.  The scope (a match)
    belongs in the keys.
    """
    done = work(df.select(*keys).dropDuplicates(list(keys)))
    return null_safe_join(df, done, list(keys))


def event_windows(events: DataFrame, duration: str, delay: str) -> DataFrame:
    """Counts in event-time windows with a watermark.  An extension, not part of parity."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", duration).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
