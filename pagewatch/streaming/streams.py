"""Structured Streaming operators (S1-S4) for incremental, restartable runs.

Each stream reads files with an explicit schema, checkpoints to a folder
under the cluster's checkpoint directory, keeps keyed state in RocksDB, and
writes through ``foreachBatch`` into a table partitioned by ``batch_id``: a
replayed batch (after a crash between write and commit) overwrites its own
partition, so the sink stays exactly-once. Tables that grow by updates (S1, S4)
can be folded while their stream lives (``snapshots.py``).
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.urls import classify_verdict, url_host
from ..operators.verdicts import body_digests, normalise_live, outcome_col
from ..session import store
from . import snapshots


def _write_batch(df: DataFrame, batch_id: int, path: str) -> None:
    (df.withColumn("batch_id", F.lit(batch_id).cast("long"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(path))


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available_now(query_builder, checkpoint: str):
    """Start a stream with ``trigger(availableNow=True)`` and wait for it to finish."""
    SparkSession.active().conf.set(STATE_STORE, ROCKSDB)  # state on executors' disks, not in their heap
    q = query_builder.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return q


# ------------------------------------------------------------------ S1
LATEST = "original string, best struct<ts14:string,pos:bigint>, n_captures long"


def stream_latest_good(captures: DataFrame, sink: str, checkpoint: str, code: str = "200"):
    """Newest good capture per URL as capture files arrive (update mode).

    State is one row per URL ("latest ever", no watermark), in RocksDB. Each
    batch's updated rows are added to ``sink``; ``read_latest_good`` reduces them on
    read, ``compact_latest_good`` folds them while the stream goes on.
    """
    good = F.when(F.col("statuscode") == F.lit(code), F.struct("ts14", "pos"))
    agg = captures.groupBy("original").agg(F.max(good).alias("best"), F.count(F.lit(1)).alias("n_captures"))
    w = (agg.writeStream.outputMode("update")
         .foreachBatch(lambda df, bid: snapshots.write_batch(df, bid, sink)))
    return run_available_now(w, checkpoint)


def _newest(updates: DataFrame) -> DataFrame:
    """The last update of each URL: it holds the running maximum."""
    last = updates.groupBy("original").agg(F.max_by(F.struct("best", "n_captures", "batch_id"), "batch_id").alias("r"))
    return last.select("original", "r.best", "r.n_captures", "r.batch_id")


def read_latest_good(spark: SparkSession, sink: str, keep_all: bool = False) -> DataFrame:
    """The S1 table reduced; with ``keep_all`` URLs without a good capture stay, with null fields."""
    last = _newest(snapshots.read(spark, sink, LATEST))
    if not keep_all:
        last = last.filter(F.col("best").isNotNull())
    return last.select("original", F.col("best.ts14").alias("ts14"), F.col("best.pos").alias("pos"), "n_captures")


def compact_latest_good(spark: SparkSession, sink: str) -> int:
    """Fold ``sink`` to one row per URL; the stream and its readers go on with the same table."""
    return snapshots.compact(spark, sink, LATEST, _newest)


# ------------------------------------------------------------------ S2
def stream_verdicts(live: DataFrame, work: DataFrame, latest_sink: str, bodies_path: str, sink: str, checkpoint: str,
                    content_only: bool = True):
    """A verdict and an outcome per arriving live observation, against the archive as it is when the batch runs.

    Each batch reads the table of S1 and the bodies stored by then, for its own URLs only: captures and bodies that
    arrive between two batches change the verdicts of the second. Live pages are digested in the stream, then joined.
    An observation of a URL that is not in ``work`` (url) is kept, with the outcome ``not_in_work``. E6's counters of
    each batch, its seconds and its rate are written to ``sink/progress``.
    """
    seen = [c for c in ("fetched_at",) if c in live.columns]

    def judge(df: DataFrame, batch_id: int) -> None:
        spark, start = df.sparkSession, time.time()
        obs = store(normalise_live(df, content_only), "live_batch")
        urls = obs.select("url").distinct().join(work.select("url").distinct(), "url", "left_semi")
        latest = read_latest_good(spark, latest_sink, keep_all=True).withColumnRenamed("original", "url").join(urls, "url", "left_semi")
        latest = store(latest, "latest_batch")
        bodies = spark.read.schema(BODY_STREAM_SCHEMA).parquet(bodies_path)
        state = urls.withColumn("in_work", F.lit(True)).join(latest, "url", "left").join(body_digests(latest, bodies, content_only), ["url", "ts14"], "left")
        j = obs.join(state.withColumn("has_body", F.coalesce("has_body", F.lit(False))), "url", "left")
        j = j.withColumn("verdict", F.when(F.col("has_body"), classify_verdict("live_status_code", "live_digest", "archive_digest", "has_body")))
        out = j.select("url", "live_status_code", *seen, "verdict",
                       F.when(F.col("in_work"), outcome_col(content_only)).otherwise(F.lit("not_in_work")).alias("outcome"))
        _write_batch(out, batch_id, f"{sink}/verdicts")
        done = spark.read.parquet(f"{sink}/verdicts").filter(F.col("batch_id") == batch_id)
        counters = done.agg(F.count(F.lit(1)).alias("checked"), F.count("verdict").alias("found"))
        seconds = max(time.time() - start, 1e-3)
        _write_batch(counters.withColumn("seconds", F.lit(seconds)).withColumn("urls_per_sec", F.round(F.col("checked") / seconds, 1)), batch_id, f"{sink}/progress")

    return run_available_now(live.writeStream.outputMode("append").foreachBatch(judge), checkpoint)


def read_verdicts(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.parquet(f"{sink}/verdicts")


def read_progress(spark: SparkSession, sink: str) -> DataFrame:
    """E6 step by step: a row per batch with its counters, and what all batches up to it checked and found."""
    steps = spark.read.parquet(f"{sink}/progress")
    upto = Window.orderBy("batch_id")  # one row a batch
    return steps.withColumn("total_checked", F.sum("checked").over(upto)).withColumn("total_found", F.sum("found").over(upto))


# ------------------------------------------------------------------ S3
def stream_checked(urls: DataFrame, ledger: str, checkpoint: str, known: DataFrame | None = None):
    """S3: each URL enters the ledger once across batches and restarts.

    The URLs seen so far are the stream's state (RocksDB, in the checkpoint
    folder), so a batch costs its own rows and the ledger is not read again.
    Not ``dropDuplicatesWithinWatermark``: that forgets a URL once the
    watermark passes it. ``known``: URLs of an earlier ledger, left out.
    """
    fresh = urls.select("url").dropDuplicates(["url"])
    if known is not None:
        fresh = fresh.join(known.select("url"), "url", "left_anti")
    w = fresh.writeStream.outputMode("append").foreachBatch(lambda df, bid: _write_batch(df, bid, ledger))
    return run_available_now(w, checkpoint)


# ------------------------------------------------------------------ S4
DAILY = "domain string, day timestamp, month string, late boolean, n long, top timestamp"


def stream_daily_counts(captures: DataFrame, sink: str, checkpoint: str, watermark: str = "45 days", code: str = "200"):
    """Good captures per (domain, day), with rows later than ``watermark`` marked as corrections, by one stream.

    Each batch adds its own counts, so there is no state to keep and none to drop: a count of a day is the sum of what
    all batches added. A row is late if its day had ended by the watermark of the batches before, the highest time that
    they have seen less the delay; that time stands beside the counts, in the same partition, so counts, corrections and
    watermark of a batch are written at once and a replay writes the same. Rows without a time are left out.
    """
    delay = F.expr(f"INTERVAL {watermark}")

    def add(df: DataFrame, batch_id: int) -> None:
        highest = snapshots.read(df.sparkSession, sink, DAILY, before=batch_id).agg(F.max("top")).first()[0]
        day = F.window("ts", "1 day")
        late = day.getField("end") <= F.lit(highest).cast("timestamp") - delay if highest is not None else F.lit(False)
        rows = df.filter("ts IS NOT NULL").withColumn("late", late)
        counts = rows.groupBy("domain", day.getField("start").alias("day"), "month", "late").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("top"))
        snapshots.write_batch(counts, batch_id, sink)

    return run_available_now(_days(captures, code).writeStream.outputMode("append").foreachBatch(add), checkpoint)


def compact_daily_counts(spark: SparkSession, sink: str) -> int:
    """Fold ``sink`` to one row per (domain, day), late and in time apart, while the stream goes on."""
    def fold(updates: DataFrame) -> DataFrame:
        return updates.groupBy("domain", "day", "month", "late").agg(F.sum("n").alias("n"), F.max("top").alias("top"), F.max("batch_id").alias("batch_id"))

    return snapshots.compact(spark, sink, DAILY, fold)


def _days(captures: DataFrame, code: str) -> DataFrame:
    # ts14 is UTC: parse it as an absolute instant so day windows (UTC-aligned)
    # never straddle a month, and carry the month from the string itself, so the
    # result does not depend on the session time zone.
    return captures.filter(F.col("statuscode") == F.lit(code)).select(
        url_host(F.col("original")).alias("domain"),
        F.try_to_timestamp(F.concat(F.col("ts14"), F.lit("+0000")), F.lit("yyyyMMddHHmmssZ")).alias("ts"),
        F.concat_ws("-", F.substring("ts14", 1, 4), F.substring("ts14", 5, 2)).alias("month"))


def read_monthly_counts(spark: SparkSession, sink: str) -> DataFrame:
    """S4 read side: all counts rolled up to months, and how many of them were corrections."""
    days = snapshots.read(spark, sink, DAILY)
    return days.groupBy("domain", "month").agg(F.sum("n").alias("n_captures"), F.sum(F.when(F.col("late"), F.col("n")).otherwise(0)).alias("n_late"))


BODY_STREAM_SCHEMA = "original string, ts14 string, html string"
CAPTURE_STREAM_SCHEMA = T.StructType([
    T.StructField("original", T.StringType()), T.StructField("ts14", T.StringType()),
    T.StructField("statuscode", T.StringType()), T.StructField("digest", T.StringType()),
    T.StructField("pos", T.LongType()),
])
