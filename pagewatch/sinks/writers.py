"""Sinks: URL index (B1, F4), findings (B2), ledger (B3), run report (B4),
cluster outputs (B5-B7) and the translation cache (B8).

Writers are plain DataFrame writes: partitioned, committed by Spark's output
committer (a failed task's files never become visible), idempotent per run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import finding_key


def write_url_index(index: DataFrame, path: str, fmt: str = "text", keys: tuple = ("domain", "year", "month")) -> None:
    """B1 + F4: sorted URL files per (domain, year, month); empty months write nothing.
    With ``keys`` (domain, year) the lists of year mode.

    Range partitioning on (domain, year, month, original) keeps a month's URLs
    in order across tasks: a small month is one sorted file, a month holding a
    third of all rows is split into several sorted, non-overlapping files whose
    names follow the order. Dynamic partition overwrite replaces only the
    months being written (a re-run of one month leaves the others).
    """
    out = (index.select(*keys, "original")
           .repartitionByRange(*keys, "original")
           .sortWithinPartitions(*keys, "original"))
    w = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys)
    if fmt == "text":
        w.text(path)
    else:
        w.parquet(path)


def read_url_index(spark, path: str, fmt: str = "text", keys: tuple = ("domain", "year", "month")) -> DataFrame:
    """Read B1 back as (domain, year, month, original) via partition discovery."""
    df = spark.read.text(path) if fmt == "text" else spark.read.parquet(path)
    if fmt == "text":
        df = df.withColumnRenamed("value", "original")
    return df.select(*[F.col(k).cast("string" if k == "domain" else "int") for k in keys], "original")


def write_findings(docs: DataFrame, path: str, run_id: str, per_document: bool = False) -> None:
    """B2: finding documents (M7) as JSON, partitioned by run and verdict.

    Writing a run again replaces its own partition. ``per_document`` adds a
    folder per finding, named by its key (C7), so each document is a file of its own.
    """
    docs = docs.withColumn("run_id", F.lit(run_id))
    keys = ["run_id", "verdict"]
    if per_document:
        docs = docs.withColumn("finding_key", finding_key(F.col("verdict"), F.col("archive.timestamp"), F.col("url")))
        keys.append("finding_key")
    (docs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).json(path))


def append_checked(ledger_rows: DataFrame, path: str, run_id: str) -> None:
    """Append this run's checked URLs; a re-run of the same ``run_id``
    replaces its own partition instead of duplicating it."""
    (ledger_rows.select("url", "outcome", F.lit(run_id).alias("run_id"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_id").parquet(path))


def run_report(metadata: DataFrame, counters: DataFrame, params: dict, scan_time: str) -> DataFrame:
    """One report row: parameters, counters and the array of the run's findings.

    The array is as long as the run's target lets ``metadata`` be (F3); a run
    without a target keeps its findings as a table (B2) and passes an empty
    ``metadata`` here.
    """
    item = F.struct(*[F.col(c) for c in metadata.columns])
    items = metadata.agg(F.sort_array(F.collect_list(item)).alias("deleted_changed_articles"))
    from ..operators.verdicts import combine_rows
    p = [F.lit(v).alias(k) for k, v in params.items()]
    head = counters.select(*p, F.lit(scan_time).alias("scan_time"), "*")
    return combine_rows(head, items)


# Double quotes are doubled and blanks kept, as spreadsheet programs expect.
CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def cluster_csv_rows(articles: DataFrame, n: int = 200) -> DataFrame:
    """B7 (+ F6, H10): one row per article, ordered by (cluster, timestamp or '')."""
    from ..functions.text import preview
    return articles.select(
        "cluster", "url", "archive_timestamp", "source_file",
        preview(F.col("text_en"), F.col("text_src"), n).alias("text_en_preview"),
        "article_id",
    ).orderBy("cluster", F.coalesce(F.col("archive_timestamp"), F.lit("")), "article_id")


def write_cluster_csv(articles: DataFrame, path: str, n: int = 200) -> None:
    """CSV with header, globally ordered (range partitioning, no single task)."""
    rows = cluster_csv_rows(articles, n)
    rows.drop("article_id").write.mode("overwrite").options(**CSV).csv(path)


def write_cluster_payload(payload: tuple[DataFrame, DataFrame, DataFrame], path: str) -> None:
    """The run's summary, articles and clusters as JSON tables under one folder.

    The articles hold every text twice, so files are compressed; each is one task's and read back by one.
    """
    for name, df in zip(("summary", "articles", "clusters"), payload, strict=True):
        df.write.mode("overwrite").option("compression", "gzip").json(f"{path}/{name}")


def write_topic_summary(lines: DataFrame, path: str) -> None:
    """The readable summary as text in its order (range partitioning, no single task)."""
    lines.select(F.col("text").alias("value")).write.mode("overwrite").text(path)


def append_cache(new_entries: DataFrame, path: str) -> None:
    """Append only new cache keys (callers pass the misses they translated)."""
    new_entries.select("src_sha1", "text_out", "ok").write.mode("append").parquet(path)
