"""Discovery: time windows (G2), month URL index (E1), counts (E4), weekly
fallback (G1), coverage resolution (G3) and skipping finished windows (D2).

Windows are generated with ``sequence`` + ``explode`` from the data's own
time range; a capture is assigned to its month and ~7-day window by date
arithmetic (an equi key), never by a range join against the window table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import url_host
from .captures import status_filter


def _day(ts14="ts14") -> Column:
    return F.to_date(F.substring(F.col(ts14), 1, 8), "yyyyMMdd")


def month_windows(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """G2 for a stated range of years, both included: one window per month."""
    seq = F.sequence(F.make_date(F.lit(first_year), F.lit(1), F.lit(1)), F.make_date(F.lit(last_year), F.lit(12), F.lit(1)), F.expr("INTERVAL 1 MONTH"))
    starts = spark.range(1).select(F.explode(seq if first_year <= last_year else F.array().cast("array<date>")).alias("start"))
    return starts.select(F.lit("month").alias("level"), "start", F.add_months("start", 1).alias("end"))


def year_windows(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """G2 (no-split mode) for a stated range of years, both included: one window per year."""
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("y"))
    return years.select(F.lit("year").alias("level"), F.make_date("y", F.lit(1), F.lit(1)).alias("start"),
                        F.make_date(F.col("y") + 1, F.lit(1), F.lit(1)).alias("end"))


def distinct_urls_by_year(captures: DataFrame, windows: DataFrame, domain_col: Column | None = None) -> DataFrame:
    """Year mode: distinct ``original`` per (domain, year) over good captures of the years in ``windows``.

    A URL captured in many months of a year stands once in that year's list.
    """
    good = status_filter(captures).select(
        (url_host(F.col("original")) if domain_col is None else domain_col).alias("domain"),
        F.substring("ts14", 1, 4).cast("int").alias("year"), "original")
    wanted = windows.select(F.year("start").alias("year")).distinct()
    return good.join(F.broadcast(wanted), "year", "left_semi").distinct()  # a row a year


def month_windows_for(captures: DataFrame) -> DataFrame:
    """G2 over the years the captures span (whole years, as the reference loops years)."""
    rng = captures.agg(F.min(F.substring("ts14", 1, 4).cast("int")).alias("y0"),
                       F.max(F.substring("ts14", 1, 4).cast("int")).alias("y1"))
    seq = F.sequence(F.make_date("y0", F.lit(1), F.lit(1)), F.make_date("y1", F.lit(12), F.lit(1)),
                     F.expr("INTERVAL 1 MONTH"))
    m = rng.select(F.explode(seq).alias("start"))
    return m.select(F.lit("month").alias("level"), "start", F.add_months("start", 1).alias("end"))


def year_windows_for(captures: DataFrame) -> DataFrame:
    """G2 (no-split mode) over the years the captures span: one window per year."""
    years = month_windows_for(captures).select(F.year("start").alias("y")).distinct()
    return years.select(F.lit("year").alias("level"), F.make_date("y", F.lit(1), F.lit(1)).alias("start"),
                        F.make_date(F.col("y") + 1, F.lit(1), F.lit(1)).alias("end"))


def week_windows(months: DataFrame, days: int = 7) -> DataFrame:
    """G1 windows: each month cut into ``days``-day windows, the last clipped at month end."""
    seq = F.sequence(F.col("start"), F.date_sub(F.col("end"), 1), F.expr(f"INTERVAL {days} DAYS"))
    w = months.select(F.col("start").alias("month_start"), F.col("end").alias("month_end"), F.explode(seq).alias("start"))
    return w.select("month_start", "start", F.least(F.date_add("start", days), F.col("month_end")).alias("end"))


def with_windows(captures: DataFrame, days: int = 7) -> DataFrame:
    """Attach ``month_start`` and ``week_start`` to each capture by arithmetic."""
    day = _day()
    month_start = F.trunc(day, "month")
    week_start = F.date_add(month_start, (F.floor((F.dayofmonth(day) - 1) / days) * days).cast("int"))
    return captures.withColumn("month_start", month_start).withColumn("week_start", week_start)


def distinct_urls_by_month(captures: DataFrame, domain_col: Column | None = None) -> DataFrame:
    """E1 (+ C3, C4): distinct ``original`` per (domain, year, month) over good captures.

    ``domain`` is the host of each URL unless given; one pass serves every
    domain. A partial + final hash aggregate: the shuffle carries at most one
    row per (month, URL) per map task.
    """
    c = status_filter(captures)
    dom = domain_col if domain_col is not None else url_host(F.col("original"))
    return c.select(
        dom.alias("domain"),
        F.substring("ts14", 1, 4).cast("int").alias("year"),
        F.substring("ts14", 5, 2).cast("int").alias("month"),
        "original",
    ).distinct()


def url_counts(index: DataFrame) -> DataFrame:
    """URL counts per month, per year and overall, over the month index.

    ``n_month_urls`` is the reference's printed "total" (a sum of month
    counts: a URL seen in 3 months counts 3 times); ``n_distinct_urls`` is the
    true number of distinct URLs at that level. Year/total rows have null month/year.
    """
    return (index.rollup("domain", "year", "month")
            .agg(F.count(F.lit(1)).alias("n_month_urls"), F.count_distinct("original").alias("n_distinct_urls"))
            .filter(F.col("domain").isNotNull()))


def weekly_urls(captures: DataFrame, days: int = 7) -> DataFrame:
    """G1: a month's URLs as the union-distinct of its ~7-day windows."""
    c = with_windows(status_filter(captures), days)
    weeks = c.select("month_start", "week_start", "original").distinct()
    return weeks.select("month_start", "original").distinct()


def resolve_coverage(fetch_log: DataFrame, captures: DataFrame, days: int = 7) -> DataFrame:
    """The URLs each month delivers and how complete they are.

    A month whose month-level fetch succeeded gives all its URLs; a failed one
    falls back to the union of its successful weeks (failed weeks are missing).
    ``coverage`` is ``complete`` (month ok or every week ok), ``partial`` or
    ``missing``. Only ``complete`` months should count as done on resume.
    """
    months = fetch_log.filter(F.col("level") == "month").select(
        F.col("start").alias("month_start"), F.col("status").alias("month_status"))
    weeks = fetch_log.filter(F.col("level") == "week").select(
        F.col("start").alias("week_start"), F.col("status").alias("week_status"))
    week_stats = (week_windows(fetch_log.filter(F.col("level") == "month").select("start", "end"), days)
                  .join(weeks.withColumnRenamed("week_start", "start"), "start", "left")
                  .groupBy("month_start")
                  .agg(F.count(F.lit(1)).alias("n_weeks"), F.count_if(F.col("week_status") == "ok").alias("n_weeks_ok")))
    cov = (months.join(week_stats, "month_start", "left")
           .select("month_start", "month_status",
                   F.when(F.col("month_status") == "ok", "complete")
                    .when(F.col("n_weeks_ok") == F.col("n_weeks"), "complete")
                    .when(F.col("n_weeks_ok") > 0, "partial").otherwise("missing").alias("coverage")))
    c = with_windows(status_filter(captures), days).select("month_start", "week_start", "original")
    c = c.join(months, "month_start").join(weeks, "week_start", "left")
    delivered = c.filter((F.col("month_status") == "ok") | (F.col("week_status") == "ok"))
    urls = delivered.select("month_start", "original").distinct()
    return urls.join(cov.select("month_start", "coverage"), "month_start")


def month_coverage(fetch_log: DataFrame, days: int = 7) -> DataFrame:
    """G3 per month only: (month_start, coverage)."""
    months = fetch_log.filter(F.col("level") == "month")
    weeks = fetch_log.filter(F.col("level") == "week").select(F.col("start"), F.col("status").alias("week_status"))
    ws = (week_windows(months.select("start", "end"), days).join(weeks, "start", "left")
          .groupBy("month_start").agg(F.count(F.lit(1)).alias("n_weeks"),
                                      F.count_if(F.col("week_status") == "ok").alias("n_weeks_ok")))
    m = months.select(F.col("start").alias("month_start"), F.col("status").alias("month_status"))
    return m.join(ws, "month_start", "left").select(
        "month_start",
        F.when(F.col("month_status") == "ok", "complete").when(F.col("n_weeks_ok") == F.col("n_weeks"), "complete")
         .when(F.col("n_weeks_ok") > 0, "partial").otherwise("missing").alias("coverage"),
        "n_weeks", "n_weeks_ok")


def pending_windows(windows: DataFrame, index: DataFrame, keys=("domain", "year", "month"), coverage: DataFrame | None = None) -> DataFrame:
    """Windows without a stored, complete result.

    A window is done if its index is not empty and, where ``coverage``
    (month_start, coverage) is given, its month is ``complete``: a partial
    month is fetched again. Empty months stay pending, as nothing was written for them.
    """
    done = index.select(*keys).distinct()
    if coverage is not None:
        whole = coverage.filter(F.col("coverage") == "complete").select(F.year("month_start").alias("year"), F.month("month_start").alias("month"))
        done = done.join(whole, ["year", "month"], "left_semi")
    return windows.join(done, list(keys), "left_anti")
