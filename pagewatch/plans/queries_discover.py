"""Registered discovery-stage queries over the event captures, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from .. import oracles as O
from ..operators import discovery as D
from ..operators.captures import prefix_filter, project_captures, status_filter, window_filter
from ..registry import register
from ..session import scratch_path
from ..sinks.writers import read_url_index, write_url_index
from ..sources.readers import read_url_list

CAPS = f"({O.EVENT_CAPTURES})"
HOST = "lower(regexp_extract(original, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1))"
INDEX_SQL = f"""SELECT DISTINCT {HOST} AS domain, cast(substr(ts14, 1, 4) AS INTEGER) AS year,
  cast(substr(ts14, 5, 2) AS INTEGER) AS month, original FROM {CAPS} WHERE statuscode = '200'"""
DAY = "strptime(substr(ts14, 1, 8), '%Y%m%d')::DATE"
MONTH_START = f"date_trunc('month', {DAY})::DATE"
WEEK_START = f"({MONTH_START} + cast(floor((day({DAY}) - 1) / 7) * 7 AS INTEGER))"
MONTHS_SQL = f"""SELECT 'month' AS level, cast(m AS DATE) AS start, cast(m + INTERVAL 1 MONTH AS DATE) AS "end"
FROM (SELECT unnest(generate_series(make_date(y0, 1, 1), make_date(y1, 12, 1), INTERVAL 1 MONTH)) AS m
      FROM (SELECT min(cast(substr(ts14, 1, 4) AS INTEGER)) AS y0, max(cast(substr(ts14, 1, 4) AS INTEGER)) AS y1 FROM {CAPS}))"""


def weeks_sql(months: str) -> str:
    return f"""SELECT month_start, cast(w AS DATE) AS start, least(cast(w + INTERVAL 7 DAY AS DATE), month_end) AS "end"
FROM (SELECT start AS month_start, "end" AS month_end,
             unnest(generate_series(start, cast("end" - INTERVAL 1 DAY AS DATE), INTERVAL 7 DAY)) AS w FROM ({months}))"""


FETCH_LOG_SQL = f"""WITH m AS (SELECT level, start, "end",
    CASE WHEN substr(md5(cast(start AS VARCHAR)), 1, 1) IN ('0','1','2','3','4','5','6','7') THEN 'error' ELSE 'ok' END AS status
  FROM ({MONTHS_SQL}))
SELECT level, start, "end", status FROM m
UNION ALL
SELECT 'week', start, "end", CASE WHEN substr(md5(cast(start AS VARCHAR)), 1, 1) IN ('0','1','2','3') THEN 'error' ELSE 'ok' END
FROM ({weeks_sql("SELECT * FROM m WHERE status = 'error'")})"""


def caps(spark, d):
    return X.event_captures(spark, d)


@register("prefix_filter", f"""SELECT original, ts14, statuscode, pos FROM {CAPS}
WHERE starts_with(regexp_replace(lower(original), '^https?://(www[0-9]*\\.)?', ''), 'site3.example/')""")
def q_prefix_filter(spark, d):
    """Captures under one domain (scheme and www ignored)."""
    return prefix_filter(caps(spark, d), "https://www.site3.example").select("original", "ts14", "statuscode", "pos")


@register("window_filter", f"""SELECT original, ts14, pos FROM {CAPS} WHERE ts14 >= '20240301000000' AND ts14 < '20240401000000'""")
def q_window_filter(spark, d):
    """Captures in March 2024, half-open window."""
    return window_filter(caps(spark, d), "20240301", "20240401").select("original", "ts14", "pos")


@register("status_filter", f"SELECT original, ts14, statuscode, pos FROM {CAPS} WHERE statuscode = '200'")
def q_status_filter(spark, d):
    """Status-200 captures (string compare)."""
    return status_filter(caps(spark, d)).select("original", "ts14", "statuscode", "pos")


@register("project_original", f"SELECT original FROM {CAPS} WHERE statuscode = '200'")
def q_project_original(spark, d):
    """C4: the discover projection (``fl=original``) of good captures."""
    return project_captures(status_filter(caps(spark, d)), ["original"])


@register("distinct_urls_by_month", INDEX_SQL)
def q_distinct_urls_by_month(spark, d):
    """Distinct URLs per (domain, year, month)."""
    return D.distinct_urls_by_month(caps(spark, d))


@register("url_counts", f"""SELECT domain, year, month, count(*) AS n_month_urls, count(DISTINCT original) AS n_distinct_urls
FROM ({INDEX_SQL}) GROUP BY ROLLUP (domain, year, month) HAVING domain IS NOT NULL""")
def q_url_counts(spark, d):
    """Month / year / domain counts (sum of months and true distinct)."""
    return D.url_counts(D.distinct_urls_by_month(caps(spark, d)))


@register("weekly_union", f"""SELECT DISTINCT cast({MONTH_START} AS VARCHAR) AS month_start, original
FROM {CAPS} WHERE statuscode = '200'""")
def q_weekly_union(spark, d):
    """G1: each month's URLs as the union of its ~7-day windows."""
    return D.weekly_urls(caps(spark, d)).select(F.col("month_start").cast("string").alias("month_start"), "original")


@register("window_generation", f"""SELECT level, cast(start AS VARCHAR) AS start, cast("end" AS VARCHAR) AS "end" FROM ({MONTHS_SQL})
UNION ALL SELECT 'week', cast(start AS VARCHAR), cast("end" AS VARCHAR) FROM ({weeks_sql(MONTHS_SQL)})
UNION ALL SELECT DISTINCT 'year', substr(cast(start AS VARCHAR), 1, 4) || '-01-01', cast(cast(substr(cast(start AS VARCHAR), 1, 4) AS INTEGER) + 1 AS VARCHAR) || '-01-01' FROM ({MONTHS_SQL})""")
def q_window_generation(spark, d):
    """G2 (+ G1 windows): years and months of the years the captures span, and the months' ~7-day windows."""
    months = D.month_windows_for(caps(spark, d))
    weeks = D.week_windows(months).select(F.lit("week").alias("level"), "start", "end")
    both = months.unionByName(weeks).unionByName(D.year_windows_for(caps(spark, d)))
    return both.select("level", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"))


@register("coverage_resolution", f"""WITH log AS ({FETCH_LOG_SQL}),
mo AS (SELECT start AS month_start, status AS month_status FROM log WHERE level = 'month'),
wk AS (SELECT start AS week_start, status AS week_status FROM log WHERE level = 'week'),
ws AS (SELECT w.month_start, count(*) AS n_weeks, count(*) FILTER (WHERE wk.week_status = 'ok') AS n_weeks_ok
       FROM ({weeks_sql("SELECT * FROM log WHERE level = 'month'")}) w LEFT JOIN wk ON wk.week_start = w.start GROUP BY w.month_start),
cov AS (SELECT mo.month_start, CASE WHEN month_status = 'ok' THEN 'complete' WHEN n_weeks_ok = n_weeks THEN 'complete'
          WHEN n_weeks_ok > 0 THEN 'partial' ELSE 'missing' END AS coverage FROM mo LEFT JOIN ws ON ws.month_start = mo.month_start),
c AS (SELECT {MONTH_START} AS month_start, {WEEK_START} AS week_start, original FROM {CAPS} WHERE statuscode = '200'),
dl AS (SELECT DISTINCT c.month_start, c.original FROM c JOIN mo ON mo.month_start = c.month_start
       LEFT JOIN wk ON wk.week_start = c.week_start WHERE mo.month_status = 'ok' OR wk.week_status = 'ok')
SELECT cast(dl.month_start AS VARCHAR) AS month_start, dl.original, cov.coverage FROM dl JOIN cov ON cov.month_start = dl.month_start""")
def q_coverage_resolution(spark, d):
    """Month result if its fetch succeeded, else the union of its good weeks; coverage per month."""
    r = D.resolve_coverage(X.fetch_log(spark, d), caps(spark, d))
    return r.select(F.col("month_start").cast("string").alias("month_start"), "original", "coverage")


@register("skip_done_windows", f"""WITH log AS ({FETCH_LOG_SQL}),
mo AS (SELECT start AS month_start, status AS month_status FROM log WHERE level = 'month'),
wk AS (SELECT start AS week_start, status AS week_status FROM log WHERE level = 'week'),
ws AS (SELECT w.month_start, count(*) AS n_weeks, count(*) FILTER (WHERE wk.week_status = 'ok') AS n_weeks_ok
       FROM ({weeks_sql("SELECT * FROM log WHERE level = 'month'")}) w LEFT JOIN wk ON wk.week_start = w.start GROUP BY w.month_start),
whole AS (SELECT cast(substr(cast(mo.month_start AS VARCHAR), 1, 4) AS INTEGER) AS year, cast(substr(cast(mo.month_start AS VARCHAR), 6, 2) AS INTEGER) AS month
          FROM mo LEFT JOIN ws ON ws.month_start = mo.month_start WHERE month_status = 'ok' OR n_weeks_ok = n_weeks),
idx AS (SELECT DISTINCT domain, year, month FROM ({INDEX_SQL}) WHERE month % 3 <> 0),
doms AS (SELECT DISTINCT domain FROM ({INDEX_SQL})),
win AS (SELECT domain, cast(substr(cast(start AS VARCHAR), 1, 4) AS INTEGER) AS year, cast(substr(cast(start AS VARCHAR), 6, 2) AS INTEGER) AS month
        FROM ({MONTHS_SQL}) m, doms)
SELECT domain, year, month FROM win WHERE NOT EXISTS (SELECT 1 FROM idx JOIN whole ON whole.year = idx.year AND whole.month = idx.month
  WHERE idx.domain = win.domain AND idx.year = win.year AND idx.month = win.month)""")
def q_skip_done_windows(spark, d):
    """Every domain's months without a stored complete result (here the index keeps months not divisible by 3)."""
    c = caps(spark, d)
    index = D.distinct_urls_by_month(c)
    months = D.month_windows_for(c).agg(F.collect_list(F.struct(F.year("start").alias("year"), F.month("start").alias("month"))).alias("m"))
    first = months.first()["m"]  # the months of the years that the captures span
    wins = F.array(*[F.struct(F.lit(m["year"]).alias("year"), F.lit(m["month"]).alias("month")) for m in first])
    windows = index.select("domain").distinct().withColumn("w", F.explode(wins)).select("domain", "w.year", "w.month")
    return D.pending_windows(windows, index.filter(F.col("month") % 3 != 0), coverage=D.month_coverage(X.fetch_log(spark, d)))


@register("write_url_index", INDEX_SQL)
def q_write_url_index(spark, d):
    """B1 + F4: write the month index as sorted text files partitioned by month, read it back."""
    path = scratch_path(spark, "url_index")
    write_url_index(D.distinct_urls_by_month(caps(spark, d)), path)
    return read_url_index(spark, path)


@register("sorted_urls", f"""SELECT domain, year, month, count(*) AS n_urls, min(original) AS first_url, max(original) AS last_url
FROM ({INDEX_SQL}) GROUP BY domain, year, month""")
def q_sorted_urls(spark, d):
    """each month file is sorted; first and last line of each month as written."""
    path = scratch_path(spark, "url_index_sorted")
    write_url_index(D.distinct_urls_by_month(caps(spark, d)), path)
    # Line order = (file name, position in file): files of a month are named in range order.
    lines = spark.read.text(path).select("domain", F.col("year").cast("int").alias("year"),
                                         F.col("month").cast("int").alias("month"),
                                         F.col("value").alias("original"),
                                         F.struct(F.col("_metadata.file_name"), F.monotonically_increasing_id()).alias("_i"))
    w = lines.groupBy("domain", "year", "month").agg(
        F.count(F.lit(1)).alias("n_urls"), F.min_by("original", "_i").alias("first_url"),
        F.max_by("original", "_i").alias("last_url"))
    return w.select(F.col("domain").cast("string").alias("domain"), "year", "month", "n_urls", "first_url", "last_url")


@register("concat_url_lists", f"SELECT original AS url FROM ({INDEX_SQL})")
def q_concat_url_lists(spark, d):
    """A2: read every month file of the index as one list; a URL in 3 months appears 3 times."""
    path = scratch_path(spark, "url_index_cat")
    write_url_index(D.distinct_urls_by_month(caps(spark, d)), path)
    return read_url_list(spark, [f"{path}/*/*/*"])


FIRST_YEAR, LAST_YEAR = 2023, 2024


@register("window_range", f"""SELECT 'month' AS level, cast(start AS VARCHAR) AS start, cast(CAST(start + INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS "end",
  (SELECT count(DISTINCT original) FROM {CAPS} c WHERE statuscode = '200' AND substr(c.ts14, 1, 6) = strftime(start, '%Y%m')) AS n_urls
FROM (SELECT CAST(unnest(range(DATE '{FIRST_YEAR}-01-01', DATE '{LAST_YEAR + 1}-01-01', INTERVAL 1 MONTH)) AS DATE) AS start)""")
def q_window_range(spark, d):
    """G2 for a stated range of years: every month of it with its number of good URLs, months without any included."""
    good = D.status_filter(caps(spark, d)).select(F.concat_ws("-", F.substring("ts14", 1, 4), F.substring("ts14", 5, 2)).alias("m"), "original").distinct()
    n = good.groupBy("m").agg(F.count("*").alias("n_urls"))
    windows = D.month_windows(spark, FIRST_YEAR, LAST_YEAR).withColumn("m", F.date_format("start", "yyyy-MM"))
    return windows.join(n, "m", "left").select("level", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"),
                                               F.coalesce("n_urls", F.lit(0)).alias("n_urls"))


@register("urls_by_year", f"""SELECT DISTINCT lower(regexp_extract(original, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)) AS domain,
  cast(substr(ts14, 1, 4) AS INTEGER) AS year, original FROM {CAPS} WHERE statuscode = '200' AND substr(ts14, 1, 4) BETWEEN '{FIRST_YEAR}' AND '{LAST_YEAR}'""")
def q_urls_by_year(spark, d):
    """Year mode: one distinct sorted list a domain and year, written a file each and read back."""
    path = scratch_path(spark, "urls_by_year")
    keys = ("domain", "year")
    write_url_index(D.distinct_urls_by_year(caps(spark, d), D.year_windows(spark, FIRST_YEAR, LAST_YEAR)), path, keys=keys)
    return read_url_index(spark, path, keys=keys)
