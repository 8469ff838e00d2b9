"""Registered streaming queries: each stream runs availableNow over files that
Spark derives from the given tables, and its sink is compared with the batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from .. import oracles as O
from ..registry import register
from ..schemas import LIVE_SCHEMA
from ..session import scratch_path, store
from ..streaming import streams as S
from .detect import work_urls
from .queries_detect import OUTCOME_CASE, observed_sql


def _two_runs(spark, schema, src, first, second, start) -> None:
    """``first`` arrives, the stream runs and ends; ``second`` arrives, the stream is restarted from its checkpoint.

    Both arrive as as many files as their partitions; a run takes what is there in one batch.
    """
    for part in (first, second):
        part.write.mode("append").parquet(src)
        start(spark.readStream.schema(schema).parquet(src))


@register("stream_latest_good", f"""SELECT original, substr(best, 1, 14) AS ts14, cast(substr(best, 15) AS BIGINT) AS pos, n_captures
FROM (SELECT original, count(*) AS n_captures,
  max(CASE WHEN statuscode = '200' THEN ts14 || lpad(cast(pos AS VARCHAR), 20, '0') END) AS best
  FROM ({O.EVENT_CAPTURES}) GROUP BY original) WHERE best IS NOT NULL""")
def q_stream_latest_good(spark, d):
    """Newest good capture per URL over two runs, folded after the first (equals E2)."""
    src, sink, ck = (scratch_path(spark, n) for n in ("s1_in", "s1_out", "s1_ck"))
    caps, even = X.event_captures(spark, d), F.col("pos") % 2 == 0

    def run(stream) -> None:
        S.stream_latest_good(stream, sink, ck)
        if S.snapshots._committed(spark, sink) == []:
            S.compact_latest_good(spark, sink)

    _two_runs(spark, S.CAPTURE_STREAM_SCHEMA, src, caps.filter(even), caps.filter(~even), run)
    return S.read_latest_good(spark, sink)


@register("stream_verdicts", f"""SELECT l.url, l.status_code AS live_status_code, l.fetched_at, v.verdict, coalesce(v.outcome, 'not_in_work') AS outcome
FROM ({O.LIVE_ALL}) l LEFT JOIN (
  SELECT *, {OUTCOME_CASE} AS outcome FROM ({observed_sql(live=O.LIVE_ALL)})) v
ON v.url = l.url AND v.fetched_at = l.fetched_at""")
def q_stream_verdicts(spark, d):
    """Verdicts of live observations arriving in two runs; captures and bodies of the second run's URLs arrive after the first."""
    names = ("s2_captures", "s2_latest", "s2_bodies", "s2_in", "s2_out", "s2_ck", "s2_latest_ck")
    caps_in, latest, bodies_in, src, sink, ck, latest_ck = (scratch_path(spark, n) for n in names)
    urls, caps, bodies, live = X.url_list(spark, d), X.page_captures(spark, d), X.archive_bodies(spark, d), X.live_observations(spark, d)
    work = store(work_urls(urls, X.checked_urls(spark, d)), "work")
    for even in (True, False):
        first = lambda c: (F.length(c) % 2 == 0) == even  # noqa: E731,B023
        caps.filter(first("original")).select("original", "ts14", "statuscode", "digest", "pos").write.mode("append").parquet(caps_in)
        S.stream_latest_good(spark.readStream.schema(S.CAPTURE_STREAM_SCHEMA).parquet(caps_in), latest, latest_ck)
        bodies.filter(first("original")).select("original", "ts14", "html").write.mode("append").parquet(bodies_in)
        live.filter(first("url")).write.mode("append").parquet(src)
        S.stream_verdicts(spark.readStream.schema(LIVE_SCHEMA).parquet(src), work, latest, bodies_in, sink, ck)
    return S.read_verdicts(spark, sink).select("url", "live_status_code", "fetched_at", "verdict", "outcome")


@register("stream_checked_ledger", f"SELECT DISTINCT url FROM ({O.URL_LIST})")
def q_stream_checked_ledger(spark, d):
    """S3: URLs arriving in two overlapping runs; every URL is in the ledger exactly once."""
    src, ledger, ck = (scratch_path(spark, n) for n in ("s3_in", "s3_ledger", "s3_ck"))
    lines, size = X.url_list(spark, d), F.length("url") % 3
    _two_runs(spark, "url string", src, lines.filter(size != 0), lines.filter(size != 1), lambda stream: S.stream_checked(stream, ledger, ck))
    return spark.read.parquet(ledger).select("url")


@register("stream_monthly_counts", f"""SELECT lower(regexp_extract(original, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)) AS domain,
  substr(ts14, 1, 4) || '-' || substr(ts14, 5, 2) AS month, count(*) AS n_captures
FROM ({O.EVENT_CAPTURES}) WHERE statuscode = '200' GROUP BY 1, 2""")
def q_stream_monthly_counts(spark, d):
    """Captures per domain-month from daily event-time windows. The second run brings rows inside
    the watermark and corrections long past it (equals the batch count)."""
    src, sink, ck = (scratch_path(spark, n) for n in ("s4_in", "s4_out", "s4_ck"))
    caps = X.event_captures(spark, d)
    second = (F.col("ts14") >= "20241215") | (F.col("pos") % 5 == 0)
    _two_runs(spark, S.CAPTURE_STREAM_SCHEMA, src, caps.filter(~second), caps.filter(second),
              lambda stream: S.stream_daily_counts(stream, sink, ck, watermark="45 days"))
    return S.read_monthly_counts(spark, sink).select("domain", "month", "n_captures")
