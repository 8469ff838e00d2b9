"""Capture operators: filters (C1-C4), cap (E3), newest good capture (E2), per-URL lookup (D3).

Captures are ``(original, ts14, statuscode, digest, pos)`` rows; ``ts14`` is the
14-digit archive timestamp whose lexical order is time order, ``pos`` the
position in the service's response (breaks timestamp ties: later wins).
"""

from __future__ import annotations

from decimal import Decimal

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import archive_url, canonical_key

POS_DIGITS = 19



def status_filter(captures: DataFrame, code: str = "200") -> DataFrame:
    """Keep captures whose *string* status equals ``code`` (no cast: ``-`` must not match)."""
    return captures.filter(F.col("statuscode") == F.lit(code))


def prefix_filter(captures: DataFrame, domain: str, col: str = "original") -> DataFrame:
    """Captures under ``domain`` (a ``/`` is appended when missing), matched on
    the canonical key (no scheme, no ``www``), as the archive's prefix match does."""
    prefix = domain if domain.endswith("/") else domain + "/"
    key = canonical_key(F.lit(prefix))
    return captures.filter(F.startswith(canonical_key(F.col(col)), key))


def _ts14(value) -> str:
    if isinstance(value, (dt.date, dt.datetime)):
        return value.strftime("%Y%m%d%H%M%S")
    s = str(value)
    return (s + "00000000000000")[:14]


def window_filter(captures: DataFrame, start, end, inclusive_to: bool = False) -> DataFrame:
    """Captures with ``start <= ts < end`` (half-open; neighbouring windows never
    overlap). ``inclusive_to=True`` mimics the service: ``to`` includes the whole
    ``end`` prefix (e.g. the whole end day)."""
    lo = _ts14(start)
    ts = F.col("ts14")
    if inclusive_to:
        raw = str(end) if not isinstance(end, (dt.date, dt.datetime)) else end.strftime("%Y%m%d")
        hi = (raw + "99999999999999")[:14]
        return captures.filter((ts >= lo) & (ts <= hi))
    return captures.filter((ts >= lo) & (ts < _ts14(end)))


def project_captures(captures: DataFrame, cols=("ts14", "statuscode", "digest", "original")) -> DataFrame:
    """C4: keep only the requested fields; Catalyst prunes the scan to them."""
    return captures.select(*cols)


def capture_cap(captures: DataFrame, n: int | None, key: str = "original") -> DataFrame:
    """Keep the first ``n`` captures per URL in response order (oldest first).

    ``row_number() <= n`` becomes a WindowGroupLimit for ``n`` up to Spark's
    ``spark.sql.optimizer.windowGroupLimitThreshold`` (1000): every map task then
    sends at most ``n`` rows per URL into the shuffle even when one URL is hot.
    Beyond it a URL's captures are sorted by one task; raise that setting for larger caps.
    """
    if not n or n <= 0:
        return captures
    w = Window.partitionBy(key).orderBy(F.col("ts14"), F.col("pos"))
    return captures.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def latest_good_capture(captures: DataFrame, code: str = "200", keep_all: bool = False) -> DataFrame:
    """Per URL the newest capture with status ``code`` (ties: larger ``pos``).

    ts14 and pos are packed into one decimal, so ``max`` is a hash aggregate
    that combines map-side: a hot URL costs one row per map task in the
    shuffle, no sort and no window. Stamps compare as text, shorter ones too; a
    null pos comes before all others. A stamp that is not 1 to 14 digits has no
    place in time: such a capture is counted but never the newest good one. With
    ``keep_all`` URLs that have captures but no good one are kept with null
    fields and ``n_captures``.
    """
    # The stamp filled up with zeros, its length (2 digits), and 0 for a null pos or pos + 1: a non-negative long, 19 digits at most.
    digits = F.when(F.col("ts14").rlike(r"\A[0-9]{1,14}\z"), F.col("ts14"))
    stamp = F.concat(F.rpad(digits, 14, "0"), F.lpad(F.length(digits).cast("string"), 2, "0"))
    place = F.coalesce(F.col("pos").cast("decimal(19,0)") + F.lit(Decimal(1)), F.lit(Decimal(0)))
    packed = stamp.try_cast("decimal(16,0)").cast("decimal(38,0)") * F.lit(Decimal(10 ** POS_DIGITS)) + place
    agg = captures.groupBy(F.col("original")).agg(
        F.max(F.when(F.col("statuscode") == F.lit(code), packed.cast("decimal(38,0)"))).alias("_best"), F.count(F.lit(1)).alias("n_captures"))
    if not keep_all:
        agg = agg.filter(F.col("_best").isNotNull())
    best = F.lpad(F.col("_best").cast("string"), 16 + POS_DIGITS, "0")
    ts14 = F.left(best, F.substring(best, 15, 2).cast("int"))
    place = F.substring(best, 17, POS_DIGITS).cast("decimal(19,0)")
    return agg.select(
        "original",
        ts14.alias("ts14"),
        F.when(place > 0, (place - F.lit(Decimal(1))).cast("long")).alias("pos"),
        F.when(F.col("_best").isNotNull(), archive_url(ts14, F.col("original"))).alias("archive_url"),
        "n_captures",
    )


def captures_for_urls(urls: DataFrame, captures: DataFrame, cap: int | None = None,
                      url_col: str = "url") -> DataFrame:
    """D3: every capture whose URL is exactly one of the candidates (semi-join:
    a candidate listed twice does not double its captures), optionally capped."""
    keys = urls.select(F.col(url_col).alias("original"))
    return capture_cap(captures.join(keys, "original", "left_semi"), cap)
