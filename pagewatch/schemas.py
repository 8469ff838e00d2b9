"""Explicit schemas (M1-M17) for every read; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

CAPTURE_SCHEMA = T.StructType([
    T.StructField("original", T.StringType()),
    T.StructField("ts14", T.StringType()),
    T.StructField("statuscode", T.StringType()),
    T.StructField("digest", T.StringType()),
    T.StructField("pos", T.LongType()),
])

LIVE_SCHEMA = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("html", T.StringType()),
    T.StructField("fetched_at", T.StringType()),
    T.StructField("error", T.StringType()),
])

ARCHIVE_SIDE = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("raw_url", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("digest", T.StringType()),
    T.StructField("text", T.StringType()),
])

LIVE_SIDE = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("fetched_at", T.StringType()),
    T.StructField("digest", T.StringType()),
    T.StructField("text", T.StringType()),
])


def _finding_schema() -> T.StructType:
    return T.StructType([
        T.StructField("url", T.StringType()),
        T.StructField("verdict", T.StringType()),
        T.StructField("comparison_mode", T.StringType()),
        T.StructField("archive", ARCHIVE_SIDE),
        T.StructField("live", LIVE_SIDE),
    ])


class _FindingSchema:
    """Fresh copy per use: StructType.add mutates in place."""

    def add(self, field):
        return _finding_schema().add(field)

    def __call__(self):
        return _finding_schema()


FINDING_SCHEMA = _FindingSchema()

LEDGER_SCHEMA = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("outcome", T.StringType()),
])

CACHE_SCHEMA = T.StructType([
    T.StructField("src_sha1", T.StringType()),
    T.StructField("text_out", T.StringType()),
    T.StructField("ok", T.BooleanType()),
])
