"""Streams equal their batch twins; the driver contract runs on sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from pagewatch.schemas import LIVE_SCHEMA
from pagewatch.session import scratch_path
from pagewatch.streaming import streams as S

TABLES = ["events", "documents", "embeddings", "pages"]


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["url", "verdict", "live_status_code", "archive_timestamp", "archive_url", "saved_file",
                          "comparison_mode", "archive_digest", "live_digest"]


def test_every_query_has_callable_and_most_have_oracles():
    qs, os_ = E.queries(), E.oracle_sql()
    assert set(os_) <= set(qs)
    assert len(qs) >= 70
    assert not [n for n in set(qs) - set(os_) if not n.startswith("op") and n != "pipeline"]


def test_stream_checked_is_idempotent_on_rerun(spark):
    src, ledger, ck = (scratch_path(spark, n) for n in ("t_s3_in", "t_s3_ledger", "t_s3_ck"))
    spark.createDataFrame([("a",), ("b",), ("a",)], "value string").coalesce(1).write.text(src)
    stream = lambda: spark.readStream.option("maxFilesPerTrigger", 1).text(src).selectExpr("value AS url")
    S.stream_checked(stream(), ledger, ck)
    spark.createDataFrame([("b",), ("c",)], "value string").coalesce(1).write.mode("append").text(src)
    S.stream_checked(stream(), ledger, ck)          # restart from the checkpoint: only the new file
    S.stream_checked(stream(), ledger, ck)          # nothing new: no change
    got = sorted(r["url"] for r in spark.read.parquet(ledger).collect())
    assert got == ["a", "b", "c"]


def test_late_rows_past_the_watermark_are_corrections(spark):
    """One stream; files that arrive between two triggers are in one batch, late rows and others, and a fold in between changes nothing."""
    src, sink, ck = (scratch_path(spark, n) for n in ("t_s4_in", "t_s4_out", "t_s4_ck"))
    run = lambda: S.stream_daily_counts(spark.readStream.schema(S.CAPTURE_STREAM_SCHEMA).parquet(src), sink, ck, "45 days")
    put = lambda rows: spark.createDataFrame(rows, S.CAPTURE_STREAM_SCHEMA).write.mode("append").parquet(src)
    put([("http://a/1", "20240301000000", "200", "d", 1)])
    run()
    put([("http://a/1", "20240601000000", "200", "d", 2), ("http://a/1", "odd", "200", "d", 7)])
    run()
    S.compact_daily_counts(spark, sink)
    put([("http://a/2", "20240105000000", "200", "d", 3)])
    put([("http://a/2", "20240531000000", "200", "d", 4), ("http://a/2", "20240301000000", "200", "d", 5)])
    run()
    run()
    want = {"2024-03": (2, 1), "2024-06": (1, 0), "2024-01": (1, 1), "2024-05": (1, 0)}
    for _ in range(2):
        got = {r["month"]: (r["n_captures"], r["n_late"]) for r in S.read_monthly_counts(spark, sink).collect()}
        assert got == want
        S.compact_daily_counts(spark, sink)


def test_stream_goes_on_after_a_fold(spark):
    src, sink, ck = (scratch_path(spark, n) for n in ("t_s1_in", "t_s1_out", "t_s1_ck"))
    rows = [(f"u{i % 5}", f"2024010{i % 9 + 1}000000", "200" if i % 4 else "404", "d", i) for i in range(40)]
    for k in range(4):
        spark.createDataFrame(rows[k * 10:k * 10 + 10], S.CAPTURE_STREAM_SCHEMA).coalesce(1).write.mode("append").parquet(src)
        S.stream_latest_good(spark.readStream.schema(S.CAPTURE_STREAM_SCHEMA).parquet(src), sink, ck)
        seen = rows[:k * 10 + 10]
        want = {(u, *max((t, p) for v, t, c, _, p in seen if v == u and c == "200"), sum(v == u for v, *_ in seen)) for u in {r[0] for r in seen}}
        for step in (lambda: None, lambda: S.compact_latest_good(spark, sink), lambda: S.snapshots.vacuum(spark, sink)):
            step()
            assert {tuple(r) for r in S.read_latest_good(spark, sink).select("original", "ts14", "pos", "n_captures").collect()} == want
    assert len(S.snapshots._folders(spark, f"{sink}/bases")) == 2 and len(S.snapshots._batches(spark, sink)) <= 1


def test_fold_that_dies_leaves_no_trace(spark):
    sink = scratch_path(spark, "t_fold")
    S.snapshots.write_batch(spark.createDataFrame([("a", 1)], "k string, n int"), 0, sink)

    def dies(df):
        return df.withColumn("n", S.F.raise_error(S.F.lit("dies")).cast("int"))

    with pytest.raises(Exception, match="dies"):
        S.snapshots.compact(spark, sink, "k string, n int", dies)
    assert [tuple(r) for r in S.snapshots.read(spark, sink, "k string, n int").collect()] == [("a", 1, 0)]
    assert S.snapshots.compact(spark, scratch_path(spark, "t_none"), "k string, n int", dies) == -1


def test_capture_between_two_runs_changes_the_verdict(spark):
    page = "<p>" + "w" * 60 + "</p>"
    caps_in, latest, bodies_in, src, sink, ck, ck1 = (scratch_path(spark, f"t_s2_{n}") for n in range(7))
    work = spark.createDataFrame([("u",), ("v",)], "url string")

    def step(capture, body, observed):
        spark.createDataFrame(capture, S.CAPTURE_STREAM_SCHEMA).write.mode("append").parquet(caps_in)
        S.stream_latest_good(spark.readStream.schema(S.CAPTURE_STREAM_SCHEMA).parquet(caps_in), latest, ck1)
        spark.createDataFrame(body, S.BODY_STREAM_SCHEMA).write.mode("append").parquet(bodies_in)
        spark.createDataFrame(observed, LIVE_SCHEMA).write.mode("append").parquet(src)
        S.stream_verdicts(spark.readStream.schema(LIVE_SCHEMA).parquet(src), work, latest, bodies_in, sink, ck)

    step([("u", "20240101000000", "404", "d", 0)], [], [("u", 200, page, "1", None), ("x", 200, page, "1", None)])
    step([("u", "20240102000000", "200", "d", 0)], [("u", "20240102000000", page)], [("u", 200, page, "2", None)])
    step([("u", "20240103000000", "200", "d", 0)], [("u", "20240103000000", page.replace("w", "x"))], [("u", 200, page, "3", None), ("v", 404, None, "3", None)])
    got = {(r["url"], r["fetched_at"]): r["outcome"] for r in S.read_verdicts(spark, sink).collect()}
    assert got == {("u", "1"): "no_good_capture", ("x", "1"): "not_in_work", ("u", "2"): "unchanged", ("u", "3"): "changed", ("v", "3"): "no_capture"}
    steps = S.read_progress(spark, sink).orderBy("batch_id").collect()
    assert [(r["checked"], r["found"], r["total_checked"], r["total_found"]) for r in steps] == [(2, 0, 2, 0), (1, 0, 3, 0), (2, 1, 5, 1)]
    assert all(r["seconds"] > 0 and r["urls_per_sec"] > 0 for r in steps)


def _duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _norm(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", ["detect_changes", "checked_outcome", "extract_main_text", "stream_latest_good",
                                  "stream_monthly_counts", "coverage_resolution", "url_counts", "sample_limit",
                                  "ctfidf_keywords", "representatives_topk"])
def test_oracle_equality_small(spark, sf, name):
    df = E.queries()[name](spark, sf)
    cols = sorted(df.columns)
    srows = _norm(tuple(r[c] for c in cols) for r in df.collect())
    cur = _duck(sf).execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    orows = _norm(tuple(r[ocols.index(c)] for c in cols) for r in cur.fetchall())
    assert sorted(ocols) == cols
    assert srows == orows


@pytest.mark.parametrize("name", ["status_filter", "stream_monthly_counts"])
def test_results_independent_of_session_time_zone(spark, sf, name):
    """Event times inside a DST gap must not move when the session zone is not UTC."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = E.queries()[name](spark, sf)
        cols = sorted(df.columns)
        srows = _norm(tuple(r[c] for c in cols) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    cur = _duck(sf).execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    assert srows == _norm(tuple(r[ocols.index(c)] for c in cols) for r in cur.fetchall())
