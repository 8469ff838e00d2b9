"""Capture, selection, discovery and source operators on hand-written edge rows."""

import json

import pytest
from pyspark.sql import functions as F

from pagewatch.operators import discovery as D
from pagewatch.operators.captures import capture_cap, latest_good_capture, prefix_filter, window_filter
from pagewatch.operators import selection as S
from pagewatch.session import scratch_path
from pagewatch.sources.readers import decode_cdx_payload, load_findings, read_url_list

CAP = "original string, ts14 string, statuscode string, digest string, pos long"


def test_latest_good_ties_and_status(spark):
    rows = [("u1", "20200101000000", "200", "a", 0), ("u1", "20200101000000", "200", "b", 1),  # tie: pos 1 wins
            ("u1", "20190101000000", "200", "c", 2),
            ("u2", "20200101000000", "-", "d", 0), ("u2", "20200102000000", "404", "e", 1),  # no good capture
            ("u3", "20200101000000", "200", "f", 5), ("u3", "20210101000000", "301", "g", 6)]
    df = spark.createDataFrame(rows, CAP)
    got = {r["original"]: (r["ts14"], r["pos"]) for r in latest_good_capture(df).collect()}
    assert got == {"u1": ("20200101000000", 1), "u3": ("20200101000000", 5)}
    allr = {r["original"]: r["ts14"] for r in latest_good_capture(df, keep_all=True).collect()}
    assert allr["u2"] is None


def test_latest_good_of_odd_stamps_and_positions(spark):
    most = 2 ** 63 - 1
    rows = [("null pos", "20200101000000", "200", "a", None), ("tie", "20200101000000", "200", "a", None), ("tie", "20200101000000", "200", "b", 0),
            ("later", "20200101000001", "200", "a", None), ("later", "20200101000000", "200", "b", most), ("most", "99999999999999", "200", "a", most),
            ("short", "2021", "200", "a", 1), ("short", "20200101000000", "200", "b", 2), ("prefix", "2021", "200", "a", 9), ("prefix", "20210000000000", "200", "b", 1),
            ("zeros", "00000000000000", "200", "a", 0), ("zeros", "0", "200", "b", 5),
            *(("mixed", t, "200", "x", 7) for t in (None, "", "abc", "1e3", " 2030", "-2030", "2030\n", "209901010000001")), ("mixed", "20200101000000", "200", "b", 3),
            ("malformed", "soon", "200", "a", 1)]
    got = {r["original"]: tuple(r)[1:] for r in latest_good_capture(spark.createDataFrame(rows, CAP), keep_all=True).collect()}
    best = {u: x[:2] for u, x in got.items()}
    assert best == {"null pos": ("20200101000000", None), "tie": ("20200101000000", 0), "later": ("20200101000001", None), "most": ("99999999999999", most),
                    "short": ("2021", 1), "prefix": ("20210000000000", 1), "zeros": ("00000000000000", 0), "mixed": ("20200101000000", 3), "malformed": (None, None)}
    assert got["mixed"][3] == 9 and got["malformed"][2:] == (None, 1) and got["null pos"][2].endswith("/20200101000000/null pos")


def test_capture_cap_and_filters(spark):
    rows = [("https://www.a.example/x", f"2020010{i}000000", "200", None, i) for i in range(1, 6)]
    rows += [("http://b.example/y", "20200301000000", "200", None, 9)]
    df = spark.createDataFrame(rows, CAP)
    assert capture_cap(df, 2).filter(F.col("original").contains("a.")).count() == 2
    assert prefix_filter(df, "a.example").count() == 5
    assert prefix_filter(df, "https://www.b.example/").count() == 1
    assert window_filter(df, "20200102", "20200104").count() == 2            # half-open
    assert window_filter(df, "20200102", "20200104", inclusive_to=True).count() == 3


def test_read_url_list_keeps_duplicates(spark):
    path = scratch_path(spark, "t_urls")
    lines = ["", "   ", "\thttps://a/1  ", " https://a/2　", "https://a/1", "https://a/3"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    got = sorted(r["url"] for r in read_url_list(spark, path).collect())
    assert got == ["https://a/1", "https://a/1", "https://a/2", "https://a/3"]


def test_drop_checked_keeps_duplicates(spark):
    urls = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "url string")
    ck = spark.createDataFrame([("b",), ("b",)], "url string")
    assert sorted(r["url"] for r in S.drop_checked(urls, ck).collect()) == ["a", "a", "c"]


def test_sample_limit_edges(spark):
    urls = spark.createDataFrame([(f"u{i % 40}",) for i in range(100)], "url string")
    assert S.sample_urls(urls, 0, "1").count() == 100       # 0 = all
    assert S.sample_urls(urls, 100, "1").count() == 100     # >= count = all
    s = S.sample_urls(urls, 37, "1")
    assert s.count() == 37
    assert sorted(tuple(r) for r in s.collect()) == sorted(tuple(r) for r in S.sample_urls(urls, 37, "1").collect())


def test_weekly_windows_leap_february(spark):
    months = spark.createDataFrame([("2024-02-01", "2024-03-01")], "start string, end string").select(
        F.to_date("start").alias("start"), F.to_date("end").alias("end"))
    w = sorted((str(r["start"]), str(r["end"])) for r in D.week_windows(months).collect())
    assert len(w) == 5
    assert w[-1] == ("2024-02-29", "2024-03-01")


def test_pending_windows_recompute_empty(spark):
    win = spark.createDataFrame([(2020, m) for m in (1, 2, 3)], "year int, month int")
    index = spark.createDataFrame([(2020, 1, "u")], "year int, month int, original string")
    got = sorted(r["month"] for r in D.pending_windows(win, index, keys=("year", "month")).collect())
    assert got == [2, 3]   # empty months have no stored rows and stay pending


def test_decode_cdx_payload_shapes(spark):
    hdr = ["timestamp", "statuscode", "digest", "original"]
    payloads = [("empty", "[]"), ("header", json.dumps([hdr])), ("bad", "{oops"),
                ("two", json.dumps([hdr, ["20200101000000", "200", "D1", "http://a/"],
                                    ["20200102000000", "404", "D2", "http://a/"]]))]
    df = spark.createDataFrame(payloads, "request string, payload string")
    out = decode_cdx_payload(df).collect()
    assert [(r["request"], r["row_pos"], r["statuscode"]) for r in sorted(out, key=lambda r: r["row_pos"])] == [
        ("two", 1, "200"), ("two", 2, "404")]


def test_load_findings_skips(spark):
    path = scratch_path(spark, "t_findings")
    good = {"url": "u1", "verdict": "deleted", "comparison_mode": "content-only",
            "archive": {"url": "a", "raw_url": "r", "timestamp": "t", "digest": "d", "text": "# H\n**bold** text"}}
    changed = dict(good, url="u2", verdict="changed")
    empty = dict(good, url="u3", archive=dict(good["archive"], text=""))
    lines = [json.dumps(good), json.dumps(changed), json.dumps(empty), "{not json"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    rows = load_findings(spark, path).collect()
    assert [(r["url"], r["text_src"]) for r in rows] == [("u1", "H bold text")]


def test_decode_cdx_payload_short_rows_and_field_order(spark):
    hdr = ["original", "timestamp", "statuscode"]          # other order, no digest column
    payload = json.dumps([hdr, ["http://a/", "20200101000000", "200"], ["http://b/"]])
    df = spark.createDataFrame([("r", payload)], "request string, payload string")
    out = sorted((r["row_pos"], r["original"], r["ts14"], r["statuscode"], r["digest"])
                 for r in decode_cdx_payload(df).collect())
    assert out == [(1, "http://a/", "20200101000000", "200", None), (2, "http://b/", None, None, None)]


def test_detect_changes_never_shuffles_pages(spark, sf):
    from pagewatch import fixtures as X
    from pagewatch.plans.detect import detect_changes
    pages = (X.archive_bodies(spark, sf), X.live_observations(spark, sf))
    stored = []
    for i, df in enumerate(pages):
        path = scratch_path(spark, f"t_pages{i}")
        df.write.parquet(path)
        stored.append(spark.read.parquet(path))
    df = detect_changes(X.url_list(spark, sf), X.page_captures(spark, sf), stored[0], stored[1], X.checked_urls(spark, sf))
    df.collect()
    qe = df._jdf.queryExecution()
    n = 0

    def walk(node):
        nonlocal n
        if "Exchange" in node.nodeName():
            n += 1
            names = [node.output().apply(i).name() for i in range(node.output().size())]
            assert not {"html", "_body", "archive_html", "live_html"} & set(names), names
        kids = node.children()
        for i in range(kids.size()):
            walk(kids.apply(i))
    walk(spark._jvm.org.apache.spark.sql.execution.QueryExecution.prepareExecutedPlan(df.sparkSession._jsparkSession, qe.sparkPlan()))
    assert n > 0


def test_newest_live_observation_wins(spark):
    from pagewatch.operators.verdicts import newest_live, normalise_live
    rows = [("u", 404, "<p>x</p>", "2024-01-01"), ("u", 200, "<p>" + "y" * 60 + "</p>", "2024-02-01"), ("u", 500, None, None), ("v", None, None, "2024-01-01")]
    live = spark.createDataFrame(rows, "url string, status_code int, html string, fetched_at string")
    got = {r["url"]: r for r in newest_live(normalise_live(live)).collect()}
    assert got["u"]["live_status_code"] == 200 and got["u"]["live_digest"] is not None and got["v"]["live_status_code"] is None


def test_needed_keeps_every_key(spark, monkeypatch):
    from pagewatch.operators import verdicts
    keys = spark.range(0, 3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("a"))
    like = spark.range(0, 60000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("b"), F.col("id"))
    got = verdicts.needed(like, ["b"], keys, ["a"])
    assert got.filter("id < 3000").count() == 3000 and got.count() == 3000
    assert verdicts.needed(like, ["b"], keys.limit(0), ["a"]).count() == 0
    monkeypatch.setattr(verdicts, "MOST_KEYS", 10)
    assert verdicts.needed(like, ["b"], keys, ["a"]).count() == 60000


def detect_tables(spark, pages, bodies):
    """(work, captures, bodies, live) of given live pages (url, code, html, time) and archive bodies (url, html)."""
    from pagewatch.plans import detect as P
    urls = sorted({p[0] for p in pages} | {b[0] for b in bodies})
    ts = "20200101000000"
    return (P.work_urls(spark.createDataFrame([(u,) for u in urls], "url string")), spark.createDataFrame([(u, ts, "200", "d", 0) for u in urls], CAP),
            spark.createDataFrame([(u, ts, h) for u, h in bodies], "original string, ts14 string, html string"),
            spark.createDataFrame(pages, "url string, status_code int, html string, fetched_at string"))


@pytest.mark.parametrize("boilerplate", [None, {"min_pages": 3, "share": 0.5}])
@pytest.mark.parametrize("most", [1 << 21, 1])
def test_older_pages_and_stored_copies_count_for_nothing(spark, monkeypatch, boilerplate, most):
    from pagewatch.operators import verdicts
    monkeypatch.setattr(verdicts, "MOST_KEYS", most)
    page = lambda i, t: f"<p>Menu of the host, on every page that it has to show to you</p><p>{t} of article {i} " + "w" * 60 + "</p>"
    urls = [f"http://a.example/{i}" for i in range(6)]
    bodies = [(u, page(i, "Text")) for i, u in enumerate(urls)] * 2 + [(urls[0], ""), (urls[1], None)]
    live = [(u, 200, page(i, "Other"), "2024-01-01") for i, u in enumerate(urls)] + [(u, 200, page(i, "Text"), "2024-02-01") for i, u in enumerate(urls[:4])]
    live += [(urls[5], 404, None, "2024-03-01")] + live[:2]
    outs = verdicts.outcomes(verdicts.observe(*detect_tables(spark, live, bodies), boilerplate=boilerplate)).collect()
    assert sorted((r["url"], r["outcome"]) for r in outs) == [(u, o) for u, o in zip(urls, ["unchanged"] * 4 + ["changed", "deleted"], strict=True)]


def test_boilerplate_does_not_depend_on_the_target(spark):
    from pagewatch.plans import detect as P
    page = lambda i, menu: f"<p>Menu {menu} of the host, on every page that it has to show to you</p><p>Text of article {i} " + "w" * 60 + "</p>"
    urls = [f"http://a.example/{i}" for i in range(40)]
    work, caps, bodies, live = detect_tables(spark, [(u, 200, page(i if i < 38 else -i, "new"), "2024-01-01") for i, u in enumerate(urls)],
                                             [(u, page(i, "old")) for i, u in enumerate(urls)])
    boilerplate = {"min_pages": 3, "share": 0.5}
    for target in (1, 100):
        found = P.find_until(work, caps, bodies, live, target, boilerplate=boilerplate, first_batch=2)
        assert {r["url"] for r in found.collect()} <= set(urls[38:]) and found.count() == min(target, 2)


def test_exact_top_n_of_any_key(spark):
    rows = [(f"{c}{i:04d}",) for i in range(50) for c in "fgz"]
    df = spark.createDataFrame(rows, "k string")
    for n in (1, 30, 120, 500):
        assert sorted(r["k"] for r in S.exact_top_n(df, "k", n).collect()) == sorted(r[0] for r in rows)[:n]


def test_target_stops_after_the_batches_it_needs(spark, monkeypatch):
    """Batches grow with the findings met, no URL is in two of them, and the pages behind the rest are not parsed."""
    from pagewatch.plans import detect as P
    urls = [f"http://a/{i}" for i in range(400)]
    body = "<p>" + "w" * 60 + "</p>"
    work, caps, bodies, live = detect_tables(spark, [(u, 404 if i % 4 == 0 else 200, body, "2024-01-01") for i, u in enumerate(urls)], [(u, body) for u in urls])
    parts = []
    monkeypatch.setattr(P, "observe", lambda part, *a, f=P.observe, **k: parts.append([r["url"] for r in part.collect()]) or f(part, *a, **k))
    found = P.find_until(work, caps, bodies, live, 12, first_batch=20)
    ranks = {r["url"]: r["sample_rank"] for r in work.collect()}
    first = sorted(ranks[u] for i, u in enumerate(urls) if i % 4 == 0)[:12]
    assert sorted(r["sample_rank"] for r in found.collect()) == first
    seen = [u for p in parts for u in p]
    assert len(seen) == len(set(seen)) < 200 and len(parts) <= 3
    assert P.find_until(work, caps, bodies, live, 1000, first_batch=20).count() == 100


def test_translator_runs_once_per_distinct_miss(spark):
    from pagewatch.operators.articles import cache_key, translate
    log = scratch_path(spark, "t_calls").removeprefix("file:")

    def fn(texts):
        import os
        import uuid
        os.makedirs(log, exist_ok=True)
        with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(texts))
        if "bad" in texts:
            raise ValueError("bad text")
        return [t.upper() for t in texts]

    arts = spark.createDataFrame([(i, t) for i, t in enumerate(["one", "two", "two", "known", "bad"])], "article_id long, text_src string")
    cache = arts.filter("text_src = 'known'").select(cache_key("text_src").alias("src_sha1"), F.lit("K").alias("text_out"), F.lit(True).alias("ok"))
    out, new = translate(arts.coalesce(1), cache, translate_fn=fn)
    assert {r["text_src"]: r["text_en"] for r in out.collect()} == {"one": "ONE", "two": "TWO", "known": "K", "bad": ""}
    assert sorted((r["text_out"], r["ok"]) for r in new.collect()) == [("", False), ("ONE", True), ("TWO", True)]
    import os
    done = [t for f in os.listdir(log) for t in open(f"{log}/{f}").read().split("\n")]
    assert "known" not in done and all(done.count(t) <= 2 for t in ("one", "two", "bad"))
    off, none = translate(arts, cache)
    assert {r["text_en"] for r in off.collect()} == {""} and none.count() == 0


def test_embed_fn_sees_whole_texts(spark):
    import numpy as np

    from pagewatch.operators.vectors import embed
    df = spark.createDataFrame([(1, "a " * 9 + "b"), (2, ""), (3, "b b")], "article_id long, text_src string")
    got = {r["article_id"]: r["vec"] for r in embed(df, embed_fn=lambda ts: np.array([[t.split().count("a"), t.split().count("b")] for t in ts], float),
                                                    max_tokens=4, batch_size=2).collect()}
    # windows of 4, 4 and 2 words: (4, 0), (4, 0), (1, 1)
    assert np.allclose(got[1], [3.4, 0.2]) and np.allclose(got[2], [0, 0]) and np.allclose(got[3], [0, 2])


def test_change_points_of_one_long_history(spark):
    """One URL holds half of all captures: its history is cut into ranges, and the last digest is carried from each to the next."""
    from pagewatch.operators.history import capture_change_points
    rows = [("hot", f"2024{i:010d}", "200", f"d{i // 7 % 3}" if i % 50 else None, i) for i in range(600)]
    rows += [(f"u{i % 40:02d}", f"2023{i:010d}", "200" if i % 9 else "404", f"d{i // 80}", i) for i in range(600)]
    rows += [("two", "20240101000000", "200", "a", 1), ("two", "20240101000000", "200", "b", 1), ("two", None, "200", "a", None)]
    got = {tuple(r) for r in capture_change_points(spark.createDataFrame(rows, CAP)).collect()}
    want, last = set(), {}
    none_first = lambda v: (v is not None, v if v is not None else 0)
    for url, ts, _, digest, pos in sorted((r for r in rows if r[2] == "200"), key=lambda r: (r[0], none_first(r[1]) if r[1] else (False, ""), none_first(r[4]), (r[3] is not None, r[3] or ""))):
        if url in last and last[url][0] != digest:
            want.add((url, ts, pos, digest, *last[url]))
        last[url] = (digest, ts)
    assert got == want and sum(r[0] == "hot" for r in got) > 100
    assert capture_change_points(spark.createDataFrame([], CAP)).count() == 0


def test_soft404_counts_urls_once_and_newest(spark):
    from pagewatch.operators.history import soft404_suspects
    page = lambda t: "<p>" + t + " " + "w" * 60 + "</p>"
    rows = [(f"http://a/{i}", 200, page("gone") if i < 4 else page(f"text {i}"), "2024-01-02") for i in range(10)]
    rows += [(f"http://a/{i}", 200, page("gone"), "2024-01-01") for i in range(10)] + rows[:1]  # older pages and a repeated row
    rows += [(f"http://b/{i}", 200, page("few"), "2024-01-01") for i in range(2)] + [("http://c/1", 404, page("few"), "2024-01-01")]
    live = spark.createDataFrame(rows, "url string, status_code int, html string, fetched_at string")
    got = [(r["host"], r["n_urls"], r["host_urls"], r["example_url"]) for r in soft404_suspects(live).collect()]
    assert got == [("a", 4, 10, "http://a/0")]
    assert soft404_suspects(live, min_urls=2).count() == 2 and soft404_suspects(live, share=0.5).count() == 0


def test_smallest_hex_sorts_one_bucket_only(spark):
    df = spark.range(3000).select(F.md5(F.col("id").cast("string")).alias("k"), "id")
    df = df.unionByName(df.limit(1)).unionByName(df.filter("id < 40").select(F.lit("8000aa").alias("k"), "id"))
    rows = sorted((r["k"], r["id"]) for r in df.collect())
    for n in (0, 1, 700, 1500, 1520, 3040, 3041, 9999):
        assert sorted((r["k"], r["id"]) for r in S.smallest_hex(df, "k", n, ("id",)).collect()) == rows[:n]


def test_translation_goes_on_where_a_run_died(spark):
    import os

    from pagewatch.operators.articles import translate_resumable
    from pagewatch.sources.readers import load_cache
    path, log = scratch_path(spark, "t_resume"), scratch_path(spark, "t_resume_log").removeprefix("file:")
    os.makedirs(log)

    def fn(texts, dies):
        import os
        import uuid
        done = [t for f in os.listdir(log) for t in open(f"{log}/{f}").read().split()]
        if dies and len(done) >= 20:
            raise SystemExit("the worker dies")
        with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(texts))
        return [t.upper() for t in texts]

    arts = spark.createDataFrame([(i, f"text{i % 40}") for i in range(60)], "article_id long, text_src string").coalesce(1)
    with pytest.raises(Exception):  # noqa: B017
        translate_resumable(arts, path, lambda t: fn(t, True), slices=6)
    kept = load_cache(spark, path).count()
    assert 0 < kept < 40
    out = translate_resumable(arts, path, lambda t: fn(t, False), slices=6)
    assert {(r["text_src"], r["text_en"]) for r in out.collect()} == {(f"text{i}", f"TEXT{i}") for i in range(40)}
    done = [t for f in os.listdir(log) for t in open(f"{log}/{f}").read().split()]
    assert load_cache(spark, path).count() == 40 and len(done) <= 40 + 40 - kept


def test_windows_of_a_stated_range_of_years(spark):
    from pagewatch.operators import discovery as D
    months = [(str(r["start"]), str(r["end"])) for r in D.month_windows(spark, 2019, 2020).orderBy("start").collect()]
    assert len(months) == 24 and months[0] == ("2019-01-01", "2019-02-01") and months[-1] == ("2020-12-01", "2021-01-01")
    years = [(str(r["start"]), str(r["end"])) for r in D.year_windows(spark, 2019, 2020).orderBy("start").collect()]
    assert years == [("2019-01-01", "2020-01-01"), ("2020-01-01", "2021-01-01")]
    assert D.month_windows(spark, 2020, 2019).count() == 0 and D.year_windows(spark, 2020, 2019).count() == 0


def test_dictionary_translation_shuffles_the_texts_once(spark):
    """Articles meet the cache; nothing else of a text moves. A cached null is a hit, a failure is retried."""
    from pagewatch.operators.articles import cache_key, translate
    arts = spark.createDataFrame([(1, "le chat"), (2, "le chat"), (3, "la maison"), (4, "le jour"), (5, None)], "article_id long, text_src string")
    keys = {r["text_src"]: r["k"] for r in arts.select("text_src", cache_key("text_src").alias("k")).collect()}
    cache = spark.createDataFrame([(keys["le chat"], "cached", True), (keys["la maison"], "", False), (keys["le jour"], None, True)],
                                  "src_sha1 string, text_out string, ok boolean")
    out, new = translate(arts, cache, dictionary={"le": "the", "la": "the"})
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert {r["article_id"]: r["text_en"] for r in out.collect()} == {1: "cached", 2: "cached", 3: "the maison", 4: "", 5: ""}
    assert [(r["src_sha1"], r["text_out"]) for r in new.filter("src_sha1 IS NOT NULL").collect()] == [(keys["la maison"], "the maison")]


def test_cluster_payload_is_written_compressed(spark):
    """Every text is in the articles twice; uncompressed they outgrew the rest of the run."""
    import os

    from pagewatch.operators.topics import cluster_payload
    from pagewatch.sinks.writers import write_cluster_payload
    odd = [None, "", "line\nbreak\r\n\ttab \"quoted\" \\ slash", "\u2028 \x01 日本語 🙂", "word " * 50_000]
    rows = [(i, f"u{i}", None if i == 1 else "a", "2023", t, t, i % 2 - 1) for i, t in enumerate(odd)]
    arts = spark.createDataFrame(rows, "article_id long, url string, archive_url string, archive_timestamp string, text_src string, text_en string, cluster int")
    payload = cluster_payload(arts, spark.createDataFrame([(0, 2)], "id int, size long"), {"input_dir": "d", "model": "m", "min_topic_size": 5, "translation": "t"})
    path = scratch_path(spark, "t_payload")
    write_cluster_payload(payload, path)
    write_cluster_payload(payload, path)
    for name, df in zip(("summary", "articles", "clusters"), payload, strict=True):
        assert sorted(map(str, spark.read.schema(df.schema).json(f"{path}/{name}").collect())) == sorted(map(str, df.collect()))
    at = f"{path.removeprefix('file:')}/articles"
    assert sum(os.path.getsize(f"{at}/{f}") for f in os.listdir(at)) < 50_000
