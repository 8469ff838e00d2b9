"""Verdict operators: live normalisation (G4), the archive/live join (D4), outcomes
(G7), finding shapes (C9, C10), run counters (E5) and progress metrics (E6).

Pages (HTML) are never shuffled: live pages and bodies that the work list
cannot need are dropped where they are read by a broadcast semi-join, the rest
are digested there, and only digests travel to the joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.urls import classify_verdict, finding_key, mode_label, raw_archive_url
from ..session import ensure_checkpoint_dir, spread, store
from .captures import latest_good_capture

OUTCOMES = ["deleted", "changed", "unchanged", "no_capture", "no_good_capture", "no_archive_body",
            "extract_failed", "live_error", "live_other_status"]
# Outcomes worth retrying on the next run: they are not written to the ledger
# unless ``compat=True`` (which records everything, as the reference's code does).
RETRYABLE = ["live_error"]


def page_digest(html, content_only: bool = True) -> Column:
    """H4 over H1-H3 (content-only) or over the raw HTML (full-page)."""
    if content_only:
        return T.content_digest(T.extract_main_text(html))
    return T.content_digest(html)


def newest_live(live: DataFrame) -> DataFrame:
    """One live observation per URL, the newest by ``fetched_at`` (the largest row where times are equal)."""
    order = [c for c in ("fetched_at", "live_status_code", "status_code", "live_digest", "live_text", "html") if c in live.columns]
    rest = [c for c in live.columns if c != "url"]
    best = F.max(F.struct(*[F.col(c) for c in order + [c for c in rest if c not in order]])).alias("_b")
    return live.groupBy("url").agg(best).select("url", *[F.col(f"_b.{c}").alias(c) for c in rest])


MOST_KEYS = 1 << 21      # hashes of keys (8 bytes each) that are broadcast


def needed(pages: DataFrame, cols: list[str], keys: DataFrame, key_cols: list[str] | None = None) -> DataFrame:
    """Rows of ``pages`` whose key may be in ``keys`` (a written table): none that is, is dropped.

    A semi-join with the broadcast hashes of the keys, so wide columns stay where they were read. More keys than
    MOST_KEYS are not broadcast: then all pages go on, and the caller's join by the key itself leaves the others out
    (Spark's runtime Bloom filter, where it applies, before they are digested).
    """
    if keys.count() > MOST_KEYS:
        return pages
    hashes = keys.select(F.xxhash64(*(key_cols or cols)).alias("_h")).distinct()
    return pages.join(F.broadcast(hashes), F.xxhash64(*[pages[c] for c in cols]) == hashes["_h"], "left_semi")


def normalise_live(live: DataFrame, content_only: bool = True) -> DataFrame:
    """Digest only for live status 200; an error row has all nulls."""
    ok = F.col("status_code") == 200
    return live.select("url", F.col("status_code").cast("int").alias("live_status_code"),
                       page_digest(F.when(ok, F.col("html")), content_only).alias("live_digest"),
                       *[c for c in ("fetched_at",) if c in live.columns])


def _latest(work: DataFrame, captures: DataFrame) -> DataFrame:
    """The newest good capture of each work URL (and how many captures it has), computed once."""
    keys = work.select(F.col("url").alias("original"))
    caps = captures.select("original", "ts14", "statuscode", "pos").join(keys, "original", "left_semi")
    return store(latest_good_capture(caps, keep_all=True).withColumnRenamed("original", "url"), "latest")


def _won(latest: DataFrame) -> DataFrame:
    return latest.filter(F.col("ts14").isNotNull()).select("url", "ts14")


def body_digests(latest: DataFrame, bodies: DataFrame, content_only: bool = True) -> DataFrame:
    """(url, ts14, has_body, archive_digest) of the winning captures' bodies, digested where they are read.

    A body that is stored more than once counts once: one that is not empty, that with the largest digest.
    """
    b = needed(bodies.select(F.col("original").alias("url"), "ts14", "html"), ["url", "ts14"], _won(latest))
    has_body = F.col("html").isNotNull() & (F.col("html") != "")
    digests = spread(b).select("url", "ts14", F.struct(has_body.alias("has_body"), page_digest(F.when(has_body, F.col("html")), content_only).alias("digest")).alias("d"))
    return digests.groupBy("url", "ts14").agg(F.max("d").alias("d")).select("url", "ts14", "d.has_body", F.col("d.digest").alias("archive_digest"))


def observe(work: DataFrame, captures: DataFrame, bodies: DataFrame, live: DataFrame,
            content_only: bool = True, boilerplate: dict | None = None) -> DataFrame:
    """One row per candidate URL with its newest good capture, the digest of
    that capture's body, and the newest normalised live observation.

    ``work`` has ``url`` (distinct) plus any carried columns (e.g. ``sample_rank``).
    The work list and its captures are written once (their keys filter the
    pages before any page is digested); every join is keyed by ``url``.
    """
    ensure_checkpoint_dir(work.sparkSession)
    work = store(work, "work")
    latest = _latest(work, captures)
    if boilerplate is not None and content_only:
        return _observe_corpus(work, latest, bodies, live, boilerplate)
    live_n = newest_live(normalise_live(spread(needed(live, ["url"], work)), content_only))
    j = work.join(latest, "url", "left").join(live_n, "url", "left")
    j = j.join(body_digests(latest, bodies, content_only), ["url", "ts14"], "left")
    return j.withColumn("has_body", F.coalesce("has_body", F.lit(False)))


def _observe_corpus(work: DataFrame, latest: DataFrame, bodies: DataFrame, live: DataFrame,
                    params: dict) -> DataFrame:
    """D4 with H1c: winning archive bodies and newest live 200 pages form one corpus;
    blocks repeated on many pages of a host are removed before digesting.

    Pages are cut to blocks where they are read, so here too no page is shuffled. Which page of a URL counts is decided
    first, by time and SHA-1: older observations and other copies of a body are no part of the corpus.
    """
    from .content import extract_main_text
    seen = [c for c in ("fetched_at",) if c in live.columns]
    page = F.sha1(F.col("html").cast("binary"))
    live = needed(live, ["url"], work).withColumns({"live_status_code": F.col("status_code").cast("int"), "page": page})
    newest = store(newest_live(live.select("url", "live_status_code", *seen, "page")).join(work.select("url"), "url", "left_semi"), "newest_live")
    b = needed(bodies.select(F.col("original").alias("url"), "ts14", "html"), ["url", "ts14"], _won(latest))
    b = b.filter(F.col("html") != "").withColumn("page", page)
    won = store(b.join(_won(latest), ["url", "ts14"], "left_semi").groupBy("url", "ts14").agg(F.max("page").alias("page")), "won_bodies")
    arch = F.concat_ws("|", F.lit("a"), "ts14", "page", "url").alias("doc")
    now = F.concat_ws("|", F.lit("l"), *seen, "page", "url").alias("doc")
    shown = newest.filter("live_status_code = 200")
    docs = b.select(arch, "url", "html").unionByName(live.filter("live_status_code = 200").select(now, "url", "html"))
    keys = won.select(arch, "url", F.lit(True).alias("archived")).unionByName(shown.select(now, "url", F.lit(False).alias("archived")))
    texts = store(extract_main_text(docs, key="doc", url_col="url", page_col="url", keep=keys.select("doc"), **params).select("doc", "digest"), "page_digests")
    digests = keys.join(texts, "doc")
    a = digests.filter("archived").select("url", F.lit(True).alias("has_body"), F.col("digest").alias("archive_digest"))
    side = digests.filter("NOT archived").select("url", F.col("digest").alias("live_digest"))
    j = work.join(latest, "url", "left").join(newest.drop("page"), "url", "left").join(a, "url", "left").join(side, "url", "left")
    return j.withColumn("has_body", F.coalesce("has_body", F.lit(False)))


def outcome_col(content_only: bool = True, gone_codes=(404,)) -> Column:
    """Why a URL did or did not produce a finding (precedence as in the reference)."""
    verdict = classify_verdict("live_status_code", "live_digest", "archive_digest", "has_body", gone_codes)
    code = F.col("live_status_code")
    return (F.when(F.col("n_captures").isNull(), F.lit("no_capture"))
            .when(F.col("ts14").isNull(), F.lit("no_good_capture"))
            .when(~F.coalesce(F.col("has_body"), F.lit(False)), F.lit("no_archive_body"))
            .when(verdict.isNotNull(), verdict)
            .when(code.isNull(), F.lit("live_error"))
            .when(code != 200, F.lit("live_other_status"))
            .when(F.col("live_digest").isNull() | F.col("archive_digest").isNull(), F.lit("extract_failed"))
            .otherwise(F.lit("unchanged")))


def outcomes(observed: DataFrame, content_only: bool = True, gone_codes=(404,)) -> DataFrame:
    """Every observed URL with ``outcome``, ``verdict`` and the verdict fields."""
    verdict = classify_verdict("live_status_code", "live_digest", "archive_digest", "has_body", gone_codes)
    return observed.select(
        "*",
        outcome_col(content_only, gone_codes).alias("outcome"),
        F.when(F.col("has_body"), verdict).alias("verdict"),
    )


def ledger_rows(outs: DataFrame, compat: bool = False) -> DataFrame:
    """What enters the checked ledger: all outcomes with ``compat``, else not the retryable ones."""
    if compat:
        return outs.select("url", "outcome")
    return outs.filter(~F.col("outcome").isin(RETRYABLE)).select("url", "outcome")


def finding_metadata(findings: DataFrame, content_only: bool = True, output_dir: str = "saved_articles") -> DataFrame:
    """The flat nine-field finding row (M8)."""
    key = finding_key(F.col("verdict"), F.col("ts14"), F.col("url"))
    return findings.select(
        "url", "verdict", "live_status_code",
        F.col("ts14").alias("archive_timestamp"),
        "archive_url",
        F.concat(F.lit(output_dir.rstrip("/") + "/"), key, F.lit(".json")).alias("saved_file"),
        mode_label(content_only).alias("comparison_mode"),
        "archive_digest",
        F.when(F.col("verdict") != "deleted", F.col("live_digest")).alias("live_digest"),
    )


def finding_struct(findings: DataFrame, bodies: DataFrame, live: DataFrame, run_ts: str,
                   content_only: bool = True) -> DataFrame:
    """The nested finding document (M7).

    Evidence text is extracted only for findings: their bodies (and, for
    ``changed``, live pages) are joined back here, after the verdicts.
    """
    f = findings.select("url", "verdict", "live_status_code", "ts14", "archive_url", "archive_digest",
                        "live_digest", *[c for c in ("sample_rank", "fetched_at") if c in findings.columns])
    ensure_checkpoint_dir(findings.sparkSession)
    f = store(f, "findings")
    b = needed(bodies.select(F.col("original").alias("url"), "ts14", "html"), ["url", "ts14"], f)
    b = b.select("url", "ts14", F.struct(page_digest(F.nullif("html", F.lit("")), content_only).alias("digest"), T.evidence_text(F.col("html")).alias("text")).alias("d"))
    b = b.groupBy("url", "ts14").agg(F.max("d").alias("d")).select("url", "ts14", F.col("d.text").alias("archive_text"))
    moved = f.filter(F.col("verdict") == "changed")
    lv = needed(live, ["url"], moved)
    lv = newest_live(lv.select("url", *[c for c in ("fetched_at",) if c in live.columns], T.evidence_text(F.col("html")).alias("live_text")))
    lv = lv.drop("fetched_at")
    j = f.join(b, ["url", "ts14"], "left").join(lv, "url", "left")
    changed = F.col("verdict") == "changed"
    return j.select(
        "url", "verdict",
        mode_label(content_only).alias("comparison_mode"),
        F.struct(
            F.col("archive_url").alias("url"),
            raw_archive_url(F.col("archive_url")).alias("raw_url"),
            F.col("ts14").alias("timestamp"),
            F.col("archive_digest").alias("digest"),
            F.col("archive_text").alias("text"),
        ).alias("archive"),
        F.struct(
            F.col("url").alias("url"),
            F.col("live_status_code").alias("status_code"),
            (F.coalesce(F.col("fetched_at"), F.lit(run_ts)) if "fetched_at" in f.columns else F.lit(run_ts)).alias("fetched_at"),
            F.when(F.col("verdict") != "deleted", F.col("live_digest")).alias("digest"),
            F.when(changed, F.col("live_text")).alias("text"),
        ).alias("live"),
        *[c for c in ("sample_rank",) if c in findings.columns],
    )


def flatten_finding(doc: DataFrame) -> DataFrame:
    """Inverse view of C10 for checks: one flat row per finding document."""
    return doc.select(
        "url", "verdict", "comparison_mode",
        F.col("archive.url").alias("archive_url"), F.col("archive.raw_url").alias("archive_raw_url"),
        F.col("archive.timestamp").alias("archive_timestamp"), F.col("archive.digest").alias("archive_digest"),
        F.col("archive.text").alias("archive_text"),
        F.col("live.status_code").alias("live_status_code"), F.col("live.fetched_at").alias("live_fetched_at"),
        F.col("live.digest").alias("live_digest"),
        F.col("live.text").alias("live_text"),
    )


def with_rate(counters: DataFrame, elapsed_sec: float, checked: str = "total_checked") -> DataFrame:
    """The time a run took and URLs per second (0 for no time) beside its counters."""
    rate = F.round(F.col(checked) / F.lit(float(elapsed_sec)), 1) if elapsed_sec > 0 else F.lit(0.0)
    return counters.withColumn("elapsed_sec", F.lit(float(elapsed_sec))).withColumn("urls_per_sec", rate)


def run_counters(outs: DataFrame, loaded: DataFrame | None = None) -> DataFrame:
    """E5: one row of run counters from the outcome table."""
    agg = outs.agg(
        F.count(F.lit(1)).alias("total_checked"),
        F.count_if(F.col("verdict").isNotNull()).alias("found_count"),
        F.count_if(F.col("verdict") == "deleted").alias("deleted_count"),
        F.count_if(F.col("verdict") == "changed").alias("changed_count"),
        F.count_if(F.col("outcome").isin(RETRYABLE)).alias("error_count"),
    )
    if loaded is not None:
        n = loaded.agg(F.count(F.lit(1)).alias("total_urls_loaded"))
        agg = combine_rows(agg, n)
    return agg


def combine_rows(*frames: DataFrame) -> DataFrame:
    """Side by side merge of single-row frames with distinct columns, as a union
    plus one global aggregate (no join, so no nested-loop plan)."""
    cols = [c for f in frames for c in f.columns]
    types = {f2.name: f2.dataType for f in frames for f2 in f.schema.fields}
    parts = []
    for f in frames:
        parts.append(f.select(*[F.col(c) if c in f.columns else F.lit(None).cast(types[c]).alias(c) for c in cols]))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.agg(*[F.first(c, ignorenulls=True).alias(c) for c in cols])


def with_progress(df: DataFrame, name: str = "progress") -> tuple[DataFrame, Observation]:
    """Attach live counters (checked, found) that fill in when the plan runs.

    Batch: a named ``Observation``; streams report the same metrics in
    ``StreamingQueryProgress.observedMetrics``.
    """
    obs = Observation(name)
    observed = df.observe(
        obs,
        F.count(F.lit(1)).alias("checked"),
        F.count_if(F.col("verdict").isNotNull()).alias("found"),
    )
    return observed, obs
