"""Derived input tables, built by Spark from the given parquet tables.

The reference reads captures, live pages and archive bodies over the network;
here they are tables. These derivations turn the driver's tables into those
shapes so every query's work grows with the given data. Each derivation has a
DuckDB twin in ``pagewatch.plans.oracles`` (same rule, other engine).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import table


def _s(c) -> Column:
    return (c if isinstance(c, Column) else F.col(c)).cast("string")


# --------------------------------------------------------------------- events
def event_captures(spark: SparkSession, sf_dir: str, month_shift: bool = True) -> DataFrame:
    """Captures (M4) from ``events``: URL = user, status from event type.

    With ``month_shift`` the timestamp moves ``event_id % 24`` months ahead so
    the one-month events table spans two years (month / year logic has work).
    """
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    ts = F.col("ts")
    if month_shift:
        ts = F.expr("ts + make_ym_interval(0, cast(event_id % 24 as int))")
    # Built from the fields, not date_format: formatting a TIMESTAMP_NTZ goes
    # through the session zone and moves times inside a DST gap.
    ts14 = F.format_string("%04d%02d%02d%02d%02d%02d", F.year(ts), F.month(ts), F.dayofmonth(ts),
                           F.hour(ts), F.minute(ts), F.second(ts))
    return ev.select(
        F.concat(F.lit("https://site"), _s(F.col("user_id") % 7), F.lit(".example/a/"), _s("user_id")).alias("original"),
        ts14.alias("ts14"),
        F.when(F.col("event_type") == "error", "404").when(F.col("event_type") == "signup", "301")
         .otherwise("200").alias("statuscode"),
        F.upper(F.sha1(F.col("props"))).alias("digest"),
        F.col("event_id").alias("pos"),
    )


# ---------------------------------------------------------------------- pages
def _pid() -> Column:
    return F.col("page_id")


def page_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of every page URL: 1-4 per page, some redirects, some ties.

    Rules (fixed; the oracle repeats them): pages with ``page_id % 17 = 0``
    have no capture; ``% 13 = 0`` only non-200 captures; the last capture is a
    301 when ``page_id`` is even; the first is ``-`` when ``% 9 = 0``; capture
    1 repeats capture 0's timestamp when ``% 7 = 3`` (later ``pos`` wins).
    """
    p = table(spark, sf_dir, "pages").select("page_id", "url").filter(F.col("page_id") % 17 != 0)
    p = p.withColumn("n", (_pid() % 4 + 1).cast("int"))
    p = p.select("page_id", "url", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    day = F.when((_pid() % 7 == 3) & (F.col("i") == 1), F.lit(1)).otherwise(F.col("i") * 7 + 1)
    ts14 = F.concat(F.lit("2023"), F.lpad(_s(_pid() % 12 + 1), 2, "0"), F.lpad(_s(day), 2, "0"),
                    F.lpad(_s(_pid() % 24), 2, "0"), F.lit("0000"))
    status = (F.when(_pid() % 13 == 0, F.lit("302"))
              .when((F.col("i") == F.col("n") - 1) & (_pid() % 2 == 0), F.lit("301"))
              .when((F.col("i") == 0) & (_pid() % 9 == 0), F.lit("-"))
              .otherwise(F.lit("200")))
    return p.select(
        "page_id",
        F.col("url").alias("original"),
        ts14.alias("ts14"),
        status.alias("statuscode"),
        F.upper(F.sha1(F.concat(F.col("url"), F.lit("#"), _s("i")))).alias("digest"),
        F.col("i").cast("long").alias("pos"),
    )


def archive_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive bodies (M6) keyed by (original, ts14), one per good capture.

    Capture 0 of a multi-capture page holds an older text (`` (old)`` before
    every ``</p>``); ``page_id % 19 = 0`` has an empty body.
    """
    caps = page_captures(spark, sf_dir).filter(F.col("statuscode") == "200")
    caps = caps.filter(~((_pid() % 7 == 3) & (F.col("pos") == 1)))
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    j = caps.join(pages, "page_id")
    html = (F.when(_pid() % 19 == 0, F.lit(""))
            .when((F.col("pos") == 0) & (_pid() % 4 != 0), F.replace(F.col("html"), F.lit("</p>"), F.lit(" (old)</p>")))
            .otherwise(F.col("html")))
    return j.select("original", "ts14", html.alias("html"))


def live_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live observations (M5): 404, 500, 410, network error, edited and layout-only pages;
    every sixth page has an older observation besides: a 404, or, every twelfth, the page as the archive has it."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    code = (F.when(_pid() % 23 == 0, F.lit(None).cast("int"))
            .when(_pid() % 5 == 0, F.lit(404))
            .when(_pid() % 11 == 0, F.lit(500))
            .when(_pid() % 29 == 0, F.lit(410))
            .otherwise(F.lit(200)))
    html = (F.when(_pid() % 3 == 0, F.replace(F.col("html"), F.lit("</p>"), F.lit(" (upd)</p>")))
            .when(_pid() % 3 == 1, F.replace(F.col("html"), F.lit("<footer>"), F.lit("<footer>Ad ")))
            .otherwise(F.col("html")))
    day = F.concat(F.lit("2024-01-"), F.lpad(_s(_pid() % 28 + 1), 2, "0"))
    newest = p.select(
        F.col("url"),
        code.alias("status_code"),
        F.when(code.isNotNull(), html).alias("html"),
        F.concat(day, F.lit("T12:00:00")).alias("fetched_at"),
        F.when(code.isNull(), F.lit("timeout")).alias("error"),
    )
    older = p.filter(_pid() % 6 == 0).select(
        F.col("url"), F.when(_pid() % 12 == 0, 200).otherwise(404).alias("status_code"),
        F.when(_pid() % 12 == 0, F.col("html")).otherwise("<p>gone</p>").alias("html"),
        F.concat(day, F.lit("T06:00:00")).alias("fetched_at"), F.lit(None).cast("string").alias("error"))
    return newest.unionByName(older)


SOFT_404 = "<article><p>The page that you asked for is not here any more. Please use the search of this site.</p></article>"


def live_with_soft404(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live observations of which every seventh page, where it answers with 200, shows the host's text for missing pages."""
    live = live_observations(spark, sf_dir)
    ids = table(spark, sf_dir, "pages").select("url", "page_id")
    gone = (_pid() % 7 == 0) & (F.col("status_code") == 200)
    return live.join(ids, "url").withColumn("html", F.when(gone, SOFT_404).otherwise(F.col("html"))).drop("page_id")


def decorated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a nested menu, users' comments, a table and a second article added."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    n = _s("page_id")
    more = F.concat(F.lit('<div class="post comments"><div><p>A user comment on '), n, F.lit('.</p></div></div><table><tr><th>pair</th><td>rate '),
                    n, F.lit('</td></tr></table></article><article><p>Second part of the story '), n, F.lit('.</p></article>'))
    html = F.replace(F.col("html"), F.lit("<article>"), F.lit("<nav>menu<ul><li><nav>inner menu</nav></li></ul>tail of the menu</nav><article>"))
    return p.select("page_id", "url", F.replace(html, F.lit("</article>"), more).alias("html"))


def url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The URL list to check (M1): every page URL, ``page_id % 10 = 0`` twice."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    dup = p.filter(_pid() % 10 == 0)
    return p.unionByName(dup).select("url")


def checked_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of already-checked URLs (M9): ``page_id % 8 = 0``, with duplicates."""
    p = table(spark, sf_dir, "pages").select("page_id", "url").filter(_pid() % 8 == 0)
    return p.unionByName(p.filter(_pid() % 16 == 0)).select("url")


def url_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw text lines of a URL file: blanks, tab / NBSP padding, duplicates."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    line = (F.when(_pid() % 7 == 0, F.lit("   "))
            .when(_pid() % 7 == 1, F.concat(F.lit("\t"), F.col("url"), F.lit("  ")))
            .when(_pid() % 7 == 2, F.concat(F.lit("\u00a0"), F.col("url"), F.lit("\u3000")))
            .otherwise(F.col("url")))
    lines = p.select("page_id", line.alias("value"))
    return lines.unionByName(lines.filter(_pid() % 5 == 0)).select("value")


# ------------------------------------------------------------------ documents
def findings_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings (M7) from ``documents``; a few are ``changed`` or have empty text."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    url = F.concat(F.lit("https://"), F.col("source"), F.lit(".example/"), _s("doc_id"))
    ts14 = F.concat(F.lit("2023"), F.lpad(_s(F.col("doc_id") % 12 + 1), 2, "0"), F.lit("15120000"))
    verdict = F.when(F.col("doc_id") % 10 == 7, F.lit("changed")).otherwise(F.lit("deleted"))
    text = (F.when(F.col("doc_id") % 25 == 3, F.lit(""))
            .otherwise(F.concat(F.lit("# Heading "), _s("doc_id"), F.lit("\n[link](https://x.example/"),
                                _s("doc_id"), F.lit(")\n"), F.col("text"))))
    archive_url = F.concat(F.lit("https://web.archive.org/web/"), ts14, F.lit("/"), url)
    return d.select(
        url.alias("url"),
        verdict.alias("verdict"),
        F.lit("content-only").alias("comparison_mode"),
        F.struct(archive_url.alias("url"),
                 F.regexp_replace(archive_url, r"^(.*?/web/\d{14})/", "$1id_/").alias("raw_url"),
                 ts14.alias("timestamp"),
                 F.upper(F.sha1(F.col("text"))).alias("digest"),
                 text.alias("text")).alias("archive"),
        F.struct(url.alias("url"), F.lit(404).alias("status_code"), F.lit("2024-01-01T00:00:00").alias("fetched_at"),
                 F.lit(None).cast("string").alias("digest"), F.lit(None).cast("string").alias("text")).alias("live"),
    )


def translation_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache rows (M12) for the texts of even documents; keys whose SHA-1 starts
    with ``0`` hold a cached failure (``ok = false``, empty text)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text").filter(F.col("doc_id") % 2 == 0)
    key = F.sha1(F.col("text"))
    ok = ~F.startswith(key, F.lit("0"))
    return d.select(
        key.alias("src_sha1"),
        F.when(ok, F.concat(F.lit("[en] "), F.col("text"))).otherwise(F.lit("")).alias("text_out"),
        ok.alias("ok"),
    ).distinct()


# A small hand-written token dictionary for the built-in
# dictionary translator (I1), source token -> output token.
DICTIONARY = [
    ("le", "the"), ("la", "the"), ("les", "the"), ("des", "of the"), ("de", "of"), ("du", "of the"),
    ("et", "and"), ("est", "is"), ("un", "a"), ("une", "a"), ("qui", "who"), ("en", "in"),
    ("elle", "she"), ("il", "he"), ("pour", "for"), ("dans", "in"), ("avec", "with"), ("sur", "on"),
    ("der", "the"), ("die", "the"), ("das", "the"), ("und", "and"), ("ist", "is"), ("ein", "a"),
    ("eine", "a"), ("mit", "with"), ("von", "from"), ("zu", "to"), ("nicht", "not"), ("auf", "on"),
    ("el", "the"), ("los", "the"), ("las", "the"), ("y", "and"), ("es", "is"), ("con", "with"),
    ("por", "by"), ("para", "for"), ("una", "a"), ("que", "that"), ("del", "of the"), ("al", "to the"),
    ("se", "itself"), ("no", "no"), ("su", "his"), ("lo", "it"), ("como", "as"), ("pero", "but"),
    ("mais", "but"), ("oder", "or"),
]


def dictionary() -> dict[str, str]:
    return dict(DICTIONARY)


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch log (for G3) over the months and weeks the event captures span.

    Month windows fail when ``md5(month start)`` starts with 0-7 (about half);
    weeks of failed months fail when their md5 starts with 0-3.
    """
    from .operators.discovery import month_windows_for, week_windows
    caps = event_captures(spark, sf_dir)
    months = month_windows_for(caps)
    mstat = F.when(F.substring(F.md5(_s("start")), 1, 1).isin("0", "1", "2", "3", "4", "5", "6", "7"), "error").otherwise("ok")
    m = months.select(F.lit("month").alias("level"), "start", "end", mstat.alias("status"))
    weeks = week_windows(m.filter(F.col("status") == "error").select("start", "end"))
    wstat = F.when(F.substring(F.md5(_s("start")), 1, 1).isin("0", "1", "2", "3"), "error").otherwise("ok")
    w = weeks.select(F.lit("week").alias("level"), "start", "end", wstat.alias("status"))
    return m.unionByName(w)
