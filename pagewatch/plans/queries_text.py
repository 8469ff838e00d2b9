"""Registered text-function queries (H1-H8) over pages and documents, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from .. import oracles as O
from ..functions import text as T
from ..operators.content import extract_main_text
from ..registry import register
from ..session import spread, table


def _docs(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def _pages(spark, d):
    return spread(table(spark, d, "pages").select("page_id", "url", "html"))


# Flat pages with the same article text as the decorated ones, without and with what only the evidence keeps.
FLAT = """SELECT page_id, url, replace(html, '</article>', '<p>Second part of the story ' || CAST(page_id AS VARCHAR) || '.</p></article>') AS html FROM pages"""
FLAT_EVIDENCE = """SELECT page_id, url, replace(html, '</article>', '<p>A user comment on ' || CAST(page_id AS VARCHAR) || '.</p><p>pair | rate '
  || CAST(page_id AS VARCHAR) || ' |</p><p>Second part of the story ' || CAST(page_id AS VARCHAR) || '.</p></article>') AS html FROM pages"""


@register("extract_main_text", O.corpus_text_sql(FLAT))
def q_extract_main_text(spark, d):
    """H1: main text of every page (nested menus, tables, comments and two articles) with per-host
    boilerplate blocks removed (+ H2-H4)."""
    return extract_main_text(X.decorated_pages(spark, d))


@register("length_gate", f"SELECT doc_id, {O.length_gate('text')} AS gated FROM documents")
def q_length_gate(spark, d):
    """H2: text kept only when 50+ characters after stripping."""
    return _docs(spark, d).select("doc_id", T.length_gate("text").alias("gated"))


@register("normalise_text", f"SELECT doc_id, {O.collapse_ws('text')} AS norm FROM documents")
def q_normalise_text(spark, d):
    """H3: NFKC + whitespace collapse (NFKC is the identity on this corpus; unit tests cover it)."""
    return _docs(spark, d).select("doc_id", T.normalise_text("text").alias("norm"))


@register("content_digest", f"SELECT doc_id, upper(sha1({O.collapse_ws('text')})) AS digest FROM documents")
def q_content_digest(spark, d):
    """H4: upper-case SHA-1 of the normalised text."""
    return _docs(spark, d).select("doc_id", T.content_digest(T.normalise_text("text")).alias("digest"))


@register("evidence_text", f"SELECT page_id, {O.evidence_markdown('html')} AS evidence FROM ({FLAT_EVIDENCE})")
def q_evidence_text(spark, d):
    """H5: Markdown evidence (headings, links, lists, emphasis, table rows) of each page's main region."""
    return spread(X.decorated_pages(spark, d)).select("page_id", T.evidence_markdown("html").alias("evidence"))


@register("evidence_fallback", f"""SELECT page_id, {O.evidence_text("CASE page_id % 4 WHEN 0 THEN '<p>' || url || '</p>' WHEN 1 THEN '<p>a</p><p>' || page_id || '</p>' ELSE html END")} AS evidence FROM pages""")
def q_evidence_fallback(spark, d):
    """H6: Markdown, else plain text, else null: whole pages, pages of one address and pages too short for either."""
    p, n = _pages(spark, d), F.col("page_id")
    h = (F.when(n % 4 == 0, F.concat(F.lit("<p>"), F.col("url"), F.lit("</p>")))
         .when(n % 4 == 1, F.concat(F.lit("<p>a</p><p>"), n.cast("string"), F.lit("</p>"))).otherwise(F.col("html")))
    return p.select("page_id", T.evidence_text(h).alias("evidence"))


MD_SRC = ("'# Title ' || cast(doc_id AS VARCHAR) || chr(10) || text || ' [a link](https://x.example/' "
          "|| cast(doc_id AS VARCHAR) || ') `code` **bold** a_b_c'")


@register("markdown_to_plain", f"SELECT doc_id, {O.markdown_to_plain(MD_SRC)} AS plain FROM documents")
def q_markdown_to_plain(spark, d):
    """H7: Markdown marks stripped from finding text."""
    md = F.concat(F.lit("# Title "), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text"),
                  F.lit(" [a link](https://x.example/"), F.col("doc_id").cast("string"), F.lit(") `code` **bold** a_b_c"))
    return _docs(spark, d).select("doc_id", T.markdown_to_plain(md).alias("plain"))


@register("snippet", f"SELECT doc_id, {O.snippet('text', 300)} AS snippet_300, {O.snippet('text', 180)} AS snippet_180 FROM documents")
def q_snippet(spark, d):
    """H8: 300- and 180-character snippets cut at a word boundary."""
    return _docs(spark, d).select("doc_id", T.snippet("text", 300).alias("snippet_300"),
                                  T.snippet("text", 180).alias("snippet_180"))
