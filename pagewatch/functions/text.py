"""Column functions for text: HTML to main text, gates, digests, Markdown, snippets.

All are native Spark expressions on the JVM side but two Arrow functions:
``nfkc`` (Spark has no Unicode normalisation) and the cut of a page
to its article (nested elements have no regular expression). They take the texts
of a batch one by one, so a task holds the batch, its results and one text.
Regexes are written so the same pattern means the same thing in Java regex and
RE2, which lets the DuckDB oracles reuse them.
"""

from __future__ import annotations

import re
import unicodedata

from collections.abc import Callable
from functools import reduce
from operator import or_

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the article and topic texts: Markdown marks, wording.
MD_HEADING_RE = r"(?dmU)^#+[\s\x1c-\x1f]*"  # (?d): only \n ends a line
MD_LINK_RE = r"\[([^\]]+)\]\([^)]+\)"
MD_CODE_RE = r"`([^`]+)`"
MD_EMPHASIS_RE = r"[*_]{1,2}([^*_]+)[*_]{1,2}"
ELLIPSIS = "…"
KEYWORDS_LEAD = "Keywords: "
EXAMPLE_LEAD = "Example: "
OUTLIER_TEXT = "(outliers — no shared topic)"

# Elements cut before extraction, block-level tags that end a
# text block, and the HTML entities decoded (``&amp;`` last, so ``&amp;lt;``
# stays ``&lt;``).
NOISE_TAGS = ["script", "style", "nav", "footer", "noscript", "template", "iframe", "svg", "form", "aside"]
BLOCK_TAGS = ["p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "br", "tr", "td", "th", "table",
              "section", "blockquote", "pre", "article", "header", "main", "dd", "dt", "figcaption", "hr"]
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
            ("&nbsp;", "\u00a0"), ("&middot;", "·"), ("&copy;", "©"), ("&reg;", "®"),
            ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&amp;", "&")]

BLOCK_RE = r"(?i)</?(" + "|".join(BLOCK_TAGS) + r")\b[^>]*>"
TAG_RE = r"<[^>]*>"
# Elements whose id or class says that they hold users' comments.
COMMENT_TAGS = ["div", "section", "ul", "ol", "aside", "article"]
COMMENT_NAMES = ["comment", "comments", "commentlist", "comment-list", "disqus_thread"]
RAW_TAGS = ["script", "style"]  # their content is no markup
EDGE_WS = " \t\n\x0b\f\r"
# Java (?U)\s is Unicode White_Space; Python's str.split() also splits on \x1c-\x1f.
UNICODE_WS_RE = r"(?U)[\s\x1c-\x1f]+"
# The same characters one by one, to trim in one pass.
UNICODE_EDGE_WS = ("\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
                   "\u2028\u2029\u202f\u205f\u3000")


def _c(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def _let(expr: Column, body) -> Column:
    """Evaluate ``expr`` once and pass it to ``body`` as a bound variable.

    Helpers below use their input several times (a test, then the value);
    binding it through a one-element ``transform`` guarantees the expensive
    input (a chain of regex passes over a whole page) runs once per row.
    """
    return F.element_at(F.transform(F.array(expr), body), 1)


def decode_entities(c) -> Column:
    def decode(t):
        out = t
        for ent, ch in ENTITIES:
            out = F.replace(out, F.lit(ent), F.lit(ch))
        return F.when(F.contains(t, F.lit("&")), out).otherwise(t)
    return _let(_c(c), decode)


_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)\b")
_ID_OR_CLASS = re.compile(r"\b(?:id|class)\s*=\s*[\"']?([^\"'>]*)", re.I)
_COMMENTS = re.compile(r"(?<![\w-])(?:" + "|".join(COMMENT_NAMES) + r")(?![\w-])", re.I)


def _tokens(html: str):
    """(markup or text, tag name or nothing) in order, without comments, in one pass whatever is left open.

    A ``<`` that no ``>`` follows is text; it stands as an entity, which no tag pattern can begin at.
    """
    i, comments = 0, True
    while i < len(html):
        at = html.find("<", i)
        if at != i:
            yield html[i:at if at > 0 else len(html)], ""
            if at < 0:
                return
        if comments and html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            if end >= 0:
                i = end + 3
                continue
            comments = False  # no comment ends from here on
        end = html.find(">", at + 1)
        if end < 0:
            yield html[at:].replace("<", "&lt;"), ""
            return
        i = end + 1
        tag = html[at:i]
        if not tag.startswith("<!--"):
            name = _NAME.match(tag)
            yield tag, name[1].lower() if name else ""


def _ends(tokens: list) -> dict[int, int]:
    """Where each element that is closed ends, by the nesting of its name; an element of raw content ends at its next end tag."""
    open_: dict[str, list[int]] = {}
    ends = {}
    for i, (tok, name) in enumerate(tokens):
        if not name:
            continue
        mine = open_.setdefault(name, [])
        if not tok.startswith("</"):
            if not tok.endswith("/>"):
                mine.append(i)
        elif name in RAW_TAGS:
            ends.update((k, i) for k in mine)
            mine.clear()
        elif mine:
            ends[mine.pop()] = i
    return ends


def _is_comments(tok: str) -> bool:
    return any(_COMMENTS.search(m[1]) for m in _ID_OR_CLASS.finditer(tok))


def _region(html: str | None, drop: frozenset, comments: bool) -> str | None:
    """The markup of every ``article`` (else of ``body``, else all) without the elements to drop.

    Elements end where their nesting says; one that is never closed is left
    in place, tag only. Work is in proportion to the page.
    """
    if html is None:
        return None
    tokens = list(_tokens(html))
    ends = _ends(tokens)
    kept = [tok for tok, _ in tokens]
    last_link = max((i for i, (tok, name) in enumerate(tokens) if name == "a" and tok.startswith("</")), default=-1)
    i = 0
    while i < len(tokens):
        tok, name = tokens[i]
        if i in ends and (name in drop or comments and name in COMMENT_TAGS and _is_comments(tok)):
            kept[i:ends[i] + 1] = [""] * (ends[i] + 1 - i)
            i = ends[i]
        elif name == "a" and i > last_link:
            kept[i] = ""  # a link without an end is no link
        i += 1

    def extents(name: str) -> list[str]:
        found, i = [], 0
        while i < len(tokens):
            if tokens[i][1] == name and kept[i] and i in ends:
                found.append("".join(kept[i + 1:ends[i]]))
                i = ends[i]
            i += 1
        return found

    return "\n".join(extents("article") or extents("body") or ["".join(kept)])


SLICE = 64  # texts that are Python strings at once


def _each(texts: pa.Array, f: Callable[[str | None], str | None]) -> pa.Array:
    """``f`` of every text, a few of them as Python strings at a time."""
    parts = [pa.array([f(t) for t in texts.slice(k, SLICE).to_pylist()], pa.string()) for k in range(0, len(texts), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


@F.arrow_udf(StringType())
def text_region(html: pa.Array) -> pa.Array:
    """The article's markup without noise elements, tables and users' comments."""
    drop = frozenset([*NOISE_TAGS, "table"])
    return _each(html, lambda h: _region(h, drop, True))


@F.arrow_udf(StringType())
def evidence_region(html: pa.Array) -> pa.Array:
    """H5: the article's markup without noise elements; tables and comments stay."""
    drop = frozenset(NOISE_TAGS)
    return _each(html, lambda h: _region(h, drop, False))


def html_blocks(html) -> Column:
    """H1b + H1d: ``array<string>`` of trimmed, non-empty text blocks of the main region."""
    flat = F.regexp_replace(F.regexp_replace(text_region(_c(html)), BLOCK_RE, "\n"), TAG_RE, "")
    flat = decode_entities(flat)
    parts = F.transform(F.split(flat, "\n"), lambda b: F.btrim(b, F.lit(EDGE_WS)))
    return F.filter(parts, lambda b: b != F.lit(""))


def join_blocks(blocks) -> Column:
    return F.array_join(_c(blocks), "\n")


def length_gate(text, n: int = 50) -> Column:
    """H2: null when the text, stripped, is shorter than ``n`` characters."""
    return _let(_c(text), lambda t: F.when(F.length(F.btrim(t, F.lit(UNICODE_EDGE_WS))) >= n, t))


@F.arrow_udf(StringType())
def nfkc(s: pa.Array) -> pa.Array:
    """Unicode NFKC in Arrow batches; ASCII text is returned as it is."""
    if pc.all(pc.string_is_ascii(s)).as_py() is not False:
        return s
    return _each(s, lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def collapse_ws(text) -> Column:
    """Python's ``" ".join(s.split())``: Unicode whitespace runs -> one space, ends stripped."""
    return F.trim(F.regexp_replace(_c(text), UNICODE_WS_RE, " "))


def normalise_text(text, use_nfkc: bool = True) -> Column:
    """H3: NFKC then whitespace collapse."""
    t = _c(text)
    return collapse_ws(nfkc(t) if use_nfkc else t)


def content_digest(text) -> Column:
    """H4: SHA-1 of the UTF-8 bytes, upper-case hex; null stays null."""
    return F.upper(F.sha1(_c(text).cast("binary")))


def extract_main_text(html, min_chars: int = 50, use_nfkc: bool = True) -> Column:
    """H1 (row form, no cross-page boilerplate) + H2 + H3: normalised main text or null."""
    return normalise_text(length_gate(join_blocks(html_blocks(html)), min_chars), use_nfkc)


# ------------------------------------------------------------ evidence (H5/H6)
def evidence_markdown(html, min_chars: int = 50) -> Column:
    """H5: Markdown rendering of the main region keeping headings, links, lists, emphasis, table rows."""
    t = evidence_region(_c(html))
    t = F.regexp_replace(t, r"(?i)<h1\b[^>]*>", "\n# ")
    t = F.regexp_replace(t, r"(?i)<h2\b[^>]*>", "\n## ")
    t = F.regexp_replace(t, r"(?i)<h3\b[^>]*>", "\n### ")
    t = F.regexp_replace(t, r"(?i)<h[4-6]\b[^>]*>", "\n#### ")
    t = F.regexp_replace(t, r"(?is)<a\b[^>]*?href=\"([^\"]*)\"[^>]*>(.*?)</a\s*>", "[$2]($1)")
    t = F.regexp_replace(t, r"(?i)<li\b[^>]*>", "\n- ")
    t = F.regexp_replace(t, r"(?i)</?(b|strong)\s*>", "**")
    t = F.regexp_replace(t, r"(?i)</?(i|em)\s*>", "*")
    t = F.regexp_replace(t, r"(?i)</t[dh]\s*>", " | ")
    t = F.regexp_replace(t, r"(?i)<t[dh]\b[^>]*>", "")  # a table row is one line
    t = F.regexp_replace(t, BLOCK_RE, "\n")
    t = decode_entities(F.regexp_replace(t, TAG_RE, ""))
    lines = F.transform(F.split(t, "\n"), lambda b: F.btrim(b, F.lit(EDGE_WS)))
    md = F.array_join(F.filter(lines, lambda b: b != F.lit("")), "\n")
    return _let(md, lambda m: F.when(F.length(m) >= min_chars, m))


def evidence_text(html, min_chars: int = 50) -> Column:
    """H6: Markdown evidence, else plain main text, else null."""
    return F.coalesce(evidence_markdown(html, min_chars), extract_main_text(html, min_chars))


# ----------------------------------------------------------- articles
def _unmarked(pattern: str, marks: list[str]) -> Callable[[Column], Column]:
    """What ``pattern`` keeps of its matches; a text with none of its ``marks`` is not searched."""
    def body(t: Column) -> Column:
        has = reduce(or_, [F.contains(t, F.lit(m)) for m in marks])
        return F.when(has, F.regexp_replace(t, pattern, "$1")).otherwise(t)
    return body


def markdown_to_plain(md) -> Column:
    """H7: strip heading marks, links, code ticks, emphasis; collapse whitespace; null/empty -> ''."""
    t = F.coalesce(_c(md), F.lit(""))
    t = F.regexp_replace(t, MD_HEADING_RE, "")
    for kept, marks in ((MD_LINK_RE, ["]("]), (MD_CODE_RE, ["`"]), (MD_EMPHASIS_RE, ["*", "_"])):
        t = _let(t, _unmarked(kept, marks))
    return collapse_ws(t)


def snippet(text, n: int = 300) -> Column:
    """H8: first ``n`` chars; when longer, cut back to the last space and add an ellipsis."""
    def cut(t):
        head = F.substring(t, 1, n)
        return F.when(F.length(t) > n, F.concat(F.regexp_replace(head, r" [^ ]*\z", ""), F.lit(ELLIPSIS))).otherwise(head)
    return _let(F.coalesce(_c(text), F.lit("")), cut)


def topic_description(keywords, snippet_en) -> Column:
    """H9: ``Keywords: k1, ..k6 | Example: <snippet 180>``; neither -> outlier text."""
    kw = _c(keywords)
    ex = F.coalesce(_c(snippet_en), F.lit(""))
    parts = F.concat_ws(
        " | ",
        F.when(F.size(kw) > 0, F.concat(F.lit(KEYWORDS_LEAD), F.array_join(F.slice(kw, 1, 6), ", "))),
        F.when(ex != "", F.concat(F.lit(EXAMPLE_LEAD), snippet(ex, 180))),
    )
    return F.when(parts == "", F.lit(OUTLIER_TEXT)).otherwise(parts)


def preview(text_en, text_src, n: int = 200) -> Column:
    """First ``n`` chars of the translation (or the source text), newlines -> spaces."""
    t = F.coalesce(F.nullif(_c(text_en), F.lit("")), _c(text_src), F.lit(""))
    return F.translate(F.substring(t, 1, n), "\n", " ")
