"""DuckDB twins of the registered queries (the correctness gate's oracle side).

Each twin recomputes, from the same parquet views, what the Spark query
computes: the fixture derivations of ``pagewatch.fixtures`` and the text
rules of ``pagewatch.functions`` are restated here in DuckDB SQL, fixed values
included. The page rules are those for flat pages: queries whose pages Spark
decorates (nested menus, tables, comments, a second article) are compared with
flat pages that should give the same text; regexes are RE2 (no ``(?U)``: in RE2 it
means "ungreedy"), so Unicode whitespace is spelled out.
"""

from __future__ import annotations

# Fixed values, stated here again so that a slip on the Spark side shows.
ARCHIVE_PREFIX = "https://web.archive.org/web/"
NOISE_TAGS = ["script", "style", "nav", "footer", "noscript", "template", "iframe", "svg", "form", "aside"]
BLOCK_TAGS = ["p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "br", "tr", "td", "th", "table",
              "section", "blockquote", "pre", "article", "header", "main", "dd", "dt", "figcaption", "hr"]
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", chr(160)),
            ("&middot;", chr(183)), ("&copy;", chr(169)), ("&reg;", chr(174)), ("&mdash;", chr(8212)),
            ("&ndash;", chr(8211)), ("&hellip;", chr(8230)), ("&amp;", "&")]

NL = "chr(10)"
# Java (?U)\s plus Python's extra \x1c-\x1f, spelled out for RE2.
UWS = r"[\s\x0B\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def rr(expr: str, pattern: str, repl: str, first_only: bool = False) -> str:
    flags = "" if first_only else ", 'g'"
    return f"regexp_replace({expr}, {q(pattern)}, {q(repl)}{flags})"


def decode_entities(expr: str) -> str:
    out = expr
    for ent, ch in ENTITIES:
        out = f"replace({out}, {q(ent)}, {q(ch)})"
    return out


def strip_noise(expr: str) -> str:
    out = rr(expr, r"(?s)<!--.*?-->", "")
    for tag in NOISE_TAGS:
        out = rr(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    return out


def main_region(expr: str) -> str:
    art = r"(?is)<article\b[^>]*>(.*)</article\s*>"
    body = r"(?is)<body\b[^>]*>(.*)</body\s*>"
    return (f"(CASE WHEN regexp_matches({expr}, {q(art)}) THEN regexp_extract({expr}, {q(art)}, 1) "
            f"WHEN regexp_matches({expr}, {q(body)}) THEN regexp_extract({expr}, {q(body)}, 1) ELSE {expr} END)")


BLOCK_RE = r"(?i)</?(" + "|".join(BLOCK_TAGS) + r")\b[^>]*>"
EDGE = r"^[\s\x0B]+|[\s\x0B]+\z"


def lines_joined(expr: str) -> str:
    parts = f"list_transform(string_split({expr}, {NL}), lambda b: {rr('b', EDGE, '')})"
    return f"array_to_string(list_filter({parts}, lambda b: b <> ''), {NL})"


def html_text(expr: str) -> str:
    """H1a-H1d: noise cut, main region, blocks, tags, entities, trimmed non-empty lines."""
    region = main_region(strip_noise(expr))
    flat = decode_entities(rr(rr(region, BLOCK_RE, "\n"), r"<[^>]*>", ""))
    return lines_joined(flat)


def length_gate(expr: str, n: int = 50) -> str:
    edge = "^" + UWS + "+|" + UWS + r"+\z"
    return f"(CASE WHEN length({rr(expr, edge, '')}) >= {n} THEN {expr} END)"


def collapse_ws(expr: str) -> str:
    return rr(rr(expr, UWS + "+", " "), r"^ | \z", "")


def extract_main_text(expr: str, n: int = 50) -> str:
    """H1 + H2 + H3 (NFKC is the identity on the fixture alphabet; unit-tested apart)."""
    return collapse_ws(length_gate(html_text(expr), n))


def digest(expr: str) -> str:
    return f"upper(sha1({expr}))"


def page_digest(expr: str, content_only: bool = True) -> str:
    return digest(extract_main_text(expr)) if content_only else digest(expr)


def evidence_markdown(expr: str, n: int = 50) -> str:
    t = main_region(strip_noise(expr))
    t = rr(t, r"(?i)<h1\b[^>]*>", "\n# ")
    t = rr(t, r"(?i)<h2\b[^>]*>", "\n## ")
    t = rr(t, r"(?i)<h3\b[^>]*>", "\n### ")
    t = rr(t, r"(?i)<h[4-6]\b[^>]*>", "\n#### ")
    t = rr(t, r"(?is)<a\b[^>]*?href=\"([^\"]*)\"[^>]*>(.*?)</a\s*>", r"[\2](\1)")
    t = rr(t, r"(?i)<li\b[^>]*>", "\n- ")
    t = rr(t, r"(?i)</?(b|strong)\s*>", "**")
    t = rr(t, r"(?i)</?(i|em)\s*>", "*")
    t = rr(t, r"(?i)</t[dh]\s*>", " | ")
    t = rr(t, BLOCK_RE, "\n")
    t = decode_entities(rr(t, r"<[^>]*>", ""))
    md = lines_joined(t)
    return f"(CASE WHEN length({md}) >= {n} THEN {md} END)"


def evidence_text(expr: str) -> str:
    return f"coalesce({evidence_markdown(expr)}, {extract_main_text(expr)})"


def markdown_to_plain(expr: str) -> str:
    t = f"coalesce({expr}, '')"
    t = rr(t, r"(?m)^#+" + UWS + "*", "")
    t = rr(t, r"\[([^\]]+)\]\([^)]+\)", r"\1")
    t = rr(t, r"`([^`]+)`", r"\1")
    t = rr(t, r"[*_]{1,2}([^*_]+)[*_]{1,2}", r"\1")
    return collapse_ws(t)


def snippet(expr: str, n: int = 300) -> str:
    t = f"coalesce({expr}, '')"
    return (f"(CASE WHEN length({t}) > {n} THEN {rr(f'substring({t}, 1, {n})', r' [^ ]*\z', '')} || '…' "
            f"ELSE substring({t}, 1, {n}) END)")


def s(expr: str) -> str:
    return f"cast({expr} AS VARCHAR)"


def archive_url(ts14: str, original: str) -> str:
    return f"({q(ARCHIVE_PREFIX)} || {ts14} || '/' || {original})"


# ------------------------------------------------------------ fixture CTEs
PAGE_CAPTURES = f"""
SELECT page_id, url AS original,
  '2023' || lpad({s('page_id % 12 + 1')}, 2, '0')
         || lpad({s('CASE WHEN page_id % 7 = 3 AND i = 1 THEN 1 ELSE i * 7 + 1 END')}, 2, '0')
         || lpad({s('page_id % 24')}, 2, '0') || '0000' AS ts14,
  CASE WHEN page_id % 13 = 0 THEN '302'
       WHEN i = n - 1 AND page_id % 2 = 0 THEN '301'
       WHEN i = 0 AND page_id % 9 = 0 THEN '-'
       ELSE '200' END AS statuscode,
  upper(sha1(url || '#' || {s('i')})) AS digest,
  cast(i AS BIGINT) AS pos
FROM (SELECT page_id, url, n, unnest(range(0, n)) AS i
      FROM (SELECT page_id, url, page_id % 4 + 1 AS n FROM pages WHERE page_id % 17 <> 0))
"""

ARCHIVE_BODIES = f"""
SELECT c.original, c.ts14,
  CASE WHEN c.page_id % 19 = 0 THEN ''
       WHEN c.pos = 0 AND c.page_id % 4 <> 0 THEN replace(p.html, '</p>', ' (old)</p>')
       ELSE p.html END AS html
FROM ({PAGE_CAPTURES}) c JOIN pages p ON p.page_id = c.page_id
WHERE c.statuscode = '200' AND NOT (c.page_id % 7 = 3 AND c.pos = 1)
"""

LIVE = """
SELECT url, status_code, CASE WHEN status_code IS NOT NULL THEN html2 END AS html, fetched_at FROM (
SELECT url, '2024-01-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') || 'T12:00:00' AS fetched_at,
  CASE WHEN page_id % 23 = 0 THEN NULL WHEN page_id % 5 = 0 THEN 404 WHEN page_id % 11 = 0 THEN 500
       WHEN page_id % 29 = 0 THEN 410 ELSE 200 END AS status_code,
  CASE WHEN page_id % 3 = 0 THEN replace(html, '</p>', ' (upd)</p>')
       WHEN page_id % 3 = 1 THEN replace(html, '<footer>', '<footer>Ad ')
       ELSE html END AS html2
FROM pages)
"""

# With the older observations that every sixth page has besides.
LIVE_ALL = f"""{LIVE}
UNION ALL SELECT url, CASE WHEN page_id % 12 = 0 THEN 200 ELSE 404 END, CASE WHEN page_id % 12 = 0 THEN html ELSE '<p>gone</p>' END, '2024-01-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') || 'T06:00:00'
FROM pages WHERE page_id % 6 = 0"""

URL_LIST = "SELECT url FROM pages UNION ALL SELECT url FROM pages WHERE page_id % 10 = 0"
CHECKED = ("SELECT url FROM pages WHERE page_id % 8 = 0 "
           "UNION ALL SELECT url FROM pages WHERE page_id % 8 = 0 AND page_id % 16 = 0")

EVENT_CAPTURES = """
SELECT 'https://site' || cast(user_id % 7 AS VARCHAR) || '.example/a/' || cast(user_id AS VARCHAR) AS original,
  strftime(ts + to_months(cast(event_id % 24 AS INTEGER)), '%Y%m%d%H%M%S') AS ts14,
  CASE event_type WHEN 'error' THEN '404' WHEN 'signup' THEN '301' ELSE '200' END AS statuscode,
  upper(sha1(props)) AS digest, event_id AS pos
FROM events
"""


def html_blocks_list(expr: str) -> str:
    """List twin of ``functions.text.html_blocks``."""
    region = main_region(strip_noise(expr))
    flat = decode_entities(rr(rr(region, BLOCK_RE, "\n"), r"<[^>]*>", ""))
    parts = f"list_transform(string_split({flat}, {NL}), lambda b: {rr('b', EDGE, '')})"
    return f"list_filter({parts}, lambda b: b <> '')"


HOST = "lower(regexp_extract({0}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1))"


def corpus_text_sql(pages: str, key: str = "page_id", url: str = "url", html: str = "html",
                    min_pages: int = 3, share: float = 0.5, page: str | None = None) -> str:
    """Twin of ``operators.content.extract_main_text`` over a pages relation
    (``page``: the column that counts as one page, default the key)."""
    pg = page or key
    return f"""WITH b0 AS (SELECT {key} AS k, {pg} AS pg, {HOST.format(url)} AS host, {html_blocks_list(html)} AS bl FROM ({pages})),
b AS (SELECT k, pg, host, unnest(bl) AS block, generate_subscripts(bl, 1) AS block_pos FROM b0),
bh AS (SELECT *, sha1(block) AS block_hash FROM b),
pb AS (SELECT host, block_hash, count(DISTINCT pg) AS n_pages FROM bh GROUP BY host, block_hash),
ph AS (SELECT host, count(DISTINCT pg) AS host_pages FROM bh GROUP BY host),
bp AS (SELECT pb.host, pb.block_hash FROM pb JOIN ph ON ph.host = pb.host
       WHERE n_pages >= greatest({min_pages}, ceil(host_pages * {share}))),
kept AS (SELECT * FROM bh WHERE NOT EXISTS (SELECT 1 FROM bp WHERE bp.host = bh.host AND bp.block_hash = bh.block_hash)),
j AS (SELECT k, string_agg(block, chr(10) ORDER BY block_pos) AS raw FROM kept GROUP BY k),
t AS (SELECT p.{key} AS k, {collapse_ws(length_gate('j.raw'))} AS text FROM ({pages}) p LEFT JOIN j ON j.k = p.{key})
SELECT k AS {key}, text, upper(sha1(text)) AS digest FROM t"""
