"""Column functions for URLs, keys and verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The archive's capture URL layout and the raw-content marker.
ARCHIVE_PREFIX = "https://web.archive.org/web/"
RAW_MARKER = "id_"
CONTENT_ONLY = "content-only"
FULL_PAGE = "full-page"


def _c(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def canonical_key(url) -> Column:
    """Lower-case URL without scheme and ``www``/``wwwN`` prefix (the archive's match key)."""
    return F.regexp_replace(F.lower(_c(url)), r"^https?://(www\d*\.)?", "")


def url_host(url) -> Column:
    """Host part of a URL, lower case (used to group pages for boilerplate)."""
    return F.lower(F.regexp_extract(_c(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1))


def archive_url(ts14, original) -> Column:
    """Capture URL from the capture's own timestamp and original URL."""
    return F.concat(F.lit(ARCHIVE_PREFIX), _c(ts14), F.lit("/"), _c(original))


def raw_archive_url(url) -> Column:
    """Insert ``id_`` after the first ``/web/<14 digits>`` only."""
    return F.regexp_replace(_c(url), r"^(.*?/web/\d{14})/", "$1" + RAW_MARKER + "/")


def finding_key(verdict, ts14, url, n: int = 80) -> Column:
    """``{verdict}_{ts14}_{url, non-alphanumerics -> _, first n chars}_{sha1(url)}``.

    The readable part is cut for the sake of file systems; the digest of the
    whole URL keeps two long URLs apart.
    """
    safe = F.substring(F.regexp_replace(_c(url), r"[^a-zA-Z0-9]", "_"), 1, n)
    return F.concat_ws("_", _c(verdict), _c(ts14), safe, F.sha1(_c(url).cast("binary")))


def mode_label(content_only: bool) -> Column:
    """The comparison-mode label."""
    return F.lit(CONTENT_ONLY if content_only else FULL_PAGE)


def classify_verdict(code, live_digest, archive_digest, has_body=None, gone_codes=(404,)) -> Column:
    """``deleted`` iff live code is a gone code (404 only by default) and the
    archive body is non-empty; ``changed`` iff live 200 and both digests are
    non-null and differ; else null."""
    code = _c(code)
    body_ok = F.lit(True) if has_body is None else _c(has_body)
    gone = code.isin(list(gone_codes))
    changed = (code == 200) & _c(live_digest).isNotNull() & _c(archive_digest).isNotNull() & \
        (_c(live_digest) != _c(archive_digest))
    return F.when(gone & body_ok, F.lit("deleted")).when(changed & body_ok, F.lit("changed"))
