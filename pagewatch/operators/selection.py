"""Selection: URL lines (A1), resume anti-join (D1), exact sample (F2), target limit.

Sampling and the target limit need an *exact* number of rows in a repeatable
order: ``smallest_hex`` for ranks that are hashes, ``exact_top_n`` for any key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import UNICODE_EDGE_WS

_CHUNK = 10_000


def clean_url_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """A1: strip every line of any Unicode whitespace, drop blanks, keep duplicates."""
    url = F.btrim(F.col(col), F.lit(UNICODE_EDGE_WS))
    return lines.select(url.alias("url")).filter(F.col("url") != "")


def drop_checked(urls: DataFrame, checked: DataFrame | None, resume: bool = True,
                 url_col: str = "url") -> DataFrame:
    """The URL list minus the ledger, keeping duplicates of the rest.

    A left-anti join, not EXCEPT (which would dedupe). Spark broadcasts the
    ledger when its runtime size is small (AQE) and shuffles otherwise.
    """
    if not resume or checked is None:
        return urls
    ledger = checked.select(F.col(url_col).alias("_ck")).dropDuplicates(["_ck"])
    return urls.join(ledger, urls[url_col] == ledger["_ck"], "left_anti")


def with_occurrence(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Number the copies of each URL 1..k without a window over the URL.

    Copies are counted with a map-side-combined aggregate, then re-expanded in
    chunks of 10,000 spread over tasks, so a URL holding a third of all rows is
    still split across the cluster.
    """
    counts = urls.groupBy(F.col(url_col).alias("url")).agg(F.count(F.lit(1)).alias("_k"))
    chunks = counts.select("url", "_k", F.explode(F.sequence(F.lit(0), F.floor((F.col("_k") - 1) / _CHUNK)))
                           .alias("_chunk"))
    chunks = chunks.repartition("url", "_chunk")
    lo = F.col("_chunk") * _CHUNK + 1
    hi = F.least((F.col("_chunk") + 1) * _CHUNK, F.col("_k"))
    return chunks.select("url", F.explode(F.sequence(lo, hi)).alias("occ"))


def sample_key(seed: str, url_col: str = "url", occ_col: str = "occ", occ: Column | None = None) -> Column:
    """Repeatable uniform order: md5 of seed, URL and copy number (same in DuckDB)."""
    n = occ if occ is not None else F.col(occ_col)
    return F.md5(F.concat(F.lit(str(seed)), F.col(url_col), F.lit("#"), n.cast("string")))


def exact_top_n(df: DataFrame, key: str, n: int, ties=()) -> DataFrame:
    """Exactly the ``n`` rows smallest by ``key`` (then ``ties``), for any ``n`` and any key type.

    Rows are range-partitioned on the key and ranked by their partition's
    offset, so no task holds more than its range.
    """
    from .clustering import dense_rank_ids
    return dense_rank_ids(df, [key, *ties], "_rank").filter(F.col("_rank") < n).drop("_rank")


def smallest_hex(df: DataFrame, key: str, n: int, ties=()) -> DataFrame:
    """Exactly the ``n`` rows smallest by a hexadecimal ``key`` (then ``ties``); all rows if there are not more.

    A histogram of the key's first four digits (65,536 rows at most) tells where the n-th row lies: rows before that
    bucket are taken as they are, only the bucket itself is sorted, and nothing is written. ``df`` is computed twice.
    """
    prefix = F.substring(key, 1, 4)
    left = n
    for p, size in sorted((r["p"], r["n"]) for r in df.groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()):
        if size >= left:
            return df.filter(prefix < p).unionByName(df.filter(prefix == p).orderBy(key, *ties).limit(left))
        left -= size
    return df


def sample_urls(urls: DataFrame, limit: int | None, seed: str = "0", url_col: str = "url") -> DataFrame:
    """uniform sample without replacement of exactly ``limit`` list entries.

    Only when ``0 < limit < count``; otherwise every entry. Duplicates are
    separate entries (drawn independently). Output: ``url, occ, sample_rank``
    where ``sample_rank`` is the repeatable order key used later by F3.
    """
    occ = with_occurrence(urls, url_col).withColumn("sample_rank", sample_key(seed))
    if not limit or limit <= 0:
        return occ
    return smallest_hex(occ, "sample_rank", limit, ties=("url", "occ"))


def limit_findings(findings: DataFrame, target: int | None, rank_col: str = "sample_rank",
                   tie_col: str = "url") -> DataFrame:
    """stop at ``target`` findings, in the deterministic sample order."""
    if not target or target <= 0:
        return findings
    return smallest_hex(findings, rank_col, target, ties=(tie_col,))
