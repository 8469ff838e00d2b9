"""H1 as a corpus job: main text with cross-page boilerplate removal (H1a-H1d).

A block (paragraph, list item, heading...) that appears on many pages of the
same host is layout, not article: menus, cookie notes, bylines. Per host the
job counts on how many distinct pages each block occurs and drops blocks at
or above ``max(min_pages, share * pages_of_host)``.

    pages --posexplode(blocks)--> (host, page, pos, block_hash)
          --distinct + count by (host, block_hash)--> boilerplate
          --left_anti--> kept blocks --ordered regroup per page--> text

Both aggregates combine map-side, so a host holding a third of all pages is
spread over its many (host, block) keys; the boilerplate table is small and
joined back by hash or broadcast as AQE sees fit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.urls import url_host
from ..session import ensure_checkpoint_dir, spread, store


def page_blocks(pages: DataFrame, key: str = "page_id", url_col: str = "url", html_col: str = "html",
                extra=()) -> DataFrame:
    """H1a/H1b/H1d: one row per text block: (key, host, block_pos, block, block_hash)."""
    p = spread(pages).select(F.col(key), *extra, url_host(F.col(url_col)).alias("host"),
                             F.posexplode(T.html_blocks(F.col(html_col))).alias("block_pos", "block"))
    return p.withColumn("block_hash", F.sha1(F.col("block")))


def boilerplate_blocks(blocks: DataFrame, min_pages: int = 3, share: float = 0.5, key: str = "page_id",
                       page_col: str | None = None) -> DataFrame:
    """(host, block_hash) pairs found on at least max(min_pages, share * host pages) pages.

    ``page_col`` names what counts as one page (default ``key``): when a corpus
    holds two versions of a URL, a block present in both still counts once.
    """
    page = page_col or key
    per_block = (blocks.select("host", page, "block_hash").distinct()
                 .groupBy("host", "block_hash").agg(F.count(F.lit(1)).alias("n_pages")))
    per_host = blocks.select("host", page).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    limit = F.greatest(F.lit(min_pages), F.ceil(F.col("host_pages") * F.lit(share)))
    return (per_block.join(per_host, "host")
            .filter(F.col("n_pages") >= limit)
            .select("host", "block_hash", "n_pages", "host_pages"))


def extract_main_text(pages: DataFrame, key: str = "page_id", url_col: str = "url", html_col: str = "html",
                      min_pages: int = 3, share: float = 0.5, min_chars: int = 50,
                      use_nfkc: bool = True, page_col: str | None = None, keep: DataFrame | None = None) -> DataFrame:
    """H1 (+ H2-H4): per page ``text`` (null if under ``min_chars``) and its ``digest``.

    ``key`` identifies a document of the corpus; ``page_col`` (default ``key``)
    what counts as one page for boilerplate frequency. ``keep`` (a table of
    distinct keys) leaves all other documents out once they are cut to blocks;
    equal documents of one key count once.
    """
    # Blocks feed three aggregates/joins: extract them once (reliable checkpoint
    # into the cluster's checkpoint folder), not once per consumer.
    ensure_checkpoint_dir(pages.sparkSession)
    blocks = page_blocks(pages, key, url_col, html_col, extra=[page_col] if page_col and page_col != key else [])
    ids = pages.select(key)
    if keep is not None:
        blocks, ids = blocks.join(keep, key, "left_semi"), keep.select(key)
    blocks = store(blocks, "blocks")
    bp = boilerplate_blocks(blocks, min_pages, share, key, page_col)
    kept = blocks.join(bp.select("host", "block_hash"), ["host", "block_hash"], "left_anti")
    joined = (kept.groupBy(key)
              .agg(F.array_join(F.transform(F.sort_array(F.collect_set(F.struct("block_pos", "block"))),
                                            lambda s: s["block"]), "\n").alias("_raw")))
    text = T.normalise_text(T.length_gate(F.col("_raw"), min_chars), use_nfkc)
    out = ids.join(joined, key, "left").select(key, text.alias("text"))
    return out.withColumn("digest", T.content_digest(F.col("text")))
