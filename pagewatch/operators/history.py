"""What the digests of captures and live pages tell beside verdicts: change points of a URL's history, suspected soft 404s."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import url_host
from ..session import store
from .captures import status_filter
from .joins import hot_join
from .verdicts import newest_live, normalise_live


def capture_change_points(captures: DataFrame, code: str | None = "200") -> DataFrame:
    """(original, ts14, pos, digest, previous_digest, previous_ts14) of every capture whose digest is not that of the one before.

    A URL's captures stand by ts14, pos and digest (nulls first); its first capture is no change, a null digest equals a
    null digest. ``code``: only captures of that status (None: all). Histories are cut into ranges by URL and place, so a
    URL with half of all captures is spread over many tasks; the last capture of each range (one row a range) is carried
    to the next, where it comes before the first capture of its URL.
    """
    order = ["original", "ts14", "pos", "digest"]
    caps = (status_filter(captures, code) if code is not None else captures).select(*order)
    ranged = store(caps.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "capture_ranges")
    last = ranged.groupBy("_range").agg(F.max(F.struct(*order)).alias("_last"))
    before = last.select("_range", F.lag("_last").over(Window.orderBy("_range")).alias("_edge"))  # a row a range
    inside = Window.partitionBy("_range", "original").orderBy("ts14", "pos", "digest")
    rows = ranged.withColumn("_prev", F.lag(F.struct(*order)).over(inside)).join(F.broadcast(before), "_range")
    carried = F.when(F.col("_edge.original").eqNullSafe(F.col("original")), F.col("_edge"))
    rows = rows.withColumn("_prev", F.coalesce("_prev", carried))
    changed = F.col("_prev").isNotNull() & ~F.col("digest").eqNullSafe(F.col("_prev.digest"))
    return rows.filter(changed).select(*order, F.col("_prev.digest").alias("previous_digest"), F.col("_prev.ts14").alias("previous_ts14"))


def soft404_suspects(live: DataFrame, min_urls: int = 3, share: float = 0.2, content_only: bool = True) -> DataFrame:
    """(host, digest, n_urls, host_urls, example_url): pages that too many URLs of a host show for them to be articles.

    The newest observation of each URL counts, if it is a 200 with a text. A digest is suspected from
    max(min_urls, share of the host's such URLs) on. Pages are digested where they are read; counts combine map-side, so a
    host with a third of all URLs costs its digests, and its total goes back to them without a hot task.
    """
    newest = newest_live(normalise_live(live, content_only)).filter("live_digest IS NOT NULL")
    per = store(newest.groupBy(url_host("url").alias("host"), F.col("live_digest").alias("digest"))
                .agg(F.count("*").alias("n_urls"), F.min("url").alias("example_url")), "host_digests")
    hosts = per.groupBy("host").agg(F.sum("n_urls").alias("host_urls"), F.count("*").alias("_n"))
    rows = hot_join(per, hosts, ["host"], "_n", per.count())
    return rows.filter(F.col("n_urls") >= F.greatest(F.lit(min_urls), F.ceil(F.col("host_urls") * F.lit(share)))).select(
        "host", "digest", "n_urls", "host_urls", "example_url")
