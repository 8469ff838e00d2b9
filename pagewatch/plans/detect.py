"""G6 detect_changes: the flagship plan.

    URL list --D1 anti ledger--> F2 exact sample --> distinct work URLs
        --D3 semi-join--> captures --E2 packed max--> newest good capture
        --> bodies that may be winners (broadcast semi-join), digested where read
        --> live observations that may be work, digested where read, the newest kept
        --> G5 verdict / G7 outcome --> F3 target --> C9 metadata

Everything keyed by ``url``; only digests are shuffled, never HTML (a test
asserts it). With a target the work list is taken in growing batches of its
sample order until the target is met.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.selection import drop_checked, limit_findings, sample_key, sample_urls
from ..operators.verdicts import finding_metadata, observe, outcomes
from ..session import ensure_checkpoint_dir, store


def work_urls(urls: DataFrame, checked: DataFrame | None = None, limit: int | None = None,
              seed: str = "0", resume: bool = True) -> DataFrame:
    """D1 then F2, reduced to one row per URL with its best sample rank.

    Without a sample limit no copies need numbering: a URL's rank is the rank
    of its first copy, and the list is only deduplicated (one aggregate).
    """
    remaining = drop_checked(urls, checked, resume)
    if not limit or limit <= 0:
        return (remaining.select("url").distinct()
                .withColumn("sample_rank", sample_key(seed, occ=F.lit(1))))
    sampled = sample_urls(remaining, limit, seed)
    return sampled.groupBy("url").agg(F.min("sample_rank").alias("sample_rank"))


def detect_outcomes(urls: DataFrame, captures: DataFrame, bodies: DataFrame, live: DataFrame,
                    checked: DataFrame | None = None, limit: int | None = None, seed: str = "0",
                    content_only: bool = True, resume: bool = True, gone_codes=(404,),
                    boilerplate: dict | None = None) -> DataFrame:
    """Every remaining (sampled) URL with its outcome (G7) and verdict fields.

    ``boilerplate`` (e.g. ``{"min_pages": 3, "share": 0.5}``) turns on H1c:
    blocks repeated across a host's pages are removed before digesting.
    """
    work = work_urls(urls, checked, limit, seed, resume)
    return outcomes(observe(work, captures, bodies, live, content_only, boilerplate), content_only, gone_codes)


def detect_changes(urls: DataFrame, captures: DataFrame, bodies: DataFrame, live: DataFrame,
                   checked: DataFrame | None = None, limit: int | None = None, seed: str = "0",
                   target: int | None = None, content_only: bool = True, resume: bool = True,
                   output_dir: str = "saved_articles", gone_codes=(404,),
                   boilerplate: dict | None = None) -> DataFrame:
    """Findings (``deleted`` / ``changed``) as flat metadata rows (M8)."""
    work = work_urls(urls, checked, limit, seed, resume)
    if target and target > 0:
        found = find_until(work, captures, bodies, live, target, content_only, gone_codes, boilerplate)
    else:
        outs = outcomes(observe(work, captures, bodies, live, content_only, boilerplate), content_only, gone_codes)
        found = outs.filter(F.col("verdict").isNotNull())
    return finding_metadata(found, content_only, output_dir)


FIRST_BATCH = 1000  # URLs of the first batch at least
PER_FINDING = 4     # and for each finding wanted


def find_until(work: DataFrame, captures: DataFrame, bodies: DataFrame, live: DataFrame, target: int,
               content_only: bool = True, gone_codes=(404,), boilerplate: dict | None = None, first_batch: int = FIRST_BATCH) -> DataFrame:
    """the first ``target`` findings in sample order; the rest of the work list is not looked at.

    The work list is written in rank order, so a batch reads its range of ranks only (``sample_rank`` is uniform hex).
    Batches grow by the findings met so far: mostly one or two are enough, and no page is parsed in more than one. A
    batch's findings are written before the next begins. What is boilerplate depends on all pages of a host: with
    ``boilerplate`` the whole work list is one batch, so verdicts do not depend on the target.
    """
    ensure_checkpoint_dir(work.sparkSession)
    work = store(work.repartitionByRange("sample_rank").sortWithinPartitions("sample_rank"), "ranked_work")
    n = work.count()
    size = n if boilerplate is not None else max(first_batch, PER_FINDING * target)
    found, met, done = None, 0, 0
    while True:
        end = min(done + size, n)
        part = work if end - done == n else work.filter(F.col("sample_rank") >= _rank(done, n))
        part = part if end == n else part.filter(F.col("sample_rank") < _rank(end, n))
        outs = outcomes(observe(part, captures, bodies, live, content_only, boilerplate), content_only, gone_codes)
        got = store(outs.filter(F.col("verdict").isNotNull()), "found")
        found = got if found is None else found.unionByName(got)
        met += got.count()
        done = end
        if met >= target or done >= n:
            return limit_findings(found, target)
        size = max(done, int(1.5 * (target - met) * done / max(met, 1)))


def _rank(k: int, n: int) -> str:
    """The rank below which about ``k`` of ``n`` uniform ranks lie."""
    return f"{(k << 64) // max(n, 1):016x}"
