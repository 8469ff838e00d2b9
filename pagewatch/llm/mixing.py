"""Mixing sources to target weights by a time-varying curriculum (DataFrame operations only).

Each source has a weight and a schedule: how its share rises or falls while
training runs from position 0 to 1. The integral of the schedule is the
source's cumulative token demand; its inverse turns the word offset of each
document into a training position, and the mix is range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)          # dealt to the sources in code-point order, null last, repeating
SLOPES = (-0.5, 0.0, 0.5)    # schedule of each weight: 1 + slope * (2t - 1), so heavy sources come late
MAX_PASSES = 3               # no document is taken more often
BUCKETS = 4096               # hash ranges per source for the distributed running sum


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(src, source_size, weight, slope, target) from (src, source_size), one row per source.

    All sources together receive the total size; a target stops at MAX_PASSES
    times its source's size and the excess goes to the others by weight.
    With sources ordered by cap / weight the capped ones are a prefix, so the
    water level is found by running sums (the table has one row per source).
    """
    cycle = lambda values: F.element_at(F.array(*map(F.lit, values)), F.pmod(F.col("_r") - 1, F.lit(len(values))).cast("int") + 1)
    every = W.partitionBy()
    ranked = sizes.withColumn("_r", F.row_number().over(W.orderBy(F.col("src").asc_nulls_last())))
    ranked = ranked.select("src", "source_size", "_r", cycle(WEIGHTS).cast("double").alias("weight"),
                           cycle(SLOPES).cast("double").alias("slope"),
                           (F.col("source_size") * float(MAX_PASSES)).alias("cap"))
    order = W.orderBy(F.col("cap") / F.col("weight"), "_r")
    ranked = (ranked.withColumn("k", F.row_number().over(order))
              .withColumn("left", F.sum("source_size").over(every).cast("double")
                          - (F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("cap")))
              .withColumn("wsum", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))))
    open_ = F.col("left") * F.col("weight") <= F.col("cap") * F.col("wsum")
    level = F.min(F.when(open_, F.struct("k", "left", "wsum"))).over(every)
    return ranked.withColumn("level", level).select(
        "src", "source_size", "weight", "slope",
        F.when(F.col("level").isNull() | (F.col("k") < F.col("level.k")), F.col("cap"))
        .otherwise(F.col("level.left") * F.col("weight") / F.col("level.wsum")).alias("target"))


def demand_inverse(x: Column, slope: Column) -> Column:
    """t with G(t) = x for G(t) = (1 - slope) t + slope t^2, the integral of 1 + slope (2t - 1)."""
    base = F.lit(1.0) - slope
    return F.lit(2.0) * x / (base + F.sqrt(base * base + F.lit(4.0) * slope * x))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Each row of ``docs`` with what the mix takes of it, in struct ``row``.

    Result: row (all columns of ``docs``, whatever their names), size,
    source_size, weight, slope, target, start (the document's word offset in
    its source's order), wanted (whole words of the target), taken.

    A source's documents stand in the order of md5(id); the source is read
    from the start again and again until its target is reached, so all but one
    document are taken a whole number of times. Offsets are running sums
    within hash ranges plus the ranges' own running sums: a source of any size
    is spread over BUCKETS groups. Null text: size 0, taken 0. Null source: a
    source of its own. Null id: stands at the start of its source. Repeated rows are
    separate documents; ties of the hash order stand by id and size.
    An empty table gives an empty result. Reruns agree.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.col(f"row.`{source_col}`").alias("src"), F.col(f"row.`{id_col}`").alias("id"),
                       word_count(f"row.`{text_col}`").alias("size"))
    rows = rows.withColumn("h", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")))
    rows = rows.withColumn("h", F.when(F.col("id").isNull(), "").otherwise(F.col("h")))
    rows = rows.withColumn("bucket", F.coalesce(F.conv(F.substring("h", 1, 3), 16, 10).cast("int") * BUCKETS / 4096,
                                                F.lit(0)).cast("int"))
    # A key that is never null, so that the join and the running sum share one shuffle of the rows.
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("src").cast("string")), F.lit("")))
    by_bucket = rows.groupBy("src", "bucket", "key").agg(F.sum("size").alias("words"))
    before = W.partitionBy("src").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = by_bucket.withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0)))
    targets = source_targets(by_bucket.groupBy("src").agg(F.sum("words").alias("source_size")))
    # One row per source and hash range, with all that the documents of the range need.
    ranges = offsets.join(targets, offsets["src"].eqNullSafe(targets["src"])).select(
        "key", "bucket", "offset", "source_size", "weight", "slope", "target")
    inside = W.partitionBy("key", "bucket").orderBy("h", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.join(ranges, ["key", "bucket"])
    placed = placed.withColumn("start", F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.withColumn("wanted", F.floor(F.col("target") + 0.5).cast("long"))
    zero = F.lit(0).cast("long")
    taken = sum((F.least(F.greatest(F.col("wanted") - F.col("source_size") * p - F.col("start"), zero), F.col("size"))
                 for p in range(MAX_PASSES)), zero)
    return placed.select("row", "id", "size", "source_size", "weight", "slope", "target", "start", "wanted",
                         taken.alias("taken"))


def position(pass_no: Column) -> Column:
    """Training position, 0 to 1, at which the document's given pass starts."""
    at = (F.col("source_size") * pass_no + F.col("start")).cast("double") / F.col("wanted").cast("double")
    return demand_inverse(at, F.col("slope"))


def curriculum(mixed: DataFrame) -> DataFrame:
    """One row per take of a document that counts whole: (row, position, pass_no, words), range-sorted by position.

    A take cut by the end of the target counts whole if at least half of its
    words are taken, so a source is off its target by half a document at most.
    """
    passes = mixed.filter("taken > 0").withColumn("pass_no", F.explode(F.sequence(F.lit(0), F.lit(MAX_PASSES - 1))))
    words = F.least(F.col("wanted") - F.col("source_size") * F.col("pass_no") - F.col("start"), F.col("size"))
    takes = passes.withColumn("words", words).filter("words > 0 AND 2 * words >= size")
    return (takes.select("row", "id", position(F.col("pass_no")).alias("position"), "pass_no", "words")
            .orderBy("position", "id"))
