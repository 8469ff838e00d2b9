"""Connected components by alternating stars, with the edges of a star's centre spread over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import store


def star_components(edges: DataFrame, a: str = "a", b: str = "b", salts: int = 8, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node reachable.

    Alternating large-star / small-star rounds over long ids. The minimum of a
    node's neighbours is an ordinary aggregate (combined map-side), and it goes
    back to the node's edges by a join salted ``salts`` ways, so the centre of
    a star that holds most edges is spread over tasks. Every round is written
    to the shared folder. Rows with a null or equal pair are ignored.
    """
    cur = store(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct(), "cc")
    salt_rows = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))

    def star(pairs: DataFrame) -> DataFrame:
        """(u, v, m): each directed pair with the smallest id among u and its listed neighbours."""
        low = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        low = low.withColumn("_s", salt_rows)
        return pairs.withColumn("_s", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int")).join(low, ["u", "_s"])

    before = None
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        small = star(large)
        small = (small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(small.select("u", F.col("m").alias("v")))
                 .filter("u <> v").distinct())
        cur = store(small, "cc")
        state = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError("connected components did not converge")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
