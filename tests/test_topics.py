"""c-TF-IDF formula, MMR choice, summary and CSV order."""

import math

from pyspark.sql import functions as F

from pagewatch.operators.topics import ctfidf, mmr, topic_summary


def test_ctfidf_formula(spark):
    toks = [("a", "x")] * 3 + [("a", "y")] + [("b", "x")] + [("b", "z")] * 2
    df = spark.createDataFrame(toks, "cluster string, term string")
    got = {(r["cluster"], r["term"]): r["weight"] for r in ctfidf(df, "cluster", 10).collect()}
    W = {"a": 4, "b": 3}
    f = {"x": 4, "y": 1, "z": 2}
    A = (4 + 3) / 2
    tf = {("a", "x"): 3, ("a", "y"): 1, ("b", "x"): 1, ("b", "z"): 2}
    for (c, t), n in tf.items():
        assert abs(got[(c, t)] - round(n / W[c] * math.log(1 + A / f[t]), 9)) < 1e-12


def test_mmr_rule(spark):
    terms = ["protest", "protests", "protester", "court", "election"]
    rows = [(1, t, w) for t, w in zip(terms, [1.0, 0.95, 0.9, 0.6, 0.5], strict=True)] + [(2, "only", 0.0)]
    df = spark.createDataFrame(rows, "cluster int, term string, weight double")

    def chosen(k, d):
        return [r["term"] for r in mmr(df, "cluster", k, d).filter("cluster = 1").orderBy("rank").collect()]
    assert chosen(5, 0.0) == terms  # no diversity: order of relevance
    assert chosen(9, 0.3)[0] == "protest" and sorted(chosen(9, 0.3)) == sorted(terms)
    # " protest " and " protests " share 7 of 10 trigrams: 0.3 * 0.95 - 0.7 * 0.7 < 0.3 * 0.6 - 0
    assert chosen(2, 0.7) == ["protest", "court"]
    assert chosen(2, 0.1) == ["protest", "protests"]
    assert [tuple(r) for r in mmr(df, "cluster", 3, 0.3).filter("cluster = 2").collect()] == [(2, 1, "only")]


def test_summary_order_outliers_last(spark):
    rows = [(-1, 50, []), (0, 10, ["a"]), (1, 10, ["b"]), (2, 30, ["c"])]
    df = spark.createDataFrame(rows, "id int, size long, keywords_en array<string>")
    assert [r["id"] for r in topic_summary(df).collect()] == [2, 0, 1, -1]
