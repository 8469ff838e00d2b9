"""Topics: c-TF-IDF keywords (I6), MMR diversification (I7), labels (I8), sizes
(E7), centroids (E8), centroid similarity (D7), representatives (F1), topic
rows (I9) and the summary / payload relations (B5, B6).

c-TF-IDF (class-based TF-IDF): weight(t, c) = tf(t, c) / W(c) * ln(1 + A / f(t)),
W(c) = words in class c, A = mean words per class, f(t) = count of t over all
classes (Grootendorst 2022). Three aggregates and two joins; the top-k per
class is a ``row_number`` filter that Spark runs as a WindowGroupLimit.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import KEYWORDS_LEAD, snippet, topic_description
from ..session import ensure_checkpoint_dir, store

# Fixed values of the summary's layout.
SUMMARY_KEYWORDS = 8
HEADING_RULE = 78


def ctfidf(tokens: DataFrame, class_col: str = "cluster", k: int = 30, decimals: int = 9) -> DataFrame:
    """Top-``k`` terms per class: (class, term, weight, rank)."""
    # tf feeds three consumers; checkpoint the (small) aggregate so the token
    # stream is produced once.
    ensure_checkpoint_dir(tokens.sparkSession)
    tf = store(tokens.groupBy(class_col, "term").agg(F.count(F.lit(1)).alias("tf")), "term_counts")
    words = tf.groupBy(class_col).agg(F.sum("tf").alias("W"))
    freq = tf.groupBy("term").agg(F.sum("tf").alias("f"))
    # A (mean words per class) is one number: fetch it as a literal instead of
    # joining a one-row frame (which plans as a nested-loop join).
    avg_words = words.agg(F.avg("W")).first()[0] or 0.0
    w = tf.join(words, class_col).join(freq, "term")
    weight = F.round(F.col("tf") / F.col("W") * F.log(1 + F.lit(float(avg_words)) / F.col("f")), decimals)
    scored = w.select(class_col, "term", weight.alias("weight"))
    win = Window.partitionBy(class_col).orderBy(F.col("weight").desc(), F.col("term"))
    return scored.withColumn("rank", F.row_number().over(win)).filter(F.col("rank") <= k)


def word_trigrams(word: Column) -> Column:
    """Distinct character trigrams of a word padded with a space on either side."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), lambda i: F.substring(padded, i, F.lit(3))))


def mmr(candidates: DataFrame, class_col: str = "cluster", k: int = 10, diversity: float = 0.3, decimals: int = 9) -> DataFrame:
    """(class, rank, term) of ``k`` diverse keywords per class.

    Greedy maximal marginal relevance: first the most relevant term, then the
    one maximising (1 - d) * relevance - d * max trigram Jaccard similarity to
    those chosen (rounded to ``decimals``; ties go to the term listed first:
    weight desc, term asc). Relevance is the weight over the class maximum.
    One aggregate per class over its candidates (30 by default), folded with
    array functions: no Python.
    """
    order = F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), F.col("term").alias("term"))))
    lists = candidates.groupBy(class_col).agg(order.alias("_l"))
    top = -F.element_at("_l", 1)["w"]
    rel = lambda x: F.when(top == 0, F.lit(0.0)).otherwise(-x["w"] / top)
    lists = lists.withColumn("_c", F.transform("_l", lambda x, i: F.struct(i.alias("i"), x["term"].alias("term"), rel(x).alias("rel"),
                                                                         word_trigrams(x["term"]).alias("g"))))

    def similarity(a: Column, b: Column) -> Column:
        both = F.size(F.array_intersect(a, b)).cast("double")
        return both / (F.size(a) + F.size(b) - both)

    def step(chosen: Column, _: Column) -> Column:
        left = F.filter("_c", lambda x: ~F.exists(chosen, lambda y: y["i"] == x["i"]))
        scored = F.transform(left, lambda x: F.struct(
            F.round((1 - diversity) * x["rel"] - diversity * F.array_max(F.transform(chosen, lambda y: similarity(x["g"], y["g"]))), decimals).alias("score"),
            (-x["i"]).alias("first"), x.alias("x")))
        return F.concat(chosen, F.transform(F.filter(F.array(F.array_max(scored)), lambda s: s.isNotNull()), lambda s: s["x"]))

    chosen = F.aggregate(F.sequence(F.lit(2), F.lit(max(k, 2))), F.slice("_c", 1, 1), step) if k > 1 else F.slice("_c", 1, 1)
    return lists.select(class_col, F.posexplode(F.transform(chosen, lambda x: x["term"])).alias("rank", "term")).withColumn("rank", F.col("rank") + 1)


def keyword_lists(ranked_terms: DataFrame, class_col: str = "cluster") -> DataFrame:
    """(class, keywords array) in rank order; lists are bounded by k."""
    return ranked_terms.groupBy(class_col).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]).alias("keywords"))


def topic_label(topic_id, keywords, n: int = 4) -> Column:
    """I8: ``id_w1_w2_w3_w4``."""
    return F.concat_ws("_", topic_id.cast("string") if isinstance(topic_id, Column) else F.col(topic_id).cast("string"),
                       F.slice(keywords if isinstance(keywords, Column) else F.col(keywords), 1, n))


def topic_sizes(labels: DataFrame, class_col: str = "cluster") -> DataFrame:
    """Articles per topic (outliers included as -1)."""
    return labels.groupBy(class_col).agg(F.count(F.lit(1)).alias("size"))


def topic_counts(labels: DataFrame, class_col: str = "cluster") -> DataFrame:
    """E7 totals: n_articles, n_topics (without -1), n_outliers."""
    return labels.agg(F.count(F.lit(1)).alias("n_articles"),
                      F.count_distinct(F.when(F.col(class_col) != -1, F.col(class_col))).alias("n_topics"),
                      F.count_if(F.col(class_col) == -1).alias("n_outliers"))


def _means(vectors: DataFrame, labels: DataFrame, id_col: str, class_col: str, vec_col: str) -> DataFrame:
    """(class, _c): the mean vector of each cluster, one vector aggregate (outliers excluded)."""
    v = vectors.join(labels.filter(F.col(class_col) != -1).select(id_col, class_col), id_col)
    dense = array_to_vector(F.col(vec_col).cast("array<double>"))
    return v.groupBy(class_col).agg(vector_to_array(Summarizer.mean(dense)).alias("_c"))


def centroids(vectors: DataFrame, labels: DataFrame, id_col: str = "article_id", class_col: str = "cluster",
              vec_col: str = "vec") -> DataFrame:
    """Mean vector per cluster, outliers excluded: (cluster, dim, mean)."""
    return _means(vectors, labels, id_col, class_col, vec_col).select(class_col, F.posexplode("_c").alias("dim", "mean"))


def centroid_similarity(vectors: DataFrame, labels: DataFrame, id_col: str = "article_id",
                        class_col: str = "cluster", vec_col: str = "vec") -> DataFrame:
    """Cosine of each clustered vector to its cluster centroid (zero norm -> 1e-12)."""
    cvec = _means(vectors, labels, id_col, class_col, vec_col)
    v = vectors.join(labels.filter(F.col(class_col) != -1).select(id_col, class_col), id_col).join(cvec, class_col)
    x = F.col(vec_col)
    dot = F.aggregate(F.zip_with(x, F.col("_c"), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda acc, y: acc + y)
    nx = F.sqrt(F.aggregate(x, F.lit(0.0), lambda acc, y: acc + y.cast("double") * y.cast("double")))
    nc = F.sqrt(F.aggregate(F.col("_c"), F.lit(0.0), lambda acc, y: acc + y * y))
    den = F.when(nx * nc == 0, F.lit(1e-12)).otherwise(nx * nc)
    return v.select(id_col, class_col, (dot / den).alias("sim"))


def representatives(vectors: DataFrame, labels: DataFrame, k: int = 3, id_col: str = "article_id",
                    class_col: str = "cluster", vec_col: str = "vec", decimals: int = 6) -> DataFrame:
    """top-``k`` articles per cluster by centroid similarity (ties: smaller id)."""
    s = centroid_similarity(vectors, labels, id_col, class_col, vec_col)
    w = Window.partitionBy(class_col).orderBy(F.round("sim", decimals).desc(), F.col(id_col))
    return (s.withColumn("rep_rank", F.row_number().over(w)).filter(F.col("rep_rank") <= k)
            .select(class_col, id_col, "rep_rank", F.round("sim", decimals).alias("sim")))


def topic_rows(sizes: DataFrame, keywords: DataFrame, reps: DataFrame, articles: DataFrame,
               class_col: str = "cluster", id_col: str = "article_id", n_keywords: int = 10) -> DataFrame:
    """I9 (+ H8, H9, I8, F7): one row per topic (M15), outliers with no keywords."""
    a = articles.select(id_col, "url", "archive_url",
                        snippet(F.col("text_en"), 300).alias("snippet_en"),
                        snippet(F.col("text_src"), 300).alias("snippet_src"))
    r = reps.join(a, id_col).groupBy(class_col).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rep_rank", "url", "archive_url", "snippet_en", "snippet_src"))),
                    lambda s: F.struct(s["url"].alias("url"), s["archive_url"].alias("archive_url"),
                                       s["snippet_en"].alias("snippet_en"), s["snippet_src"].alias("snippet_src")))
        .alias("representative_articles"))
    kw = F.when(F.col(class_col) == -1, F.array().cast("array<string>")).otherwise(
        F.coalesce(F.col("keywords"), F.array().cast("array<string>")))
    t = (sizes.join(keywords, class_col, "left").join(r, class_col, "left")
         .select(F.col(class_col).alias("id"), "size", kw.alias("_kw"),
                 F.coalesce("representative_articles", F.array()).alias("representative_articles")))
    first_en = F.get(F.col("representative_articles"), 0)["snippet_en"]
    return t.select(
        "id", "size",
        topic_label(F.col("id"), F.col("_kw")).alias("label"),
        topic_description(F.col("_kw"), first_en).alias("description"),
        F.slice("_kw", 1, n_keywords).alias("keywords_en"),
        "representative_articles",
    )


def topic_summary(topics: DataFrame, n_keywords: int = SUMMARY_KEYWORDS) -> DataFrame:
    """B6 (+ F5): a block of lines per topic, outliers last, then size desc, then id."""
    tag = F.when(F.col("id") == -1, F.lit("OUTLIERS")).otherwise(F.concat(F.lit("Cluster "), F.col("id").cast("string")))
    kw = F.slice("keywords_en", 1, n_keywords)
    head = F.concat(tag, F.lit("  ("), F.col("size").cast("string"), F.lit(" articles)"))
    empty = F.array().cast("array<string>")

    def article(r: Column) -> Column:
        text = F.coalesce(F.nullif(r["snippet_en"], F.lit("")), r["snippet_src"], F.lit(""))
        return F.concat_ws("\n", F.concat(F.lit("  - "), r["url"]), F.when(text != "", F.concat(F.lit("      "), text)))

    reps = F.transform("representative_articles", article) if "representative_articles" in topics.columns else empty
    return topics.select(
        "id", "size",
        (F.col("id") == -1).alias("is_outlier"),
        tag.alias("tag"),
        F.array_join(kw, ", ").alias("keywords"),
        F.array_join(F.concat(F.array(head), F.when(F.size(kw) > 0, F.array(F.concat(F.lit("  " + KEYWORDS_LEAD), F.array_join(kw, ", ")))).otherwise(empty),
                              reps, F.array(F.lit(""))), "\n").alias("text"),
    ).orderBy(F.col("is_outlier"), F.col("size").desc(), F.col("id"))


def summary_heading(counts: DataFrame) -> DataFrame:
    """The heading of the summary from the totals."""
    return counts.select(F.concat(F.lit("Clusters from "), F.col("n_articles").cast("string"), F.lit(" deleted articles ("), F.col("n_topics").cast("string"),
                                  F.lit(" topics, "), F.col("n_outliers").cast("string"), F.lit(" outliers)\n"), F.lit("=" * HEADING_RULE), F.lit("\n")).alias("text"))


def cluster_payload(articles: DataFrame, topics: DataFrame, params: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(run summary row, articles, clusters) relations instead of one giant JSON.

    ``params`` are the run's input_dir, model, min_topic_size and translation.
    """
    summary = topic_counts(articles).select(F.struct(*[F.lit(v).alias(k) for k, v in params.items()]).alias("params"), "*")
    names = ["source_file", "url", "archive_url", "archive_timestamp", "cluster", "text_src", "text_en"]
    return summary, articles.select(*[c for c in names if c in articles.columns]), topics
