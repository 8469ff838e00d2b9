"""Registered cluster / topic queries with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from .. import oracles as O
from ..functions.text import preview as preview_col
from ..operators.articles import articles_from_findings, cache_hits, cache_key, translate, translate_resumable
from ..operators.clustering import connected_components, dense_rank_ids, density_clusters
from ..operators.topics import (centroid_similarity, centroids, cluster_payload, ctfidf, keyword_lists, mmr, representatives,
                                summary_heading, topic_counts, topic_label, topic_sizes, topic_summary)
from ..operators.vectors import embed, hashed_weights, similarity_pairs, tokenise
from ..registry import register
from ..session import scratch_path, store, table
from ..sinks.writers import CSV, write_cluster_csv, write_cluster_payload
from .cluster import cluster_articles
from .queries_io import FINDINGS_SQL

THRESHOLD, MIN_PTS, MIN_SIZE, DIM = 0.95, 5, 5, 64


# ------------------------------------------------------------------ Spark side
def articles(spark, d):
    ident = F.regexp_extract("url", r"/([0-9]+)$", 1).cast("long")
    return articles_from_findings(X.findings_from_documents(spark, d), id_expr=ident)


def article_cache(arts):
    """Cache prefilled for even articles; keys starting with 0 are cached failures."""
    key = cache_key("text_src")
    ok = ~F.startswith(key, F.lit("0"))
    return arts.filter(F.col("article_id") % 2 == 0).select(
        key.alias("src_sha1"),
        F.when(ok, F.concat(F.lit("[cached] "), F.col("text_src"))).otherwise(F.lit("")).alias("text_out"),
        ok.alias("ok")).dropDuplicates(["src_sha1"])  # the key fixes the rest of a row; a join by it needs no other shuffle


def translated(spark, d):
    arts = articles(spark, d)
    out, _ = translate(arts, article_cache(arts), dictionary=X.dictionary())
    return out


def vectors(spark, d):
    return embed(articles(spark, d), "article_id", "text_src", DIM)


def labels(spark, d):
    arts = articles(spark, d)
    return density_clusters(embed(arts), arts, THRESHOLD, MIN_PTS, MIN_SIZE)


# ------------------------------------------------------------------- SQL side
ARTS = (f"SELECT cast(regexp_extract(url, '/([0-9]+)$', 1) AS BIGINT) AS article_id, url, archive_url, "
        f"archive_timestamp, text_src FROM ({FINDINGS_SQL})")
CACHE = """SELECT DISTINCT sha1(text_src) AS src_sha1,
  CASE WHEN NOT starts_with(sha1(text_src), '0') THEN '[cached] ' || text_src ELSE '' END AS text_out,
  NOT starts_with(sha1(text_src), '0') AS ok FROM arts WHERE article_id % 2 = 0"""
DICT = "SELECT * FROM (VALUES " + ", ".join(f"({O.q(a)}, {O.q(b)})" for a, b in X.DICTIONARY) + ") d(token, out)"


def translated_ctes() -> str:
    return f"""arts AS ({ARTS}),
cache AS ({CACHE}),
keys AS (SELECT DISTINCT sha1(text_src) AS src_sha1, text_src AS text FROM arts),
misses AS (SELECT * FROM keys WHERE src_sha1 NOT IN (SELECT src_sha1 FROM cache WHERE ok)),
toks AS (SELECT src_sha1, unnest(string_split(text, ' ')) AS tok, generate_subscripts(string_split(text, ' '), 1) AS pos FROM misses),
newt AS (SELECT src_sha1, string_agg(coalesce(d.out, tok), ' ' ORDER BY pos) AS text_out FROM toks
         LEFT JOIN ({DICT}) d ON d.token = lower(tok) GROUP BY src_sha1),
known AS (SELECT src_sha1, text_out FROM cache WHERE ok UNION ALL SELECT src_sha1, text_out FROM newt),
tr AS (SELECT a.*, sha1(a.text_src) AS src_sha1, coalesce(k.text_out, '') AS text_en FROM arts a
       LEFT JOIN known k ON k.src_sha1 = sha1(a.text_src))"""


def weights_ctes(src: str = "arts") -> str:
    return f"""wt AS (SELECT article_id, unnest(regexp_split_to_array(lower(text_src), '[^\\p{{L}}\\p{{N}}]+')) AS term FROM {src}),
wb AS (SELECT article_id, cast(('0x' || substr(md5(term), 1, 8)) AS BIGINT) % {DIM} AS bucket FROM wt WHERE length(term) >= 2),
wc AS (SELECT article_id, bucket, count(*) AS n FROM wb GROUP BY article_id, bucket),
wn AS (SELECT article_id, sqrt(sum(n * n)) AS norm FROM wc GROUP BY article_id),
w AS (SELECT wc.article_id, wc.bucket, wc.n / wn.norm AS weight FROM wc JOIN wn ON wn.article_id = wc.article_id)"""


PAIRS_CTE = f"""pairs AS (SELECT a.article_id AS i, b.article_id AS j, round(sum(a.weight * b.weight), 6) AS cosine
  FROM w a JOIN w b ON a.bucket = b.bucket AND a.article_id < b.article_id
  GROUP BY a.article_id, b.article_id HAVING round(sum(a.weight * b.weight), 6) >= {THRESHOLD})"""


def dbscan_ctes() -> str:
    return f"""e AS (SELECT i AS src, j AS dst FROM pairs UNION ALL SELECT j, i FROM pairs),
deg AS (SELECT src AS id, count(*) AS degree FROM e GROUP BY src),
core AS (SELECT id FROM deg WHERE degree + 1 >= {MIN_PTS}),
ce AS (SELECT src, dst FROM e WHERE src IN (SELECT id FROM core) AND dst IN (SELECT id FROM core)),
r(x, l) AS (SELECT id, id FROM core UNION SELECT ce.dst, r.l FROM r JOIN ce ON ce.src = r.x),
comp AS (SELECT x AS id, min(l) AS component FROM r GROUP BY x),
sim AS (SELECT i, j, cosine FROM pairs UNION ALL SELECT j, i, cosine FROM pairs),
b0 AS (SELECT sim.i AS id, comp.component, row_number() OVER (PARTITION BY sim.i ORDER BY sim.cosine DESC, sim.j) AS rn
       FROM sim JOIN comp ON comp.id = sim.j WHERE sim.i NOT IN (SELECT id FROM core)),
members AS (SELECT id, component FROM comp UNION ALL SELECT id, component FROM b0 WHERE rn = 1),
sizes AS (SELECT component, count(*) AS size FROM members GROUP BY component),
ranked AS (SELECT component, cast(row_number() OVER (ORDER BY size DESC, component) - 1 AS INTEGER) AS cluster
           FROM sizes WHERE size >= {MIN_SIZE}),
labels AS (SELECT a.article_id, cast(coalesce(rk.cluster, -1) AS INTEGER) AS cluster FROM arts a
           LEFT JOIN members m ON m.id = a.article_id LEFT JOIN ranked rk ON rk.component = m.component)"""


def labels_sql(select: str) -> str:
    return f"WITH RECURSIVE arts AS ({ARTS}), {weights_ctes()}, {PAIRS_CTE}, {dbscan_ctes()} {select}"


def ctfidf_ctes(tokens: str, cls: str, k: int) -> str:
    return f"""tf AS (SELECT {cls} AS cls, term, count(*) AS tf FROM ({tokens}) GROUP BY {cls}, term),
words AS (SELECT cls, sum(tf) AS W FROM tf GROUP BY cls),
freq AS (SELECT term, sum(tf) AS f FROM tf GROUP BY term),
avgw AS (SELECT avg(W) AS A FROM words),
sc AS (SELECT tf.cls, tf.term, round(tf.tf / words.W * ln(1 + avgw.A / freq.f), 9) AS weight
       FROM tf JOIN words ON words.cls = tf.cls JOIN freq ON freq.term = tf.term, avgw),
kw AS (SELECT * FROM (SELECT cls, term, weight, row_number() OVER (PARTITION BY cls ORDER BY weight DESC, term) AS rank
       FROM sc) WHERE rank <= {k})"""


def mmr_ctes(k: int = 10, diversity: float = 0.3) -> str:
    """Table ``mm`` (cls, terms): the greedy choice among each class's candidates in ``kw``; needs WITH RECURSIVE."""
    jac = "len(list_intersect(x, q.g)) / CAST(len(x) + len(q.g) - len(list_intersect(x, q.g)) AS DOUBLE)"
    return f"""gr AS (SELECT cls, term, rank AS r0,
  CASE WHEN max(weight) OVER (PARTITION BY cls) = 0 THEN 0 ELSE weight / max(weight) OVER (PARTITION BY cls) END AS rel,
  list_distinct(list_transform(range(1, greatest(1, length(term)) + 1), lambda i: substring(' ' || term || ' ', CAST(i AS INTEGER), 3))) AS g FROM kw),
ch(step, cls, terms, gs) AS (
  SELECT 1, cls, [term], [g] FROM gr WHERE r0 = 1
  UNION ALL
  SELECT step + 1, cls, list_append(terms, term), list_append(gs, g) FROM (
    SELECT c.step, c.cls, c.terms, c.gs, q.term, q.g, row_number() OVER (PARTITION BY c.cls ORDER BY
        round((1 - {diversity}) * q.rel - {diversity} * list_max(list_transform(c.gs, lambda x: {jac})), 9) DESC, q.r0) AS pick
    FROM ch c JOIN gr q ON q.cls = c.cls WHERE c.step < {k} AND NOT list_contains(c.terms, q.term)) WHERE pick = 1),
mm AS (SELECT cls, arg_max(terms, step) AS terms FROM ch GROUP BY cls)"""


def tokens_sql(src: str, text: str, keep: str) -> str:
    return (f"SELECT {keep}, term FROM (SELECT {keep}, unnest(regexp_split_to_array(lower({text}), "
            f"'[^\\p{{L}}\\p{{N}}]+')) AS term FROM {src}) WHERE length(term) >= 2")


def snip(expr: str, n: int) -> str:
    return O.snippet(expr, n)


def topics_sql(select: str, k: int = 10) -> str:
    """Topic rows with MMR keywords, translation by dictionary."""
    return f"""WITH RECURSIVE {translated_ctes()}, {weights_ctes()}, {PAIRS_CTE}, {dbscan_ctes()},
lt AS (SELECT l.cluster, tr.* FROM labels l JOIN tr ON tr.article_id = l.article_id),
{ctfidf_ctes(tokens_sql('lt', 'text_en', 'cluster'), 'cluster', 30)},
{mmr_ctes(k)},
kws AS (SELECT cls AS cluster, terms AS keywords FROM mm),
csize AS (SELECT cluster, count(*) AS n FROM labels WHERE cluster <> -1 AND article_id IN (SELECT article_id FROM w) GROUP BY cluster),
cent AS (SELECT l.cluster, w.bucket, sum(w.weight) / max(csize.n) AS mean FROM labels l JOIN w ON w.article_id = l.article_id
         JOIN csize ON csize.cluster = l.cluster GROUP BY l.cluster, w.bucket),
cn AS (SELECT cluster, sqrt(sum(mean * mean)) AS norm FROM cent GROUP BY cluster),
an AS (SELECT article_id, sqrt(sum(weight * weight)) AS norm FROM w GROUP BY article_id),
simc AS (SELECT l.article_id, l.cluster, sum(w.weight * cent.mean) AS dot FROM labels l JOIN w ON w.article_id = l.article_id
         JOIN cent ON cent.cluster = l.cluster AND cent.bucket = w.bucket WHERE l.cluster <> -1 GROUP BY l.article_id, l.cluster),
sims AS (SELECT simc.article_id, simc.cluster, round(dot / CASE WHEN an.norm * cn.norm = 0 THEN 1e-12 ELSE an.norm * cn.norm END, 6) AS sim
         FROM simc JOIN an ON an.article_id = simc.article_id JOIN cn ON cn.cluster = simc.cluster),
reps AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY sim DESC, article_id) AS rep_rank FROM sims) WHERE rep_rank <= 3),
repa AS (SELECT reps.cluster, reps.rep_rank, lt.url, lt.archive_url, {snip('lt.text_en', 300)} AS snippet_en, {snip('lt.text_src', 300)} AS snippet_src
         FROM reps JOIN lt ON lt.article_id = reps.article_id),
tsz AS (SELECT cluster, count(*) AS size FROM labels GROUP BY cluster),
topics AS (SELECT tsz.cluster AS id, tsz.size, CASE WHEN tsz.cluster = -1 THEN [] ELSE coalesce(kws.keywords, []) END AS kw,
                  coalesce((SELECT string_agg(url, ' ' ORDER BY rep_rank) FROM repa WHERE repa.cluster = tsz.cluster), '') AS rep_urls,
                  (SELECT snippet_en FROM repa WHERE repa.cluster = tsz.cluster AND rep_rank = 1) AS first_en
           FROM tsz LEFT JOIN kws ON kws.cluster = tsz.cluster)
{select}"""


DESC_SQL = """CASE WHEN concat_ws(' | ', CASE WHEN len(kw) > 0 THEN 'Keywords: ' || array_to_string(kw[1:6], ', ') END,
   CASE WHEN coalesce(first_en, '') <> '' THEN 'Example: ' || {ex} END) = '' THEN '(outliers — no shared topic)'
 ELSE concat_ws(' | ', CASE WHEN len(kw) > 0 THEN 'Keywords: ' || array_to_string(kw[1:6], ', ') END,
   CASE WHEN coalesce(first_en, '') <> '' THEN 'Example: ' || {ex} END) END""".format(ex=snip("first_en", 180))
LABEL_SQL = "CASE WHEN len(kw) = 0 THEN cast(id AS VARCHAR) ELSE concat_ws('_', cast(id AS VARCHAR), array_to_string(kw[1:4], '_')) END"


# ----------------------------------------------------------------- registered
@register("translate_with_cache", f"WITH {translated_ctes()} SELECT url, src_sha1, text_en FROM tr")
def q_translate_with_cache(spark, d):
    """Cache hits reused, misses translated once per distinct text (dictionary join), failures retried."""
    return translated(spark, d).select("url", "src_sha1", "text_en")


@register("translate_resumed", f"WITH {translated_ctes()} SELECT url, src_sha1, text_en FROM tr")
def q_translate_resumed(spark, d):
    """I1 with B8: a run that has the articles of one half committed, and one that goes on from its cache."""
    from ..sinks.writers import append_cache
    arts, path = articles(spark, d), scratch_path(spark, "cache")
    append_cache(article_cache(arts), path)
    translate_resumable(arts.filter(F.length("url") % 2 == 0), path, dictionary=X.dictionary(), slices=4).count()
    return translate_resumable(arts, path, dictionary=X.dictionary(), slices=4).select("url", "src_sha1", "text_en")


@register("translation_off", f"WITH arts AS ({ARTS}) SELECT article_id, '' AS text_en, text_src FROM arts")
def q_translation_off(spark, d):
    """I1 switched off: no translation, what follows uses the source text."""
    arts = articles(spark, d)
    out, _ = translate(arts, article_cache(arts))
    return out.select("article_id", "text_en", "text_src")


@register("cache_lookup_join", f"""WITH arts AS ({ARTS}), cache AS ({CACHE})
SELECT a.url, sha1(a.text_src) AS src_sha1, c.text_out, c.ok FROM arts a LEFT JOIN cache c ON c.src_sha1 = sha1(a.text_src) AND c.ok""")
def q_cache_lookup_join(spark, d):
    """Each article's usable cached translation (null on a miss)."""
    arts = articles(spark, d)
    return cache_hits(arts, article_cache(arts)).select("url", "src_sha1", "text_out", "ok")


@register("embed_articles", f"WITH arts AS ({ARTS}), {weights_ctes()} SELECT article_id, cast(bucket AS INTEGER) AS bucket, round(weight, 9) AS weight FROM w")
def q_embed_articles(spark, d):
    """Hashed term-count vectors (64 buckets, L2-normalised), sparse form."""
    w = hashed_weights(articles(spark, d), "article_id", "text_src", DIM)
    return w.select("article_id", "bucket", F.round("weight", 9).alias("weight"))


@register("similarity_pairs", f"WITH arts AS ({ARTS}), {weights_ctes()}, {PAIRS_CTE} SELECT i, j, cosine FROM pairs")
def q_similarity_pairs(spark, d):
    """Every article pair with cosine >= 0.95, exact (blocked matrix products)."""
    return similarity_pairs(vectors(spark, d), THRESHOLD)


MOST = 3


@register("similarity_neighbours", f"""WITH arts AS ({ARTS}), {weights_ctes()}, {PAIRS_CTE},
d AS (SELECT i, j, cosine FROM pairs UNION ALL SELECT j, i, cosine FROM pairs),
r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY cosine DESC, j) AS no FROM d)
SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j, cosine FROM r WHERE no <= {MOST}""")
def q_similarity_neighbours(spark, d):
    """D8 with at most three partners a vector: a bounded top-k in each block pair, then over all."""
    return similarity_pairs(vectors(spark, d), THRESHOLD, max_neighbours=MOST)


@register("similarity_lsh_recall", f"""WITH arts AS ({ARTS}), {weights_ctes()}, {PAIRS_CTE}
SELECT count(*) AS pairs, true AS recall_reached, cast(0 AS BIGINT) AS wrong FROM pairs""")
def q_similarity_lsh_recall(spark, d):
    """D8 by hyperplane bands held against the exact pairs: their number, whether 0.9 of them are found, and pairs that are none."""
    v = store(vectors(spark, d), "vectors")
    exact = similarity_pairs(v, THRESHOLD, checkpoint_input=False).select("i", "j", F.lit(1).alias("is_pair"))
    found = similarity_pairs(v, THRESHOLD, method="lsh", checkpoint_input=False).select("i", "j", F.lit(1).alias("is_found"))
    both = exact.join(found, ["i", "j"], "full")
    hits = F.count_if(F.col("is_pair").isNotNull() & F.col("is_found").isNotNull())
    return both.agg(F.count("is_pair").alias("pairs"), (hits >= 0.9 * F.count("is_pair")).alias("recall_reached"),
                    F.count_if(F.col("is_pair").isNull()).alias("wrong"))


@register("connected_components", f"""WITH RECURSIVE arts AS ({ARTS}), {weights_ctes()}, {PAIRS_CTE},
e AS (SELECT i AS src, j AS dst FROM pairs UNION ALL SELECT j, i FROM pairs),
r(x, l) AS (SELECT DISTINCT src, src FROM e UNION SELECT e.dst, r.l FROM r JOIN e ON e.src = r.x)
SELECT x AS id, min(l) AS component FROM r GROUP BY x""")
def q_connected_components(spark, d):
    """I4: components of the similarity graph (label = smallest article id)."""
    return connected_components(similarity_pairs(vectors(spark, d), THRESHOLD))


@register("density_clusters", labels_sql("SELECT article_id, cluster FROM labels"))
def q_density_clusters(spark, d):
    """DBSCAN on the cosine graph; ids by size, -1 = outlier."""
    return labels(spark, d)


@register("article_topic_join", labels_sql("SELECT a.url, l.cluster FROM labels l JOIN arts a ON a.article_id = l.article_id"))
def q_article_topic_join(spark, d):
    """Cluster attached to each article by id (never by position)."""
    return labels(spark, d).join(articles(spark, d), "article_id").select("url", "cluster")


@register("topic_sizes", labels_sql("SELECT cluster, count(*) AS size FROM labels GROUP BY cluster"))
def q_topic_sizes(spark, d):
    """Articles per topic."""
    return topic_sizes(labels(spark, d))


@register("tokenise_terms", f"SELECT doc_id, term, count(*) AS n FROM ({tokens_sql('documents', 'text', 'doc_id')}) GROUP BY doc_id, term")
def q_tokenise_terms(spark, d):
    """letter/digit tokens of 2+ characters per document (counted)."""
    t = tokenise(table(spark, d, "documents").select("doc_id", "text"), "text", keep=("doc_id",))
    return t.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))


@register("ctfidf_keywords", f"""WITH {ctfidf_ctes(tokens_sql('documents', 'text', 'lang'), 'lang', 10)}
SELECT cls AS lang, term, weight, cast(rank AS INTEGER) AS rank FROM kw""")
def q_ctfidf_keywords(spark, d):
    """Top-10 c-TF-IDF terms per language class over all documents."""
    t = tokenise(table(spark, d, "documents").select("lang", "text"), "text", keep=("lang",))
    return ctfidf(t, "lang", 10).select("lang", "term", "weight", F.col("rank").cast("int").alias("rank"))


@register("mmr_keywords", f"""WITH RECURSIVE {ctfidf_ctes(tokens_sql('documents', 'text', 'lang'), 'lang', 30)},
{mmr_ctes(10, 0.3)}
SELECT cls AS lang, CAST(generate_subscripts(terms, 1) AS INTEGER) AS rank, unnest(terms) AS term FROM mm""")
def q_mmr_keywords(spark, d):
    """10 diverse keywords per language class from the top-30 candidates."""
    t = tokenise(table(spark, d, "documents").select("lang", "text"), "text", keep=("lang",))
    return mmr(ctfidf(t, "lang", 30), "lang", 10, 0.3)


@register("topic_label", f"""WITH {ctfidf_ctes(tokens_sql('documents', 'text', 'lang'), 'lang', 4)}
SELECT cls AS lang, concat_ws('_', cls, string_agg(term, '_' ORDER BY rank)) AS label FROM kw GROUP BY cls""")
def q_topic_label(spark, d):
    """I8: ``id_w1_w2_w3_w4`` from each class's top-4 terms."""
    t = tokenise(table(spark, d, "documents").select("lang", "text"), "text", keep=("lang",))
    kws = keyword_lists(ctfidf(t, "lang", 4), "lang")
    return kws.select("lang", topic_label(F.col("lang"), F.col("keywords")).alias("label"))


EMB = """SELECT vec_id, label AS cluster, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings"""
CENT = f"SELECT cluster, dim, avg(cast(x AS DOUBLE)) AS mean FROM ({EMB}) GROUP BY cluster, dim"
SIMS = f"""SELECT e.vec_id, e.cluster, sum(cast(e.x AS DOUBLE) * c.mean) AS dot,
  sqrt(sum(cast(e.x AS DOUBLE) * cast(e.x AS DOUBLE))) AS nx, max(cn.norm) AS nc
FROM ({EMB}) e JOIN ({CENT}) c ON c.cluster = e.cluster AND c.dim = e.dim
JOIN (SELECT cluster, sqrt(sum(mean * mean)) AS norm FROM ({CENT}) GROUP BY cluster) cn ON cn.cluster = e.cluster
GROUP BY e.vec_id, e.cluster"""


def _emb(spark, d):
    e = table(spark, d, "embeddings")
    return (e.select(F.col("vec_id").alias("article_id"), F.col("embedding").alias("vec")),
            e.select(F.col("vec_id").alias("article_id"), F.col("label").alias("cluster")))


@register("centroids", f"SELECT cluster, cast(dim AS INTEGER) AS dim, round(mean, 6) AS mean FROM ({CENT})")
def q_centroids(spark, d):
    """Mean embedding per label (label as cluster)."""
    v, lab = _emb(spark, d)
    return centroids(v, lab).select("cluster", "dim", F.round("mean", 6).alias("mean"))


@register("centroid_join", f"""SELECT vec_id AS article_id, cluster, round(dot / CASE WHEN nx * nc = 0 THEN 1e-12 ELSE nx * nc END, 6) AS sim
FROM ({SIMS})""")
def q_centroid_join(spark, d):
    """Cosine of every embedding to its label's centroid."""
    v, lab = _emb(spark, d)
    return centroid_similarity(v, lab).select("article_id", "cluster", F.round("sim", 6).alias("sim"))


@register("representatives_topk", f"""SELECT cluster, article_id, cast(rep_rank AS INTEGER) AS rep_rank, sim FROM (
  SELECT cluster, vec_id AS article_id, round(dot / CASE WHEN nx * nc = 0 THEN 1e-12 ELSE nx * nc END, 6) AS sim,
    row_number() OVER (PARTITION BY cluster ORDER BY round(dot / CASE WHEN nx * nc = 0 THEN 1e-12 ELSE nx * nc END, 6) DESC, vec_id) AS rep_rank
  FROM ({SIMS})) WHERE rep_rank <= 3""")
def q_representatives_topk(spark, d):
    """three embeddings closest to each label's centroid."""
    v, lab = _emb(spark, d)
    return representatives(v, lab, 3).select("cluster", "article_id", F.col("rep_rank").cast("int").alias("rep_rank"), "sim")


def _topics(spark, d, diversity: float = 0.3):
    arts = articles(spark, d)
    res = cluster_articles(arts, article_cache(arts), X.dictionary(), threshold=THRESHOLD, min_pts=MIN_PTS,
                           min_topic_size=MIN_SIZE, dim=DIM, diversity=diversity)
    return res


@register("topic_rows", topics_sql(f"""SELECT id, size, {LABEL_SQL} AS label, {DESC_SQL} AS description,
  array_to_string(kw[1:10], ', ') AS keywords_en, rep_urls FROM topics"""))
def q_topic_rows(spark, d):
    """I9 (+ I8, H8, H9, F7): topic rows from the full cluster plan (MMR at diversity 0.3)."""
    t = _topics(spark, d).topics
    return t.select("id", "size", "label", "description", F.array_join("keywords_en", ", ").alias("keywords_en"),
                    F.array_join(F.transform("representative_articles", lambda r: r["url"]), " ").alias("rep_urls"))


PAYLOAD_PARAMS = {"input_dir": "documents", "model": "hashed-64", "min_topic_size": MIN_SIZE, "translation": "dictionary"}


def _payload(spark, d):
    """B5 written to a folder; its path."""
    res = _topics(spark, d)
    path = scratch_path(spark, "clusters")
    payload = cluster_payload(res.articles, res.topics, PAYLOAD_PARAMS)
    write_cluster_payload(payload, path)
    return path, [df.schema for df in payload]


@register("cluster_payload", labels_sql("""SELECT 'documents' AS input_dir, 'hashed-64' AS model, 5 AS min_topic_size, 'dictionary' AS translation,
  count(*) AS n_articles, count(DISTINCT cluster) FILTER (WHERE cluster <> -1) AS n_topics,
  count(*) FILTER (WHERE cluster = -1) AS n_outliers FROM labels"""))
def q_cluster_payload(spark, d):
    """The written run summary (all four params + counts)."""
    path, schemas = _payload(spark, d)
    return spark.read.schema(schemas[0]).json(f"{path}/summary").select("params.*", "n_articles", "n_topics", "n_outliers")


@register("cluster_payload_articles", topics_sql("""SELECT url, archive_url, archive_timestamp, cluster, text_src, text_en FROM lt"""))
def q_cluster_payload_articles(spark, d):
    """The written article relation."""
    path, schemas = _payload(spark, d)
    return spark.read.schema(schemas[1]).json(f"{path}/articles").select("url", "archive_url", "archive_timestamp", "cluster", "text_src", "text_en")


@register("cluster_payload_clusters", topics_sql(f"""SELECT id, size, {LABEL_SQL} AS label, {DESC_SQL} AS description, array_to_string(kw, ', ') AS keywords_en,
  coalesce((SELECT string_agg(concat_ws(chr(9), url, archive_url, snippet_en, snippet_src), chr(10) ORDER BY rep_rank) FROM repa WHERE repa.cluster = id), '') AS reps
FROM topics"""))
def q_cluster_payload_clusters(spark, d):
    """The written cluster relation with the representatives' snippets."""
    path, schemas = _payload(spark, d)
    c = spark.read.schema(schemas[2]).json(f"{path}/clusters")
    reps = F.transform("representative_articles", lambda r: F.concat_ws("\t", r["url"], r["archive_url"], r["snippet_en"], r["snippet_src"]))
    return c.select("id", "size", "label", "description", F.array_join("keywords_en", ", ").alias("keywords_en"), F.array_join(reps, "\n").alias("reps"))


@register("topic_description", topics_sql(f"SELECT id, {DESC_SQL} AS description FROM topics"))
def q_topic_description(spark, d):
    """H9: the one-line topic description (keywords + example snippet)."""
    return _topics(spark, d).topics.select("id", "description")


@register("keyword_topk", topics_sql("""SELECT id, array_to_string(kw[1:10], ', ') AS k10, array_to_string(kw[1:8], ', ') AS k8,
  array_to_string(kw[1:6], ', ') AS k6 FROM topics"""))
def q_keyword_topk(spark, d):
    """10 keywords stored, 8 in the summary, 6 in the description."""
    t = _topics(spark, d).topics
    return t.select("id", F.array_join(F.slice("keywords_en", 1, 10), ", ").alias("k10"),
                    F.array_join(F.slice("keywords_en", 1, 8), ", ").alias("k8"),
                    F.array_join(F.slice("keywords_en", 1, 6), ", ").alias("k6"))


@register("topic_summary", topics_sql("""SELECT text FROM (
  SELECT -1 AS r, 'Clusters from ' || (SELECT count(*) FROM labels) || ' deleted articles (' || (SELECT count(*) FROM topics WHERE id <> -1) || ' topics, '
    || (SELECT count(*) FROM labels WHERE cluster = -1) || ' outliers)' || chr(10) || repeat('=', 78) || chr(10) AS text
  UNION ALL
  SELECT row_number() OVER (ORDER BY id = -1, size DESC, id),
    CASE WHEN id = -1 THEN 'OUTLIERS' ELSE 'Cluster ' || id END || '  (' || size || ' articles)' || chr(10)
    || CASE WHEN len(kw) > 0 THEN '  Keywords: ' || array_to_string(kw[1:8], ', ') || chr(10) ELSE '' END
    || coalesce((SELECT string_agg('  - ' || url || CASE WHEN coalesce(nullif(snippet_en, ''), snippet_src) <> ''
         THEN chr(10) || '      ' || coalesce(nullif(snippet_en, ''), snippet_src) ELSE '' END || chr(10), '' ORDER BY rep_rank) FROM repa WHERE repa.cluster = id), '')
  FROM topics)"""))
def q_topic_summary(spark, d):
    """Heading and a block per topic with keywords, representatives and snippets."""
    res = _topics(spark, d)
    return summary_heading(topic_counts(res.articles)).unionByName(topic_summary(res.topics).select("text"))


@register("cluster_csv", topics_sql(f"""SELECT CAST(cluster AS VARCHAR) AS cluster, url, archive_timestamp, 'documents/' || article_id || '.json' AS source_file,
  translate(substring(coalesce(nullif(text_en, ''), text_src), 1, 200), chr(10), ' ') AS text_en_preview FROM lt"""))
def q_cluster_csv(spark, d):
    """B7 + H10: the CSV written with its header and read back, one row per article, with the file it came from."""
    a = _topics(spark, d).articles.withColumn("source_file", F.concat(F.lit("documents/"), F.col("article_id").cast("string"), F.lit(".json")))
    path = scratch_path(spark, "cluster_csv")
    write_cluster_csv(a, path)
    return spark.read.options(**CSV, multiLine=True).csv(path).select("cluster", "url", "archive_timestamp", "source_file", "text_en_preview")


@register("preview", f"WITH {translated_ctes()} SELECT url, translate(substring(coalesce(nullif(text_en, ''), text_src), 1, 200), chr(10), ' ') AS preview FROM tr")
def q_preview(spark, d):
    """200-character preview of the translation, else the source text."""
    return translated(spark, d).select("url", preview_col(F.col("text_en"), F.col("text_src"), 200).alias("preview"))


@register("write_translation_cache", f"WITH {translated_ctes()} SELECT src_sha1, text_out, true AS ok FROM newt")
def q_write_translation_cache(spark, d):
    """Only the newly translated keys are appended to the cache, then read back."""
    from ..sinks.writers import append_cache
    from ..sources.readers import load_cache
    arts = articles(spark, d)
    _, new = translate(arts, article_cache(arts), dictionary=X.dictionary())
    path = scratch_path(spark, "cache_new")
    append_cache(new, path)
    return load_cache(spark, path)


@register("ctfidf", topics_sql("SELECT cls AS cluster, term, weight, cast(rank AS INTEGER) AS rank FROM kw"))
def q_ctfidf(spark, d):
    """C-TF-IDF top-30 terms per topic of the cluster plan (translated text)."""
    res = _topics(spark, d)
    toks = tokenise(res.articles, "text_en", keep=("cluster",))
    return ctfidf(toks, "cluster", 30).select("cluster", "term", "weight", F.col("rank").cast("int").alias("rank"))


@register("summary_order", topics_sql("""SELECT id, cast(row_number() OVER (ORDER BY id = -1, size DESC, id) - 1 AS INTEGER) AS summary_rank
FROM topics"""))
def q_summary_order(spark, d):
    """topic order in the summary: outliers last, then size descending."""
    s = topic_summary(_topics(spark, d).topics).select("id", "is_outlier", (-F.col("size")).alias("_neg"))
    return dense_rank_ids(s, ["is_outlier", "_neg", "id"], "summary_rank").select("id", "summary_rank")


@register("csv_order", topics_sql("""SELECT url, cast(row_number() OVER (ORDER BY cluster, coalesce(archive_timestamp, ''), article_id) - 1 AS INTEGER) AS csv_rank
FROM lt"""))
def q_csv_order(spark, d):
    """CSV row order (cluster, timestamp or ''), so -1 comes first."""
    a = _topics(spark, d).articles.select("url", "cluster", "article_id",
                                          F.coalesce("archive_timestamp", F.lit("")).alias("_ts"))
    return dense_rank_ids(a, ["cluster", "_ts", "article_id"], "csv_rank").select("url", "csv_rank")
