"""Registered queries of the training-data operators and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, scratch_path
from . import (
    ann, bpe_codec, centroid_clusters, conversation_repair, embedding_dedup, exact_topk, language_id, lm_scoring, mixing, simhash, token_counts, toxicity, warc)
from .common import crc_mod, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_checkpoint_dir(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn
    return deco


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op1_lm_scoring")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    models = lm_scoring.train(docs, read(spark, sf_dir, "benchmark").select("text"))
    return lm_scoring.score(docs, models).select("doc_id", "lm.*")


@register("op2_bpe_codec")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_codec.encode_decode_digests(docs, vocabulary("word_bpe_49k.json")).select("doc_id", "bpe.*")


@register("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, vocabulary("byte_bpe_50k.json"), keep=["doc_id"])
    return counted.select("row.doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > token_counts.LIMIT).alias("over_limit"))


WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
     d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
     o AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS owner FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 100 OR owner = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes < 100 OR owner = page_id THEN NULL ELSE owner END AS refers_to
FROM o
"""


@register("op4_warc", WARC_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    warc.write_warc(read(spark, sf_dir, "pages"), folder)
    records = warc.read_warc(spark, folder)
    bad = F.raise_error(F.concat(F.lit("record does not match its digest: "), "file", F.lit(" "), F.col("offset").cast("string")))
    return records.select("page_id", "payload_bytes", F.when(F.col("valid"), F.col("payload_digest")).otherwise(bad).alias("payload_digest"),
                          "record_type", "refers_to")


@register("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    model = language_id.train(docs.filter(crc_mod("doc_id", 5) != 0))
    return (language_id.identify(docs.select("doc_id", "text", held.alias("held_out")), model)
            .select("doc_id", "held_out", F.col("language.lang").alias("lang_pred"), "language.score"))


@register("op6_simhash")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").filter(crc_mod("doc_id", 4) != 2).select("doc_id", "toxic")
    model = toxicity.train(docs, labels)
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    scored = toxicity.score(docs.select("doc_id", "text", held.alias("held_out")), model, out="score")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@register("op8_nearest_neighbours")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = ann.search(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@register("op10_embedding_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


MIX_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         CASE WHEN doc_id IS NULL THEN '' ELSE md5(doc_id::VARCHAR) END AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT source, source_size, r, ((r - 1) % 3 + 1)::DOUBLE AS weight, (source_size * 3)::DOUBLE AS cap,
             CASE (r - 1) % 3 WHEN 0 THEN -0.5 WHEN 1 THEN 0.0 ELSE 0.5 END::DOUBLE AS slope FROM s),
-- Targets as they are told: share what is left by weight, fix what is above its cap, share again.
fill(step, source, target, fixed) AS (
  SELECT 0, source, 0.0::DOUBLE, false FROM w
  UNION ALL
  SELECT step + 1, source, CASE WHEN fixed THEN target WHEN share > cap THEN cap ELSE share END, fixed OR share > cap
  FROM (SELECT f.step, w.source, f.target, f.fixed, w.cap,
               ((SELECT sum(source_size) FROM w)::DOUBLE - sum(CASE WHEN f.fixed THEN f.target ELSE 0 END) OVER ()) * w.weight
                 / sum(CASE WHEN f.fixed THEN 0 ELSE w.weight END) OVER () AS share
        FROM fill f JOIN w ON f.source IS NOT DISTINCT FROM w.source
        WHERE f.step < (SELECT count(*) FROM w))),
t AS (SELECT w.*, f.target, floor(f.target + 0.5)::BIGINT AS wanted
      FROM w JOIN fill f ON f.source IS NOT DISTINCT FROM w.source WHERE f.step = (SELECT count(*) FROM w)),
p AS (SELECT d.doc_id, d.size, t.*, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, (least(greatest(wanted - start, 0), size) + least(greatest(wanted - source_size - start, 0), size)
                 + least(greatest(wanted - 2 * source_size - start, 0), size))::BIGINT AS taken,
             start::DOUBLE / wanted::DOUBLE AS frac, 1.0::DOUBLE - slope AS base FROM p)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN round(2.0 * frac / (base + sqrt(base * base + 4.0 * slope * frac)), 9) END AS first_position
FROM x
"""


@register("op9_curriculum_mix", MIX_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    first = F.when(F.col("taken") > 0, F.round(mixing.position(F.lit(0)), 9))
    return (mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", first.alias("first_position"))
            .orderBy(F.col("first_position").asc_nulls_last(), "doc_id"))


CENTROID_ROUNDS = "".join(f"""
a{i} AS (SELECT r, unnest(arg_min({{'c': cluster, 'd': d}}, (d, cluster)), recursive := true)
       FROM (SELECT v.r, c.cluster, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM v JOIN c{i} c USING (p) GROUP BY v.r, c.cluster) GROUP BY r),
m{i} AS (SELECT a.c AS cluster, v.p, sum(v.x)::BIGINT AS s, count(*)::BIGINT AS n FROM v JOIN a{i} a USING (r) GROUP BY a.c, v.p),
c{i + 1} AS (SELECT c.cluster, c.p, CASE WHEN n IS NULL THEN c.x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{i} c LEFT JOIN m{i} m USING (cluster, p)),""" for i in range(3))
CENTROID_SQL = f"""
WITH e AS (SELECT vec_id, row_number() OVER () AS r, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS x
           FROM embeddings WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64),
f AS (SELECT r, row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR) NULLS LAST, x) - 1 AS cluster FROM e),
v AS (SELECT r, unnest(x) AS x, generate_subscripts(x, 1) AS p FROM e),
c0 AS (SELECT f.cluster, v.p, v.x FROM f JOIN v USING (r) WHERE f.cluster < 16),{CENTROID_ROUNDS}
a3 AS (SELECT r, unnest(arg_min({{'c': cluster, 'd': d}}, (d, cluster)), recursive := true)
       FROM (SELECT v.r, c.cluster, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM v JOIN c3 c USING (p) GROUP BY v.r, c.cluster) GROUP BY r),
h AS (SELECT cluster, sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY p)) AS centroid_sha256 FROM c3 GROUP BY cluster)
SELECT e.vec_id, a.c::INT AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
       (sum(a.d) OVER ())::BIGINT AS inertia, h.centroid_sha256
FROM e JOIN a3 a USING (r) JOIN h ON h.cluster = a.c
"""


@register("op12_centroid_clusters", CENTROID_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = centroid_clusters.cluster(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    numbers = F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",").cast("binary")
    of = centroids.select("cluster", F.col("inertia").alias("cluster_inertia"), F.sha2(numbers, 256).alias("centroid_sha256"))
    total = centroids.agg(F.sum("inertia").alias("inertia"))
    found = found.join(F.broadcast(of), "cluster").join(F.broadcast(total))  # a row a centroid, and one row
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


TOPK_SQL = """
WITH v AS (SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)),
e AS (SELECT vec_id, row_number() OVER () AS r, len(x) AS n, unnest(x) AS x, generate_subscripts(x, 1) AS p FROM v),
s AS (SELECT q.vec_id AS query_id, d.vec_id, q.r, d.r AS dr, sum(q.x * d.x)::BIGINT AS score
      FROM e q JOIN e d ON q.p = d.p AND q.n = d.n AND q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0 GROUP BY ALL),
b AS (SELECT query_id, vec_id, max(score) AS score FROM s GROUP BY ALL)
SELECT query_id, (row_number() OVER w)::INT AS rank, vec_id, score FROM b
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 10
"""


@register("op13_exact_topk", TOPK_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = exact_topk.search(vectors, vectors.filter(F.col("vec_id") % 100 == 0), k=10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


REPAIR_SQL = r"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
z AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], [ord(c)::BIGINT FOR c IN string_split(key, '')]), lambda crc, b:
             list_reduce(list_concat([xor(crc, b)], [0::BIGINT FOR i IN range(8)]), lambda x, i:
               CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 20 AS kind FROM k),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                   unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM z),
r0 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
r1 AS (SELECT *, left(role, 1) AS x, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
              CASE WHEN rtrim(text, E' \t\n\x0b\x0c\r') = '' THEN 'blank'
                   WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                   WHEN right(rtrim(text, E' \t\n\x0b\x0c\r'), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM r0),
counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
                  count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                  count(*) FILTER (fault = 'truncated') AS truncated,
                  count(*) FILTER (before IS NOT NULL AND before || x NOT IN ('su', 'ua', 'au')) AS illegal FROM r1 GROUP BY conv_id),
next(q, x, q2) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
moves AS (SELECT '-' AS op, q, '' AS x, q AS q2, 0 AS price FROM range(4) t(q) UNION ALL SELECT 'D', q, '', q, 4 FROM range(4) t(q)
          UNION ALL SELECT 'K', q, x, q2, 0 FROM next UNION ALL SELECT 'R', q, x, q2, 3 FROM next WHERE x <> 's'
          UNION ALL SELECT 'I', q, x, q2, 3 FROM next WHERE x <> 's'),
-- Three steps a row: two insertions at most, then the row's own edit; after the last row two more insertions.
place(conv_id, n, t, q, cost, audit) AS (
  SELECT conv_id, n, 0, 0::BIGINT, 0::BIGINT, '' FROM counts
  UNION ALL
  SELECT conv_id, n, t, q, cost, audit FROM (
    SELECT p.conv_id, p.n, p.t + 1 AS t, m.q2 AS q, p.audit || CASE m.op WHEN '-' THEN '' ELSE m.op END AS audit,
           p.cost + m.price + CASE WHEN m.op IN ('K', 'R') AND r.fault = 'truncated' THEN 3 ELSE 0 END AS cost
    FROM place p JOIN moves m ON m.q = p.q
    LEFT JOIN r1 r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND p.t % 3 = 2 AND r.i = p.t // 3 + 1
    WHERE p.t < 3 * p.n + 2 AND CASE WHEN p.t % 3 < 2 THEN m.op IN ('-', 'I')
          ELSE m.op = 'D' OR (r.fault IN ('', 'truncated') AND (m.op = 'R' OR (m.op = 'K' AND m.x = r.x))) END)
  QUALIFY row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) = 1),
best AS (SELECT conv_id, cost, audit FROM place WHERE t = 3 * n + 2 AND q IN (0, 3)
         QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1),
letters AS (SELECT conv_id, j, substr(audit, j, 1) AS op FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM best)),
numbered AS (SELECT *, count(*) FILTER (op <> 'I') OVER w AS i, count(*) FILTER (op <> 'D') OVER w AS o FROM letters
             WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
said AS (SELECT l.conv_id, l.j, l.o, l.op, r.role, CASE WHEN l.op = 'I' THEN '' ELSE r.text END AS text,
                max(CASE WHEN l.o = 1 AND l.op = 'K' AND r.x = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS s
         FROM numbered l LEFT JOIN r1 r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = l.i AND l.op <> 'I' WHERE l.op <> 'D'),
lines AS (SELECT conv_id, string_agg(CASE WHEN op = 'K' THEN role WHEN (o - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j) AS t
          FROM said GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM ids LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


@register("op11_conversation_repair", REPAIR_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversation_repair.damage(read(spark, sf_dir, "conversations"))
    return conversation_digests(conversation_repair.repair(damaged, copies=F.col("copies")))


def conversation_digests(repaired: conversation_repair.Repaired) -> DataFrame:
    """Counts, audit and SHA-256 of the repaired lines of each conversation; lines of cut conversations are digested part by part."""
    rows = repaired.conversations
    lines = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    whole = rows.filter("repaired IS NOT NULL").withColumn("repaired_sha256", F.sha2(lines.cast("binary"), 256)).drop("repaired")
    parts = conversation_repair.sha256_of_parts(repaired.parts).select(F.col("conv").alias("_conv"), F.col("sha256").alias("repaired_sha256"))
    cut = rows.filter("repaired IS NULL").drop("repaired")
    cut = cut.join(parts, cut["conv"].eqNullSafe(parts["_conv"]), "left").drop("_conv")
    return whole.unionByName(cut).withColumnRenamed("conv", "conv_id")


@register("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
