"""Sources: URL lists (A1, A2), CDX JSON payloads (A3), finding documents (A4),
the checked ledger (A5) and the translation cache (A6).

Every read names its schema: no inference pass, stable schemas for streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import markdown_to_plain
from ..operators.selection import clean_url_lines
from ..schemas import CACHE_SCHEMA, FINDING_SCHEMA, LEDGER_SCHEMA


def read_url_list(spark: SparkSession, paths, distinct: bool = False) -> DataFrame:
    """A1 / A2: one URL per line from one or many text files (a glob works too).

    Lines are stripped of any Unicode whitespace, blanks dropped; duplicates
    are kept (a URL listed in three month files is three entries) unless
    ``distinct``.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    lines = spark.read.text(paths)
    urls = clean_url_lines(lines)
    return urls.dropDuplicates(["url"]) if distinct else urls


CDX_JSON = T.ArrayType(T.ArrayType(T.StringType()))


def decode_cdx_payload(payloads: DataFrame, col: str = "payload", keep=("request",)) -> DataFrame:
    """A3: JSON array-of-arrays (row 0 = header) into one row per data row.

    Empty, header-only and malformed payloads yield no rows. Fields are taken
    by the header's names, so column order in the payload does not matter.
    Output keeps the ``keep`` columns and adds ``row_pos`` (1-based data row).
    """
    v = F.from_json(F.col(col), CDX_JSON)
    kept = [c for c in keep if c in payloads.columns]
    p = payloads.select(*kept, v.alias("_v")).filter(F.size("_v") >= 2)
    rows = p.select(*kept, F.col("_v")[0].alias("_hdr"),
                    F.posexplode(F.slice("_v", 2, F.size("_v") - 1)).alias("row_pos", "_row"))

    def field(name):
        # Position of the field in the header (0 if absent -> index -1 -> null);
        # ``get`` returns null past the end of a short row instead of failing.
        return F.get(F.col("_row"), F.array_position(F.col("_hdr"), F.lit(name)).cast("int") - 1)

    return rows.select(*kept, (F.col("row_pos") + 1).alias("row_pos"),
                       field("timestamp").alias("ts14"), field("statuscode").alias("statuscode"),
                       field("digest").alias("digest"), field("original").alias("original"))


def load_findings(spark: SparkSession, path: str, verdict: str = "deleted", multiline: bool = False,
                  file_glob: str | None = None) -> DataFrame:
    """A4 (+ H7): finding documents with extractable archive text, as articles.

    Malformed documents are skipped (PERMISSIVE mode, ``_corrupt_record`` set),
    as are other verdicts and empty archive text. ``multiline`` reads one
    pretty-printed document per file (the reference's layout; set
    ``file_glob='deleted_*.json'`` for its names); the default reads JSON lines.
    """
    schema = FINDING_SCHEMA.add(T.StructField("_corrupt_record", T.StringType()))
    r = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    if multiline:
        r = r.option("multiLine", True)
    if file_glob:
        r = r.option("pathGlobFilter", file_glob)
    df = r.json(path).select("*", F.col("_metadata.file_path").alias("source_file"))
    ok = (F.col("_corrupt_record").isNull() & (F.col("verdict") == verdict)
          & F.col("archive.text").isNotNull() & (F.col("archive.text") != ""))
    return df.filter(ok).select(
        "source_file", "url",
        F.col("archive.url").alias("archive_url"),
        F.col("archive.timestamp").alias("archive_timestamp"),
        markdown_to_plain(F.col("archive.text")).alias("text_src"),
    )


def load_checked(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A5: distinct checked URLs; a missing ledger is an empty frame of the same schema.

    ``fmt='text'`` reads the reference's one-URL-per-line file.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], "url string")
    if fmt == "text":
        return read_url_list(spark, path).dropDuplicates(["url"])
    df = spark.read.schema(LEDGER_SCHEMA).parquet(path)
    clean = F.regexp_replace(F.col("url"), r"(?U)^\s+|\s+\z", "")
    return df.select(clean.alias("url")).filter(F.col("url") != "").dropDuplicates(["url"])


SHA1_HEX = r"^[0-9a-f]{40}$"


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    """The translation cache; rows with a malformed key are dropped (not the
    whole cache, as the reference does on any corruption). One row per key."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    df = spark.read.schema(CACHE_SCHEMA).parquet(path)
    good = df.filter(F.col("src_sha1").rlike(SHA1_HEX) & F.col("text_out").isNotNull())
    # A key written twice (retry after failure) keeps its successful entry.
    return good.groupBy("src_sha1").agg(
        F.max_by("text_out", F.col("ok").cast("int")).alias("text_out"), F.max("ok").alias("ok"))


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(jpath))
