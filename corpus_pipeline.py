"""Corpus pipeline: toxicity, language ID, SimHash near-dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it
kept and returns a DataFrame, which is written as Parquet and read again. All
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewatch.llm import bpe_codec, language_id, mixing, simhash, toxicity
from pagewatch.llm.common import crc_mod, read, write_table
from pagewatch.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MIN_SHARE = 0.4  # a document is kept if one language has at least this share of it


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under the threshold; learned from the labelled documents outside the held-out fold."""
    labels = read(spark, sf_dir, "labels").filter(crc_mod("doc_id", 4) != 2).select("doc_id", "toxic")
    model = toxicity.train(docs.select("doc_id", "text"), labels)
    return toxicity.score(docs.select(*COLUMNS), model, out="_toxicity").filter(F.col("_toxicity") < toxicity.THRESHOLD).select(*COLUMNS)


def reject_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters of which one language has at least MIN_SHARE; learned as op5 learns, from this stage's documents."""
    model = language_id.train(docs.filter(crc_mod("doc_id", 5) != 0).select("text", "lang"))
    known = language_id.identify(docs.select(*COLUMNS), model, out="_language")
    return known.filter((F.col("_language.lang") != language_id.UNKNOWN) & (F.col("_language.score") >= MIN_SHARE)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates."""
    return simhash.keep_one(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order: each document as often as it is taken, those not taken left out."""
    return mixing.curriculum(mixing.mix(docs.select(*COLUMNS))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids and of the decoded text of each document of the mix, with its place in training.

    The stage before wrote its rows range-sorted by position, file by file: (shard, row), the number of a row's file and
    its place in it, is the training order, and tells the takes of a document apart. Rows that come from no file have none.
    """
    try:
        docs = docs.select("doc_id", "text", F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("int").alias("shard"),
                           F.col("_metadata.row_index").alias("row"))
    except AnalysisException:  # no table of files
        docs = docs.select("doc_id", "text", F.lit(None).cast("int").alias("shard"), F.lit(None).cast("long").alias("row"))
    return bpe_codec.encode_decode_digests(docs, vocabulary("word_bpe_49k.json")).select("doc_id", "bpe.*", "shard", "row")


STAGES = [
    ("toxicity", reject_toxic),
    ("language_id", reject_unknown_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("curriculum_mix", mix_sources),
    ("bpe_codec", encode),
]

# The classifiers and the tokeniser have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
