"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import star_components as connected_components  # noqa: F401 (for the operators)
from ..operators.joins import hot_join, merge_labels  # noqa: F401
from ..session import ensure_checkpoint_dir, scratch_path

def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame) -> dict:
    """The columns of a table of bounded size as arrays, sent to the driver as Arrow batches."""
    got = df.toArrow()
    return {name: got[name].to_numpy() for name in got.column_names}


def crc_mod(id_col: str, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod`` (null id: null)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % mod
