"""Tables that a stream adds to, batch by batch, and that are folded while it lives.

``sink/updates/batch_id=n`` holds what batch n wrote; a replayed batch
overwrites its own partition. A compaction folds the last base and all batches
up to some n into a new base and commits it by a manifest, a folder that counts
once Spark's _SUCCESS file is in it. Readers take the newest manifest's base and the
batches after its n, so they see each row once, before, during and after a compaction,
and the stream goes on writing where it wrote.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "base string, upto long"


def write_batch(df: DataFrame, batch_id: int, sink: str) -> None:
    """Rows of one batch into its partition of ``sink``, exactly once however often the batch is replayed."""
    (df.withColumn("batch_id", F.lit(batch_id).cast("long"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(f"{sink}/updates"))


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders under ``path``, none if it is not there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def _committed(spark: SparkSession, sink: str) -> list[str]:
    """Names of the manifests that count, oldest first."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = p(sink).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [m for m in _folders(spark, f"{sink}/manifests") if fs.exists(p(f"{sink}/manifests/{m}/_SUCCESS"))]


def _manifest(spark: SparkSession, sink: str, name: str):
    return spark.read.schema(MANIFEST).json(f"{sink}/manifests/{name}").first()


def _batches(spark: SparkSession, sink: str) -> list[int]:
    return sorted(int(f.removeprefix("batch_id=")) for f in _folders(spark, f"{sink}/updates") if f.startswith("batch_id="))


def read(spark: SparkSession, sink: str, schema: str, before: int | None = None) -> DataFrame:
    """The newest base and the batches after it (those with an id under ``before``, if given); ``schema`` without batch_id."""
    whole = f"{schema}, batch_id long"
    names = _committed(spark, sink)
    base = _manifest(spark, sink, names[-1]) if names else None
    upto = base["upto"] if base else -1
    later = [b for b in _batches(spark, sink) if b > upto and (before is None or b < before)]
    out = spark.read.schema(whole).parquet(base["base"]) if base else spark.createDataFrame([], whole)
    if later:
        rows = spark.read.schema(whole).option("basePath", f"{sink}/updates").parquet(*[f"{sink}/updates/batch_id={b}" for b in later])
        out = rows if base is None else out.unionByName(rows)
    return out


def compact(spark: SparkSession, sink: str, schema: str, fold: Callable[[DataFrame], DataFrame]) -> int:
    """Fold everything up to the newest batch into a new base; the id of that batch, -1 if there is nothing to fold.

    ``fold`` gives rows of the same columns, batch_id among them. A compaction that dies leaves no manifest and so no trace.
    """
    batches = _batches(spark, sink)
    names = _committed(spark, sink)
    upto = max([_manifest(spark, sink, names[-1])["upto"] if names else -1, *batches[-1:]])
    if upto < 0:
        return upto
    base = f"{sink}/bases/{uuid.uuid4().hex}"
    fold(read(spark, sink, schema, before=upto + 1)).write.parquet(base)
    no = int(names[-1]) + 1 if names else 0
    spark.createDataFrame([(base, upto)], MANIFEST).coalesce(1).write.json(f"{sink}/manifests/{no:012d}")
    return upto


def vacuum(spark: SparkSession, sink: str, keep: int = 2) -> None:
    """Remove bases of all but the last ``keep`` manifests, and batches that the oldest of these has folded.

    Readers that began under an older manifest must have ended.
    """
    names = _committed(spark, sink)
    if len(names) < keep:
        return
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = p(sink).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    kept = [_manifest(spark, sink, n) for n in names[-keep:]]
    bases = {k["base"].rsplit("/", 1)[1] for k in kept}
    gone = [f"{sink}/bases/{b}" for b in _folders(spark, f"{sink}/bases") if b not in bases]
    gone += [f"{sink}/updates/batch_id={b}" for b in _batches(spark, sink) if b <= kept[0]["upto"]]
    gone += [f"{sink}/manifests/{n}" for n in names[:-keep]]
    for path in gone:
        fs.delete(p(path), True)
