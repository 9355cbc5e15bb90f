"""Keyed tables that a stream updates: files by bucket of the key, and a manifest of versions that names them."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One row for each bucket of each version; every version is one file, so it is there as a whole or not at all.
MANIFEST = "version long, epoch long, bucket int, folder string"


def _manifest(spark: SparkSession, target: str) -> DataFrame:
    try:
        return spark.read.schema(MANIFEST).parquet(f"{target}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def versions(spark: SparkSession, target: str) -> DataFrame:
    """version, epoch, buckets: what was committed."""
    return _manifest(spark, target).groupBy("version", "epoch").agg(F.count("*").alias("buckets"))


def _folders(spark: SparkSession, target: str, version: int | None = None) -> tuple[int, int, dict[int, str]]:
    """Number and epoch of a version, the latest if none is named, and the folder of each bucket: at most ``buckets`` rows."""
    m = _manifest(spark, target)
    top = m.agg(F.max("version")).first()[0] if version is None else version
    rows = [] if top is None else m.where(F.col("version") == top).collect()
    return (rows[0]["version"], rows[0]["epoch"], {r["bucket"]: r["folder"] for r in rows}) if rows else (-1, -1, {})


def read_version(spark: SparkSession, target: str, schema: T.StructType, version: int | None = None) -> DataFrame:
    """The table as the latest version, or the one named, has it; no rows before the first one."""
    _, _, folders = _folders(spark, target, version)
    return spark.read.schema(schema).parquet(*folders.values()) if folders else spark.createDataFrame([], schema)


def apply_batch(batch: DataFrame, epoch: int, key: str, target: str, buckets: int = 64, order: str | None = None) -> None:
    """Commit a micro-batch: of each key the row of the highest ``order`` (then the greatest row) replaces what was there.

    Only buckets with keys of the batch are read and written anew. A batch whose epoch was committed before is a replay
    and changes nothing; files of a batch that failed before its commit are named by no version. One stream writes to a
    target. Rows without a key are kept as one row. ``buckets`` may not change.
    """
    spark = batch.sparkSession
    version, done, folders = _folders(spark, target)
    if epoch <= done:
        return
    schema, bucket = batch.schema, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    row = F.struct((F.col(order) if order else F.lit(0)).alias("first"), F.struct(*schema.names).alias("row"))
    new = batch.groupBy(F.col(key).alias("__key")).agg(F.max(row).alias("__row")).select(*[F.col("__row.row")[c].alias(c) for c in schema.names])
    touched = [r[0] for r in batch.select(bucket.alias("b")).distinct().collect()]
    if not touched:
        return
    held = [folders[b] for b in touched if b in folders]
    both = new.withColumn("__new", F.lit(1))
    if held:
        both = both.unionByName(spark.read.schema(schema).parquet(*held).withColumn("__new", F.lit(0)))
    last = both.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*schema.names), "__new").alias("__row"))
    folder = f"{target}/data/{uuid.uuid4().hex}"
    out = last.select(*[F.col("__row")[c].alias(c) for c in schema.names]).withColumn("__bucket", bucket)
    out.repartition(min(len(touched), buckets), "__bucket").write.partitionBy("__bucket").parquet(folder)
    now = {**folders, **{b: f"{folder}/__bucket={b}" for b in touched}}
    rows = [(version + 1, epoch, b, f) for b, f in sorted(now.items())]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{target}/manifest")


def upsert_stream(stream: DataFrame, key: str, target: str, checkpoint: str, buckets: int = 64, order: str | None = None):
    """Keep the latest row of each key of a stream in ``target``; read it with ``read_version``."""
    write = lambda batch, epoch: apply_batch(batch, epoch, key, target, buckets, order)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unused(spark: SparkSession, target: str, keep: int = 1) -> list[str]:
    """Bucket folders that only versions before the last ``keep`` name."""
    m = _manifest(spark, target)
    top = m.agg(F.max("version").alias("top"))
    marked = m.join(F.broadcast(top)).withColumn("live", F.col("version") > F.col("top") - keep)
    return [r["folder"] for r in marked.groupBy("folder").agg(F.max("live").alias("live")).where("not live").collect()]


def remove_unused(spark: SparkSession, target: str, keep: int = 1) -> int:
    """Delete those folders; versions older than the last ``keep`` can then no longer be read. Run it while no reader
    needs them."""
    conf, n = spark.sparkContext._jsc.hadoopConfiguration(), 0
    for folder in unused(spark, target, keep):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n
