"""Tables kept between stages, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from spark.checkpoint.dir; a fresh local one where that is unset and
    the master is local."""
    context = spark.sparkContext
    path = spark.conf.get(_KEY, None) or context.getConf().get(_KEY) or getattr(context, "_lectern_folder", None)
    if not path:
        if not context.master.startswith("local"):
            raise ValueError(f"{_KEY} must name a folder that all executors share")
        # the session doesn't let this setting change any more
        path = context._lectern_folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return path.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs no more than the tasks that ran on it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lectern/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of the batches that go to Python; texts may be long, and these bound what a task holds at once.
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}
_DEFAULTS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "10000", "spark.sql.execution.arrow.maxBytesPerBatch": "67108864b"}


@contextmanager
def batches_of(spark: SparkSession, size: str) -> Iterator[None]:
    """Batches to Python of ``size`` bytes for the jobs that run inside."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once for each SparkContext."""
    context = spark.sparkContext
    for key, value in _BATCHES.items():
        if spark.conf.get(key, None) in (None, _DEFAULTS[key]):
            spark.conf.set(key, value)
    if not getattr(context, "_lectern_shipped", False):
        top = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="spark-")) / "lectern.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        context.addPyFile(str(archive))
        context._lectern_shipped = True
