"""Sources and sinks with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECTIONS = T.StructType([
    T.StructField("file_path", T.StringType()), T.StructField("file_name", T.StringType()), T.StructField("file_type", T.StringType()),
    T.StructField("page_number", T.IntegerType()), T.StructField("section", T.StringType()), T.StructField("text", T.StringType()),
])
ATTEMPTS = "student bigint, topic string, step int, score double, d int, q int"
COURSES = "Title string, URL string, `Short Intro` string, Skills string, Language string"


def scan_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("txt", "md", "json", "csv")) -> DataFrame:
    """path, extension, length of files below ``path`` with the wanted extensions; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.select("path", ext.alias("extension"), "length").where(F.col("extension").isin(*extensions))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text: each file a row."""
    return spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


#: Why a record is no section; the first that holds is given.
MALFORMED, NO_FILE, NO_TEXT, BAD_PAGE = "malformed", "no file path", "no text", "bad page number"


def contract_records(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The columns of ``SECTIONS`` with ``record`` (the whole record as JSON, or as it stood) and ``reason`` (null where
    the record keeps the contract).

    JSON lines that can't be read, and values that can't be cast to their declared type, are malformed. Columns that
    files lack are null, further ones are in ``record`` alone. A section needs a file path and a text (empty is a text),
    and no page number below 0.
    """
    if fmt == "json":
        schema = T.StructType([*[T.StructField(f.name, T.StringType()) for f in SECTIONS], T.StructField("__bad", T.StringType())])
        lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("r"))
        raw = lines.select("r.*", F.col("value").alias("record")).withColumn("__bad", F.col("__bad").isNotNull())
    else:
        raw = spark.read.format(fmt).option("mergeSchema", "true").load(path)
        raw = raw.select("*", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"), F.lit(False).alias("__bad"))
    have = set(raw.columns)
    source = {f.name: F.col(f.name) if f.name in have else F.lit(None) for f in SECTIONS}
    cast = {f.name: source[f.name].try_cast(f.dataType) for f in SECTIONS}
    bad = F.col("__bad")
    for name in cast:
        bad = bad | (source[name].isNotNull() & cast[name].isNull())
    reason = (
        F.when(bad, MALFORMED).when(F.trim(F.coalesce(cast["file_path"], F.lit(""))) == "", NO_FILE).when(cast["text"].isNull(), NO_TEXT).when(cast["page_number"] < 0, BAD_PAGE)
    )
    return raw.select(*[c.alias(n) for n, c in cast.items()], "record", reason.alias("reason"))


def section_table(spark: SparkSession, path: str, fmt: str = "parquet", quarantine: str | None = None) -> DataFrame:
    """The sections of the files that keep the contract. Other records are appended to ``quarantine`` as record, reason
    and path; without such a folder they are an error, so that none is lost silently."""
    records = contract_records(spark, path, fmt)
    rejected = records.where("reason is not null").select("record", "reason", F.lit(path).alias("path"))
    if quarantine:
        rejected.write.mode("append").parquet(quarantine)
    elif first := rejected.first():
        raise ValueError(f"{path} holds records that are no sections: {first['reason']}: {first['record'][:200]}")
    return records.where("reason is null").select(*SECTIONS.names)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"')


def write_csv(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).csv(path, header=True, escape='"')


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)
