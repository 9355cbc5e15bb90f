"""Inverted index of words for BM25: postings kept by term, with document lengths and document frequencies beside them.

A corpus is cut to words once, when it is indexed or when documents are added; searches read the folders of their own
terms' buckets and the small tables of frequencies and lengths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..sources.workspace import workspace
from .retrieval import EPSILON, K1, B, postings, small

#: Buckets of terms; each is a folder. Characters of text whose words a task counts.
BUCKETS, TASK_CHARS = 32, 4_000_000
_POSTINGS, _DF, _LENGTHS = "doc_id {key}, term string, tf long, doc_len int, bucket int", "term string, df long", "doc_id {key}, doc_len int"


@dataclass(frozen=True)
class KeywordIndex:
    """A kept index; ``key`` is the type of doc_id. Every delivery of documents is a folder of its own below ``path``."""

    spark: SparkSession
    path: str
    key: str
    deliveries: tuple[str, ...] = ()

    def _read(self, part: str, schema: str) -> DataFrame:
        schema = schema.format(key=self.key)
        if not self.deliveries:
            return self.spark.createDataFrame([], schema)
        # each delivery is read by its own folder, so that the buckets stay partitions
        first, *more = [self.spark.read.schema(schema).parquet(f"{self.path}/{d}/{part}") for d in self.deliveries]
        for df in more:
            first = first.unionByName(df)
        return first

    @property
    def postings(self) -> DataFrame:
        """doc_id, term, tf, doc_len, bucket."""
        return self._read("postings", _POSTINGS)

    @property
    def lengths(self) -> DataFrame:
        return self._read("lengths", _LENGTHS)

    def statistics(self) -> DataFrame:
        """One row: number of documents and mean length."""
        return self.lengths.agg(F.count("*").alias("docs"), F.avg("doc_len").alias("mean_len"))

    def weights(self) -> DataFrame:
        """term, df, idf; a negative idf becomes EPSILON times the mean idf of all terms."""
        df = self._read("df", _DF)
        df = df.groupBy("term").agg(F.sum("df").alias("df")) if len(self.deliveries) > 1 else df
        raw = df.join(F.broadcast(self.statistics())).select("term", "df", (F.log(F.col("docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
        mean = raw.agg(F.avg("raw").alias("mean_idf"))
        return raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))

    def add(self, docs: DataFrame) -> KeywordIndex:
        """The index with ``docs(doc_id, text)`` too. Documents whose id it has already are passed over, so a delivery
        that comes again changes nothing; null texts count as empty, and of rows of one id the greatest text counts."""
        # tasks grow in number with the text, so that each counts the words of a bounded part; a document is in one of them
        chars = docs.agg(F.sum(F.length(F.coalesce("text", F.lit(""))) + 1)).first()[0] or 0
        dealt = docs.repartition(int(-(-chars // TASK_CHARS)) or 1, "doc_id")
        new = dealt.groupBy("doc_id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
        if self.deliveries:
            new = new.join(self.lengths.select("doc_id"), "doc_id", "left_anti")
        name = f"delivery-{len(self.deliveries)}"
        at = f"{self.path}/{name}"
        # a document without words has no posting, but counts: it is kept under no term
        words = new.select("doc_id", t.tokens(F.lower("text")).alias("w"))
        words.select("doc_id", F.size("w").alias("doc_len")).write.parquet(f"{at}/lengths")
        bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")
        posted = postings(new).select("doc_id", "term", "tf", "doc_len", bucket.alias("bucket"))
        # a hot term's postings are spread over tasks by document; files grow in number with the text
        spread = max(8, int(chars // (BUCKETS * TASK_CHARS)))
        posted.repartition(BUCKETS * spread, "bucket", F.pmod(F.xxhash64("doc_id"), F.lit(spread))).write.partitionBy("bucket").parquet(f"{at}/postings")
        grown = KeywordIndex(self.spark, self.path, self.key, (*self.deliveries, name))
        own = self.spark.read.schema(_POSTINGS.format(key=self.key)).parquet(f"{at}/postings")
        own.groupBy("term").agg(F.count("*").alias("df")).write.parquet(f"{at}/df")
        return grown

    def bm25(self, queries: DataFrame) -> DataFrame:
        """query_id, doc_id, score for queries(query_id, query). Repeated query words count again; only the buckets of the
        queries' terms are read."""
        asked = queries.select("query_id", F.explode(t.tokens(F.lower("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
        asked = asked.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
        weighed = asked.join(self.weights().select("term", "idf"), "term")
        hits = self.postings.join(small(weighed), ["bucket", "term"]).join(F.broadcast(self.statistics()))
        tf = F.col("tf")
        part = F.col("times") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("doc_len") / F.col("mean_len")))
        return hits.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def build_keyword_index(docs: DataFrame) -> KeywordIndex:
    """Index of ``docs(doc_id, text)``; an empty table gives an index that finds nothing."""
    spark = docs.sparkSession
    return KeywordIndex(spark, workspace(spark, "keyword-index"), docs.schema["doc_id"].dataType.simpleString()).add(docs)
