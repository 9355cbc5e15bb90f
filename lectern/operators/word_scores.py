"""BM25 of a block of queries over all documents, without an index.

Documents are cut to words once for the frequencies and once for the scores. What is shuffled are counts of each task's
different words and the best documents of each task, so it does not grow with the pairs of queries and documents.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t
from ..sources.workspace import kept
from .products import _steps, best_places
from .retrieval import K1, B, term_idf, top_per_query

# the functions go to the workers as they are, so these need no copy of the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Queries of a block, at most: their words and weights go to all tasks.
BLOCK = 512


def best_bm25(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, score, rank (from 0) of the ``k`` highest scores of each of ``queries(query_id, query)``, BLOCK of
    them at most, over ``docs(doc_id, text)`` that hold a word of it; scores alike to nine places go to the least id.
    Repeated query words count again, null texts as empty. Ids are different numbers."""
    spark = docs.sparkSession
    words = docs.select("doc_id", t.tokens(F.lower(F.coalesce("text", F.lit("")))).alias("w")).select("doc_id", F.size("w").alias("n"), "w")
    # no word is empty: an empty one in each document counts the documents and their lengths in the same pass
    each = words.select("n", F.explode(F.concat(F.array(F.lit("")), F.array_distinct("w"))).alias("term"))
    counted = kept(each.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term") == "", F.col("n"))).alias("words")), "word-frequencies")
    stats = counted.where("term = ''").select(F.col("df").alias("docs"), (F.col("words") / F.col("df")).alias("mean_len"))
    asked = queries.select("query_id", F.explode(t.tokens(F.lower("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    idf = term_idf(counted.where("term <> ''").select("term", "df"), stats)
    weighed = idf.join(F.broadcast(asked), "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight")).collect()  # the words of a block
    ids = sorted({r["query_id"] for r in weighed})
    terms = sorted({r["term"] for r in weighed})
    of, at = {q: i for i, q in enumerate(ids)}, {w: i for i, w in enumerate(terms)}
    weights, holds = np.zeros((len(terms), len(ids))), np.zeros((len(terms), len(ids)), np.float32)
    for r in weighed:
        weights[at[r["term"]], of[r["query_id"]]], holds[at[r["term"]], of[r["query_id"]]] = r["weight"], 1
    mean = stats.first()
    given = spark.sparkContext.broadcast((ids, terms, weights, holds, mean["mean_len"] if mean else 0.0))
    own = words.select("doc_id", "n", F.filter("w", lambda w: w.isin(*terms)).alias("w")).where(F.size("w") > 0)
    shape = T.StructType([queries.schema["query_id"], docs.schema["doc_id"], T.StructField("score", T.DoubleType())])
    return top_per_query(own.mapInArrow(_best_of(given, k, shape), shape), k, [F.desc(F.round("score", 9)), F.asc("doc_id")])


def _best_of(given, k: int, shape: T.StructType):
    """The k best documents of each batch for each query that shares a word with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        ids, terms, weights, holds, mean = given.value
        schema = to_arrow_schema(shape)
        ids, terms = pa.array(ids, schema.types[0]), pa.array(terms, pa.string())
        for batch in batches:
            doc, n, w = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "n", "w"))
            place = pc.index_in(w.flatten(), value_set=terms).to_numpy(zero_copy_only=False)
            ends = np.insert(np.cumsum(pc.list_value_length(w).to_numpy(zero_copy_only=False)), 0, 0)
            row = np.repeat(np.arange(len(doc)), np.diff(ends))
            norm = K1 * (1 - B + B * n.to_numpy(zero_copy_only=False) / mean)
            score = np.empty((len(doc), len(ids)))
            for lo, hi in _steps(len(doc), len(terms)):
                part = slice(ends[lo], ends[hi])
                tf = np.bincount((row[part] - lo) * len(terms) + place[part], minlength=(hi - lo) * len(terms)).reshape(hi - lo, -1).astype(float)
                score[lo:hi] = (tf * (K1 + 1) / (tf + norm[lo:hi, None])) @ weights
                score[lo:hi][(tf > 0).astype(np.float32) @ holds == 0] = -np.inf
            keys = doc.to_numpy(zero_copy_only=False)
            for lo, hi in _steps(len(ids), len(doc)):
                best, query = best_places(score[:, lo:hi], keys, k)
                found = np.isfinite(score[best, query + lo])
                best, query = best[found], query[found] + lo
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(query)), doc.take(pa.array(best)), pa.array(score[best, query])], schema=schema)

    return run
