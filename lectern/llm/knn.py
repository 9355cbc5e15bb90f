"""Exact top-k by integer inner product: a Voronoi join.

Rows are dealt to the cells of pivots. Queries form groups of neighbouring cells; for each group and cell a bound is
derived from the pivots, and of a cell's rows only those that the bound cannot rule out are sent to the group, where
they are scored in blocks. With unit-like vectors of many dimensions the bound rules out little and the join is then
a blocked scan of all rows for each group of queries; it never depends on the data for being exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import keep

#: Most pivots, queries in a group, data rows in a chunk, least chunks of a group.
PIVOTS, GROUP, CHUNK, CHUNKS = 128, 512, 20_000, 64


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as array<bigint>; null if the vector is null or has a null, NaN or infinite one."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(vector.isNotNull() & whole, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _assign(pivots: np.ndarray):
    width, squares = pivots.shape[1], (pivots**2).sum(1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            m = _matrix(batch["v"], width)
            d2 = np.maximum((m**2).sum(1)[:, None] - 2 * m @ pivots.T + squares, 0)
            cell = d2.argmin(1) if len(m) else np.empty(0, int)
            yield batch.assign(cell=cell.astype("int32"), far=np.sqrt(d2[np.arange(len(m)), cell]))

    return run


def _bounds(pivots: np.ndarray, pivot_ids: np.ndarray, k: int):
    """Per group and cell the least distance from the pivot from which on a row may be among a query's best k."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            q = _matrix(batch["v"], pivots.shape[1])
            scores = q @ pivots.T
            others = np.where(batch["vec_id"].to_numpy()[:, None] == pivot_ids, -np.inf, scores)
            floor = np.sort(others, 1)[:, -k] if others.shape[1] >= k else np.full(len(q), -np.inf)
            norm = np.sqrt((q**2).sum(1))[:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where(norm > 0, (floor[:, None] - scores) / norm, -np.inf)
            least = pd.DataFrame(least).groupby(batch["group"].to_numpy()).min()
            yield pd.DataFrame({
                "group": np.repeat(least.index.to_numpy(), least.shape[1]), "cell": np.tile(np.arange(least.shape[1]), len(least)), "least": least.to_numpy().ravel(),
            })

    return run


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _solve(k: int):
    def run(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(queries) and len(rows):
            width = max(queries["v"].map(len).max(), rows["v"].map(len).max())
            q, m = _matrix(queries["v"], width), _matrix(rows["v"], width)
            ids = rows["vec_id"].to_numpy()
            exact = np.abs(q).max() * np.abs(m).max() * width < 2**53
            if not exact:
                q, m = q.astype(np.int64), m.astype(np.int64)
            for lo in range(0, len(q), 64):
                block = (q[lo : lo + 64] @ m.T).astype(np.int64)
                for own, scores in zip(queries["vec_id"].to_numpy()[lo : lo + 64], block):
                    best = _top(scores, ids, k + 1)  # one more, as the query's own row may be among them
                    best = best[ids[best] != own][:k] if (ids[best] == own).sum() <= 1 else _top(scores[ids != own], ids[ids != own], k)
                    if (ids == own).sum() > 1:
                        keepers = np.flatnonzero(ids != own)
                        best = keepers[_top(scores[keepers], ids[keepers], k)]
                    out += [(own, ids[i], scores[i]) for i in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of ``vectors(vec_id, embedding)`` that ``is_query`` marks its
    k highest integer inner products with rows of another vec_id, ties to the smaller vec_id; all, if fewer.

    Components become floor(scale * x). Vectors that are null or hold null or non-finite components, and rows with a
    null id, take no part; missing trailing components count as 0. Of repeated rows (one id and vector) one counts.
    An empty table gives no rows. The pivots, at most PIVOTS, and the number of queries in each cell reach the driver.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), scale).alias("v")).where("vec_id is not null and v is not null").distinct()
    rows = keep(rows, "vectors")
    n = rows.count()
    empty = "query_id long, rank int, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], empty)
    first = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(PIVOTS, int(n**0.5)))).collect()
    width = max(1, rows.agg(F.max(F.size("v"))).first()[0])
    pivots, pivot_ids = np.zeros((len(first), width)), np.array([r[0] for r in first])
    for i, r in enumerate(first):
        pivots[i, : len(r[1])] = r[1]
    celled = keep(rows.mapInPandas(_assign(pivots), "vec_id long, v array<bigint>, cell int, far double"), "cells")
    queries = celled.where(is_query)
    per_cell = {r[0]: r[1] for r in queries.groupBy("cell").count().collect()}
    # cells in an order in which neighbours follow one another, cut into groups; a cell with many queries is several groups
    order, left = [0], set(range(1, len(pivots)))
    while left:
        at = min(left, key=lambda j: (((pivots[j] - pivots[order[-1]]) ** 2).sum(), j))
        order.append(at)
        left.discard(at)
    groups, number, held = [], 0, 0
    for c in order:
        q = per_cell.get(c, 0)
        if not q:
            continue
        if held and held + q > GROUP:
            number, held = number + 1, 0
        parts = -(-q // GROUP)
        groups.append((c, number, parts))
        number, held = (number + parts, 0) if parts > 1 else (number, held + q)
    if not groups:
        return spark.createDataFrame([], empty)
    of = F.broadcast(spark.createDataFrame(groups, "cell int, first int, parts int"))  # a row per pivot at most
    grouped = queries.join(of, "cell").select("vec_id", "v", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int").alias("group"))
    grouped = keep(grouped, "groups")
    bounds = keep(grouped.mapInPandas(_bounds(pivots, pivot_ids, k), "group int, cell int, least double").groupBy("cell", "group").agg(F.min("least").alias("least")), "bounds")
    chunks = max(CHUNKS, -(-n // CHUNK))
    sent = celled.join(bounds, "cell").where(F.col("far") >= F.col("least") - 1e-6 * (1 + F.abs("least"))).select("group", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).alias("chunk"), "vec_id", "v")
    asked = grouped.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    solved = asked.groupBy("group", "chunk").cogroup(sent.groupBy("group", "chunk")).applyInPandas(_solve(k), "query_id long, vec_id long, score long")
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))), 1, k)  # k rows a chunk
    return solved.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("pos", "b")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.minus")).alias("score")
    )


#: DuckDB SQL for ``top_k`` with k = 5, scale 256 and every fiftieth vector as a query: all queries against all rows.
ORACLE = """
WITH rows AS MATERIALIZED (
    SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, r.vec_id, CAST(list_inner_product(q.v, r.v) AS BIGINT) AS score
    FROM rows q JOIN rows r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
QUALIFY rank <= 5
"""
