"""Inverted-file index of vectors: rows kept by coarse cell, searched in the cells nearest to a query.

Centres are fitted on a bounded sample; every row is indexed. A search reads the folders of the cells that its queries
probe and no others, and scores the rows there exactly, a batch of rows at a time against the queries of its cell. How
many cells it takes to find a wanted share of the true neighbours is measured when the index is built, on sampled rows as
queries against all rows.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.workspace import workspace
from .products import CELLS as CELLS_HELD
from .products import best_places
from .retrieval import top_per_query

# the functions go to the workers as they are, so these need no copy of the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows on which centres are fitted, at most; most cells; rows that measure recall; share of true neighbours to find.
SAMPLE, CELLS, MEASURED, RECALL = 100_000, 4096, 200, 0.97
#: Queries of a block, on average: each block is sent to all tasks and reads its cells once. Rows of a cell's folder file.
QUERIES, FILE_ROWS = 4096, 200_000


def _distances(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all vectors to all centres."""
    return np.maximum((vectors**2).sum(1)[:, None] - 2 * vectors @ centres.T + (centres**2).sum(1), 0)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(len(column), -1)


@dataclass(frozen=True)
class VectorIndex:
    """A kept index. ``rows`` (key, embedding, cell) lie in folders by cell; ``radii`` are the cells' largest distances from
    their centres; ``probes`` cells found a share of ``recall`` of the measured rows' neighbours."""

    spark: SparkSession
    path: str
    schema: T.StructType
    key: str
    centres: np.ndarray = field(repr=False)
    radii: np.ndarray = field(repr=False)
    probes: int = 1
    recall: float = 1.0

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """``queries`` (query_id, query_vec, ...) with the key, ``score`` and ``rank`` (from 0) of the ``k`` highest inner
        products in their ``probes`` nearest cells; scores alike to nine places go to the least key. Query ids are
        different; queries of null vectors find nothing."""
        near = lambda ids, q: [np.argsort(d, kind="stable")[: probes or self.probes] for d in _distances(q, self.centres)]
        return self._searched(queries, k, near)

    def search_exact(self, queries: DataFrame, k: int) -> DataFrame:
        """As ``search``, but the true ``k`` best of all rows: the k-th score in the nearest cells rules out those cells whose
        centre and radius allow no higher one, and the others are read."""

        def able(ids: list, q: np.ndarray) -> list[np.ndarray]:
            asked = self.spark.createDataFrame(list(zip(ids, q.tolist())), T.StructType([queries.schema["query_id"], T.StructField("query_vec", T.ArrayType(T.DoubleType()))]))
            worst = self.search(asked, k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("floor")).collect()  # a row for each query of a block
            floor = {r["query_id"]: r["floor"] for r in worst if r["floor"] is not None}
            bound = q @ self.centres.T + np.sqrt((q**2).sum(1))[:, None] * self.radii
            return [np.flatnonzero(b >= floor.get(i, -np.inf) - 1e-6) for i, b in zip(ids, bound)]

        return self._searched(queries, k, able)

    def _searched(self, queries: DataFrame, k: int, cells_of: Callable[[list, np.ndarray], list[np.ndarray]], with_cell: bool = False) -> DataFrame:
        asked = queries.where("query_vec is not null")
        blocks = max(1, -(-asked.count() // QUERIES))
        parts = []
        for b in range(blocks):
            own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select("query_id", "query_vec").collect()  # a block: about QUERIES
            ids = [r["query_id"] for r in own]
            q = np.array([r["query_vec"] for r in own], float).reshape(len(own), -1)
            cells = cells_of(ids, q) if ids and len(self.centres) else []
            # pairs of cell and query as numbers, in the order of the cells
            cell, place = (np.concatenate([np.empty(0, np.int32), *c]).astype(np.int32) for c in (cells, [np.full(len(c), i, np.int32) for i, c in enumerate(cells)]))
            order = np.argsort(cell, kind="stable")
            by_cell = cell[order], place[order]
            # only folders of these cells are read
            rows = self.rows.where(F.col("cell").isin(np.unique(cell).tolist())).select(self.key, "embedding", "cell")
            shape = T.StructType([queries.schema["query_id"], self.schema[self.key], T.StructField("score", T.DoubleType()), T.StructField("cell", T.IntegerType())])
            parts.append(rows.mapInPandas(_best_of(self.spark.sparkContext.broadcast((ids, q, by_cell)), self.key, k), shape))
        found = top_per_query(reduce(DataFrame.unionByName, parts), k, [F.desc(F.round("score", 9)), F.asc(self.key)])
        return asked.join(found if with_cell else found.drop("cell"), "query_id").drop("query_vec")


def _best_of(asked, key: str, k: int):
    """The k best rows of each batch for each query that probes the row's cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q, (cells, places) = asked.value
        ids = np.array(ids, object)
        for batch in batches:
            for cell, rows in batch.groupby("cell"):
                mine = places[slice(*np.searchsorted(cells, (cell, cell + 1)))]
                vectors, keys = _matrix(rows["embedding"]), rows[key].to_numpy()
                for lo in range(0, len(mine), step := max(1, CELLS_HELD // len(rows))):
                    own = mine[lo : lo + step]
                    scores = vectors @ q[own].T
                    row, column = best_places(scores, keys, k)
                    yield pd.DataFrame({"query_id": ids[own[column]], key: keys[row], "score": scores[row, column], "cell": np.int32(cell)})

    return run


def _assigned(centres: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            d = _distances(_matrix(batch["embedding"]), centres) if len(batch) else np.empty((0, len(centres)))
            cell = d.argmin(1)
            yield batch.assign(cell=cell.astype("int32"), far=np.sqrt(d[np.arange(len(d)), cell]))

    return run


def build_index(vectors: DataFrame, key: str = "vec_id", cells: int | None = None, k: int = 5, recall: float = RECALL, seed: int = 7) -> VectorIndex:
    """Index all rows of ``vectors(key, embedding)`` whose vector is not null; vectors have one length.

    ``cells`` is the square root of the number of rows unless given, CELLS at most. ``probes`` is the least number of
    cells that finds ``recall`` of the ``k`` best rows of MEASURED sampled rows; all cells find them all. An empty table
    gives an index that finds nothing.
    """
    spark = vectors.sparkSession
    whole = vectors.where("embedding is not null").select(key, F.col("embedding").cast("array<double>").alias("embedding"))
    n = whole.count()
    cells = max(1, min(cells or int(n**0.5), CELLS, n))
    path = workspace(spark, "vector-index")
    schema = T.StructType([*whole.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())])
    centres = np.zeros((0, 0))
    if n:
        sample = whole.orderBy(F.xxhash64("embedding")).limit(SAMPLE) if n > SAMPLE else whole
        # the clustering takes two centres at least
        centres = np.array([sample.first()["embedding"]] if cells == 1 else _fitted(sample, cells, seed))
    placed = whole.mapInPandas(_assigned(centres), schema)
    # a folder for each cell; a cell of many rows is several files, written by as many tasks
    placed.repartition("cell", F.pmod(F.xxhash64(key), F.lit(max(1, n // (cells * FILE_ROWS))))).write.partitionBy("cell").parquet(f"{path}/rows")
    index = VectorIndex(spark, path, schema, key, centres, np.zeros(len(centres)))
    if not n:
        return index
    for r in index.rows.groupBy("cell").agg(F.max("far").alias("far")).collect():  # a row for each cell
        index.radii[r["cell"]] = r["far"]
    probes, share = _measured(index, k, recall)
    return replace(index, probes=probes, recall=share)


def _fitted(sample: DataFrame, cells: int, seed: int) -> list:
    return KMeans(k=cells, seed=seed, maxIter=10, initSteps=1).fit(sample.select(array_to_vector("embedding").alias("features"))).clusterCenters()


def _measured(index: VectorIndex, k: int, least: float) -> tuple[int, float]:
    """Cells to probe, and the share of true neighbours that they find. Rows are asked for their own neighbours."""
    asked = index.rows.orderBy(F.xxhash64(index.key, F.lit(1))).limit(MEASURED).select(F.col(index.key).alias("query_id"), F.col("embedding").alias("query_vec"))
    places: dict = {}

    def every(ids: list, q: np.ndarray) -> list[np.ndarray]:
        order = np.argsort(_distances(q, index.centres), axis=1, kind="stable")
        places.update(zip(ids, np.argsort(order, axis=1)))  # at which place, by distance, a query's cells come
        return list(order)

    true = index._searched(asked, k + 1, every, with_cell=True).where(F.col("query_id") != F.col(index.key)).where(F.col("rank") <= k).select("query_id", "cell").collect()  # k rows for each of MEASURED
    at = np.array(sorted(places[r["query_id"]][r["cell"]] for r in true))
    if not len(at):
        return 1, 1.0
    probes = int(at[min(len(at) - 1, int(np.ceil(least * len(at))) - 1)]) + 1
    return probes, float((at < probes).mean())
