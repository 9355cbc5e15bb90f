"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import keep
from .shingles import SIMILARITY, WORDS_IN_SHINGLE, shingle_hashes

#: Shingles in an item's sketch, and how many standard deviations below its mean the hits of a match may lie.
SKETCH, DEVIATIONS = 32, 6.0
SEED = 77
#: Rows up to which a table is broadcast; it is counted first, and joined by shuffle beyond.
BROADCAST_ROWS = 500_000


def _sized(small: DataFrame) -> DataFrame:
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def _own() -> F.Column:
    """Hash of the text of a row without an id, which tells it from others; null for all rows that have one."""
    return F.when(F.col("doc_id").cast("long").isNull(), F.xxhash64("text"))


def sketches(items: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Items (item_id, text) by size class: key, item_id, shingles, n, size_class, sketch, need.

    The sketch is a bottom-k MinHash: the shingles of least permuted hash, all of them for items of up to SKETCH
    shingles. The share of a sketch that a document holds estimates the item's containment in it whatever the
    document's length. ``need`` is the number of hits that an item of just the threshold reaches but once in 10^9.
    """
    shingles = F.array_distinct(shingle_hashes(F.col("text")))
    rows = items.select(F.xxhash64("item_id", "text").alias("key"), F.col("item_id").cast("long").alias("item_id"), shingles.alias("shingles")).distinct()
    rows = rows.withColumn("n", F.size("shingles")).where("n > 0")
    ranked = F.array_sort(F.transform("shingles", lambda s: F.struct(F.xxhash64(s, F.lit(SEED)).alias("p"), s.alias("s"))))
    sketch = F.transform(F.slice(ranked, 1, SKETCH), lambda r: r["s"])
    spread = DEVIATIONS * (SKETCH * threshold * (1 - threshold)) ** 0.5
    need = F.when(F.col("n") <= SKETCH, F.ceil(F.col("n") * threshold - 1e-9)).otherwise(max(1, int(threshold * SKETCH - spread)))
    return rows.select("key", "item_id", "shingles", "n", F.floor(F.log2("n")).cast("int").alias("size_class"), sketch.alias("sketch"), need.cast("int").alias("need"))


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, item_shingles, shared, containment: documents that hold ``threshold`` or more of an item's
    different five-word shingles.

    ``docs`` and ``items`` need doc_id, text and item_id, text; other columns are not read. Items and documents of
    fewer than five words (null and empty ones too) have no shingles and match nothing. If an id stands in several
    rows, each row is searched and the best containment of the id is returned; of rows without an id, that of each
    different text. Empty tables give no rows.
    """
    return _contained(docs, items, threshold).drop("own")


def _contained(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """Contained items with ``own``, the hash of the text where doc_id is null, else null."""
    sketched = keep(sketches(items, threshold), "sketches")
    probes = sketched.select("key", "need", "n", "size_class", F.explode("sketch").alias("shingle"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _own().alias("own"), F.col("text"))
    seen = texts.select("doc_id", "own", F.array_distinct(shingle_hashes(F.col("text"))).alias("s"))
    hits = (
        seen.select("doc_id", "own", F.size("s").alias("held"), F.explode("s").alias("shingle"))
        .join(_sized(probes), "shingle")
        # a document too small for the item's size class cannot hold enough of it
        .where(F.col("held") >= F.ceil(F.pow(F.lit(2), F.col("size_class")) * threshold - 1e-9))
        .groupBy("doc_id", "own", "key").agg(F.count("*").alias("hits"), F.max("need").alias("need"))
    )
    candidates = keep(hits.where("hits >= need").groupBy(F.col("doc_id").alias("__doc"), F.col("own").alias("__own")).agg(F.collect_list("key").alias("keys")), "candidates")
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & F.col("own").eqNullSafe(F.col("__own"))
    again = texts.join(_sized(candidates), same).select("doc_id", "own", "keys", F.array_distinct(shingle_hashes(F.col("text"))).alias("s"))
    each = again.select("doc_id", "own", F.explode("keys").alias("key"), "s").join(_sized(sketched.select("key", "item_id", "shingles", "n")), "key")
    shared = F.size(F.array_intersect("shingles", "s"))
    found = each.select("doc_id", "own", "item_id", F.col("n").alias("item_shingles"), shared.alias("shared"), (shared / F.col("n")).alias("containment"))
    best = found.where(F.col("containment") >= threshold).groupBy("doc_id", "own", "item_id").agg(F.max(F.struct("containment", "shared", "item_shingles")).alias("b"))
    return best.select("doc_id", "item_id", "b.item_shingles", "b.shared", "b.containment", "own")


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """``docs`` without the documents that hold an item, by doc_id, those without an id by text; all columns
    stay."""
    found = keep(_contained(docs, items, threshold).select(F.col("doc_id").alias("__leak"), F.col("own").alias("__text")).distinct(), "leaks")
    return docs.join(_sized(found), F.col("doc_id").cast("long").eqNullSafe(F.col("__leak")) & _own().eqNullSafe(F.col("__text")), "left_anti")


#: DuckDB SQL for ``contained_items`` at its defaults, every shingle of every item compared.
ORACLE = rf"""
WITH texts AS (
    SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark
), worded AS MATERIALIZED (
    SELECT row_number() OVER () AS r, side, id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS w FROM texts
), shingled AS MATERIALIZED (
    SELECT DISTINCT r, side, id, unnest(list_transform(range(1, len(w) - {WORDS_IN_SHINGLE - 2}), lambda i: array_to_string(w[i : i + {WORDS_IN_SHINGLE - 1}], ' '))) AS s FROM worded
), sizes AS (
    SELECT r, id AS item_id, count(*) AS n FROM shingled WHERE side = 'i' GROUP BY r, id
), shared AS (
    SELECT d.r AS d, d.id AS doc_id, i.r AS i, count(*) AS shared FROM shingled d JOIN shingled i ON d.s = i.s AND d.side = 'd' AND i.side = 'i' GROUP BY ALL
), best AS (
    SELECT doc_id, item_id, max({{'c': shared / n, 's': shared, 'n': n}}) AS b FROM shared JOIN sizes ON shared.i = sizes.r WHERE shared / n >= {SIMILARITY} GROUP BY ALL
)
SELECT doc_id, item_id, CAST(b.n AS INTEGER) AS item_shingles, CAST(b.s AS INTEGER) AS shared, b.c AS containment FROM best
"""


__all__ = ["ORACLE", "WORDS_IN_SHINGLE", "contained_items", "sketches", "without_leaks"]
