"""Word shingles as 64-bit hashes, made by Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS_IN_SHINGLE = 5
SIMILARITY = 0.8


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null is empty."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(text: Column, n: int = WORDS_IN_SHINGLE, short: bool = False) -> Column:
    """Hashes of all runs of ``n`` words, repeats included. A text of fewer words has none or, with ``short``, one for
    all its words; a text without words has none."""
    hashed = F.transform(words(text), lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        all_runs = F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(n)]))
        few = F.when(F.size(h) > 0, F.array(F.aggregate(h, F.lit(0).cast("bigint"), lambda a, x: F.xxhash64(a, x)))) if short else None
        none = F.array().cast("array<bigint>")
        return F.when(F.size(h) >= n, all_runs).otherwise(F.coalesce(few, none) if short else none)

    # the array of one binds the word hashes, which would else be computed again for every run
    return F.get(F.transform(F.array(hashed), runs), F.lit(0))
