"""Document fingerprints by winnowing: rolling k-gram hashes, of every window the least one, rightmost if equal.

Letters and digits count, blanks and ASCII punctuation do not, A-Z are lower-cased. Two texts that share a run of at
least ``window + k - 1`` such characters share a hash of it, and no run shorter than ``k`` can make them share one.
Positions, in code points of the text as it is, say where.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a k-gram, k-grams of a window: runs of 51 characters or more are found.
K, WINDOW = 20, 32
#: Ranges of doc_id for each shuffle partition.
RANGES = 4

_BASE, _MIX = 0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD
_RECORD = np.dtype([("hash", ">u8"), ("at", ">u4")])
#: By code point: does it count? All from U+3001 on do.
_COUNTS = np.ones(0x3002, bool)
_COUNTS[[c for c in range(0x3001) if chr(c).isspace() or (c < 128 and not chr(c).isalnum())]] = False


def _rolled(x: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes, modulo 2^64, of all runs of ``k``: runs of powers of two are put together."""
    out, have, power, width = None, 0, x, 1
    while True:
        if k & width:
            n = len(x) - have - width + 1
            out = power[:n] if out is None else out[:n] * np.uint64(pow(_BASE, width, 1 << 64)) + power[have : have + n]
            have += width
        if have == k:
            return out
        n = len(power) - width
        power, width = power[:n] * np.uint64(pow(_BASE, width, 1 << 64)) + power[width : width + n], 2 * width


def _least(h: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash of each window, the rightmost if equal; each once."""
    if len(h) <= window:
        return np.array([len(h) - 1 - h[::-1].argmin()])
    at, width = np.arange(len(h), dtype=np.int32), 1

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(h[b] <= h[a], b, a)

    while 2 * width <= window:
        at, width = joined(at[:-width], at[width:]), 2 * width
    if width < window:
        at = joined(at[: len(at) - (window - width)], at[window - width :])
    return at[np.r_[True, at[1:] != at[:-1]]]


def winnow(text: str, k: int = K, window: int = WINDOW) -> np.ndarray:
    """(hash, at) of the chosen k-grams of a whole text. A text of fewer than ``k`` characters that count has one hash
    for all of them, one without any is taken as it is, and the empty text has none."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    at = np.flatnonzero(_COUNTS[np.minimum(code, 0x3001)])
    if not len(at):
        at = np.arange(len(code))
    if not len(at):
        return np.empty(0, _RECORD)
    low = code[at]
    low = np.where((low >= 65) & (low <= 90), low + 32, low).astype(np.uint64) + np.uint64(1)
    h = _rolled(low, min(k, len(low)))
    h = (h ^ (h >> np.uint64(33))) * np.uint64(_MIX)
    h ^= h >> np.uint64(29)
    chosen = _least(h, window)
    out = np.empty(len(chosen), _RECORD)
    out["hash"], out["at"] = h[chosen], at[chosen]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common hashes among all different ones; 1 for two texts without any."""
    x, y = np.unique(a["hash"]), np.unique(b["hash"])
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / (len(x) + len(y) - common) if len(x) or len(y) else 1.0


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """``docs`` with ``fingerprint``: 24 hexadecimal digits for each chosen k-gram of ``text``, 16 of its hash and 8 of
    its position, in the order of the text. A null text counts as empty; a column of that name is replaced."""

    @F.pandas_udf("string")
    def prints(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda t: winnow(t, k, window).tobytes().hex())

    return docs.withColumn("fingerprint", prints(F.col("text")))


def places(prints: DataFrame) -> DataFrame:
    """doc_id, hash, at: a row for each chosen k-gram of ``prints(doc_id, fingerprint)``."""
    n = (F.length("fingerprint") / 24).cast("int")
    i = F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)))
    digits = prints.select("doc_id", "fingerprint", i.alias("i"))
    take = lambda start, length: F.substring(F.col("fingerprint"), F.col("i") * 24 + start, F.lit(length))
    return digits.select("doc_id", take(1, 16).alias("hash"), F.conv(take(17, 8), 16, 10).cast("long").alias("at"))


def first_places(prints: DataFrame) -> DataFrame:
    """doc_id, hash, at, first_id, first_at, holders: for each chosen k-gram that several documents hold, where the one
    of the least id has it. A row for each document and hash, not for each pair of documents."""
    own = places(prints).groupBy("doc_id", "hash").agg(F.min("at").alias("at"))
    first = own.groupBy("hash").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("holders")).where("holders > 1")
    return own.join(first, "hash").select("doc_id", "hash", "at", F.col("first.doc_id").alias("first_id"), F.col("first.at").alias("first_at"), "holders")


def _range_of(bounds: list[int]) -> Column:
    """The number of the range that holds ``doc_id``; found in two steps, so that many bounds cost little."""
    step = math.isqrt(len(bounds)) + 1
    fine = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    up_to = lambda b: F.size(F.filter(b, lambda x: x <= F.col("doc_id"))) - 1
    part = F.greatest(up_to(F.array(*[F.lit(f[0]) for f in fine])), F.lit(0))
    inner = F.get(F.array(*[F.array(*[F.lit(x) for x in f]) for f in fine]), part)
    return F.when(F.col("doc_id").isNull(), 0).otherwise(F.greatest(part * step + up_to(inner), F.lit(0)))


def in_circle(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` in partitions sorted so that each row is followed by the next document's, with ``head``.

    Documents are ordered by doc_id, null first, then by text. Each range of ids ends with a copy of the next range's
    first document, marked ``head``; the last one's ends with the first document of all. Texts are shuffled once.
    """
    spark = docs.sparkSession
    parts = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    least, bounds = docs.agg(F.min("doc_id"), F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10 * parts)).first()
    bounds = sorted({least, *(bounds or [])} - {None}) or [0]
    ranged = docs.withColumn("g", _range_of(bounds).cast("int")).withColumn("order", F.xxhash64("text"))
    at_bound = ranged.where(F.col("doc_id").isin(bounds) | F.col("doc_id").isNull())
    heads = at_bound.groupBy("g").agg(F.min(F.struct("doc_id", "order", "text")).alias("m"))
    heads = heads.select("m.doc_id", "m.text", F.pmod(F.col("g") - 1, F.lit(len(bounds))).cast("int").alias("g"), "m.order", F.lit(True).alias("head"))
    every = ranged.select("doc_id", "text", "g", "order", F.lit(False).alias("head")).unionByName(heads)
    return every.repartition("g").sortWithinPartitions("g", "head", F.asc_nulls_first("doc_id"), "order", "text").select("doc_id", "text", "head")


def compared(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of ``docs(doc_id, text)``.

    The edited text is the document's with its last floor(n_chars / 4) code points replaced by the first as many, or
    all, of the next document: the one that follows by doc_id (null first) and text, after the last the first. A null
    text is empty; repeated rows follow one another; a single document follows itself; an empty table gives no rows;
    other columns are not read. Two texts without any character are alike (1); with one, not (0).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = None
        for batch in batches:
            out = []
            for doc_id, text, head in zip(batch["doc_id"].astype("object").where(batch["doc_id"].notna(), None), batch["text"], batch["head"], strict=True):
                prints = winnow(text, k, window)
                if before is not None:
                    own_id, own, own_prints = before
                    cut = len(own) // 4
                    edited = own[: len(own) - cut] + text[:cut]
                    edited_prints = winnow(edited, k, window)
                    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((own_id, len(own), digest, own_prints.tobytes().hex(), edited_prints.tobytes().hex(), likeness(own_prints, edited_prints), likeness(own_prints, prints)))
                before = None if head else (doc_id, text, prints)
            columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            yield pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64", "n_chars": "int64", "near_edited": "float64", "near_next": "float64"})

    return in_circle(rows).mapInPandas(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
