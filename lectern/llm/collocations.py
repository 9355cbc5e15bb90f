"""Phrase collocations by top-order marginalisation.

Only the longest windows are counted: a row for each word, with the words that follow it in lead columns, padded behind
the end of its piece. A ROLLUP over these columns then sums ever shorter prefixes, which gives the counts of all
phrases. Exact cuts keep the windows few: a word that is itself too rare ends a window, and so does one whose prefix of
the window is too rare, as no phrase through either can be frequent enough.
"""

from __future__ import annotations

import string
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import keep

#: Longest phrase (six words at most), least count of a candidate, rows returned for each language.
WORDS, LEAST, BEST = 5, 100, 2000
#: Frequent words up to which tasks hold them as a dictionary of 20-bit numbers; beyond, windows are made of the words.
DICTIONARY = 1 << 20
#: Words that make up one in so many of all are hot: pairs of two such are dealt to several tasks.
HOT = 1000
#: Windows, and different words, that a task holds before it hands their counts on; rows of a batch it gives out; bytes
#: of text, but at least one text, that it cuts to words at once.
HELD, COUNTED, BATCH, SLICE = 1 << 20, 200_000, 200_000, 1 << 20

_BREAK = b"\xff"  # not in any UTF-8 text
_TABLE = bytearray(range(256))
for _c in string.ascii_uppercase.encode():
    _TABLE[_c] = _c + 32
for _c in b".,;:!?\n\x0b\x0c\r":
    _TABLE[_c] = _BREAK[0]
_TABLE[9] = 32
_TABLE = bytes(_TABLE)


def _tokens(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """The batch's words by language, some texts at a time; pieces and texts end with _BREAK."""
    cut = lambda texts: _BREAK.join(texts).translate(_TABLE).replace(_BREAK, b" \xff ").split()
    by: dict[str, list[bytes]] = defaultdict(list)
    held: Counter = Counter()
    for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
        lang, text = lang.as_py(), text.as_buffer().to_pybytes()
        by[lang].append(text)
        held[lang] += len(text)
        if held[lang] >= SLICE:
            yield lang, cut(by.pop(lang))
            del held[lang]
    for lang, texts in by.items():
        yield lang, cut(texts)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = defaultdict(Counter)

    def out() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            counts.pop(_BREAK, None)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])
        held.clear()

    for batch in batches:
        for lang, tokens in _tokens(batch):
            held[lang].update(tokens)
        if sum(map(len, held.values())) > COUNTED:
            yield from out()
    yield from out()


def _combined(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Different windows with their counts, packed: the numbers of the first three words in one long, of the others in one more."""
    w = np.concatenate(held, axis=1).astype(np.int64)
    first, rest = (sum((x << (20 * (2 - i)) for i, x in enumerate(part)), np.zeros(w.shape[1], np.int64)) for part in (w[:3], w[3:]))
    order = np.lexsort((rest, first))
    first, rest = first[order], rest[order]
    new = np.flatnonzero(np.r_[True, (first[1:] != first[:-1]) | (rest[1:] != rest[:-1])])
    counts, first, rest = np.diff(np.r_[new, len(order)]), first[new], rest[new]
    for lo in range(0, len(new), BATCH):
        yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + BATCH]) for x in (first, rest, counts)], ["first", "rest", "c"])


def _unpacked(size: int) -> dict[str, Column]:
    return {c: F.shiftright("first" if i < 3 else "rest", 20 * (2 - i % 3)).bitwiseAND((1 << 20) - 1).cast("int") for i, c in enumerate(_columns(size))}


def _columns(size: int) -> list[str]:
    return [f"w{i}" for i in range(1, size + 1)]


def _coded(known, size: int):
    """Windows as numbers of the dictionary; 0 pads, and stands for words that are not in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for lang, tokens in _tokens(batch):
                number = known.value.get(lang)
                if not number or not tokens:
                    continue
                code = np.fromiter(map(number.get, tokens, repeat(0)), np.int32, len(tokens))
                padded, lead = np.r_[code, np.zeros(size, np.int32)], [code]
                for k in range(1, size):
                    lead.append(np.where(lead[-1] > 0, padded[k : k + len(code)], 0))
                starts = code > 0
                held.append(np.stack([x[starts] for x in lead]))
                rows += held[-1].shape[1]
                if rows >= HELD:
                    yield from _combined(held)
                    held, rows = [], 0
        if rows:
            yield from _combined(held)

    return run


def _decoded(known, size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = {i: (lang, word.decode()) for lang, words in known.value.items() for word, i in words.items()}
        for batch in batches:
            columns = [batch[c].tolist() for c in _columns(size)]
            phrases = [[names[i] for i in row[:n]] for n, *row in zip(batch["size"].tolist(), *columns, strict=True)]
            yield pd.DataFrame({"lang": [p[0][0] for p in phrases], "phrase": [" ".join(w for _, w in p) for p in phrases], "size": batch["size"], "f": batch["f"]})

    return run


def _spelled(texts: DataFrame, size: int) -> DataFrame:
    """The same windows as words, with the language; the empty word pads."""
    low = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    words = texts.select("lang", F.explode(F.split(low, r"[.,;:!?\x0A-\x0D]")).alias("piece")).select("lang", F.filter(F.split("piece", r"[ \t]+"), lambda w: w != "").alias("w"))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.struct(*[F.coalesce(F.get(w, i + k), F.lit("")).alias(c) for k, c in enumerate(_columns(size))]))

    return words.where(F.size("w") > 0).select("lang", F.inline(windows(F.col("w")))).withColumn("c", F.lit(1).cast("long"))


def rolled_up(windows: DataFrame, size: int, least: int, lead: tuple[str, ...] = (), hot: int = 0) -> DataFrame:
    """All prefixes of at least one word and a count of ``least``, with ``size`` and ``f``, of ``windows(*lead, w1 .. wN, c)``
    or, packed, ``windows(first, rest, c)``.

    Windows are dealt by a prefix, so that its count and those of longer ones are known before the ROLLUP, and each is
    cut to its longest prefix that is frequent enough. Packed ones are dealt by two words, but by three if both are
    among the ``hot`` most frequent; such a pair is not cut. Words as they are are dealt by three, and pairs not cut.
    """
    words, pad = _columns(size), F.lit("" if lead else 0)
    if "first" in windows.columns:
        pair, number = F.shiftright("first", 20), lambda at: F.shiftright("first", at).bitwiseAND((1 << 20) - 1)
        deal = F.when((number(40) <= hot) & (number(20) <= hot), F.col("first")).otherwise(F.shiftleft(pair, 20))
        dealt = windows.repartition(deal).withColumn("deal", deal)  # told again from what came, so not sent
        whole = dealt.groupBy("deal", "first", "rest").agg(F.sum("c").alias("c")).withColumns(_unpacked(size))
        dealt_by, first = ["deal"], ["deal", "first"]
        is_hot = (F.col("w1") <= hot) & (F.col("w2") <= hot)
    else:
        dealt_by = first = [*lead, *words[:3]]
        whole = windows.repartition(*first).groupBy(*lead, *words).agg(F.sum("c").alias("c"))
        is_hot = F.lit(True)
    for i in range(size - 1, 2, -1):  # from the longest, so that one order of rows does for all
        whole = whole.withColumn(f"f{i}", F.sum("c").over(W.partitionBy(*first, *words[3:i])))
    whole = whole.withColumn("f2", F.sum("c").over(W.partitionBy(*dealt_by)))
    enough = [is_hot | (F.col("f2") >= least), *[F.col("c" if i == size else f"f{i}") >= least for i in range(3, size + 1)]]
    cut = whole.select(*lead, words[0], *[F.when(e, F.col(c)).otherwise(pad).alias(c) for e, c in zip(enough, words[1:])], "c")
    sums = cut.rollup(*lead, *words).agg(F.sum("c").alias("f"), F.grouping_id().alias("g"))
    level = (size - F.bit_count("g")).cast("int")
    kept = sums.where(F.col("f") >= least).withColumn("size", level).where(F.col("size") > 0)
    return kept.where(F.get(F.array(*words), F.col("size") - 1) != pad).drop("g")


def phrase_counts(docs: DataFrame, size: int = WORDS, least: int = LEAST, dictionary: int = DICTIONARY) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of all phrases of 1 to ``size`` words with f >= ``least`` in ``docs(lang, text)``, and
    (lang, n), the number of all words; both kept as tables.

    A-Z are lower-cased, texts are cut at [.,;:!?\\x0A-\\x0D] into pieces and at blanks and tabs into words. A null
    language is ``und``, a null text empty. Tasks hold the frequent words while they are at most ``dictionary`` (2^20);
    beyond, the windows carry the words themselves, with the same result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counted = keep(texts.mapInArrow(_count_words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    totals = keep(counted.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    frequent = counted.where(F.col("n") >= least)
    if frequent.count() <= min(dictionary, DICTIONARY - 1):  # 0 pads
        known: dict[str, dict[bytes, int]] = defaultdict(dict)
        every, hot = totals.agg(F.sum("n")).first()[0] or 0, 0
        for i, r in enumerate(frequent.orderBy(F.desc("n")).toLocalIterator()):
            known[r["lang"]][bytes(r["word"])] = i + 1
            hot += r["n"] * HOT >= every
        shared = spark.sparkContext.broadcast(dict(known))
        windows = texts.mapInArrow(_coded(shared, size), "first long, rest long, c long")
        phrases = rolled_up(windows, size, least, hot=hot).mapInPandas(_decoded(shared, size), "lang string, phrase string, size int, f long")
    else:
        phrases = rolled_up(_spelled(texts, size), size, least, ("lang",))
        phrases = phrases.select("lang", F.array_join(F.slice(F.array(*_columns(size)), F.lit(1), F.col("size")), " ").alias("phrase"), "size", "f")
    return keep(phrases, "phrases"), totals


def collocations(docs: DataFrame, size: int = WORDS, least: int = LEAST, best: int = BEST, dictionary: int = DICTIONARY) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``best`` phrases of ``docs(lang, text)`` by score.

    Candidates are phrases of 2 to ``size`` words with a = f(phrase) >= ``least``. A cut after the first k words gives
    l and r, the counts of both parts, and floor(1000 * a * n / (l * r)); the lowest counts, ties to the smallest k. A
    candidate whose words lie in a longer one of the same count goes. Equal scores are ordered by a, descending, and
    by the phrase's bytes. Repeated rows count again; other columns are not read; a table without words gives no rows.
    Products are decimals of 38 digits.
    """
    phrases, totals = phrase_counts(docs, size, least, dictionary)
    found = phrases.where("size >= 2").withColumn("w", F.split("phrase", " ")).withColumnRenamed("f", "a")

    def part(at: Column | int, n: Column) -> Column:
        return F.array_join(F.slice("w", at, n), " ")

    k = F.col("k")
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).withColumns({"first": part(F.lit(1), k), "rest": part(k + 1, F.col("size") - k)})
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(phrases.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    exact = {c: F.col(c).cast("decimal(19,0)") for c in "anlr"}
    cuts = cuts.join(totals, "lang").withColumn("score", F.call_function("div", F.lit(1000).cast("decimal(4,0)") * exact["a"] * exact["n"], exact["l"] * exact["r"]))
    lowest = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "n", "cut.score", "cut.l", "cut.r")
    spans = [(i, n) for n in range(2, size) for i in range(1, size - n + 2)]
    inside = found.where("size >= 3").select("lang", "a", F.explode(F.array(*[F.when(F.col("size") > F.lit(max(n, i + n - 2)), part(F.lit(i), F.lit(n))) for i, n in spans])).alias("phrase"))
    longer = inside.where("phrase is not null").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = lowest.join(longer, ["lang", "phrase"], "left").where("longer is null or 100 * longer < 100 * a")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return left.withColumn("rank", rank).where(F.col("rank") <= best).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: DuckDB SQL for ``collocations`` with its defaults.
ORACLE = r"""
WITH piece AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS w FROM piece),
total AS MATERIALIZED (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
gram AS (SELECT lang, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM words, (SELECT unnest([1, 2, 3, 4, 5]) AS s) WHERE len(w) >= s),
f AS MATERIALIZED (SELECT lang, s, array_to_string(w[i:i + s - 1], ' ') AS phrase, count(*) AS f FROM gram GROUP BY ALL HAVING count(*) >= 100),
cand AS MATERIALIZED (SELECT lang, s, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE s >= 2),
cut AS (SELECT lang, phrase, s, a, w, unnest(range(1, s)) AS k FROM cand),
scored AS (
    SELECT c.lang, c.phrase, c.a, n, k, x.f AS l, y.f AS r, (1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f) AS score
    FROM cut c JOIN total USING (lang) JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:], ' ')
), lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
    SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
    FROM (SELECT lang, w, a, m, unnest(range(1, s - m + 2)) AS i FROM cand, (SELECT unnest([2, 3, 4]) AS m) WHERE s > m) GROUP BY ALL
), kept AS (SELECT lowest.* FROM lowest LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM kept
QUALIFY rank <= 2000
"""
