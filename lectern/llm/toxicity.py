"""Toxicity: Levenshtein automata run against a trie of lexicon terms, and scores of the words around each hit.

The lexicon is learned from labelled texts: terms, and stems (beginnings of words) for terms of many forms, that stand
in toxic texts far more often than in others. Misspelled terms are found by walking the trie with the states of a
Levenshtein automaton. Each hit's window of words tells quotation and report from abuse, and a logistic model over the
sums of hits, by kind and window, gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import keep

#: Least toxic texts that hold a lexicon entry, and least log odds (two standard errors below the estimate).
LEAST, ODDS = 4, 2.0
#: Rows of ids up to which a counted table is broadcast; beyond, the same joins shuffle.
BROADCAST_ROWS = 500_000
#: Least letters of a term whose misspellings count.
LETTERS = 5
#: Letters of stems, words of the window on each side, rows to which the logistic model is fitted at most.
STEMS, WINDOW, FIT_ROWS = (4, 5, 6), 4, 50_000
#: Words that report speech or address someone, by language family of the corpus.
REPORTS = frozenset("said says say called calls call wrote writes quoted quote quotes word term insult heißt sagte nannte dit appelle mot dijo llama palabra".split())
ADDRESS = frozenset("you your you're u are is this that these such such an du ihr bist sind tu vous es êtes eres sois".split())
QUOTES = "\"“”„«»‚‘’"
WORD = re.compile(r"[^\W_]+")
FEATURES = ("hits", "strength", "misspelled", "stems", "quoted", "addressed", "density", "most")


def in_training(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(doc_id.cast("string")) % folds != 0


def _units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts of each kind that hold a word or stem (marked by *), counted for some thousand texts at a time."""
    for batch in batches:
        for lo in range(0, len(batch), 2000):
            part = batch.iloc[lo : lo + 2000]
            held: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(part["text"], part["toxic"]):
                words = set(WORD.findall(text.lower())) if text else set()
                for k in STEMS:
                    words.update([w[:k] + "*" for w in words if len(w) > k and w[-1] != "*"])
                held[int(toxic == 1)].update(words)
            units = list(held[0] | held[1])
            yield pd.DataFrame({"unit": units, "b": [held[1][u] for u in units], "g": [held[0][u] for u in units]})


def learn_lexicon(labelled: DataFrame) -> list[tuple[str, bool, float]]:
    """(term, is it a stem, weight) from ``labelled(text, toxic)``: all rows count, each term once a text.

    A term or stem enters if at least LEAST toxic texts hold it and its log odds, less two standard errors, reach
    ODDS. A stem that adds nothing to a term of its own is left out.
    """
    rows = labelled.where("toxic is not null").select(F.col("toxic").cast("int").alias("toxic"), "text")
    total = rows.agg(F.sum((F.col("toxic") == 1).cast("long")), F.count("*")).first()
    bad, good = total[0] or 0, (total[1] or 0) - (total[0] or 0)
    if not bad or not good:
        return []
    counted = rows.mapInPandas(_units, "unit string, b long, g long").groupBy("unit").agg(F.sum("b").alias("b"), F.sum("g").alias("g"))
    counts = counted.select(F.rtrim("unit", F.lit("*")).alias("t"), F.endswith("unit", F.lit("*")).alias("stem"), "b", "g")
    b, g = F.col("b") + 0.5, F.col("g") + 0.5
    odds = F.log(b / (bad + 1.0 - b)) - F.log(g / (good + 1.0 - g))
    error = F.sqrt(1 / b + 1 / g)
    found = counts.where(F.col("b") >= LEAST).withColumn("odds", odds - 2 * error).where(F.col("odds") >= ODDS)
    passed = found.select("t", "stem", "odds", "b").collect()
    out = [(r["t"], False, r["odds"]) for r in passed if not r["stem"]]
    most: dict[str, int] = {}
    for r in passed:
        if not r["stem"]:
            for k in STEMS:
                most[r["t"][:k]] = max(most.get(r["t"][:k], 0), r["b"])
    out += [(r["t"], True, r["odds"]) for r in passed if r["stem"] and most.get(r["t"], 0) < 0.8 * r["b"]]
    return sorted(out)


class Trie:
    """Lexicon terms of LETTERS letters or more as nested dicts, walked together with a Levenshtein automaton of the
    word looked up; shorter terms and stems are looked up as they are."""

    def __init__(self, entries: list[tuple[str, bool, float]]):
        self.root: dict = {}
        self.exact: dict[str, float] = {}
        self.stems: dict[str, float] = {}
        for term, stem, weight in entries:
            if stem:
                self.stems[term] = weight
                continue
            self.exact[term] = weight
            if len(term) < LETTERS:
                continue
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = (term, weight)
        self.sizes = sorted({len(s) for s in self.stems}, reverse=True)
        # a word within one error of a term equals it, or shares with it a deletion of one letter, or is one
        self.deletions = {d for t in self.exact if len(t) >= LETTERS for d in (t, *(t[:i] + t[i + 1 :] for i in range(len(t))))}
        self.seen: set[str] = set()
        self.found: dict[str, tuple[str, float]] = {}

    def near(self, word: str, errors: int) -> tuple[str, float] | None:
        """The term of most weight within ``errors`` insertions, deletions, substitutions or swaps of neighbours."""
        best: tuple[str, float] | None = None
        n = len(word)
        first = tuple(i if i <= errors else errors + 1 for i in range(n + 1))
        stack: list[tuple[dict, tuple, tuple | None, str]] = [(self.root, first, None, "")]
        while stack:
            node, state, before, last = stack.pop()
            if "" in node and state[n] <= errors and (best is None or node[""][1] > best[1]):
                best = node[""]
            for c, child in node.items():
                if not c:
                    continue
                step = [state[0] + 1]
                for i in range(1, n + 1):
                    d = min(step[i - 1] + 1, state[i] + 1, state[i - 1] + (word[i - 1] != c))
                    if before is not None and i > 1 and word[i - 1] == last and word[i - 2] == c:
                        d = min(d, before[i - 2] + 1)
                    step.append(d)
                if min(step) <= errors:
                    stack.append((child, tuple(step), state, c))
        return best

    def find(self, word: str) -> tuple[str, float] | None:
        """(kind, weight) of a word: exact, stem or misspelled; None if it is no term."""
        hit: tuple[str, float] | None = None
        if word in self.exact:
            hit = ("exact", self.exact[word])
        elif (s := next((word[:k] for k in self.sizes if word[:k] in self.stems), None)) is not None:
            hit = ("stem", self.stems[s])
        elif len(word) >= LETTERS - 1 and not self.deletions.isdisjoint([word, *[word[:i] + word[i + 1 :] for i in range(len(word))]]):
            near = self.near(word, 1)
            if near:
                hit = ("misspelled", near[1])
        return hit

    def hits(self, words: set[str]) -> dict[str, tuple[str, float]]:
        """The words that are terms, with kind and weight; each word is looked up once and then remembered."""
        for w in words - self.seen:
            if hit := self.find(w):
                self.found[w] = hit
        self.seen |= words
        out = {w: self.found[w] for w in words & self.found.keys()}
        if len(self.seen) > 500_000:
            self.seen.clear()
            self.found.clear()
        return out


def features(text: str, trie: Trie) -> list[float]:
    """Values of FEATURES for a text."""
    low = text.lower()
    words = WORD.findall(low)
    kinds = trie.hits(set(words))
    if not kinds:
        return [0.0] * len(FEATURES)
    count = strength = misspelled = stems = quoted = addressed = most = 0.0
    spans = [(m.start(), m.end(), m.group()) for m in WORD.finditer(low)]
    for i, (lo, hi, w) in enumerate(spans):
        if w not in kinds:
            continue
        kind, weight = kinds[w]
        count += 1
        strength += weight
        most = max(most, weight)
        misspelled += kind == "misspelled"
        stems += kind == "stem"
        around = [s[2] for s in spans[max(0, i - WINDOW) : i] + spans[i + 1 : i + 1 + WINDOW]]
        lead, trail = low[max(0, lo - 40) : lo], low[hi : hi + 40]
        inside = any(q in lead for q in QUOTES) and any(q in trail for q in QUOTES)
        if inside or any(a in REPORTS for a in around):
            quoted += 1
        elif any(a in ADDRESS for a in around):
            addressed += 1
    return [math.log1p(count), math.log1p(strength), math.log1p(misspelled), math.log1p(stems), quoted / count, addressed / count, math.log1p(100 * count / len(words)), most / 10]


def _features(entries):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = Trie(entries.value)
        for batch in batches:
            rows = [features(t, trie) if t else [0.0] * len(FEATURES) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "own": batch["own"], "x": rows})

    return run


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic model, the intercept last, by Newton's method."""
    m = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(m.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        step = np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + np.diag(penalty), m.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _own() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def score_texts(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on), x (FEATURES).

    ``labels(doc_id, toxic)`` are learned from where crc32(doc_id as text) mod ``folds`` is not 0; the lexicon counts
    all such rows, the logistic model is fitted to FIT_ROWS of them at most (those of least hashed id). Null and empty
    texts have no hits and get the score of a text without one. Without labels of both kinds every score is 0. Null
    labels are skipped; if an id stands in several rows of either table, all their pairs are learned from.
    """
    return _scored(docs, labels, folds).drop("own")


def _scored(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """Scores with ``own``, the hash of the row's text."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _own().alias("own"), F.col("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where("toxic is not null").where(in_training(F.col("doc_id"), folds))
    known = keep(known, "labels")
    few = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    entries = learn_lexicon(texts.join(few, "doc_id").select("text", "toxic"))
    sent = docs.sparkSession.sparkContext.broadcast(entries)
    found = keep(texts.mapInPandas(_features(sent), "doc_id long, own long, x array<double>"), "toxicity")
    sample = found.join(few, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS).select("x", "toxic").collect()
    y = np.array([float(r[1] == 1) for r in sample])
    held_out = F.coalesce(~in_training(F.col("doc_id"), folds), F.lit(False)).alias("held_out")
    if not entries and not (0 < y.sum() < len(y)):
        score = F.lit(0.0)
    else:
        w = fit(np.array([r[0] for r in sample]), y)
        z = F.lit(float(w[-1]))
        for i, v in enumerate(w[:-1]):
            z = z + F.get("x", F.lit(i)) * float(v)
        score = 1 / (1 + F.exp(-z))
    return found.select("doc_id", "own", held_out, score.alias("score"), "x").select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "x", "own")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows predicted toxic, by doc_id (null ids too) and text; all columns stay."""
    bad = _scored(docs, labels).where("predicted = 1").select(F.col("doc_id").alias("__toxic"), F.col("own").alias("__text")).distinct()
    bad = keep(bad, "toxic")
    few = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    return docs.join(few, F.col("doc_id").cast("long").eqNullSafe(F.col("__toxic")) & (_own() == F.col("__text")), "left_anti")
