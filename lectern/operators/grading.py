"""Grading of free-text answers: coverage, negation, completeness, length, error classes, feedback.

Vectors are optional: without a model the similarity is the cosine of the texts' word counts.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.hooks import embedder
from ..sources.workspace import kept
from .retrieval import cosine

#: Weights of similarity, coverage, entailment and completeness by question type.
WEIGHTS = {"factual": (0.45, 0.30, 0.10, 0.15), "inferential": (0.35, 0.20, 0.15, 0.30), "evaluative": (0.25, 0.15, 0.20, 0.40)}
OTHER_WEIGHTS = (0.40, 0.20, 0.15, 0.25)


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _tagged(words: Column, tag: Column) -> Column:
    return F.transform(words, lambda w: F.struct(w.alias("term"), tag.alias("tag")))


def _spans(s: Column, key=lambda x: x) -> Column:
    """Where each run of equal keys in a sorted array begins (lo) and ends (hi)."""
    places = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: (i == 0) | (key(F.get(s, i)) != key(F.get(s, i - 1))))
    return bind(starts, lambda st: F.transform(st, lambda lo, j: F.struct(lo.alias("lo"), F.coalesce(F.get(st, j + 1), F.size(s)).alias("hi"))))


def _sum(values: Column, zero: Column) -> Column:
    return F.aggregate(values, zero, lambda x, y: x + y)


def keyword_share(answer: Column, reference: Column) -> Column:
    """Share of the reference's content words that the answer has, rare ones weighing more; null if it has no such words.
    Words are sorted and counted within the row, so none is shuffled or compared with all others."""

    def share(ref: Column) -> Column:
        both = F.concat(_tagged(F.array_distinct(t.content_words(F.coalesce(answer, F.lit("")))), F.lit(-1)), _tagged(ref, F.lit(0)))

        def weights(s: Column) -> Column:
            def one(r: Column) -> Column:
                has = F.get(s, r["lo"])["tag"] == -1
                n = r["hi"] - r["lo"] - has.cast("int")
                weight = F.when(n > 0, F.log(F.size(ref) / n + 1)).otherwise(0.0)
                return F.struct(weight.alias("all"), F.when(has, weight).otherwise(0.0).alias("met"))

            return F.transform(_spans(s, lambda x: x["term"]), one)

        found = bind(F.sort_array(both), weights)
        part = lambda w: F.least(_sum(w["met"], F.lit(0.0)) / _sum(w["all"], F.lit(0.0)), F.lit(1.0))
        return F.when(F.size(ref) > 0, bind(found, part))

    return bind(t.content_words(F.coalesce(reference, F.lit("")), 2), share)


def coverage(pairs: DataFrame) -> DataFrame:
    """pair, keyword: ``keyword_share`` of ``pairs(pair, answer, reference)``; pairs without content words have no row."""
    return pairs.select("pair", keyword_share(F.col("answer"), F.col("reference")).alias("keyword")).where("keyword is not null")


def contradicts(answer_tokens: Column, reference_set: Column) -> Column:
    """A negation right before a word of the reference, where the reference itself negates nothing."""
    neg = F.array(*[F.lit(n) for n in t.NEGATIONS])

    def test(s: Column) -> Column:
        places = F.when(F.size(s) >= 2, F.sequence(F.lit(0), F.size(s) - 2)).otherwise(F.array().cast("array<int>"))
        return F.exists(places, lambda i: F.array_contains(neg, F.get(s, i)) & F.array_contains(reference_set, F.get(s, i + 1)))

    return ~F.arrays_overlap(reference_set, neg) & bind(answer_tokens, test)


def _squares(words: Column) -> Column:
    """Sum of the squares of the words' counts."""
    squares = lambda s: F.transform(_spans(s), lambda r: (r["hi"] - r["lo"]).cast("long") * (r["hi"] - r["lo"]))
    return _sum(bind(F.sort_array(words), squares), F.lit(0).cast("long"))


def _products(answer: Column, parts: Column) -> Column:
    """For each array of words in ``parts`` the sum over its words of how often the answer has them."""
    every = F.concat(_tagged(answer, F.lit(-1)), F.flatten(F.transform(parts, lambda p, j: _tagged(p, j))))

    def met(s: Column) -> Column:
        def one(r: Column) -> Column:
            own = F.sequence(r["lo"], r["hi"] - 1)
            n = F.size(F.filter(own, lambda i: F.get(s, i)["tag"] == -1))
            rest = F.filter(own, lambda i: (F.get(s, i)["tag"] >= 0) & (F.get(s, r["lo"])["tag"] == -1))
            return bind(n, lambda n: F.transform(rest, lambda i: F.struct(F.get(s, i)["tag"].alias("part"), n.cast("long").alias("n"))))

        return F.flatten(F.transform(_spans(s, lambda x: x["term"]), one))

    # a row of each part, so that the run of a part has its number
    rows = F.concat(bind(F.sort_array(every), met), F.transform(parts, lambda _, j: F.struct(j.alias("part"), F.lit(0).cast("long").alias("n"))))
    total = lambda s, r: _sum(F.transform(F.sequence(r["lo"], r["hi"] - 1), lambda i: F.get(s, i)["n"]), F.lit(0).cast("long"))
    return bind(F.sort_array(rows), lambda s: F.transform(_spans(s, lambda x: x["part"]), lambda r: total(s, r)))


def word_likeness(answer: Column, reference: Column) -> Column:
    """``similarity`` and ``completeness`` of one pair by word counts. Words are sorted within the row, none is shuffled."""
    words = lambda c: t.tokens(t.preprocess(c))
    answer, reference = (F.coalesce(c, F.lit("")) for c in (answer, reference))
    texts = F.concat(F.array(words(reference)), F.transform(reference_sentences(reference), words))

    def cosines(b: Column) -> Column:
        a = b["answer"]
        each = lambda x, p: bind(b["aa"] * _squares(p), lambda n: F.when(n > 0, x / F.sqrt(n.cast("double"))).otherwise(0.0))
        return F.zip_with(_products(a, b["parts"]), b["parts"], each)

    both = bind(F.struct(words(answer).alias("answer"), texts.alias("parts")), lambda b: F.struct(b["answer"].alias("answer"), b["parts"].alias("parts"), _squares(b["answer"]).alias("aa")))
    credits = lambda s: _sum(F.transform(F.slice(s, 2, F.size(s) - 1), credit), F.lit(0.0)) / (F.size(s) - 1)
    return bind(bind(both, cosines), lambda s: F.struct(F.get(s, F.lit(0)).alias("similarity"), credits(s).alias("completeness")))


def _vector_cosines(pairs: DataFrame, parts: DataFrame, encode: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """The same by vectors; every different text is encoded once."""
    every = pairs.select(F.col("answer").alias("text")).unionByName(parts.select("text")).distinct()
    vectors = kept(embedder(every.select(F.md5("text").alias("doc_id"), "text"), encode), "text-vectors")
    of = lambda name: vectors.select(F.col("doc_id").alias(f"{name}_id"), F.col("embedding").alias(name))
    met = parts.select("pair", "pos", F.md5("text").alias("b_id")).join(pairs.select("pair", F.md5("answer").alias("a_id")), "pair").join(of("a"), "a_id").join(of("b"), "b_id")
    return met.select("pair", "pos", cosine(F.col("a"), F.col("b")).alias("similarity"))


def similarities(pairs: DataFrame, encode: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """pair, similarity, completeness of ``pairs(pair, answer, reference)``: the answer's cosine to the reference, and the
    mean credit of the reference's sentences by theirs. Without a model, vectors are word counts. Null texts are empty;
    a text without words is like none (0)."""
    if encode is None:
        return pairs.select("pair", word_likeness(F.col("answer"), F.col("reference")).alias("w")).select("pair", "w.similarity", "w.completeness")
    whole = pairs.select("pair", F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("reference", F.lit("")).alias("reference"))
    sentences = whole.select("pair", F.posexplode(reference_sentences(F.col("reference"))).alias("pos", "text"))
    parts = sentences.unionByName(whole.select("pair", F.lit(-1).alias("pos"), F.col("reference").alias("text")))
    found = _vector_cosines(whole, parts, encode)
    every = parts.select("pair", "pos").join(found, ["pair", "pos"], "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    of_part = F.col("pos") >= 0
    return every.groupBy("pair").agg(F.max(F.when(~of_part, F.col("similarity"))).alias("similarity"), F.avg(F.when(of_part, credit(F.col("similarity")))).alias("completeness"))


def entailment(contradiction: Column, similarity: Column) -> Column:
    s = similarity
    return F.when(contradiction, 0.25).when(s >= 0.75, 1.0).when(s >= 0.55, 0.75).when(s >= 0.40, 0.5).when(s >= 0.25, 0.3).otherwise(0.15)


#: Feedback by error class, for high scores, and ('') for any other class.
MESSAGES = {
    "high": "Excellent — all key points covered.",
    "off_topic": "Your answer doesn't address the question. Re-read: {question}",
    "conceptual": "Core concept misunderstood. Review: {missing}.",
    "partial": "Partially correct. Missing details on: {missing}.",
    "code_syntax": "Code logic may be right but contains syntax errors. Review carefully.",
    "careless": "Almost there — improve precision on: {missing}.",
    "": "Review the concept — missing: {missing}.",
}


def credit(similarity: Column) -> Column:
    return F.when(similarity >= 0.60, 1.0).when(similarity >= 0.45, 0.6).when(similarity >= 0.30, 0.2).otherwise(0.0)


def reference_sentences(reference: Column) -> Column:
    strip = lambda s: F.regexp_replace(s, r"^[ \t\n\r]+|[ \t\n\r]+$", "")
    parts = F.filter(F.transform(F.split(reference, "[.]"), strip), lambda s: F.length(s) > 5)
    return bind(parts, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(reference)))


def length_factor(answer: Column, reference: Column) -> Column:
    a, r = F.size(t.tokens(answer)), F.size(t.tokens(reference))
    ratio = a / F.when(r > 0, r)
    return F.when(r == 0, 1.0).when(ratio >= 0.40, 1.0).when(ratio >= 0.25, 0.85).when(ratio >= 0.15, 0.70).otherwise(0.55)


def copied_share(answer: Column, question: Column) -> Column:
    a, q = F.array_distinct(t.tokens(F.lower(answer))), F.array_distinct(t.tokens(F.lower(question)))
    return F.size(F.array_intersect(a, q)) / F.greatest(F.size(q), F.lit(1))


def recalibrate(score: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score - low) / (high - low)))


def weighted(kind: Column, parts: list[Column]) -> Column:
    total = lambda w: reduce(lambda a, b: a + b, [v * p for v, p in zip(w, parts)])
    chain = F.when(F.lit(False), 0.0)
    for name, w in WEIGHTS.items():
        chain = chain.when(kind == name, total(w))
    return chain.otherwise(total(OTHER_WEIGHTS))


def error_class(score: Column, similarity: Column, keyword: Column, nli: Column, overlap: Column, code: Column) -> Column:
    return (
        F.when(score >= 0.75, "none").when((similarity < 0.25) & (overlap < 0.1), "off_topic").when((nli < 0.3) & (overlap > 0.2), "conceptual")
        .when(code & (score < 0.5), "code_syntax").when((keyword < 0.3) & (similarity > 0.4), "partial").when(score < 0.5, "partial").otherwise("careless")
    )


def feedback(score: Column, error: Column, missing: Column, question: Column, messages: dict[str, str] = MESSAGES, high: float = 0.85) -> Column:
    """The message of an answer's error class; {missing} in it are the words that the answer lacks, {question} the question."""
    words = F.when(F.size(missing) > 0, F.array_join(missing, ", ")).otherwise("key concepts")
    fields = {"{missing}": words, "{question}": question}

    def filled(message: str) -> Column:
        return F.concat(*[fields.get(p, F.lit(p)) for p in re.split(r"({missing}|{question})", message) if p])

    by_class = [(k, m) for k, m in messages.items() if k not in ("", "high")]
    return reduce(lambda c, km: c.when(error == km[0], filled(km[1])), by_class, F.when(score >= high, filled(messages["high"]))).otherwise(filled(messages[""]))


def _pair() -> Column:
    """A key for answer and reference: a pair that comes again is graded once."""
    return F.concat(F.md5(F.coalesce("answer", F.lit(""))), F.md5(F.coalesce("reference", F.lit(""))))


def completeness(answers: DataFrame, encode: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """``answers(answer, reference, ..)`` with ``completeness``."""
    if encode is None:
        return answers.withColumn("completeness", word_likeness(F.col("answer"), F.col("reference"))["completeness"])
    keyed = answers.withColumn("__pair", _pair())
    pairs = keyed.select(F.col("__pair").alias("pair"), "answer", "reference").dropDuplicates(["pair"])
    found = similarities(pairs, encode).select(F.col("pair").alias("__pair"), "completeness")
    return keyed.join(found, "__pair").drop("__pair")


def grade(answers: DataFrame, encode: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """``answers(question, reference, answer, question_type, ..)`` with scores, error class and feedback. An answer that
    repeats the question scores 0 everywhere. ``encode`` makes vectors of answers, references and their sentences; the
    default counts words. Work grows with the number of words, whatever a text's length."""
    key = F.coalesce(keyword_share(F.col("answer"), F.col("reference")), F.lit(0.0)).alias("__key")
    if encode is None:
        likeness = answers.select("*", word_likeness(F.col("answer"), F.col("reference")).alias("__like"), key)
        scored = likeness.select(*answers.columns, "__key", F.col("__like.similarity").alias("__sim"), F.col("__like.completeness").alias("__com"))
    else:
        keyed = answers.withColumn("__pair", _pair())
        found = similarities(keyed.select(F.col("__pair").alias("pair"), "answer", "reference").dropDuplicates(["pair"]), encode)
        scored = keyed.join(found.select(F.col("pair").alias("__pair"), F.col("similarity").alias("__sim"), F.col("completeness").alias("__com")), "__pair").select("*", key)
    a = scored.select(
        "*", t.tokens(t.preprocess(F.col("answer"))).alias("__at"), t.content_words(F.col("reference")).alias("__rw"), t.content_words(F.col("answer")).alias("__aw"),
        (copied_share(F.col("answer"), F.col("question")) > 0.8).alias("__copied"),
    )
    ref_set = F.array_distinct("__rw")
    a = a.select(
        "*", entailment(contradicts(F.col("__at"), ref_set), F.col("__sim")).alias("__nli"), length_factor(F.col("answer"), F.col("reference")).alias("__len"),
        (F.size(F.array_intersect(F.array_distinct("__aw"), ref_set)) / F.greatest(F.size(ref_set), F.lit(1))).alias("__over"),
        F.slice(F.array_except(F.filter("__rw", lambda w: F.length(w) > 3), F.col("__at")), 1, 5).alias("__missing"),
    )
    raw = weighted(F.col("question_type"), [F.col("__sim"), F.col("__key"), F.col("__nli"), F.col("__com")]) * F.col("__len")
    a = a.withColumn("__final", F.round(recalibrate(raw).cast("decimal(38,12)"), 3).cast("double"))
    code = t.contains_count(F.col("answer"), t.ANSWER_CODE_SIGNALS) >= 2
    a = a.withColumn("__err", error_class(F.col("__final"), F.col("__sim"), F.col("__key"), F.col("__nli"), F.col("__over"), code))
    zero = lambda c: F.when(F.col("__copied"), 0.0).otherwise(c)
    return a.select(
        *answers.columns, zero(F.col("__sim")).alias("semantic"), zero(F.col("__key")).alias("keyword"), zero(F.col("__nli")).alias("nli"), zero(F.col("__com")).alias("completeness"),
        zero(F.col("__len")).alias("length_factor"), zero(F.col("__final")).alias("final"), F.when(F.col("__copied"), "conceptual").otherwise(F.col("__err")).alias("error_type"),
        F.when(F.col("__copied"), "The answer repeats the question.").otherwise(feedback(F.col("__final"), F.col("__err"), F.col("__missing"), F.col("question"))).alias("feedback"),
    )


def question_problem(question: Column, answer: Column) -> Column:
    """Why a generated question is not valid; null if it is."""
    n = lambda c: F.size(t.tokens(c))
    return F.when(F.contains(question, F.lit("Error")) | F.contains(answer, F.lit("Error")), "error").when(n(question) < 5, "short question").when(n(answer) < 5, "short answer")


def is_choice(text: Column) -> Column:
    return t.contains_count(F.lower(text), t.OPTION_MARKS) >= 3


def valid_choice(question: Column, options: Column, correct: Column) -> Column:
    """A question of four words, options under exactly the keys a) to d), none blank, and a correct answer that is one of
    these keys, with or without its bracket, and points to an option of two words."""
    keys, four = F.transform(F.map_keys(options), lambda k: F.lower(F.trim(k))), F.array(*[F.lit(k) for k in ("a)", "b)", "c)", "d)")])
    named = F.lower(F.trim(correct))
    key = F.when(F.endswith(named, F.lit(")")), named).otherwise(F.concat(named, F.lit(")")))
    full = F.forall(F.map_values(options), lambda v: F.trim(F.coalesce(v, F.lit(""))) != "")
    resolved = F.size(t.tokens(F.coalesce(F.element_at(options, key), F.lit("")))) >= 2
    valid = (F.size(t.tokens(question)) >= 4) & (F.array_sort(F.array_distinct(keys)) == four) & full & F.array_contains(four, key) & resolved
    return F.coalesce(valid, F.lit(False))

