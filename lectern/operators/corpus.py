"""Corpus building: sections, chunks, ids, duplicates, profiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.hooks import embedder
from .context import semantic_segments

#: Components of the vectors that stand in for a model's.
SENTENCE_WIDTH = 256


def paragraph_sections(docs: DataFrame, separator: str = r"\n{2,}", size: int = 5) -> DataFrame:
    """doc_id, page_number, section, text: groups of ``size`` paragraphs; a text without any is one section."""
    # a lambda of one argument: the bare function would take each paragraph's place as the characters to trim
    parts = docs.select("doc_id", F.posexplode(F.filter(F.transform(F.split("text", separator), lambda p: F.trim(p)), lambda p: p != "")).alias("pos", "paragraph"))
    rows = parts.select("doc_id", F.floor(F.col("pos") / size).alias("g"), "pos", "paragraph")
    joined = rows.groupBy("doc_id", "g").agg(F.array_sort(F.collect_list(F.struct("pos", "paragraph"))).alias("p"))
    found = joined.select("doc_id", (F.col("g") + 1).alias("page_number"), F.concat(F.lit("Section "), (F.col("g") + 1).cast("string")).alias("section"), F.array_join(F.col("p.paragraph"), "\n\n").alias("text"))
    blank = docs.where(F.trim(F.coalesce("text", F.lit(""))) == "").select("doc_id", F.lit(1).cast("long").alias("page_number"), F.lit("").alias("section"), F.lit("").alias("text"))
    return found.unionByName(blank)


def heading_sections(lines: DataFrame, is_heading: Column) -> DataFrame:
    """doc_id, page_number, section, text from ``lines(doc_id, pos, line)``: what follows a heading belongs to it; the
    first group is "Introduction"; headings without text have no section."""
    w = W.partitionBy("doc_id").orderBy("pos")
    g = lines.withColumn("h", is_heading).withColumn("g", F.sum(F.col("h").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    rows = g.groupBy("doc_id", "g").agg(
        F.max(F.when(F.col("h"), F.trim("line"))).alias("heading"),
        F.array_sort(F.collect_list(F.when(~F.col("h") & (F.trim("line") != ""), F.struct("pos", F.trim("line").alias("line"))))).alias("p"),
    )
    full = rows.where(F.size("p") > 0)
    number = F.row_number().over(W.partitionBy("doc_id").orderBy("g"))
    return full.select("doc_id", number.alias("page_number"), F.coalesce("heading", F.lit("Introduction")).alias("section"), F.array_join(F.col("p.line"), "\n").alias("text"))


def lines_table(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(t.lines_of(F.col("text"))).alias("pos", "line"))


def parent_id(file_path: Column, page: Column) -> Column:
    return F.md5(F.concat(file_path, F.lit("::p"), page.cast("string")))


def chunk_id(file_path: Column, page: Column, index: Column, text: Column) -> Column:
    return F.md5(F.concat(file_path, F.lit("::p"), page.cast("string"), F.lit("::c"), index.cast("string"), F.lit("::"), F.length(text).cast("string"), F.lit("::"), text))


def typed(parts: DataFrame) -> DataFrame:
    """Chunk rows of parts (file_name, file_path, page_number, section, chunk_index, total_chunks, text), typed and with ids."""
    return parts.select(
        chunk_id(F.col("file_path"), F.col("page_number"), F.col("chunk_index"), F.col("text")).alias("chunk_id"), "text", "file_name", "file_path", "page_number", "section", "chunk_index", "total_chunks",
        parent_id(F.col("file_path"), F.col("page_number")).alias("parent_id"), t.chunk_type(F.col("text")).alias("chunk_type"),
        t.detect_code(F.col("text")).alias("contains_code"), t.detect_example(F.col("text")).alias("contains_example"),
    )


def chunks(sections: DataFrame, size: int = 500, overlap: int = 80) -> DataFrame:
    """Chunk rows of sections (file_name, file_path, page_number, section, text), typed and with ids."""
    packed = sections.where(F.trim("text") != "").withColumn("parts", t.pack_sentences(F.col("text"), size, overlap))
    return typed(packed.select("file_name", "file_path", "page_number", "section", F.size("parts").alias("total_chunks"), F.posexplode("parts").alias("chunk_index", "text")))


def sentence_vectors(sentences: DataFrame, encode: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """``sentences`` (key, pos, text) with ``embedding``; every different sentence is embedded once."""
    distinct = sentences.select(F.md5("text").alias("doc_id"), "text").dropDuplicates(["doc_id"])
    found = embedder(distinct, encode, SENTENCE_WIDTH).withColumnRenamed("doc_id", "id")
    return sentences.join(found, F.md5("text") == F.col("id")).drop("id")


def semantic_chunks(sections: DataFrame, vectors: Callable[[DataFrame], DataFrame] = sentence_vectors, threshold: float = 0.4, size: int = 500, overlap: int = 80) -> DataFrame:
    """As ``chunks``, cut where the topic shifts: a chunk ends before a sentence whose vector's cosine to the one before is
    below ``threshold``, and a longer one than ``size`` is packed anew from its sentences.

    ``vectors`` gives sentences (key, pos, text) their ``embedding``. A text of ``size`` characters or fewer, or of one
    sentence, is one chunk, whatever its length; a blank one has none. Sections are told apart by path, page and name.
    """
    own = ["file_name", "file_path", "page_number", "section"]
    keyed = sections.where(F.trim("text") != "").withColumn("key", F.md5(F.to_json(F.struct(*own)))).withColumn("parts", t.sentences(F.col("text")))
    short = (F.length("text") <= size) | (F.size("parts") <= 1)
    whole = keyed.where(short).select("key", F.lit(0).cast("long").alias("segment"), F.array(F.trim("text")).alias("pieces"))
    cut = vectors(keyed.where(~short).select("key", F.posexplode("parts").alias("pos", "text")))
    found = semantic_segments(cut, "key", "pos", threshold).groupBy("key", "segment").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("s"))
    joined = found.select("key", F.col("segment").cast("long").alias("segment"), F.array_join("s.text", " ").alias("text"))
    pieces = F.when(F.length("text") > size, t.pack_sentences(F.col("text"), size, overlap)).otherwise(F.array("text"))
    every = whole.unionByName(joined.select("key", "segment", pieces.alias("pieces"))).select("key", "segment", F.posexplode("pieces").alias("piece", "text")).where(F.trim("text") != "")
    w = W.partitionBy("key")
    placed = every.withColumn("chunk_index", F.row_number().over(w.orderBy("segment", "piece")) - 1).withColumn("total_chunks", F.count("*").over(w).cast("int"))
    return typed(placed.drop("segment", "piece").join(keyed.select("key", *own).distinct(), "key"))


def corpus_build(docs: DataFrame, separator: str = r"\n{2,}", chunked: Callable[[DataFrame], DataFrame] = chunks) -> DataFrame:
    """Chunks of ``docs`` (doc_id, file_name, file_path, text) from raw text on: paragraphs in sections, each normalised,
    cut by ``chunked`` (``chunks``, ``semantic_chunks``) and deduplicated by id, the first by path, page and place."""
    found = paragraph_sections(docs, separator).withColumn("text", t.normalize_text(F.col("text")))
    sections = found.join(docs.select("doc_id", "file_name", "file_path"), "doc_id")
    return keep_first(chunked(sections), [F.col("chunk_id")], [F.col("file_path"), F.col("page_number"), F.col("chunk_index")])


def keep_first(rows: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """One row per key, the first by ``order``. Partial aggregates keep a hot key from gathering its rows in one task."""
    columns = rows.columns
    best = rows.groupBy(*[k.alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("r"))
    return best.select("r.*")


def keep_latest(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Upsert: rows of ``new`` replace those of the same key in ``old``."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    columns = old.columns
    return both.groupBy(key).agg(F.max_by(F.struct(*columns), "__new").alias("r")).select("r.*")


def update_columns(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``rows`` with ``columns`` replaced where ``changes`` has a value for the key."""
    c = changes.select(key, *[F.col(x).alias(f"__{x}") for x in columns])
    j = rows.join(c, key, "left")
    return j.select(*[F.coalesce(f"__{x}", x).alias(x) if x in columns else F.col(x) for x in rows.columns])


def file_texts(rows: DataFrame, first: int = 20, limit: int = 10_000) -> DataFrame:
    """file_name, text: the first chunks of each file joined and cut. Only ``first`` rows a file leave each task."""
    top = rows.withColumn("__n", F.row_number().over(W.partitionBy("file_name").orderBy("pos"))).where(F.col("__n") <= first)
    joined = top.groupBy("file_name").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("p"))
    return joined.select("file_name", F.substring(F.array_join(F.col("p.text"), "\n"), 1, limit).alias("text"))


def profile(chunked: DataFrame) -> DataFrame:
    return chunked.agg(
        F.count("*").alias("chunks"), F.count_if(F.col("chunk_type") == "code").alias("code_chunks"), F.count_if(F.col("chunk_type") == "equation").alias("equation_chunks"),
        F.count_if("contains_code").alias("with_code"), F.count_if("contains_example").alias("with_example"), F.count_distinct("parent_id").alias("parents"),
    )


def regular_table(text: Column) -> Column:
    """Recognised text as a markdown table after the mark [TABLE]: lines are cut at two or more blanks, or else at each;
    the most frequent width, first seen if tied, is that of all rows, short ones padded and long ones cut; without
    letters in most cells of the first row, there is a head of numbered columns. Fewer than two lines stay as they are."""
    strip = lambda s: F.regexp_replace(s, r"^[ \t\n\r]+|[ \t\n\r]+$", "")
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")

    def cells(line: Column) -> Column:
        wide = F.split(line, r"[ \t]{2,}")
        return F.when(F.size(wide) > 1, wide).otherwise(F.filter(F.split(line, r"[ \t]+"), lambda c: c != ""))

    def modal(widths: Column) -> Column:
        # sorted widths in runs: linear in the lines but for the sort
        counted = F.aggregate(
            F.array_sort(F.transform(widths, lambda w, i: F.struct(w.alias("w"), i.alias("i")))),
            F.struct(F.lit(-1).alias("w"), F.lit(0).alias("n"), F.lit(0).alias("i"), F.lit(0).alias("bw"), F.lit(0).alias("bn"), F.lit(0).alias("bi")),
            lambda a, x: _run(F.when(a["w"] == x["w"], F.struct(a["w"].alias("w"), (a["n"] + 1).alias("n"), a["i"].alias("i"))).otherwise(F.struct(x["w"].alias("w"), F.lit(1).alias("n"), x["i"].alias("i"))), a),
        )
        return counted["bw"]

    def _run(now: Column, a: Column) -> Column:
        better = (now["n"] > a["bn"]) | ((now["n"] == a["bn"]) & (now["i"] < a["bi"]))
        pick = lambda have, best: F.when(better, have).otherwise(best)
        return F.struct(now["w"].alias("w"), now["n"].alias("n"), now["i"].alias("i"), pick(now["w"], a["bw"]).alias("bw"), pick(now["n"], a["bn"]).alias("bn"), pick(now["i"], a["bi"]).alias("bi"))

    def shaped(rows: Column) -> Column:
        def table(width: Column) -> Column:
            fit = lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), width)), F.lit(1), width)
            line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
            first = fit(F.get(rows, F.lit(0)))
            named = F.size(F.filter(first, lambda c: F.rlike(c, F.lit(r"\p{L}")))) / width > 0.5
            numbers = F.transform(F.sequence(F.lit(1), width), lambda i: F.concat(F.lit("Column "), i.cast("string")))
            head = F.when(named, first).otherwise(numbers)
            body = F.when(named, F.slice(rows, F.lit(2), F.size(rows))).otherwise(rows)
            rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), width))
            return F.array_join(F.concat(F.array(line(head), rule), F.transform(body, lambda r: line(fit(r)))), "\n")

        return F.get(F.transform(F.array(modal(F.transform(rows, F.size))), table), F.lit(0))

    made = F.get(F.transform(F.array(F.transform(lines, cells)), shaped), F.lit(0))
    return F.concat(F.lit("[TABLE]\n"), F.when(F.size(lines) < 2, text).otherwise(made))
