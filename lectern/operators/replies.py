"""Questions read from the replies of a model: sound JSON, broken JSON, or plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A fenced block with its language, and the mark that stands for the block of that number.
FENCE = r"(?s)```(?:[a-zA-Z]*\n?)?(.*?)```"
MARK = "__CODE_BLOCK_{}__"
BLANKS = " \t\n\r\f\x0b"
#: What a reply without a question or an answer has instead.
ERROR = "Error"
#: Strings (the last one perhaps open), escaped characters, and everything between. Possessive, so that long strings
#: need no stack.
_TOKEN = r'(?s)"(?:[^"\\]++|\\.)*+(?:"|\\?\z)|\\.|\\\z|[^"\\]++'


def _strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def _mark(place: Column) -> Column:
    before, after = MARK.split("{}")
    return F.concat(F.lit(before), place.cast("string"), F.lit(after))


def _places(blocks: Column) -> Column:
    return F.when(F.size(blocks) > 0, F.sequence(F.lit(0), F.size(blocks) - 1)).otherwise(F.array().cast("array<int>"))


def _fenced(code: Column) -> Column:
    return F.concat(F.lit("```\n"), code, F.lit("\n```"))


def without_code(text: Column, blocks: Column) -> Column:
    """``text`` with a mark in place of each fenced block."""
    parts = F.split(text, FENCE, -1)
    return F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.when(i < F.size(blocks), _mark(i)).otherwise(""))), "")


def with_code(text: Column, blocks: Column) -> Column:
    """``text`` with the blocks in place of their marks."""
    return F.aggregate(_places(blocks), text, lambda s, i: F.replace(s, _mark(i), _fenced(F.get(blocks, i))))


def _no_marks(text: Column, blocks: Column) -> Column:
    return F.aggregate(_places(blocks), text, lambda s, i: _strip(F.replace(s, _mark(i), F.lit(""))))


def _no_fences(text: Column) -> Column:
    return F.regexp_replace(text, FENCE, "")


def _object(text: Column) -> Column:
    """From the first { to the last }, or null; tripled quotes become one."""
    body = F.regexp_replace(F.regexp_replace(_strip(text), r"^```json\s*", ""), r"```$", "")
    return F.replace(F.nullif(F.regexp_extract(body, r"(?s)\{.*\}", 0), F.lit("")), F.lit('"""'), F.lit('"'))


def one_line_strings(json: Column) -> Column:
    """``json`` with a blank for each line end inside a string."""
    tokens = F.regexp_extract_all(json, F.lit(_TOKEN), F.lit(0))
    return F.array_join(F.transform(tokens, lambda x: F.when(x.startswith('"'), F.translate(x, "\n", " ")).otherwise(x)), "")


def one_object(json: Column) -> Column:
    """Whether the brace that closes the first object is the last one."""
    outside = F.regexp_replace(json, r'(?s)"(?:[^"\\]++|\\.)*+"', "")
    braces = F.regexp_extract_all(outside, F.lit(r"[{}]"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("closed"))

    def step(s: Column, b: Column) -> Column:
        depth = s["depth"] + F.when(b == "{", 1).otherwise(-1)
        return F.struct(depth.alias("depth"), (s["closed"] + (depth <= 0).cast("int")).alias("closed"))

    end = F.aggregate(braces, start, step)
    return (end["depth"] == 0) & (end["closed"] == 1)


def _read(replies: DataFrame, text: Column, name: str) -> DataFrame:
    """``replies`` with a struct of the fields that JSON gives, or the patterns of two fields in broken JSON; null where
    neither does."""
    r = replies.withColumn("__json", one_line_strings(_object(text)))
    r = r.withColumn("__map", F.when(one_object(F.col("__json")) & F.try_parse_json("__json").isNotNull(), F.from_json("__json", "map<string,variant>")))
    text_of = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    field = lambda n: text_of(F.try_element_at("__map", F.lit(n)))
    pattern = lambda n: rf'(?s)"{n}"\s*:\s*"((?:[^"\\]++|\\.)*+)"'
    found = lambda n: _strip(F.regexp_extract("__json", pattern(n), 1))
    other = F.filter(F.map_entries("__map"), lambda e: (e["key"] != "question") & (F.size(F.split(_strip(F.coalesce(text_of(e["value"]), F.lit(""))), r"\s+")) > 5))
    none = F.lit(None).cast("string")
    sound = F.struct(
        _strip(F.coalesce(field("question"), F.lit(""))).alias("question"), F.coalesce(field("reference_answer"), F.lit("")).alias("answer"),
        F.try_variant_get(F.try_element_at("__map", F.lit("options")), "$", "map<string,string>").alias("options"), field("correct_answer").alias("correct_answer"),
        F.lit("json").alias("path"), F.transform(other, lambda e: text_of(e["value"])).alias("other"),
    )
    broken = F.struct(
        found("question").alias("question"), found("reference_answer").alias("answer"), F.lit(None).cast("map<string,string>").alias("options"), none.alias("correct_answer"),
        F.lit("fields").alias("path"), F.array().cast("array<string>").alias("other"),
    )
    both = F.regexp_like("__json", F.lit(pattern("question"))) & F.regexp_like("__json", F.lit(pattern("reference_answer")))
    whole = F.size("__map") > 0
    return r.withColumn(name, F.when(whole, sound).when(F.col("__map").isNull() & both, broken)).drop("__json", "__map")


def _plain(raw: Column, blocks: Column) -> Column:
    """The struct of what stands after the names of the two fields, else of the first line that asks."""
    middle = r'(?s)"question"\s*:(.*?)"reference_answer"\s*:'
    part = F.regexp_extract(raw, middle, 1)
    asked = _strip(F.regexp_replace(F.regexp_replace(_strip(part), r'^"+', ""), r'"++\s*+,?\s*+$', ""))
    codes = F.filter(F.transform(F.regexp_extract_all(part, F.lit(FENCE), F.lit(1)), _strip), lambda c: c != "")
    asked = F.aggregate(codes, asked, lambda s, c: F.when(F.contains(s, _fenced(c)), s).otherwise(F.concat(_fenced(c), F.lit("\n"), s)))
    told = _strip(F.regexp_extract(raw, r'(?s)"reference_answer"\s*:\s*"?(.*?)(?:"?\s*\}|\z)', 1))
    told = _strip(F.regexp_replace(F.regexp_replace(told, r'^"+', ""), r'"++\s*+\}?\s*+$', ""))
    told = _no_marks(_strip(_no_fences(told)), blocks)
    line = F.get(F.filter(F.transform(F.split(raw, "\n"), _strip), lambda x: x.endswith("?")), F.lit(0))
    first = F.when(F.size(blocks) > 0, F.concat(_fenced(F.get(blocks, F.lit(0))), F.lit("\n"), line)).otherwise(line)
    path = F.when((asked != "") | (told != ""), "pattern").when(line.isNotNull(), "line").otherwise("none")
    return F.struct(
        _strip(F.coalesce(F.nullif(asked, F.lit("")), first, F.lit(ERROR))).alias("question"), F.coalesce(F.nullif(told, F.lit("")), F.lit(ERROR)).alias("answer"),
        F.lit(None).cast("map<string,string>").alias("options"), F.lit(None).cast("string").alias("correct_answer"), path.alias("path"),
    )


def parse_questions(replies: DataFrame) -> DataFrame:
    """``replies(.., raw)`` with question, reference_answer, options, correct_answer and parse_path.

    Fenced code is put aside, and comes back in the question alone. ``parse_path``: ``json`` for sound JSON (line ends in
    strings become blanks), ``fields`` for two fields of broken JSON, ``pattern`` for the text after their names,
    ``line`` for the first line that asks, ``none`` for nothing. If the text without code gives no JSON, the whole reply
    is read, as when all of it is fenced. JSON without an answer takes its other strings of more than five words, in
    order. Fields of other types count as missing, a key that stands twice makes the JSON broken, a null reply is an
    empty one; a plain text without question or answer has "Error" there.
    """
    raw = F.coalesce(F.col("raw"), F.lit(""))
    r = replies.withColumn("__blocks", F.transform(F.regexp_extract_all(raw, F.lit(FENCE), F.lit(1)), _strip))
    blocks = F.col("__blocks")
    r = _read(r, without_code(raw, blocks), "__first")
    r = _read(r, F.when(F.col("__first").isNull(), raw), "__second")

    def result(read: str, question: Column, clean) -> Column:  # noqa: ANN001
        x = F.col(read)
        own = clean(x["answer"])
        answer = F.when(own != "", own).otherwise(clean(F.array_join(x["other"], "")))
        return F.struct(question.alias("question"), _strip(answer).alias("answer"), x["options"].alias("options"), x["correct_answer"].alias("correct_answer"), x["path"].alias("path"))

    first = result("__first", with_code(F.col("__first")["question"], blocks), lambda a: _no_marks(a, blocks))
    second = result("__second", F.col("__second")["question"], lambda a: _strip(_no_fences(a)))
    got = F.when(F.col("__first").isNotNull(), first).when(F.col("__second").isNotNull(), second).otherwise(_plain(raw, blocks))
    x = F.col("__got")
    return r.withColumn("__got", got).select(
        *replies.columns, x["question"].alias("question"), x["answer"].alias("reference_answer"), x["options"].alias("options"), x["correct_answer"].alias("correct_answer"), x["path"].alias("parse_path")
    )
