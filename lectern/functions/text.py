"""Text functions as column expressions; no Python runs on the rows."""

from __future__ import annotations

import unicodedata
from functools import cache, reduce
from string import ascii_lowercase, digits

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Markers that the classifiers look for.
EXAMPLE_WORDS = ("example", "consider", "suppose", "let us", "case", "illustration")
CHART_WORDS = ("chart", "graph", "x-axis", "y-axis", "legend", "series", "plot", "trend", "increase", "decrease", "percentage", "vs ", "axis")
PREAMBLES = ("here is", "i fixed", "the corrected", "below is", "certainly", "sure,", "of course")
CODE_STARTS = ("class ", "public ", "private ", "def ", "#include")
CODE_SIGNALS = ("{", "}", ";", "#include", "class ", "return", "::")
ANSWER_CODE_SIGNALS = ("{", "}", ";", "::", "->", "def ", "class ", "#include", "return ", "void ")
OPTION_MARKS = ("a)", "b)", "c)", "d)", "a.", "b.", "c.", "d.", "1)", "2)", "3)", "4)")
#: Substitutions in recognised code. Letters, digits and _ of any alphabet make a word.
OCR_FIXES = ((r"(?<=[a-zA-Z])0(?![\p{L}\p{N}_])", "O"), (r"(?<![\p{L}\p{N}_])l(?![\p{L}\p{N}_])", "1"), (r"(?<=[0-9])l(?=[0-9])", "1"))
#: English stop words of the usual list; they hold "no" and "not", which leave reference words too.
STOP_WORDS = tuple(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that "
    "these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during "
    "before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own "
    "same so than too very s t can will just don should now".split()
)
NEGATIONS = ("not", "no", "never", "none", "incorrect", "wrong", "false")


def contains_count(text: Column, marks: tuple[str, ...]) -> Column:
    """How many of the marks stand in the text."""
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(m)).cast("int") for m in marks])


def any_of(text: Column, marks: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in marks])


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


@cache
def ascii_forms() -> tuple[str, str, dict[str, str]]:
    """What is left in ASCII of the compatibility decompositions of Unicode's first plane, Hangul and ideographs apart:
    characters and their one-letter forms, and those that have longer ones."""
    one, long = {}, {}
    for c in map(chr, (*range(0xA0, 0x3400), *range(0xF900, 0x10000))):
        form = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
        if len(form) == 1:
            one[c] = form
        elif form:
            long[c] = form
    return "".join(one), "".join(one.values()), long


def to_ascii(text: Column) -> Column:
    """Letters without their accents, ligatures and other compatibility characters written out; the rest of what is
    not ASCII goes."""
    have, want, long = ascii_forms()
    plain = F.translate(text, have, want)
    few = [c for c in long if ord(c) < 0x2200 or 0xFB00 <= ord(c) <= 0xFB06]
    written = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(long[c])), few, plain)
    return F.regexp_replace(F.when(F.rlike(plain, F.lit(f"[{''.join(few)}]")), written).otherwise(plain), r"[^\x00-\x7f]", "")


def normalize_text(text: Column) -> Column:
    """ASCII only, without control characters, rules, bare page numbers, repeated characters and lines of signs."""
    ascii_only = F.regexp_replace(to_ascii(text), r"[\x00\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    lines = lines_of(F.regexp_replace(ascii_only, r"\n{3,}", "\n\n"))

    def keep(lines: Column) -> Column:
        def test(line: Column) -> Column:
            s = F.trim(line)
            return (s == "") | ~(
                F.rlike(s, F.lit(r"^[-=_*]{3,}$")) | (F.rlike(s, F.lit(r"^[0-9]{1,3}$")) & (F.size(lines) > 20))
                | F.rlike(s, F.lit(r"^(.)\1{2,}$")) | ((F.length(s) > 12) & ~F.rlike(s, F.lit("[a-zA-Z]")))
            )

        return F.array_join(F.transform(F.filter(lines, test), lambda x: F.when(F.trim(x) == "", "").otherwise(x)), "\n")

    kept = F.get(F.transform(F.array(lines), keep), F.lit(0))
    return F.regexp_replace(kept, r"^[ \t\n\r]+|[ \t\n\r]+$", "")


def clean_ocr_text(text: Column) -> Column:
    """Normalised text without lines of preamble."""
    kept = F.array_join(F.filter(lines_of(normalize_text(text)), lambda x: ~any_of(F.lower(F.trim(x)), PREAMBLES)), "\n")
    return F.regexp_replace(kept, r"^[ \t\n\r]+|[ \t\n\r]+$", "")


def fix_ocr_code(text: Column) -> Column:
    """Usual confusions of recognised code: a zero at a word's end is an O, an l alone or between digits a one."""
    for pattern, correct in OCR_FIXES:
        text = F.regexp_replace(text, pattern, correct)
    return text


def code_score(text: Column) -> Column:
    """Two for each line of code, one for each that has a brace or semicolon."""

    def one(line: Column) -> Column:
        s = F.trim(line)
        has = lambda m: F.contains(s, F.lit(m))
        starts = reduce(lambda a, b: a | b, [s.startswith(m) for m in CODE_STARTS])
        strong = starts | has("::") | has("->") | (has("(") & has(")") & has("{")) | (has("=") & has(";"))
        return F.when(strong, 2).when(has("{") | has("}") | has(";"), 1).otherwise(0)

    return F.aggregate(F.transform(lines_of(text), one), F.lit(0), lambda a, x: a + x)


def detect_code(text: Column) -> Column:
    return code_score(text) >= 4


def chunk_type(text: Column) -> Column:
    return F.when(detect_code(text), "code").when(F.rlike(text, F.lit(r"[$\\∫∑√]")), "equation").otherwise("text")


def detect_example(text: Column) -> Column:
    return any_of(F.lower(text), EXAMPLE_WORDS)


def detect_chart(text: Column) -> Column:
    low = F.lower(text)
    return (contains_count(low, CHART_WORDS) >= 2) & F.rlike(low, F.lit("[0-9]"))


def sentences(text: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` and white space."""
    marked = F.regexp_replace(text, r"([.!?])[ \t\n\r]+", "$1\u0001")
    return F.split(marked, "\u0001")


def _tail(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.substring(text, -n, n)).otherwise(text)


def pack_sentences(text: Column, size: int = 500, overlap: int = 80) -> Column:
    """Chunks of whole sentences of about ``size`` characters, each beginning with the last ``overlap`` of the one before.

    A short text is one chunk, a blank one none; a sentence longer than ``size`` makes an oversized chunk.
    """
    none = F.array().cast("array<string>")

    def step(acc: Column, s: Column) -> Column:
        fits = F.length(acc["now"]) + F.length(s) + 1 <= size
        return F.struct(
            F.when(fits | (acc["now"] == ""), acc["done"]).otherwise(F.array_append(acc["done"], acc["now"])).alias("done"),
            F.trim(F.concat(F.when(fits, acc["now"]).otherwise(_tail(acc["now"], overlap)), F.lit(" "), s)).alias("now"),
        )

    packed = F.aggregate(
        sentences(text), F.struct(none.alias("done"), F.lit("").alias("now")), step, lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["now"]))
    )
    whole = F.trim(text)
    return F.when(F.length(text) <= size, F.when(whole == "", none).otherwise(F.array(whole))).otherwise(packed)


def hard_split(text: Column, size: int = 500, overlap: int = 80) -> Column:
    """Chunks of whole sentences without overlap; a longer sentence is cut to pieces that overlap."""
    none = F.array().cast("array<string>")
    stride = size - overlap

    def step(acc: Column, s: Column) -> Column:
        fits = F.length(acc["now"]) + F.length(s) + 1 <= size
        flushed = F.when(acc["now"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["now"]))
        cuts = F.when(F.length(s) > size, F.ceil((F.length(s) - size) / stride)).otherwise(0).cast("int")
        pieces = F.when(cuts > 0, F.transform(F.sequence(F.lit(0), cuts - 1), lambda i: F.substring(s, i * stride + 1, F.lit(size)))).otherwise(none)
        rest = F.substring(s, cuts * stride + 1, F.length(s))
        return F.struct(
            F.when(fits, acc["done"]).otherwise(F.concat(flushed, pieces)).alias("done"),
            F.when(fits, F.trim(F.concat(acc["now"], F.lit(" "), s))).otherwise(rest).alias("now"),
        )

    split = F.aggregate(
        sentences(text), F.struct(none.alias("done"), F.lit("").alias("now")), step, lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["now"]))
    )
    return F.when(F.length(text) <= size, F.when(F.trim(text) == "", none).otherwise(F.array(text))).otherwise(split)


def preprocess(text: Column) -> Column:
    # the letters one by one: a class with ranges takes the engine about ten times as long
    return F.regexp_replace(F.lower(text), rf"[^{ascii_lowercase}{digits} \t\n\r]+", "")


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t\n\r]+"), lambda w: w != "")


def content_words(text: Column, longer_than: int = 0) -> Column:
    """Preprocessed words that are no stop words."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(tokens(preprocess(text)), lambda w: ~F.array_contains(stop, w) & (F.length(w) > longer_than))


def title_case(text: Column) -> Column:
    return F.initcap(text)


def code_blocks(text: Column) -> Column:
    """Fenced blocks of code, else the lines that look like code."""
    fenced = F.regexp_extract_all(text, F.lit(r"(?s)```[a-zA-Z+]*\n?(.*?)```"), 1)
    lines = F.filter(lines_of(text), lambda x: code_score(x) > 0)
    return F.when(F.size(fenced) > 0, F.array_join(fenced, "\n")).otherwise(F.array_join(lines, "\n"))


def prose(text: Column) -> Column:
    """The text without its code."""
    fenced = F.regexp_replace(text, r"(?s)```[a-zA-Z+]*\n?.*?```", "")
    lines = F.array_join(F.filter(lines_of(text), lambda x: code_score(x) == 0), "\n")
    return F.trim(F.when(F.contains(text, F.lit("```")), fenced).otherwise(lines))


#: What makes a line of a question code, if it has no fenced block.
LINE_CODE_SIGNALS = (
    "{", "}", ";", "::", "->", "def ", "class ", "public ", "private ", "return ", "#include",
    "void ", "int ", "bool ", "string ", "()", "==", "!=", "+=", "-=", "<=", ">=",
)


def code_and_prose(text: Column) -> tuple[Column, Column]:
    """Code and prose of a text, both trimmed: its fenced blocks, joined by blank lines, and the rest; without a fenced
    block, lines with a sign of code or an indent of two blanks, and the other lines. Null gives nulls."""
    strip = lambda c: F.btrim(c, F.lit(" \t\n\r\f\x0b"))
    fence = r"(?s)```(?:[\p{L}\p{N}_]+)?\n?(.*?)\n?```"
    blocks = F.regexp_extract_all(text, F.lit(fence), F.lit(1))
    is_code = lambda x: any_of(x, LINE_CODE_SIGNALS) | (x.startswith("  ") & (strip(x) != ""))
    lines = F.split(text, "\n")
    code = F.when(F.size(blocks) > 0, F.array_join(blocks, "\n\n")).otherwise(F.array_join(F.filter(lines, is_code), "\n"))
    rest = F.when(F.size(blocks) > 0, F.regexp_replace(text, fence, "")).otherwise(F.array_join(F.filter(lines, lambda x: ~is_code(x)), "\n"))
    return strip(code), strip(rest)


def json_slice(text: Column, opening: str = "{") -> Column:
    """From the first opening brace (or bracket) to the last closing one; fences are dropped first; null if none."""
    bare = F.regexp_replace(text, "```(json)?", "")
    found = F.regexp_extract(bare, r"(?s)\{.*\}" if opening == "{" else r"(?s)\[.*\]", 0)
    return F.when(found != "", found)


def known(column: Column) -> Column:
    """Null, '' and 'Unknown' all mean that there is no topic."""
    return ~F.coalesce(column, F.lit("")).isin("", "Unknown")
