"""Tags of chunks: parsing replies, canonical topics, page consistency, concept graph, curriculum tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as t
from .replies import parse_questions  # noqa: F401  read with the tags

#: Defaults and allowed values of tags.
DEFAULTS = {"topic": "Unknown", "subtopic": "Unknown", "concept_type": "other", "difficulty": "medium", "keywords": ""}
CONCEPT_TYPES = ("definition", "example", "explanation", "summary", "other")
DIFFICULTIES = ("easy", "medium", "hard")


def parse_tags(replies: DataFrame) -> DataFrame:
    """``replies(.., raw)`` with the five tags: the salvaged JSON's strings, defaults for what is missing, no string or
    no allowed value."""
    v = F.try_parse_json(t.json_slice(F.col("raw")))
    r = replies.withColumn("__v", v)

    def tag(name: str) -> Column:
        got = F.try_variant_get("__v", f"$.{name}", "string")
        kind = F.schema_of_variant(F.try_variant_get("__v", f"$.{name}", "variant"))
        return F.when((kind == "STRING") & (F.trim(got) != ""), got).otherwise(DEFAULTS[name])

    out = r.select(*replies.columns, *[tag(n).alias(n) for n in DEFAULTS])
    low = lambda c: F.lower(F.trim(c))
    return out.withColumn("concept_type", F.when(low("concept_type").isin(*CONCEPT_TYPES), low("concept_type")).otherwise("other")).withColumn(
        "difficulty", F.when(low("difficulty").isin(*DIFFICULTIES), low("difficulty")).otherwise("medium")
    )


def canonical(rows: DataFrame, topics: DataFrame) -> DataFrame:
    """``rows`` with topic replaced by its canonical form (raw, canonical), or by the section if it was dropped."""
    dim = topics.select(F.lower("raw").alias("__raw"), "canonical")
    j = rows.join(F.broadcast(dim), F.lower("topic") == F.col("__raw"), "left")
    return j.withColumn("topic", F.coalesce("canonical", "section")).drop("__raw", "canonical")


def match_label(rows: DataFrame, topics: DataFrame) -> DataFrame:
    """``rows(id, label)`` with ``matched``: the topic equal to the label, else the first that holds it or is held, else
    the first. ``topics(topic, ord)`` is a dimension table."""
    same = F.lower("label") == F.lower("topic")
    inside = F.contains(F.lower("label"), F.lower("topic")) | F.contains(F.lower("topic"), F.lower("label"))
    j = rows.join(F.broadcast(topics), same | inside, "left")
    best = j.groupBy("id", "label").agg(F.min_by("topic", F.struct((~same).alias("other"), F.col("ord"))).alias("found"))
    first = topics.agg(F.min_by("topic", "ord").alias("first_topic"))
    return best.join(F.broadcast(first)).select("id", "label", F.coalesce("found", "first_topic").alias("matched"))


def page_consistent(rows: DataFrame) -> DataFrame:
    """``rows(doc_id, file_name, page_number, topic)`` with each page's most frequent known topic, ties to the first
    seen; pages without a known topic keep what they have."""
    page = ["file_name", "page_number"]
    votes = rows.where(t.known(F.col("topic"))).groupBy(*page, "topic").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    major = votes.groupBy(*page).agg(F.min_by("topic", F.struct((-F.col("n")).alias("n"), "first", "topic")).alias("major"))
    return rows.join(major, page, "left").withColumn("topic", F.coalesce("major", "topic")).drop("major")


def usable_replies(chunks: DataFrame, replies: DataFrame, tries: int = 3) -> DataFrame:
    """doc_id, raw, tried of each chunk without a topic that has ``replies(doc_id, attempt, raw)``: the first attempt that
    holds a JSON object, null if none of the first ``tries`` does, and the number of the last attempt. Of two replies to
    one attempt the smaller text counts."""
    waiting = chunks.where(F.col("topic").isNull()).select("doc_id")
    r = replies.where(F.col("attempt") <= tries).select("doc_id", "attempt", "raw").join(waiting, "doc_id", "left_semi")
    sound = F.try_parse_json(t.json_slice(F.col("raw"))).isNotNull()
    one = r.groupBy("doc_id").agg(F.min(F.when(sound, F.struct("attempt", "raw"))).alias("first"), F.max("attempt").alias("tried"))
    return one.select("doc_id", F.col("first.raw").alias("raw"), "tried")


def open_requests(chunks: DataFrame, replies: DataFrame, tries: int = 3) -> DataFrame:
    """doc_id, attempt: what is to be asked next, for chunks without a topic, without a usable reply and with tries left."""
    waiting = chunks.where(F.col("topic").isNull()).select("doc_id").distinct()
    j = waiting.join(usable_replies(chunks, replies, tries), "doc_id", "left")
    return j.where(F.col("raw").isNull() & (F.coalesce("tried", F.lit(0)) < tries)).select("doc_id", (F.coalesce("tried", F.lit(0)) + 1).alias("attempt"))


def enrich_chunks(chunks: DataFrame, replies: DataFrame, topics: DataFrame, tries: int = 3) -> DataFrame:
    """``chunks`` with the tags that a ledger of replies gives, the same columns and rows.

    Chunks with a topic keep their tags and take no reply, so a run over its own result changes nothing. Chunks without
    one take the tags of their first usable reply, or the defaults once ``tries`` attempts failed; their topic becomes
    the canonical one of ``topics(raw, canonical)``, else their section, else Unknown. Others wait, and are in
    ``open_requests``. All chunks that have a topic then take the majority of their page.
    """
    got = usable_replies(chunks, replies, tries).where(F.col("raw").isNotNull() | (F.col("tried") >= tries))
    tags = parse_tags(got.select("doc_id", "raw")).select("doc_id", F.struct(*DEFAULTS).alias("__tags"))
    j = chunks.join(tags, "doc_id", "left")
    new = F.col("topic").isNull() & F.col("__tags").isNotNull()
    tagged = j.withColumn("__new", new)
    for name in DEFAULTS:
        tagged = tagged.withColumn(name, F.when(F.col("__new"), F.col("__tags")[name]).otherwise(F.col(name)))
    dim = topics.groupBy(F.lower("raw").alias("__raw")).agg(F.min("canonical").alias("__canonical"))  # raw names twice add no rows
    named = tagged.join(dim, F.lower("topic") == F.col("__raw"), "left")
    topic = F.when(F.col("__new"), F.coalesce("__canonical", "section", F.lit(DEFAULTS["topic"]))).otherwise(F.col("topic"))
    named = named.withColumn("topic", topic).withColumn("__waits", F.col("topic").isNull()).select(*chunks.columns, "__waits")
    return page_consistent(named).withColumn("topic", F.when(~F.col("__waits"), F.col("topic"))).select(*chunks.columns)


def topic_difficulty(rows: DataFrame) -> DataFrame:
    """topic, level: the most frequent difficulty mapped to a level; ties to the first seen."""
    votes = rows.groupBy("topic", "difficulty").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    top = votes.groupBy("topic").agg(F.min_by("difficulty", F.struct((-F.col("n")).alias("n"), "first", "difficulty")).alias("difficulty"))
    return top.select("topic", F.when(F.col("difficulty") == "easy", "basic").when(F.col("difficulty") == "hard", "advanced").otherwise("intermediate").alias("level"))


def subtopics(rows: DataFrame) -> DataFrame:
    return rows.where(t.known(F.col("topic"))).groupBy("topic").agg(F.sort_array(F.collect_set("subtopic")).alias("subtopics"))


def concepts(docs: DataFrame, top: int = 5, chars: int = 500) -> DataFrame:
    """doc_id, concept: the longest words of each text's beginning, at most ``top``; the model-free labeller."""
    words = docs.select("doc_id", F.array_distinct(F.filter(t.tokens(t.preprocess(F.substring("text", 1, chars))), lambda w: F.length(w) > 3)).alias("w"))
    best = F.slice(F.array_sort(F.transform("w", lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1, top)
    return words.select("doc_id", F.explode(F.transform(best, lambda x: x["w"])).alias("concept"))


def concept_graph(found: DataFrame) -> DataFrame:
    """c1, c2: concepts of one chunk, both ways; linear in the chunks, as each has few concepts."""
    other = found.select("doc_id", F.col("concept").alias("c2"))
    return found.select("doc_id", F.col("concept").alias("c1")).join(other, "doc_id").where("c1 <> c2").select("c1", "c2").distinct()


def central_neighbours(edges: DataFrame, top: int) -> DataFrame:
    """c1, c2, degree, place: each concept's neighbours of most links."""
    degree = edges.groupBy("c1").agg(F.count("*").alias("degree")).withColumnRenamed("c1", "c2")
    j = edges.join(degree, "c2", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return j.withColumn("place", F.row_number().over(W.partitionBy("c1").orderBy(F.desc("degree"), "c2"))).where(F.col("place") <= top)


def expand(edges: DataFrame, wanted: DataFrame, limit: int = 5) -> DataFrame:
    """concept, near, place: the concept itself and up to ``limit`` neighbours."""
    j = wanted.join(edges, F.col("concept") == F.col("c1")).withColumn("place", F.row_number().over(W.partitionBy("concept").orderBy("c2"))).where(F.col("place") <= limit)
    return wanted.select("concept", F.col("concept").alias("near"), F.lit(0).alias("place")).unionByName(j.select("concept", F.col("c2").alias("near"), "place"))


def clean_prereqs(edges: DataFrame, topics: DataFrame) -> DataFrame:
    """Edges between two different known topics."""
    known = topics.select("topic").distinct()
    ends = edges.join(F.broadcast(known), "topic", "left_semi")
    return ends.join(F.broadcast(known.withColumnRenamed("topic", "prereq")), "prereq", "left_semi").where("topic <> prereq")


def tagging_outcome(tagged: DataFrame) -> DataFrame:
    default = F.lit(True)
    for name, value in DEFAULTS.items():
        default = default & (F.col(name) == value)
    return tagged.agg(F.count_if(~default).alias("tagged"), F.count_if(default).alias("defaulted"))


#: Kinds of chunks that the concept graph is made of, and how many at most.
EXCERPT_TYPES, EXCERPTS = ("definition", "explanation", "example"), 150


def excerpts(chunks: DataFrame, types: tuple[str, ...] = EXCERPT_TYPES, limit: int = EXCERPTS) -> DataFrame:
    """The first chunks of these kinds: the input of the concept graph."""
    return chunks.where(F.col("concept_type").isin(*types)).orderBy("doc_id").limit(limit)


def curriculum(chunks: DataFrame, prereqs: DataFrame) -> DataFrame:
    """topic, level, subtopics, prereqs (cleaned, in their order), excerpts (chunks of the graph's input), last_excerpt."""
    levels = topic_difficulty(chunks)
    known = clean_prereqs(prereqs, levels).groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("ord", "prereq"))).alias("p")).select("topic", F.col("p.prereq").alias("prereqs"))
    shown = excerpts(chunks).groupBy("topic").agg(F.count("*").alias("excerpts"), F.max("doc_id").alias("last_excerpt"))
    out = levels.join(subtopics(chunks), "topic", "left").join(known, "topic", "left").join(shown, "topic", "left")
    return out.withColumn("prereqs", F.coalesce("prereqs", F.array().cast("array<string>"))).withColumn("excerpts", F.coalesce("excerpts", F.lit(0)))
