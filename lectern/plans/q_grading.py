"""Queries of enrichment, grading, reviews, recommendation and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import context, enrich, reports
from ..operators import grading as g
from ..operators import mastery as m
from ..operators import products as p
from ..operators import recommend as rec
from ..operators import retrieval as r
from ..operators.corpus import keep_first
from ..registry import query, rounded
from ..sources.workspace import kept
from .q_retrieval import found_for_queries, hybrid_queries
from .views import attempts, chunk_meta, courses, judged, literal_table, pick, prereqs, qa, table, topic_levels, vectors, with_views

CM, CO, QA, JU = with_views("chunk_meta"), with_views("courses"), with_views("qa"), with_views("attempts", "judged")
KNOWN = "coalesce(topic, '') NOT IN ('', 'Unknown')"


def words_sql(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '[ \\t\\n\\r]+'), lambda w: w <> '')"


def pre_sql(c: str) -> str:
    return words_sql(f"regexp_replace(lower({c}), '[^a-z0-9 \\t\\n\\r]', '', 'g')")


STOP = "[" + ", ".join(f"'{w}'" for w in t.STOP_WORDS) + "]"
NEG = "[" + ", ".join(f"'{w}'" for w in t.NEGATIONS) + "]"


# --- projections and filters ---------------------------------------------------------------------------------


@query("p1_topic_filter", f"{CM} SELECT doc_id, topic, subtopic FROM chunk_meta WHERE topic IN ('src1', 'src4/en') OR subtopic IN ('src1', 'src4/en')")
def p1(s: SparkSession, d: str) -> DataFrame:
    cm = chunk_meta(s, d).select("doc_id", "topic", "subtopic")
    wanted = [F.lit(x) for x in ("src1", "src4/en")]
    return cm.where(F.col("topic").isin("src1", "src4/en") | F.array_contains(F.array(*wanted), F.col("subtopic")))


@query("p2_known_topics", f"{CM} SELECT doc_id, topic FROM chunk_meta WHERE {KNOWN}")
def p2(s: SparkSession, d: str) -> DataFrame:
    return chunk_meta(s, d).where(t.known(F.col("topic"))).select("doc_id", "topic")


@query("p3_concept_type", f"{CM} SELECT doc_id, concept_type FROM chunk_meta WHERE concept_type IN ('definition', 'explanation') ORDER BY doc_id LIMIT 150")
def p3(s: SparkSession, d: str) -> DataFrame:
    return chunk_meta(s, d).where(F.col("concept_type").isin("definition", "explanation")).select("doc_id", "concept_type").orderBy("doc_id").limit(150)


@query("p4_language_filter", f"{CO} SELECT page_id, language FROM courses WHERE language IS NULL OR contains(lower(language), 'en')")
def p4(s: SparkSession, d: str) -> DataFrame:
    return courses(s, d).where(F.col("language").isNull() | F.contains(F.lower("language"), F.lit("en"))).select("page_id", "language")


@query("p5_required_columns", f"{CO} SELECT page_id, url FROM courses WHERE nullif(title, '') IS NOT NULL AND url IS NOT NULL")
def p5(s: SparkSession, d: str) -> DataFrame:
    return courses(s, d).withColumn("title", F.nullif("title", F.lit(""))).dropna(subset=["title", "url"]).select("page_id", "url")


@query("p9_invalid_questions", f"{QA} SELECT conv_id, turn FROM qa WHERE question NOT IN ('Error', '', 'None') AND NOT starts_with(question, 'Error')")
def p9(s: SparkSession, d: str) -> DataFrame:
    return qa(s, d).where(~F.col("question").isin("Error", "", "None") & ~F.col("question").startswith("Error")).select("conv_id", "turn")


@query("p10_question_validation", f"""{QA} SELECT conv_id, turn, CASE WHEN contains(question, 'Error') OR contains(reference, 'Error') THEN 'error' WHEN len({words_sql('question')}) < 5 THEN 'short question' WHEN len({words_sql('reference')}) < 5 THEN 'short answer' END AS reject_reason FROM qa""")
def p10(s: SparkSession, d: str) -> DataFrame:
    return qa(s, d).select("conv_id", "turn", g.question_problem(F.col("question"), F.col("reference")).alias("reject_reason"))


@query("p11_choice_format", f"""{QA} SELECT conv_id, turn, len(list_filter(['a)', 'b)', 'c)', 'd)', 'a.', 'b.', 'c.', 'd.', '1)', '2)', '3)', '4)'], lambda m: contains(lower(question), m))) >= 3 AS is_choice FROM qa""")
def p11(s: SparkSession, d: str) -> DataFrame:
    return qa(s, d).select("conv_id", "turn", g.is_choice(F.col("question")).alias("is_choice"))


@query("p12_choice_structure", f"""{QA}, x AS (SELECT conv_id, turn, question, {words_sql('answer')} AS w FROM qa),
o AS (SELECT *, CASE WHEN turn % 4 = 0 AND conv_id % 3 = 0 THEN ['a)', 'b)', 'c)'] WHEN conv_id % 5 = 1 THEN ['A)', ' b)', 'c)', 'd)'] ELSE ['a)', 'b)', 'c)', 'd)'] END AS ks,
    lower(trim(CASE conv_id % 4 WHEN 0 THEN 'b' WHEN 1 THEN ' C) ' WHEN 2 THEN 'A' ELSE coalesce(w[1], '') END)) AS named FROM x),
p AS (SELECT *, list_transform(range(1, len(ks) + 1), lambda i: trim(coalesce(w[2 * i], '') || ' ' || coalesce(w[2 * i + 1], ''))) AS vs, CASE WHEN ends_with(named, ')') THEN named ELSE named || ')' END AS c FROM o)
SELECT conv_id, turn, len({words_sql('question')}) >= 4 AND list_sort(list_distinct(list_transform(ks, lambda k: lower(trim(k))))) = ['a)', 'b)', 'c)', 'd)'] AND len(list_filter(vs, lambda v: v = '')) = 0
    AND list_contains(['a)', 'b)', 'c)', 'd)'], c) AND coalesce(len({words_sql('vs[list_position(ks, c)]')}), 0) >= 2 AS valid FROM p""")
def p12(s: SparkSession, d: str) -> DataFrame:
    w = t.tokens(F.col("answer"))
    given = lambda *ks: F.array(*[F.lit(k) for k in ks])
    keys = F.when((F.col("turn") % 4 == 0) & (F.col("conv_id") % 3 == 0), given("a)", "b)", "c)")).when(F.col("conv_id") % 5 == 1, given("A)", " b)", "c)", "d)")).otherwise(given("a)", "b)", "c)", "d)"))
    word = lambda i: F.coalesce(F.get(w, i), F.lit(""))
    options = F.map_from_arrays(keys, F.transform(keys, lambda k, i: F.trim(F.concat_ws(" ", word(2 * i + 1), word(2 * i + 2)))))
    correct = F.when(F.col("conv_id") % 4 == 0, "b").when(F.col("conv_id") % 4 == 1, " C) ").when(F.col("conv_id") % 4 == 2, "A").otherwise(word(F.lit(0)))
    return qa(s, d).select("conv_id", "turn", g.valid_choice(F.col("question"), options, correct).alias("valid"))


@query("p14_flat_projection", f"{CM} SELECT doc_id AS id, topic, subtopic, file_name, page_number, round((doc_id % 77) / 77.0::DOUBLE, 4) AS similarity_score, 'multi_query' AS retrieval_source FROM chunk_meta")
def p14(s: SparkSession, d: str) -> DataFrame:
    return chunk_meta(s, d).select(F.col("doc_id").alias("id"), "topic", "subtopic", "file_name", "page_number", rounded((F.col("doc_id") % 77) / 77.0, 4).alias("similarity_score"), F.lit("multi_query").alias("retrieval_source"))


# --- joins and enrichment ------------------------------------------------------------------------------------

CANON = (("src1", "Source One"), ("SRC2", "Source Two"), ("src3", "Source Three"))
CANON_SQL = "canon(raw, canonical) AS (VALUES ('src1', 'Source One'), ('SRC2', 'Source Two'), ('src3', 'Source Three'))"
LABELS = (("alpha", 0), ("src1", 1), ("rc1", 2), ("src12/x", 3))
LABELS_SQL = "lab(topic, ord) AS (VALUES ('alpha', 0), ('src1', 1), ('rc1', 2), ('src12/x', 3))"


@query("j6_difficulty_maps", f"{CM} SELECT doc_id, CASE difficulty WHEN 'easy' THEN 'basic' WHEN 'hard' THEN 'advanced' ELSE 'intermediate' END AS level, CASE difficulty WHEN 'easy' THEN 0 WHEN 'hard' THEN 2 ELSE 1 END AS ordinal FROM chunk_meta")
def j6(s: SparkSession, d: str) -> DataFrame:
    dim = literal_table(s, (("easy", "basic", 0), ("medium", "intermediate", 1), ("hard", "advanced", 2)), "difficulty string, level string, ordinal int")
    return chunk_meta(s, d).join(F.broadcast(dim), "difficulty", "left").select("doc_id", F.coalesce("level", F.lit("intermediate")).alias("level"), F.coalesce("ordinal", F.lit(1)).alias("ordinal"))


@query("j7_canonical_topics", f"{CM}, {CANON_SQL} SELECT doc_id, coalesce(canonical, section) AS topic FROM chunk_meta LEFT JOIN canon ON lower(topic) = lower(raw)")
def j7(s: SparkSession, d: str) -> DataFrame:
    return enrich.canonical(chunk_meta(s, d), literal_table(s, CANON, "raw string, canonical string")).select("doc_id", "topic")


@query("j8_label_match", f"""{CM}, {LABELS_SQL}, j AS (SELECT c.doc_id AS id, c.topic AS label, l.topic, l.ord, lower(c.topic) = lower(l.topic) AS same FROM chunk_meta c LEFT JOIN lab l ON contains(lower(c.topic), lower(l.topic)) OR contains(lower(l.topic), lower(c.topic)))
SELECT id, label, coalesce(arg_min(topic, CASE WHEN same THEN 0 ELSE 100 END + ord), 'alpha') AS matched FROM j GROUP BY id, label""")
def j8(s: SparkSession, d: str) -> DataFrame:
    return enrich.match_label(chunk_meta(s, d).select(F.col("doc_id").alias("id"), F.col("topic").alias("label")), literal_table(s, LABELS, "topic string, ord int"))


@query("j9_course_name_filter", f"{CM} SELECT doc_id, topic FROM chunk_meta WHERE lower(topic) <> 'src5'")
def j9(s: SparkSession, d: str) -> DataFrame:
    return chunk_meta(s, d).where(F.lower("topic") != "src5").select("doc_id", "topic")


@query("j10_prerequisite_cleanup", f"""{with_views('prereqs')}, e AS (SELECT * FROM prereqs UNION ALL SELECT 'view', 'view', 5 UNION ALL SELECT 'view', 'nothing', 6 UNION ALL SELECT event_type, 'error', event_id FROM events WHERE event_id % 100 = 0), v AS (SELECT DISTINCT event_type AS t FROM events)
SELECT topic, prereq, ord FROM e WHERE topic IN (SELECT t FROM v) AND prereq IN (SELECT t FROM v) AND topic <> prereq""")
def j10(s: SparkSession, d: str) -> DataFrame:
    ev = table(s, d, "events")
    more = literal_table(s, (("view", "view", 5), ("view", "nothing", 6)), "topic string, prereq string, ord int")
    seen = ev.where("event_id % 100 = 0").select(F.col("event_type").alias("topic"), F.lit("error").alias("prereq"), F.col("event_id").cast("int").alias("ord"))
    return enrich.clean_prereqs(prereqs(s).unionByName(more).unionByName(seen), ev.select(F.col("event_type").alias("topic"))).select("topic", "prereq", "ord")


@query("j12_weak_topic_material", f"{CM}, w(t) AS (VALUES (' SRC1 '), ('src7/en'), ('none')) SELECT DISTINCT file_name, page_number FROM chunk_meta WHERE lower(trim(topic)) IN (SELECT lower(trim(t)) FROM w) OR lower(trim(subtopic)) IN (SELECT lower(trim(t)) FROM w)")
def j12(s: SparkSession, d: str) -> DataFrame:
    weak = literal_table(s, ((" SRC1 ",), ("src7/en",), ("none",)), "topic string")
    return rec.material(chunk_meta(s, d), weak).select("file_name", "page_number")


CONCEPTS = """cw AS (SELECT doc_id, list_distinct(list_filter(list_filter(regexp_split_to_array(regexp_replace(lower(substr(text, 1, 500)), '[^a-z0-9 \\t\\n\\r]', '', 'g'), '[ \\t\\n\\r]+'), lambda w: w <> ''), lambda w: length(w) > 3)) AS w FROM documents),
cx AS (SELECT doc_id, unnest(w) AS concept FROM cw), con AS (SELECT doc_id, concept FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(concept) DESC, concept) AS n FROM cx) WHERE n <= 5),
edges AS (SELECT DISTINCT a.concept AS c1, b.concept AS c2 FROM con a JOIN con b USING (doc_id) WHERE a.concept <> b.concept)"""


def _edges(s: SparkSession, d: str) -> DataFrame:
    return enrich.concept_graph(enrich.concepts(table(s, d, "documents")))


@query("j14_concept_graph", f"WITH {CONCEPTS} SELECT c1, c2 FROM edges")
def j14(s: SparkSession, d: str) -> DataFrame:
    return _edges(s, d)


@query("j15_one_hop", f"WITH {CONCEPTS}, w AS (SELECT DISTINCT c1 AS concept FROM edges) SELECT concept, concept AS near, 0 AS place FROM w UNION ALL SELECT * FROM (SELECT concept, c2, row_number() OVER (PARTITION BY concept ORDER BY c2) AS place FROM w JOIN edges ON c1 = concept) WHERE place <= 5")
def j15(s: SparkSession, d: str) -> DataFrame:
    e = _edges(s, d)
    return enrich.expand(e, e.select(F.col("c1").alias("concept")).distinct())


@query("o6_central_neighbours", f"WITH {CONCEPTS}, dg AS (SELECT c1, count(*) AS degree FROM edges GROUP BY c1) SELECT * FROM (SELECT e.c1, e.c2, coalesce(g.degree, 0) AS degree, row_number() OVER (PARTITION BY e.c1 ORDER BY coalesce(g.degree, 0) DESC, e.c2) AS place FROM edges e LEFT JOIN dg g ON g.c1 = e.c2) WHERE place <= 2")
def o6(s: SparkSession, d: str) -> DataFrame:
    return enrich.central_neighbours(_edges(s, d), 2).select("c1", "c2", "degree", "place")


@query("f32_topic_keys", f"""{CM}, tp AS (SELECT DISTINCT subtopic AS q, regexp_split_to_array(lower(subtopic), '[ /]+') AS w FROM chunk_meta), k AS (SELECT q, w, list_concat([array_to_string(w, ' ')], list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), w)) AS ks FROM tp)
SELECT q AS query_id, unnest(range(len(ks))) AS ord, unnest(ks) AS key FROM k""")
def f32(s: SparkSession, d: str) -> DataFrame:
    tp = chunk_meta(s, d).select(F.col("subtopic").alias("query_id"), F.col("subtopic").alias("topic")).distinct()
    return r.topic_keys(tp)


@query("a4_distinct_topics", f"{CM} SELECT DISTINCT topic FROM chunk_meta WHERE {KNOWN}")
def a4(s: SparkSession, d: str) -> DataFrame:
    return chunk_meta(s, d).where(t.known(F.col("topic"))).select("topic").distinct().orderBy("topic")


@query("a5_subtopics", f"{CM} SELECT topic, string_agg(DISTINCT subtopic, ',' ORDER BY subtopic) AS subtopics FROM chunk_meta WHERE {KNOWN} GROUP BY topic")
def a5(s: SparkSession, d: str) -> DataFrame:
    return enrich.subtopics(chunk_meta(s, d)).select("topic", F.array_join("subtopics", ",").alias("subtopics"))


MAJOR = f"""v AS (SELECT file_name, page_number, topic, count(*) AS n, min(doc_id) AS f FROM cmx WHERE {KNOWN} GROUP BY ALL), mj AS (SELECT file_name, page_number, first(topic ORDER BY n DESC, f, topic) AS major FROM v GROUP BY ALL)"""
CMX = "cmx AS (SELECT doc_id, doc_id % 5 AS page_number, 'f' || (doc_id % 7) AS file_name, topic, difficulty FROM chunk_meta)"


def _cmx(s: SparkSession, d: str) -> DataFrame:
    return chunk_meta(s, d).select("doc_id", (F.col("doc_id") % 5).alias("page_number"), F.concat(F.lit("f"), (F.col("doc_id") % 7).cast("string")).alias("file_name"), "topic", "difficulty")


@query("a6_page_majority", f"{CM}, {CMX}, {MAJOR} SELECT doc_id, coalesce(major, topic) AS topic FROM cmx LEFT JOIN mj USING (file_name, page_number)")
def a6(s: SparkSession, d: str) -> DataFrame:
    return enrich.page_consistent(_cmx(s, d)).select("doc_id", "topic")


@query("a6_majority_at_scale", "WITH v AS (SELECT l_orderkey % 100 AS file_name, l_suppkey % 10 AS page_number, l_returnflag AS topic, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS f FROM lineitem GROUP BY ALL) SELECT file_name, page_number, first(topic ORDER BY n DESC, f, topic) AS topic FROM v GROUP BY ALL")
def a6_scale(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem").select((F.col("l_orderkey") % 100).alias("file_name"), (F.col("l_suppkey") % 10).alias("page_number"), F.col("l_returnflag").alias("topic"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("doc_id"))
    return enrich.page_consistent(rows).select("file_name", "page_number", "topic").distinct()


@query("a7_topic_difficulty", f"{CM}, v AS (SELECT topic, difficulty, count(*) AS n, min(doc_id) AS f FROM chunk_meta GROUP BY ALL) SELECT topic, CASE first(difficulty ORDER BY n DESC, f, difficulty) WHEN 'easy' THEN 'basic' WHEN 'hard' THEN 'advanced' ELSE 'intermediate' END AS level FROM v GROUP BY topic")
def a7(s: SparkSession, d: str) -> DataFrame:
    return enrich.topic_difficulty(chunk_meta(s, d))


@query("u2_removed_topics", f"{CM} SELECT DISTINCT topic FROM chunk_meta EXCEPT SELECT DISTINCT topic FROM chunk_meta WHERE doc_id % 19 = 0")
def u2(s: SparkSession, d: str) -> DataFrame:
    cm = chunk_meta(s, d)
    return cm.select("topic").distinct().exceptAll(cm.where("doc_id % 19 = 0").select("topic").distinct())


@query("u3_shared_words", f"{QA} SELECT conv_id, turn, len(list_intersect(list_distinct({pre_sql('answer')}), list_distinct({pre_sql('reference')}))) AS shared, len(list_distinct({pre_sql('answer')})) AS unique_words FROM qa")
def u3(s: SparkSession, d: str) -> DataFrame:
    a, b = t.tokens(t.preprocess(F.col("answer"))), t.tokens(t.preprocess(F.col("reference")))
    return qa(s, d).select("conv_id", "turn", F.size(F.array_intersect(a, b)).alias("shared"), F.size(F.array_distinct(a)).alias("unique_words"))


@query("u4_ordered_union", f"{CM} SELECT doc_id, array_to_string([topic] || list_filter([subtopic, lang], lambda x: x <> topic), ',') AS expanded FROM chunk_meta")
def u4(s: SparkSession, d: str) -> DataFrame:
    return chunk_meta(s, d).select("doc_id", F.array_join(F.array_distinct(F.array("topic", "subtopic", "lang", "topic")), ",").alias("expanded"))


@query("f14_json_salvage", "WITH x AS (SELECT event_id, 'Here: ```json ' || props || ' ``` done' AS raw FROM events) SELECT event_id, nullif(regexp_extract(replace(replace(raw, '```json', ''), '```', ''), '(?s)\\{.*\\}'), '') AS slice, CAST(regexp_extract(raw, '([0-9]+)', 1) AS BIGINT) AS k FROM x")
def f14(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "events").select("event_id", t.json_slice(F.concat(F.lit("Here: ```json "), "props", F.lit(" ``` done"))).alias("slice"))
    return x.select("event_id", "slice", F.try_variant_get(F.try_parse_json("slice"), "$.k", "bigint").alias("k"))


def _replies(s: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    body = (
        F.when(k % 7 == 0, F.lit("no json here"))
        .when(k % 5 == 0, F.concat(F.lit('x {"topic": 5, "difficulty": "Hard", "keywords": "a,b"} y')))
        .otherwise(F.concat(F.lit('Sure: {"topic": "T'), (k % 4).cast("string"), F.lit('", "subtopic": "S", "concept_type": "'), pick(("example", "Odd", "summary"), k % 3), F.lit('", "difficulty": "'), pick(("easy", "extreme"), k % 2), F.lit('"}')))
    )
    return table(s, d, "events").select("event_id", k.alias("k"), body.alias("raw"))


TAGS = """SELECT event_id, CASE WHEN k % 7 = 0 OR k % 5 = 0 THEN 'Unknown' ELSE 'T' || (k % 4) END AS topic, CASE WHEN k % 7 = 0 OR k % 5 = 0 THEN 'Unknown' ELSE 'S' END AS subtopic,
CASE WHEN k % 7 = 0 OR k % 5 = 0 THEN 'other' WHEN k % 3 = 0 THEN 'example' WHEN k % 3 = 2 THEN 'summary' ELSE 'other' END AS concept_type,
CASE WHEN k % 7 = 0 THEN 'medium' WHEN k % 5 = 0 THEN 'hard' WHEN k % 2 = 0 THEN 'easy' ELSE 'medium' END AS difficulty, CASE WHEN k % 7 <> 0 AND k % 5 = 0 THEN 'a,b' ELSE '' END AS keywords
FROM (SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)"""


@query("f15_tag_validation", TAGS)
def f15(s: SparkSession, d: str) -> DataFrame:
    return enrich.parse_tags(_replies(s, d)).drop("raw", "k")


@query("a35_tagging_outcome", f"SELECT count(*) FILTER (topic <> 'Unknown' OR subtopic <> 'Unknown' OR concept_type <> 'other' OR difficulty <> 'medium' OR keywords <> '') AS tagged, count(*) FILTER (topic = 'Unknown' AND subtopic = 'Unknown' AND concept_type = 'other' AND difficulty = 'medium' AND keywords = '') AS defaulted FROM ({TAGS})")
def a35(s: SparkSession, d: str) -> DataFrame:
    return enrich.tagging_outcome(enrich.parse_tags(_replies(s, d)))


_PLAIN = r'[\x00-\x1f"\\`{}]'
F16 = """WITH x AS (SELECT conv_id, turn, (conv_id + turn) % 8 AS k, 'About ' || trim(regexp_replace(question, '[\x00-\x1f"\\\\`{}]', ' ', 'g')) AS q, 'Since ' || trim(regexp_replace(reference, '[\x00-\x1f"\\\\`{}]', ' ', 'g')) AS a FROM qa)
SELECT conv_id, turn, CASE k WHEN 1 THEN q || ' or not?' WHEN 4 THEN q || E' ```\nx = 1;\ny = 2;\n``` end' WHEN 6 THEN q || ' why?' ELSE q END AS question,
CASE k WHEN 6 THEN 'Error' WHEN 7 THEN 'one two three four five ' || a ELSE a END AS reference_answer, CASE WHEN k = 0 THEN 'x y' END AS first_option, CASE WHEN k IN (0, 7) THEN 'a)' END AS correct_answer,
CASE k WHEN 2 THEN 'fields' WHEN 5 THEN 'pattern' WHEN 6 THEN 'line' ELSE 'json' END AS parse_path FROM x"""


def _question_replies(s: SparkSession, d: str) -> DataFrame:
    """Eight kinds of replies: with options, with a line end in a string, without a comma, fenced whole, with code, cut
    off, a plain question, and with the answer under another name."""
    plain = lambda c: F.trim(F.regexp_replace(c, _PLAIN, " "))
    q, a = F.concat(F.lit("About "), plain("question")), F.concat(F.lit("Since "), plain("reference"))
    part = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    kinds = [
        part('Sure: {"question": "', q, '", "reference_answer": "', a, '", "options": {"a)": "x y", "b)": "z"}, "correct_answer": "a)"} Done.'),
        part('{"question": "', q, '\nor not?", "reference_answer": "', a, '"}'),
        part('{"question": "', q, '" "reference_answer": "', a, '"}'),
        part('```json\n{"question": "', q, '",\n "reference_answer": "', a, '"}\n```'),
        part('{"question": "', q, ' ```c\nx = 1;\ny = 2;\n``` end", "reference_answer": "', a, ' ```\nx = 1;\n```"}'),
        part('{"question": "', q, '", "reference_answer": "', a),
        part("Here it is.\n ", q, " why? \nBecause."),
        part('{"question": "', q, '", "explanation": "one two three four five ', a, '", "correct_answer": "a)"}'),
    ]
    k = (F.col("conv_id") + F.col("turn")) % 8
    raw = F.coalesce(*[F.when(k == i, r) for i, r in enumerate(kinds)])
    return qa(s, d).select("conv_id", "turn", raw.alias("raw"))


@query("f16_question_repair", F16.replace("WITH ", f"{QA}, ", 1))
def f16(s: SparkSession, d: str) -> DataFrame:
    return enrich.parse_questions(_question_replies(s, d)).select("conv_id", "turn", "question", "reference_answer", F.try_element_at("options", F.lit("a)")).alias("first_option"), "correct_answer", "parse_path")


@query("f17_tolerant_casts", "WITH x AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'bad' ELSE (event_id % 100)::VARCHAR END AS v FROM events) SELECT event_id, coalesce(TRY_CAST(v AS DOUBLE), 0.0) AS as_double, coalesce(TRY_CAST(v AS INT), 0) AS as_int, upper(trim(CASE WHEN event_id % 2 = 0 THEN ' True ' ELSE 'no' END)) = 'TRUE' AS flag FROM x")
def f17(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, "bad").otherwise((F.col("event_id") % 100).cast("string")).alias("v"))
    return x.select("event_id", reports.tolerant_double(F.col("v")).alias("as_double"), reports.tolerant_int(F.col("v")).alias("as_int"), reports.is_true(F.when(F.col("event_id") % 2 == 0, " True ").otherwise("no")).alias("flag"))


@query("f38_course_text", f"{CO} SELECT page_id, md5(title || ' | ' || substr(intro, 1, 300) || ' | ' || substr(skills, 1, 200)) AS text_md5 FROM courses")
def f38(s: SparkSession, d: str) -> DataFrame:
    return courses(s, d).select("page_id", F.md5(rec.course_text(F.col("title"), F.col("intro"), F.col("skills"))).alias("text_md5"))


@query("f40_title_case", f"{CM} SELECT DISTINCT topic, upper(substr(topic, 1, 1)) || lower(substr(topic, 2)) AS title FROM chunk_meta")
def f40(s: SparkSession, d: str) -> DataFrame:
    return chunk_meta(s, d).select("topic", t.title_case(F.col("topic")).alias("title")).distinct()


@query("f37_rotation", f"""{CM}, c AS (SELECT * FROM chunk_meta WHERE {KNOWN}), req AS (SELECT tp.topic, i, tp.topic || '-' || i AS request_id FROM (SELECT DISTINCT topic FROM c) tp, range(6) x(i)),
sb AS (SELECT topic, subtopic, row_number() OVER (PARTITION BY topic ORDER BY subtopic) - 1 AS s, count(*) OVER (PARTITION BY topic) AS n FROM (SELECT DISTINCT topic, subtopic FROM c)),
mb AS (SELECT topic, subtopic, doc_id, row_number() OVER (PARTITION BY topic, subtopic ORDER BY doc_id) - 1 AS m, count(*) OVER (PARTITION BY topic, subtopic) AS size FROM c)
SELECT request_id, req.topic, sb.subtopic, mb.doc_id FROM req JOIN sb ON sb.topic = req.topic AND i % n = s JOIN mb ON mb.topic = sb.topic AND mb.subtopic = sb.subtopic AND mb.m = (3 * i) % mb.size""")
def f37(s: SparkSession, d: str) -> DataFrame:
    cm = chunk_meta(s, d).where(t.known(F.col("topic")))
    req = cm.select("topic").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("request_id", F.concat_ws("-", "topic", F.col("i").cast("string")))
    return context.rotation(cm, req)


# --- grading -------------------------------------------------------------------------------------------------

CW = f"list_filter({{}}, lambda w: NOT list_contains({STOP}, w))"


@query("f18_preprocess", f"{QA} SELECT conv_id, turn, array_to_string({pre_sql('answer')}, ' ') AS words, len({CW.format(pre_sql('answer'))}) AS content_words FROM qa")
def f18(s: SparkSession, d: str) -> DataFrame:
    return qa(s, d).select("conv_id", "turn", F.array_join(t.tokens(t.preprocess(F.col("answer"))), " ").alias("words"), F.size(t.content_words(F.col("answer"))).alias("content_words"))


FREQ = f"""rw AS (SELECT conv_id, turn, list_filter({CW.format(pre_sql('reference'))}, lambda w: length(w) > 2) AS r, {CW.format(pre_sql('answer'))} AS a FROM qa),
ex AS (SELECT conv_id, turn, unnest(r) AS w, len(r) AS n, a FROM rw), fr AS (SELECT conv_id, turn, w, count(*) AS f, ln(max(n) / count(*)::DOUBLE + 1) AS weight, bool_or(list_contains(a, w)) AS has FROM ex GROUP BY conv_id, turn, w)"""


@query("a36_term_weights", f"{QA}, {FREQ} SELECT conv_id, turn, w AS word, f AS n, round(weight, 6) AS weight FROM fr")
def a36(s: SparkSession, d: str) -> DataFrame:
    words = qa(s, d).select("conv_id", "turn", t.content_words(F.col("reference"), 2).alias("r"))
    x = words.select("conv_id", "turn", F.size("r").alias("total"), F.explode("r").alias("word")).groupBy("conv_id", "turn", "word").agg(F.count("*").alias("n"), F.max("total").alias("total"))
    return x.select("conv_id", "turn", "word", "n", rounded(F.log(F.col("total") / F.col("n") + 1), 6).alias("weight"))


@query("f19_keyword_coverage", f"{QA}, {FREQ} SELECT q.conv_id, q.turn, round(coalesce(sum(weight) FILTER (has) / sum(weight), 0), 6) AS keyword FROM qa q LEFT JOIN fr USING (conv_id, turn) GROUP BY ALL")
def f19(s: SparkSession, d: str) -> DataFrame:
    pairs = qa(s, d).select(F.struct("conv_id", "turn").alias("pair"), "answer", "reference")
    return pairs.join(g.coverage(pairs), "pair", "left").select("pair.*", rounded(F.coalesce("keyword", F.lit(0.0)), 6).alias("keyword"))


@query("f20_entailment", f"""{QA}, x AS (SELECT conv_id, turn, {pre_sql('answer')} AS a, list_distinct({CW.format(pre_sql('reference'))}) AS r FROM qa),
y AS (SELECT *, len(list_intersect(r, {NEG})) = 0 AND len(list_filter(range(1, len(a)), lambda i: list_contains({NEG}, a[i]) AND list_contains(r, a[i + 1]))) > 0 AS contra FROM x)
SELECT conv_id, turn, contra, CASE WHEN contra THEN 0.25 ELSE CASE turn % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 WHEN 2 THEN 0.5 WHEN 3 THEN 0.3 ELSE 0.15 END END::DOUBLE AS nli FROM y""")
def f20(s: SparkSession, d: str) -> DataFrame:
    contra = g.contradicts(t.tokens(t.preprocess(F.col("answer"))), F.array_distinct(t.content_words(F.col("reference"))))
    sim = F.element_at(F.array(*[F.lit(v) for v in (0.8, 0.6, 0.45, 0.3, 0.1)]), (F.col("turn") % 5 + 1).cast("int"))
    return qa(s, d).select("conv_id", "turn", contra.alias("contra"), g.entailment(contra, sim).alias("nli"))


#: Similarity (i = -1 is the whole reference) and completeness by exploded word counts.
SIM_SQL = f"""pr AS (SELECT *, {pre_sql('answer')} AS aw, {pre_sql('reference')} AS rf FROM qa),
sent AS (SELECT conv_id, turn, CASE WHEN len(y) > 0 THEN y ELSE [reference] END AS x FROM (SELECT *, list_filter(list_transform(string_split(reference, '.'), lambda s: regexp_replace(s, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g')), lambda s: length(s) > 5) AS y FROM pr)),
part AS (SELECT conv_id, turn, i, {pre_sql('p')} AS w FROM (SELECT conv_id, turn, unnest(x) AS p, unnest(range(len(x))) AS i FROM sent) UNION ALL SELECT conv_id, turn, -1, rf FROM pr),
pt AS (SELECT conv_id, turn, i, w, count(*) AS n FROM (SELECT conv_id, turn, i, unnest(w) AS w FROM part) GROUP BY ALL),
an AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(aw) AS w FROM pr) GROUP BY ALL),
nm AS (SELECT conv_id, turn, sum(n * n) AS nn FROM an GROUP BY ALL),
cs AS (SELECT pt.conv_id, pt.turn, i, sum(pt.n * coalesce(an.n, 0)) AS x, sum(pt.n * pt.n) AS pp FROM pt LEFT JOIN an USING (conv_id, turn, w) GROUP BY ALL),
sm AS (SELECT part.conv_id, part.turn, part.i, coalesce(x::DOUBLE / sqrt((pp * nn)::DOUBLE), 0.0::DOUBLE) AS s FROM part LEFT JOIN cs USING (conv_id, turn, i) LEFT JOIN nm USING (conv_id, turn)),
com AS (SELECT conv_id, turn, max(s) FILTER (i = -1) AS sim,
    avg(CASE WHEN s >= 0.6 THEN 1.0::DOUBLE WHEN s >= 0.45 THEN 0.6::DOUBLE WHEN s >= 0.3 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END) FILTER (i >= 0) AS com FROM sm GROUP BY ALL)"""


@query("f21_completeness", f"{QA}, {SIM_SQL} SELECT conv_id, turn, round(com, 6) AS completeness FROM com")
def f21(s: SparkSession, d: str) -> DataFrame:
    return g.completeness(qa(s, d)).select("conv_id", "turn", rounded("completeness", 6).alias("completeness"))


@query("f22_length_factor", f"{QA}, x AS (SELECT conv_id, turn, len({words_sql('answer')})::DOUBLE / nullif(len({words_sql('reference')}), 0) AS ratio FROM qa) SELECT conv_id, turn, CASE WHEN ratio IS NULL OR ratio >= 0.4 THEN 1.0 WHEN ratio >= 0.25 THEN 0.85 WHEN ratio >= 0.15 THEN 0.7 ELSE 0.55 END::DOUBLE AS length_factor FROM x")
def f22(s: SparkSession, d: str) -> DataFrame:
    return qa(s, d).select("conv_id", "turn", g.length_factor(F.col("answer"), F.col("reference")).alias("length_factor"))


@query("f23_recalibrate", f"{with_views('attempts')} SELECT student, step, round(greatest(0.0, least(1.0, (score - 0.2) / 0.6)), 6) AS stretched FROM attempts")
def f23(s: SparkSession, d: str) -> DataFrame:
    return attempts(s, d).select("student", "step", rounded(g.recalibrate(F.col("score"), 0.2, 0.8), 6).alias("stretched"))


@query("f24_weighted_score", f"""{QA}, x AS (SELECT conv_id, turn, question_type, (turn % 7) / 7.0::DOUBLE AS s, (turn % 5) / 5.0::DOUBLE AS k, (turn % 3) / 3.0::DOUBLE AS n, (turn % 2) / 2.0::DOUBLE AS c FROM qa)
SELECT conv_id, turn, round(CASE question_type WHEN 'factual' THEN 0.45 * s + 0.30 * k + 0.10 * n + 0.15 * c WHEN 'inferential' THEN 0.35 * s + 0.20 * k + 0.15 * n + 0.30 * c ELSE 0.25 * s + 0.15 * k + 0.20 * n + 0.40 * c END, 6) AS score FROM x""")
def f24(s: SparkSession, d: str) -> DataFrame:
    part = lambda n: (F.col("turn") % n) / float(n)
    return qa(s, d).select("conv_id", "turn", rounded(g.weighted(F.col("question_type"), [part(7), part(5), part(3), part(2)]), 6).alias("score"))


@query("f25_question_copy", f"{QA}, x AS (SELECT conv_id, turn, list_distinct({words_sql('lower(answer)')}) AS a, list_distinct({words_sql('lower(question)')}) AS q FROM qa) SELECT conv_id, turn, len(list_intersect(a, q)) / greatest(len(q), 1)::DOUBLE > 0.8 AS copied FROM x")
def f25(s: SparkSession, d: str) -> DataFrame:
    return qa(s, d).select("conv_id", "turn", (g.copied_share(F.col("answer"), F.col("question")) > 0.8).alias("copied"))


@query("f26_error_class", f"""{with_views('attempts')}, x AS (SELECT student, step, score AS f, (k % 10) / 10.0::DOUBLE AS s, (k % 7) / 7.0::DOUBLE AS kw, (k % 4) / 4.0::DOUBLE AS n, (k % 5) / 5.0::DOUBLE AS o, k % 6 = 0 AS code FROM attempts)
SELECT student, step, CASE WHEN f >= 0.75 THEN 'none' WHEN s < 0.25 AND o < 0.1 THEN 'off_topic' WHEN n < 0.3 AND o > 0.2 THEN 'conceptual' WHEN code AND f < 0.5 THEN 'code_syntax' WHEN kw < 0.3 AND s > 0.4 THEN 'partial' WHEN f < 0.5 THEN 'partial' ELSE 'careless' END AS error_type FROM x""")
def f26(s: SparkSession, d: str) -> DataFrame:
    part = lambda n: (F.col("k") % n) / float(n)
    return attempts(s, d).select("student", "step", g.error_class(F.col("score"), part(10), part(7), part(4), part(5), F.col("k") % 6 == 0).alias("error_type"))


@query("f27_feedback", f"""{QA}, x AS (SELECT conv_id, turn, question, list_filter({CW.format(pre_sql('reference'))}, lambda w: length(w) > 3) AS r, {pre_sql('answer')} AS a, turn % 5 AS e FROM qa),
u AS (SELECT *, list_filter(r, lambda w, i: list_position(r, w) = i AND NOT list_contains(a, w))[1:5] AS mw FROM x), y AS (SELECT *, CASE WHEN len(mw) > 0 THEN array_to_string(mw, ', ') ELSE 'key concepts' END AS miss FROM u)
SELECT conv_id, turn, md5(CASE e WHEN 0 THEN 'Your answer doesn''t address the question. Re-read: ' || question WHEN 1 THEN 'Core concept misunderstood. Review: ' || miss || '.' WHEN 2 THEN 'Partially correct. Missing details on: ' || miss || '.' WHEN 3 THEN 'Code logic may be right but contains syntax errors. Review carefully.' ELSE 'Almost there — improve precision on: ' || miss || '.' END) AS feedback_md5 FROM y""")
def f27(s: SparkSession, d: str) -> DataFrame:
    missing = F.slice(F.array_except(t.content_words(F.col("reference"), 3), t.tokens(t.preprocess(F.col("answer")))), 1, 5)
    error = pick(("off_topic", "conceptual", "partial", "code_syntax", "careless"), F.col("turn") % 5)
    return qa(s, d).select("conv_id", "turn", F.md5(g.feedback(F.lit(0.4), error, missing, F.col("question"))).alias("feedback_md5"))


_MARKS = "[" + ", ".join(f"'{m}'" for m in t.ANSWER_CODE_SIGNALS) + "]"
_RAW = "CASE question_type " + " ".join(f"WHEN '{k}' THEN {w[0]} * sim + {w[1]} * kw + {w[2]} * nli + {w[3]} * com" for k, w in g.WEIGHTS.items()) + " END"
_SAID = lambda k: "'" + g.MESSAGES[k].replace("'", "''").replace("{missing}", "' || miss || '").replace("{question}", "' || question || '") + "'"
_FEEDBACK = f"CASE WHEN final >= 0.85 THEN {_SAID('high')} " + " ".join(f"WHEN err = '{k}' THEN {_SAID(k)}" for k in g.MESSAGES if k not in ("", "high")) + f" ELSE {_SAID('')} END"


@query("c6_graded_answers", f"""{QA}, {SIM_SQL}, {FREQ},
kw AS (SELECT conv_id, turn, least(coalesce(sum(weight) FILTER (has), 0) / sum(weight), 1.0) AS kw FROM fr GROUP BY conv_id, turn),
w AS (SELECT *, {CW.format('aw')} AS ac, {CW.format('rf')} AS rc, len({words_sql('answer')}) AS na, len({words_sql('reference')}) AS nr, list_distinct({words_sql('lower(answer)')}) AS da, list_distinct({words_sql('lower(question)')}) AS dq FROM pr),
y AS (SELECT *, list_distinct(rc) AS rs, len(list_intersect(da, dq)) / greatest(len(dq), 1)::DOUBLE > 0.8 AS copied, len(list_filter({_MARKS}, lambda m: contains(answer, m))) >= 2 AS code FROM w),
z AS (SELECT y.*, sim, com, coalesce(kw, 0.0) AS kw, len(list_intersect(list_distinct(ac), rs)) / greatest(len(rs), 1)::DOUBLE AS over,
    len(list_intersect(rs, {NEG})) = 0 AND len(list_filter(range(1, len(aw)), lambda i: list_contains({NEG}, aw[i]) AND list_contains(rs, aw[i + 1]))) > 0 AS contra,
    CASE WHEN nr = 0 OR na / nr::DOUBLE >= 0.4 THEN 1.0 WHEN na / nr::DOUBLE >= 0.25 THEN 0.85 WHEN na / nr::DOUBLE >= 0.15 THEN 0.7 ELSE 0.55 END::DOUBLE AS lf,
    list_filter(list_filter(rc, lambda x: length(x) > 3), lambda x, i: list_position(list_filter(rc, lambda v: length(v) > 3), x) = i AND NOT list_contains(aw, x))[1:5] AS mw FROM y JOIN com USING (conv_id, turn) LEFT JOIN kw USING (conv_id, turn)),
n AS (SELECT *, CASE WHEN contra THEN 0.25 WHEN sim >= 0.75 THEN 1.0 WHEN sim >= 0.55 THEN 0.75 WHEN sim >= 0.4 THEN 0.5 WHEN sim >= 0.25 THEN 0.3 ELSE 0.15 END::DOUBLE AS nli, CASE WHEN len(mw) > 0 THEN array_to_string(mw, ', ') ELSE 'key concepts' END AS miss FROM z),
f AS (SELECT *, round(greatest(0.0, least(1.0, ({_RAW}) * lf)), 3) AS final FROM n),
e AS (SELECT *, CASE WHEN final >= 0.75 THEN 'none' WHEN sim < 0.25 AND over < 0.1 THEN 'off_topic' WHEN nli < 0.3 AND over > 0.2 THEN 'conceptual' WHEN code AND final < 0.5 THEN 'code_syntax' WHEN kw < 0.3 AND sim > 0.4 THEN 'partial' WHEN final < 0.5 THEN 'partial' ELSE 'careless' END AS err FROM f),
c AS (SELECT *, CASE WHEN copied THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS own FROM e)
SELECT conv_id, turn, question_type, round(own * sim, 3) AS semantic, round(own * kw, 3) AS keyword, round(own * nli, 3) AS nli, round(own * com, 3) AS completeness, round(own * lf, 3) AS length_factor, round(own * final, 3) AS final,
CASE WHEN copied THEN 'conceptual' ELSE err END AS error_type, CASE WHEN copied THEN 'The answer repeats the question.' ELSE {_FEEDBACK} END AS feedback FROM c""")
def c6(s: SparkSession, d: str) -> DataFrame:
    out = g.grade(qa(s, d))
    return out.select("conv_id", "turn", "question_type", *[rounded(c, 3).alias(c) for c in ("semantic", "keyword", "nli", "completeness", "length_factor", "final")], "error_type", "feedback")


# --- reviews -------------------------------------------------------------------------------------------------

RV = f"{JU}, rv AS (SELECT *, CASE WHEN judge_score >= 0 THEN judge_score END AS judge, CASE WHEN judge_score >= 0 THEN judge_score END - system_score AS gap, 1 - abs(system_score - CASE WHEN judge_score >= 0 THEN judge_score END) AS agreement FROM judged)"


def _rv(s: SparkSession, d: str) -> DataFrame:
    return reports.reviewed(judged(s, d))


@query("f41_review_columns", f"{RV} SELECT student, step, round(judge, 6) AS judge, round(gap, 6) AS gap, round(agreement, 6) AS agreement, round(coalesce((judge + system_score) / 2, -1), 6) AS mean_or_missing FROM rv")
def f41(s: SparkSession, d: str) -> DataFrame:
    return _rv(s, d).select("student", "step", *[rounded(c, 6).alias(c) for c in ("judge", "gap", "agreement")], rounded(F.coalesce((F.col("judge") + F.col("system_score")) / 2, F.lit(-1.0)), 6).alias("mean_or_missing"))


@query("a24_quality_means", f"{RV} SELECT CASE WHEN grouping(difficulty) = 0 THEN 'difficulty' WHEN grouping(question_type) = 0 THEN 'question_type' ELSE 'all' END AS section, coalesce(difficulty, question_type, '') AS key, count(judge) AS n, round(avg(judge), 6) AS mean_judge FROM rv GROUP BY GROUPING SETS ((), (difficulty), (question_type))")
def a24(s: SparkSession, d: str) -> DataFrame:
    return reports.by_sections(_rv(s, d), ["difficulty", "question_type"], [F.count("judge").alias("n"), rounded(F.avg("judge"), 6).alias("mean_judge")])


AUDIT = """count(*) AS n, round(avg(judge), 6) AS mean_judge, round(avg(CASE WHEN judge IS NOT NULL THEN system_score END), 6) AS mean_system, round(avg(gap), 6) AS mean_gap, round(avg(agreement), 6) AS mean_agreement,
round(CASE WHEN count(judge) > 1 THEN corr(judge, system_score) END, 6) AS correlation, round(100 * avg(CASE WHEN gap < -0.15 THEN 1.0 WHEN gap IS NOT NULL THEN 0.0 END), 6) AS over_pct, round(100 * avg(CASE WHEN gap > 0.15 THEN 1.0 WHEN gap IS NOT NULL THEN 0.0 END), 6) AS under_pct"""


@query("a25_score_audit", f"{RV} SELECT student_type, {AUDIT} FROM rv GROUP BY student_type")
def a25(s: SparkSession, d: str) -> DataFrame:
    out = _rv(s, d).groupBy("student_type").agg(*reports.audit(_rv(s, d)))
    return out.select("student_type", "n", *[rounded(c, 6).alias(c) for c in out.columns[2:]])


@query("a26_multihop", f"{RV} SELECT question_type, round(avg(hop_depth), 6) AS mean_depth, round(100 * avg((hop_depth >= 4)::INT), 6) AS deep_pct FROM rv WHERE hop_depth > 0 GROUP BY question_type")
def a26(s: SparkSession, d: str) -> DataFrame:
    return _rv(s, d).where("hop_depth > 0").groupBy("question_type").agg(rounded(F.avg("hop_depth"), 6).alias("mean_depth"), rounded(100 * F.avg((F.col("hop_depth") >= 4).cast("int")), 6).alias("deep_pct"))


@query("a27_student_comparison", f"{RV} SELECT student_type, count(*) AS n, round(100.0 * count(*) FILTER (difficulty = 'advanced') / count(*), 6) AS advanced_pct, round(100.0 * count(*) FILTER (question_type = 'evaluative') / count(*), 6) AS evaluative_pct, round(avg(system_score), 6) AS mean_score, count(DISTINCT student) AS students FROM rv GROUP BY student_type")
def a27(s: SparkSession, d: str) -> DataFrame:
    pct = lambda c: rounded(100.0 * F.count_if(c) / F.count("*"), 6)
    return _rv(s, d).groupBy("student_type").agg(
        F.count("*").alias("n"), pct(F.col("difficulty") == "advanced").alias("advanced_pct"), pct(F.col("question_type") == "evaluative").alias("evaluative_pct"),
        rounded(F.avg("system_score"), 6).alias("mean_score"), F.count_distinct("student").alias("students"),
    )


@query("a28_session_digest", f"{RV}, x AS (SELECT difficulty AS value, count(*) AS n FROM rv GROUP BY difficulty) SELECT value, n, round(100.0 * n / (SELECT count(*) FROM rv), 6) AS pct FROM x")
def a28(s: SparkSession, d: str) -> DataFrame:
    return reports.digest(_rv(s, d), "difficulty").select("value", "n", rounded("pct", 6).alias("pct"))


@query("o4_top_topics", f"{with_views('attempts')}, x AS (SELECT topic, count(*) AS n FROM attempts GROUP BY topic) SELECT topic, n, row_number() OVER (ORDER BY n DESC, topic) AS place FROM x ORDER BY n DESC, topic LIMIT 5")
def o4(s: SparkSession, d: str) -> DataFrame:
    counts = attempts(s, d).groupBy("topic").agg(F.count("*").alias("n"))
    return reports.ranked(counts, [F.desc("n"), F.asc("topic")], 5).select("topic", "n", "place")


@query("c9_review_report", f"""{RV} SELECT 'quality' AS section, difficulty AS key, 'mean_judge' AS metric, round(avg(judge), 6) AS value FROM rv GROUP BY difficulty UNION ALL SELECT 'audit', student_type::VARCHAR, 'mean_gap', round(avg(gap), 6) FROM rv GROUP BY student_type
UNION ALL SELECT 'audit', student_type::VARCHAR, 'correlation', round(corr(judge, system_score), 6) FROM rv GROUP BY student_type UNION ALL SELECT 'multihop', question_type, 'mean_depth', round(avg(hop_depth), 6) FROM rv GROUP BY question_type
UNION ALL SELECT 'students', student_type::VARCHAR, 'mean_score', round(avg(system_score), 6) FROM rv GROUP BY student_type""")
def c9(s: SparkSession, d: str) -> DataFrame:
    rv = _rv(s, d)
    long = lambda df, section, key, metric: df.select(F.lit(section).alias("section"), F.col(key).cast("string").alias("key"), F.lit(metric).alias("metric"), rounded(metric, 6).alias("value"))
    by = rv.groupBy("student_type").agg(F.avg("gap").alias("mean_gap"), F.corr("judge", "system_score").alias("correlation"), F.avg("system_score").alias("mean_score"))
    return (
        long(rv.groupBy("difficulty").agg(F.avg("judge").alias("mean_judge")), "quality", "difficulty", "mean_judge")
        .unionByName(long(by, "audit", "student_type", "mean_gap")).unionByName(long(by, "audit", "student_type", "correlation"))
        .unionByName(long(rv.groupBy("question_type").agg(F.avg("hop_depth").alias("mean_depth")), "multihop", "question_type", "mean_depth")).unionByName(long(by, "students", "student_type", "mean_score"))
    )


# --- recommendation and composition --------------------------------------------------------------------------


@query("a3_dedup_courses", f"{CO} SELECT page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) AS n FROM courses) WHERE n = 1")
def a3(s: SparkSession, d: str) -> DataFrame:
    return keep_first(courses(s, d).select("page_id", "url"), [F.col("url")], [F.col("page_id")])


@query("c8_recommendation", f"""{with_views('attempts', 'levels', 'prereqs')}, st AS (SELECT student, topic, count(*) AS attempts, avg(score) AS mean FROM attempts GROUP BY ALL), sp AS (SELECT DISTINCT a.student, l.topic FROM attempts a, levels l),
weak AS (SELECT student, topic FROM sp LEFT JOIN st USING (student, topic) WHERE mean < 0.5 OR (attempts IS NULL AND topic IN (SELECT topic FROM prereqs))),
lab(topic, label) AS (VALUES ('signup', 0), ('view', 1), ('click', 2), ('error', 3), ('purchase', 4)),
sim AS (SELECT v.vec_id, v.label, list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) AS score FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q),
best AS (SELECT vec_id, label, max(score) AS best FROM sim GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(best, 9) DESC, vec_id) AS rank FROM best)
SELECT student, weak.topic, vec_id, rank FROM weak JOIN lab USING (topic) JOIN rk USING (label) WHERE rank <= 3""")
def c8(s: SparkSession, d: str) -> DataFrame:
    weak = m.weak_topics(attempts(s, d), topic_levels(s), prereqs(s)).select("student", "topic")
    labels = literal_table(s, (("signup", 0), ("view", 1), ("click", 2), ("error", 3), ("purchase", 4)), "topic string, label int")
    v = vectors(s, d)
    sims = p.highest_similarities(v, v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")))
    return rec.courses_for(weak.join(F.broadcast(labels), "topic"), sims, 3)


@query("c2_enrichment", f"""{CM}, {CMX}, cn AS (SELECT c.doc_id, c.file_name, c.page_number, coalesce(canonical, CASE WHEN {KNOWN} THEN topic ELSE 'Unknown' END) AS topic FROM cmx c LEFT JOIN canon ON lower(topic) = lower(raw)), v AS (SELECT file_name, page_number, topic, count(*) AS n, min(doc_id) AS f FROM cn WHERE {KNOWN} GROUP BY ALL),
mj AS (SELECT file_name, page_number, first(topic ORDER BY n DESC, f, topic) AS major FROM v GROUP BY ALL) SELECT doc_id, coalesce(major, topic) AS topic FROM cn LEFT JOIN mj USING (file_name, page_number)""".replace(f"{CM},", f"{CM}, {CANON_SQL},"))
def c2(s: SparkSession, d: str) -> DataFrame:
    rows = _cmx(s, d).withColumn("section", F.when(t.known(F.col("topic")), F.col("topic")).otherwise("Unknown"))
    named = enrich.canonical(rows, literal_table(s, CANON, "raw string, canonical string"))
    return enrich.page_consistent(named).select("doc_id", "topic")


@query("c2_reply_ledger", f"""WITH {CANON_SQL}, x AS (SELECT doc_id, doc_id % 3 AS page_number, 'f' || (doc_id % 11) AS file_name, lang, source, doc_id % 5 AS k, doc_id % 7 AS m FROM documents),
st AS (SELECT *, CASE WHEN k = 0 THEN 'done' WHEN k = 1 THEN 'tagged' WHEN m = 3 THEN 'waits' WHEN k = 4 THEN 'defaults' ELSE 'tagged' END AS state FROM x),
tp AS (SELECT st.*, CASE state WHEN 'done' THEN source WHEN 'tagged' THEN coalesce(canonical, lang) WHEN 'defaults' THEN lang END AS topic FROM st LEFT JOIN canon ON lower(source) = lower(raw)),
v AS (SELECT file_name, page_number, topic, count(*) AS n, min(doc_id) AS f FROM tp WHERE coalesce(topic, '') NOT IN ('', 'Unknown') GROUP BY ALL), mj AS (SELECT file_name, page_number, first(topic ORDER BY n DESC, f, topic) AS major FROM v GROUP BY ALL)
SELECT doc_id, CASE WHEN topic IS NOT NULL THEN coalesce(major, topic) END AS topic, CASE state WHEN 'done' THEN 'kept' WHEN 'tagged' THEN 'try' || k WHEN 'defaults' THEN 'Unknown' END AS subtopic,
CASE state WHEN 'done' THEN 'easy' WHEN 'tagged' THEN 'hard' WHEN 'defaults' THEN 'medium' END AS difficulty, CASE WHEN state = 'waits' THEN 2 END AS next_attempt FROM tp LEFT JOIN mj USING (file_name, page_number)""")
def c2_ledger(s: SparkSession, d: str) -> DataFrame:
    chunks, replies = _ledger(s, d)
    topics = literal_table(s, CANON, "raw string, canonical string")
    out = kept(enrich.enrich_chunks(chunks, replies, topics), "enriched")
    ask = enrich.open_requests(out, replies).withColumnRenamed("attempt", "next_attempt")
    return out.join(ask, "doc_id", "left").select("doc_id", "topic", "subtopic", "difficulty", "next_attempt")


def _ledger(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Chunks of which each fifth has its tags, and replies of four attempts: useless ones before the attempt
    ``doc_id % 5``, and one attempt only where ``doc_id % 7`` is 3."""
    k, done = F.col("doc_id") % 5, F.col("doc_id") % 5 == 0
    docs = table(s, d, "documents")
    chunks = docs.select(
        "doc_id", F.concat(F.lit("f"), (F.col("doc_id") % 11).cast("string")).alias("file_name"), (F.col("doc_id") % 3).alias("page_number"), F.col("lang").alias("section"),
        F.when(done, F.col("source")).alias("topic"), F.when(done, "kept").alias("subtopic"), F.when(done, "other").alias("concept_type"), F.when(done, "easy").alias("difficulty"), F.when(done, "").alias("keywords"),
    )
    a = F.col("attempt").cast("string")
    good = F.concat(F.lit('Sure: {"topic": "'), "source", F.lit('", "subtopic": "try'), a, F.lit('", "difficulty": "Hard"}'))
    raw = F.when(F.col("attempt") >= k, good).when(F.col("attempt") == 1, "no object").otherwise(F.lit('{"topic": }'))
    attempts_made = F.sequence(F.lit(1), F.when(F.col("doc_id") % 7 == 3, 1).otherwise(4))
    replies = docs.select("doc_id", "source", F.explode(attempts_made).alias("attempt")).withColumn("raw", raw).select("doc_id", "attempt", "raw")
    return chunks, replies


@query("c5_question_requests")
def c5(s: SparkSession, d: str) -> DataFrame:
    found = kept(found_for_queries(s, d), "retrieved")
    requests = hybrid_queries(s, d).select("query_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i")).withColumn("request_id", F.concat_ws("-", "query_id", F.col("i").cast("string")))
    siblings = chunk_meta(s, d).select("doc_id", F.concat_ws("::p", "file_name", F.floor(F.col("doc_id") / 3).cast("string")).alias("parent_id"), "text")
    asked = hybrid_queries(s, d).select("query_id", F.substring("topic", 4, 1).try_cast("int").alias("k")).join(qa(s, d).select((F.col("conv_id") % 10).alias("k"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), "question"), "k")
    out = context.question_requests(found, requests, siblings, asked.select("query_id", "ord", "question"))
    return out.select("request_id", "query_id", "hops", "doc_ids", "has_code", F.coalesce(F.length("snippet"), F.lit(0)).alias("snippet_chars"), F.length("context").alias("context_chars"), F.md5("context").alias("context_md5"), F.md5("avoid").alias("avoid_md5"))


WANTED = (("src1", "src0", 0), ("src1", "src2", 1), ("src3", "src5", 0), ("src3", "src3", 1), ("src3", "nothing", 2))
WANTED_SQL = "wanted(topic, prereq, ord) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in WANTED) + ")"


@query("c11_curriculum", f"""{CM}, {WANTED_SQL}, v AS (SELECT topic, difficulty, count(*) AS n, min(doc_id) AS f FROM chunk_meta WHERE {KNOWN} GROUP BY ALL), lv AS (SELECT topic, CASE first(difficulty ORDER BY n DESC, f, difficulty) WHEN 'easy' THEN 'basic' WHEN 'hard' THEN 'advanced' ELSE 'intermediate' END AS level FROM v GROUP BY topic),
sb AS (SELECT topic, string_agg(DISTINCT subtopic, ',' ORDER BY subtopic) AS subtopics FROM chunk_meta WHERE {KNOWN} GROUP BY topic),
pr AS (SELECT topic, string_agg(prereq, ',' ORDER BY ord) AS prereqs FROM wanted WHERE topic IN (SELECT topic FROM lv) AND prereq IN (SELECT topic FROM lv) AND topic <> prereq GROUP BY topic),
ex AS (SELECT topic, count(*) AS excerpts, max(doc_id) AS last_excerpt FROM (SELECT * FROM chunk_meta WHERE {KNOWN} AND concept_type IN ('definition', 'explanation', 'example') ORDER BY doc_id LIMIT 150) GROUP BY topic)
SELECT topic, level, subtopics, coalesce(prereqs, '') AS prereqs, coalesce(excerpts, 0) AS excerpts, last_excerpt FROM lv LEFT JOIN sb USING (topic) LEFT JOIN pr USING (topic) LEFT JOIN ex USING (topic)""")
def c11(s: SparkSession, d: str) -> DataFrame:
    cm = chunk_meta(s, d).where(t.known(F.col("topic")))
    return enrich.curriculum(cm, literal_table(s, WANTED, "topic string, prereq string, ord int")).select("topic", "level", F.array_join("subtopics", ",").alias("subtopics"), F.array_join("prereqs", ",").alias("prereqs"), "excerpts", "last_excerpt")
