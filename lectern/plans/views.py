"""Views over the given tables that stand in for course material, attempts and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DIFFICULTIES = ("easy", "medium", "hard")
LEVELS = ("basic", "intermediate", "advanced")
QUESTION_TYPES = ("factual", "inferential", "evaluative")
CONCEPTS = ("definition", "example", "explanation", "summary", "other")
#: topic, prerequisite, place in the topic's list.
PREREQS = (("view", "signup", 0), ("click", "view", 0), ("purchase", "click", 0), ("click", "error", 1))
TOPIC_LEVELS = {"signup": "basic", "view": "basic", "click": "intermediate", "error": "intermediate", "purchase": "advanced"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], index: F.Column) -> F.Column:
    """The value at a 0-based index."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def literal_table(spark: SparkSession, rows: tuple[tuple, ...], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def sections(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        F.col("source").alias("file_name"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("file_path"),
        (F.col("doc_id") % 10).alias("page_number"), F.col("lang").alias("section"), "text", "doc_id",
    )


def chunk_meta(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        "doc_id", "text", "lang", F.col("source").alias("file_name"), (F.col("doc_id") % 10).alias("page_number"), F.col("lang").alias("section"),
        F.when(F.col("doc_id") % 17 == 0, "Unknown").otherwise(F.col("source")).alias("topic"),
        F.concat("source", F.lit("/"), "lang").alias("subtopic"),
        pick(CONCEPTS, F.col("doc_id") % 5).alias("concept_type"), pick(DIFFICULTIES, F.col("doc_id") % 3).alias("difficulty"),
    )


def attempts(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    scale = F.when(F.col("user_id") % 3 == 0, 10.0).when(F.col("user_id") % 3 == 1, 30.0).otherwise(60.0)
    return table(spark, d, "events").select(
        F.col("user_id").alias("student"), F.col("event_type").alias("topic"), "event_id", "ts",
        F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("step"),
        F.least(F.col("value") / scale, F.lit(1.0)).alias("score"), k.alias("k"),
        (k % 3).alias("d"), (F.floor(k / 3) % 3).cast("int").alias("q"),
    )


def named(attempts: DataFrame) -> DataFrame:
    """Attempts with the names of their difficulty and question type."""
    return attempts.withColumn("difficulty", pick(LEVELS, F.col("d"))).withColumn("question_type", pick(QUESTION_TYPES, F.col("q")))


def judged(spark: SparkSession, d: str) -> DataFrame:
    a = named(attempts(spark, d))
    return a.select(
        "student", "topic", "step", "difficulty", "question_type", (F.col("student") % 3).alias("student_type"), F.col("score").alias("system_score"),
        F.when(F.col("k") % 20 == 0, -1.0).otherwise((F.col("k") % 101) / 100).alias("judge_score"), (F.col("k") % 5 + 1).alias("hop_depth"),
    )


def qa(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy("turn")
    t = table(spark, d, "conversations").select(
        "conv_id", "turn", "role", F.col("text").alias("question"), F.lead("text", 1).over(w).alias("reference"), F.lead("text", 2).over(w).alias("answer")
    )
    kind = pick(QUESTION_TYPES, (F.col("conv_id") + F.col("turn")) % 3)
    return t.where("role = 'user' and reference is not null and answer is not null").select("conv_id", "turn", "question", "reference", "answer", kind.alias("question_type"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "embedding", F.col("label").alias("topic"))


def courses(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(
        "page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", 'lang="([a-z]*)"', 1).alias("language"),
        F.regexp_extract("html", '<div class="ad">([^<]*)</div>', 1).alias("intro"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("skills"),
    )


def prereqs(spark: SparkSession) -> DataFrame:
    return literal_table(spark, PREREQS, "topic string, prereq string, ord int")


def topic_levels(spark: SparkSession) -> DataFrame:
    return literal_table(spark, tuple(TOPIC_LEVELS.items()), "topic string, level string")


# The same views in the checking engine's SQL, as common table expressions.
SQL = {
    "chunk_meta": """chunk_meta AS (SELECT doc_id, text, lang, source AS file_name, doc_id % 10 AS page_number, lang AS section,
        CASE WHEN doc_id % 17 = 0 THEN 'Unknown' ELSE source END AS topic, source || '/' || lang AS subtopic,
        CASE doc_id % 5 WHEN 0 THEN 'definition' WHEN 1 THEN 'example' WHEN 2 THEN 'explanation' WHEN 3 THEN 'summary' ELSE 'other' END AS concept_type,
        CASE doc_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty FROM documents)""",
    "attempts": """attempts AS (SELECT user_id AS student, event_type AS topic, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step,
        least(value / CASE user_id % 3 WHEN 0 THEN 10.0 WHEN 1 THEN 30.0 ELSE 60.0 END::DOUBLE, 1.0::DOUBLE) AS score, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events),
        named AS (SELECT *, k % 3 AS d, (k // 3) % 3 AS q, CASE k % 3 WHEN 0 THEN 'basic' WHEN 1 THEN 'intermediate' ELSE 'advanced' END AS difficulty,
        CASE (k // 3) % 3 WHEN 0 THEN 'factual' WHEN 1 THEN 'inferential' ELSE 'evaluative' END AS question_type FROM attempts)""",
    "judged": """judged AS (SELECT student, topic, step, difficulty, question_type, student % 3 AS student_type, score AS system_score,
        CASE WHEN k % 20 = 0 THEN -1.0::DOUBLE ELSE (k % 101) / 100::DOUBLE END AS judge_score, k % 5 + 1 AS hop_depth FROM named)""",
    "qa": """turns AS (SELECT conv_id, turn, role, text AS question, lead(text, 1) OVER w AS reference, lead(text, 2) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
        qa AS (SELECT conv_id, turn, question, reference, answer, CASE (conv_id + turn) % 3 WHEN 0 THEN 'factual' WHEN 1 THEN 'inferential' ELSE 'evaluative' END AS question_type
        FROM turns WHERE role = 'user' AND reference IS NOT NULL AND answer IS NOT NULL)""",
    "courses": """courses AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, 'lang="([a-z]*)"', 1) AS language,
        regexp_extract(html, '<div class="ad">([^<]*)</div>', 1) AS intro, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS skills FROM pages)""",
    "prereqs": """prereqs(topic, prereq, ord) AS (VALUES ('view', 'signup', 0), ('click', 'view', 0), ('purchase', 'click', 0), ('click', 'error', 1))""",
    "levels": """levels(topic, level) AS (VALUES ('signup', 'basic'), ('view', 'basic'), ('click', 'intermediate'), ('error', 'intermediate'), ('purchase', 'advanced'))""",
}


def with_views(*names: str) -> str:
    """WITH clause of the named views, ready for more expressions or a query."""
    return "WITH " + ",\n".join(SQL[n] for n in names)
