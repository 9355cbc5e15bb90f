"""Material and courses for weak topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import top_per_query


def material(chunks: DataFrame, weak: DataFrame) -> DataFrame:
    """Different pages whose topic or subtopic is weak."""
    names = weak.select(F.lower(F.trim("topic")).alias("name")).distinct()
    each = chunks.select("file_name", "page_number", F.explode(F.array(F.lower(F.trim("topic")), F.lower(F.trim("subtopic")))).alias("name"))
    return each.join(names, "name", "left_semi").select("file_name", "page_number").distinct()


def course_text(title: Column, intro: Column, skills: Column) -> Column:
    return F.concat_ws(" | ", title, F.substring(intro, 1, 300), F.substring(skills, 1, 200))


def courses_for(weak: DataFrame, similar: DataFrame, k: int) -> DataFrame:
    """student, topic, vec_id, rank: for each weak topic the courses of its label with the best score over all queries.

    The ranking is made once for each label, not for each student.
    """
    best = similar.groupBy("vec_id", F.col("topic").alias("query_id")).agg(F.max("score").alias("best"))
    top = top_per_query(best, k, [F.desc(F.round("best", 9)), F.asc("vec_id")], start=1)
    return weak.join(F.broadcast(top), F.col("label") == F.col("query_id")).select("student", "topic", "vec_id", "rank")
