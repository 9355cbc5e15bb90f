"""Queries of search: BM25, vectors, fusion, boosts, hybrid retrieval and its measures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import products as p
from ..operators import retrieval as r
from ..operators.keyword_index import KeywordIndex, build_keyword_index
from ..operators.vector_index import VectorIndex, build_index
from ..operators.enrich import concept_graph, concepts
from ..registry import query, rounded
from ..sources.workspace import kept
from .views import chunk_meta, literal_table, table, vectors, with_views

CM = with_views("chunk_meta")
TOK = "list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r]+'), lambda w: w <> '')"
QUERIES = (("q1", "the that worthless"), ("q2", "license version under"), ("q3", "la de eau que"), ("q4", "der die und nicht"), ("q5", "the the of"))
Q_SQL = "q(query_id, query) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in QUERIES) + ")"
POST = f"""post AS MATERIALIZED (SELECT doc_id, doc_len, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS doc_len, unnest(w) AS term FROM (SELECT doc_id, {TOK} AS w FROM documents)) GROUP BY ALL),
stats AS MATERIALIZED (SELECT count(*) AS docs, avg(len({TOK})) AS mean_len FROM documents),
df AS MATERIALIZED (SELECT term, count(*) AS df FROM post GROUP BY term), raw AS MATERIALIZED (SELECT term, df, ln(docs - df + 0.5) - ln(df + 0.5) AS raw FROM df, stats),
mean_idf AS MATERIALIZED (SELECT avg(raw) AS mean_idf FROM raw), idf AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * mean_idf ELSE raw END AS idf FROM raw, mean_idf)"""
BM25 = f"""{POST}, asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(string_split(query, ' ')) AS term FROM q) GROUP BY ALL),
bm AS (SELECT query_id, doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_len / mean_len))) AS score FROM post JOIN asked USING (term) JOIN idf USING (term), stats GROUP BY ALL)"""
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
SIM = f"sim AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, {DOT.format(a='v.embedding', b='q.embedding')} AS score FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q)"


def lit_queries(s: SparkSession) -> DataFrame:
    return literal_table(s, QUERIES, "query_id string, query string")


def docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "text")


_INDEXES: dict[tuple, KeywordIndex | VectorIndex] = {}


def _index_of(s: SparkSession, d: str, name: str, build: Callable[[DataFrame], KeywordIndex | VectorIndex]) -> KeywordIndex | VectorIndex:
    """The index of a table, made once in an application and read by all its queries."""
    rows = table(s, d, name)
    key = (s.sparkContext.applicationId, name, *sorted(rows.inputFiles()))
    if key not in _INDEXES:
        _INDEXES[key] = build(rows)
    return _INDEXES[key]


def words_index(s: SparkSession, d: str) -> KeywordIndex:
    return _index_of(s, d, "documents", lambda rows: build_keyword_index(rows.select("doc_id", "text")))


def vectors_index(s: SparkSession, d: str) -> VectorIndex:
    return _index_of(s, d, "embeddings", lambda rows: build_index(rows.select("vec_id", "embedding", F.col("label").alias("topic"))))


def vector_queries(s: SparkSession, d: str) -> DataFrame:
    return vectors(s, d).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


@query("a11_bm25_statistics", f"WITH {POST} SELECT term, df, round(idf, 6) AS idf FROM idf")
def a11(s: SparkSession, d: str) -> DataFrame:
    return words_index(s, d).weights().select("term", "df", rounded("idf", 6).alias("idf"))


@query("a12_bm25_scores", f"WITH {Q_SQL}, {BM25} SELECT query_id, doc_id, round(score, 6) AS score FROM bm")
def a12(s: SparkSession, d: str) -> DataFrame:
    return words_index(s, d).bm25(lit_queries(s)).select("query_id", "doc_id", rounded("score", 6).alias("score"))


@query("o2_bm25_top", f"WITH {Q_SQL}, {BM25} SELECT query_id, doc_id, rank FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) - 1 AS rank FROM bm) WHERE rank < 15")
def o2(s: SparkSession, d: str) -> DataFrame:
    return r.top_per_query(words_index(s, d).bm25(lit_queries(s)), 15, [F.desc(rounded("score", 9)), F.asc("doc_id")]).select("query_id", "doc_id", "rank")


@query("j1_similarity_join", f"WITH {SIM} SELECT query_id, vec_id, round(score, 6) AS score FROM sim")
def j1(s: SparkSession, d: str) -> DataFrame:
    return p.similarities(vectors(s, d).drop("topic"), vector_queries(s, d)).select("query_id", "vec_id", rounded("score", 6).alias("score"))


@query("f28_cosine", f"""WITH c AS (SELECT q.vec_id AS query_id, v.vec_id, {DOT.format(a='v.embedding', b='q.embedding')} / sqrt({DOT.format(a='v.embedding', b='v.embedding')} * {DOT.format(a='q.embedding', b='q.embedding')}) AS c
FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q) SELECT query_id, vec_id, round(c, 5) AS similarity, round(1 - c, 5) AS distance FROM c""")
def f28(s: SparkSession, d: str) -> DataFrame:
    c = p.cosine_of(F.col("score"), F.col("squares"))
    return p.similarities(vectors(s, d).drop("topic"), vector_queries(s, d), lengths=True).select("query_id", "vec_id", rounded(c, 5).alias("similarity"), rounded(1 - c, 5).alias("distance"))


TOP = "row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id)"


def _order() -> list:
    return [F.desc(rounded("score", 9)), F.asc("vec_id")]


@query("o1_vector_top", f"WITH {SIM} SELECT query_id, vec_id, rank FROM (SELECT *, {TOP} AS rank FROM sim) WHERE rank <= 5")
def o1(s: SparkSession, d: str) -> DataFrame:
    return vectors_index(s, d).search_exact(vector_queries(s, d), 5).select("query_id", "vec_id", (F.col("rank") + 1).alias("rank"))


HYBRID = "0.7 * score + 0.3 * (CASE WHEN label = query_id % 10 THEN 1.0 ELSE 0.0 END)"


@query("o3_overfetch", f"WITH {SIM}, f AS (SELECT * FROM (SELECT *, {TOP} AS r FROM sim) WHERE r <= 15), h AS (SELECT query_id, vec_id, round({HYBRID}, 6) AS score FROM f) SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM h) WHERE rank <= 5")
def o3(s: SparkSession, d: str) -> DataFrame:
    wide = r.top_per_query(p.best_similarities(vectors(s, d), vector_queries(s, d), 15), 15, _order(), start=1)
    h = wide.withColumn("score", rounded(0.7 * F.col("score") + 0.3 * (F.col("topic") == F.col("query_id") % 10).cast("double"), 6))
    return r.top_per_query(h.drop("rank"), 5, [F.desc("score"), F.asc("vec_id")], start=1).select("query_id", "vec_id", "score", "rank")


@query("p8_fallback", f"WITH {SIM}, f AS (SELECT * FROM sim WHERE label = 3 AND query_id % 2 = 0), e AS (SELECT * FROM f UNION ALL SELECT * FROM sim WHERE query_id NOT IN (SELECT query_id FROM f)) SELECT query_id, vec_id, rank FROM (SELECT *, {TOP} AS rank FROM e) WHERE rank <= 5")
def p8(s: SparkSession, d: str) -> DataFrame:
    v, asked = vectors(s, d), vector_queries(s, d)
    filtered = kept(r.top_per_query(p.best_similarities(v.where("topic = 3"), asked.where("query_id % 2 = 0"), 5), 5, _order(), start=1), "filtered")
    left = asked.join(filtered.select("query_id").distinct(), "query_id", "left_anti")
    return r.with_fallback(filtered, r.top_per_query(p.best_similarities(v, left, 5), 5, _order(), start=1)).select("query_id", "vec_id", "rank")


BMR = "bmr AS (SELECT query_id, doc_id AS key, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) - 1 AS rank FROM bm)"


@query("j13_fusion", f"""WITH {Q_SQL}, {BM25}, {BMR}, a AS (SELECT * FROM bmr WHERE rank < 30), b AS (SELECT query_id, doc_id AS key, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) - 1 AS rank FROM bm QUALIFY rank < 30)
SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.key, b.key) AS key, round(coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 6) AS fused FROM a FULL JOIN b ON a.query_id = b.query_id AND a.key = b.key""")
def j13(s: SparkSession, d: str) -> DataFrame:
    scored = words_index(s, d).bm25(lit_queries(s)).withColumn("key", F.col("doc_id"))
    a = r.top_per_query(scored, 30, [F.desc(rounded("score", 9)), F.asc("doc_id")])
    b = r.top_per_query(scored, 30, [F.asc("doc_id")])
    return r.fuse(a, b).select("query_id", "key", rounded("fused", 6).alias("fused"))


@query("a13_rrf_scores", f"WITH {Q_SQL}, {BM25}, {BMR} SELECT query_id, key, round(1.0 / (60 + rank), 6) AS fused FROM bmr WHERE rank < 15")
def a13(s: SparkSession, d: str) -> DataFrame:
    ranked = r.top_per_query(words_index(s, d).bm25(lit_queries(s)), 15, [F.desc(rounded("score", 9)), F.asc("doc_id")])
    return r.fuse(ranked.withColumn("key", F.col("doc_id"))).select("query_id", "key", rounded("fused", 6).alias("fused"))


@query("f30_bonuses", f"{CM} SELECT doc_id, CASE concept_type WHEN 'explanation' THEN 0.05 WHEN 'example' THEN 0.03 ELSE 0.0 END::DOUBLE AS concept_bonus, CASE difficulty WHEN 'hard' THEN 0.08 WHEN 'medium' THEN 0.03 ELSE 0.0 END::DOUBLE AS difficulty_bonus FROM chunk_meta")
def f30(s: SparkSession, d: str) -> DataFrame:
    return chunk_meta(s, d).select("doc_id", r.concept_bonus(F.col("concept_type")).alias("concept_bonus"), r.difficulty_bonus(F.col("difficulty"), F.lit("hard")).alias("difficulty_bonus"))


@query("p7_recently_used", f"""{CM}, x AS (SELECT topic AS query_id, doc_id, trim(substr(text, 1, 80)) AS k, doc_id % 4 <> 0 AS used FROM chunk_meta), u AS (SELECT DISTINCT query_id, k FROM x WHERE used),
m AS (SELECT x.*, u.k IS NOT NULL AS seen FROM x LEFT JOIN u USING (query_id, k)), f AS (SELECT *, count(*) FILTER (NOT seen) OVER (PARTITION BY query_id) AS free FROM m) SELECT query_id, doc_id FROM f WHERE NOT seen OR free < 3""")
def p7(s: SparkSession, d: str) -> DataFrame:
    rows = chunk_meta(s, d).select(F.col("topic").alias("query_id"), "doc_id", "text")
    used = rows.where("doc_id % 4 <> 0").select("query_id", F.trim(F.substring("text", 1, 80)).alias("used_key"))
    return r.fresh(rows, used).select("query_id", "doc_id")


@query("w15_diversity", f"""{CM}, x AS (SELECT difficulty AS query_id, doc_id, CASE WHEN topic = 'Unknown' THEN 't:' || trim(substr(text, 1, 60)) ELSE 's:' || subtopic END AS g, doc_id * 7919 % 1000 AS score FROM chunk_meta)
SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, g ORDER BY score DESC, doc_id) AS n FROM x) WHERE n = 1""")
def w15(s: SparkSession, d: str) -> DataFrame:
    rows = chunk_meta(s, d).select(F.col("difficulty").alias("query_id"), "doc_id", "text", F.when(F.col("topic") == "Unknown", "Unknown").otherwise(F.col("subtopic")).alias("subtopic"), (F.col("doc_id") * 7919 % 1000).alias("score"))
    return r.diverse(rows, [F.desc("score"), F.asc("doc_id")]).select("query_id", "doc_id")


@query("f31_query_variants", f"""{CM}, tp AS (SELECT DISTINCT topic FROM chunk_meta WHERE topic <> 'Unknown') SELECT topic AS query_id, i AS variant, topic || v AS query FROM tp, (VALUES (0, ''), (1, ' explanation'), (2, ' example'), (3, ' definition'), (4, ' concepts'), (5, ' applications')) x(i, v)""")
def f31(s: SparkSession, d: str) -> DataFrame:
    topics = chunk_meta(s, d).where("topic <> 'Unknown'").select("topic").distinct().withColumn("query_id", F.col("topic"))
    return r.query_variants(topics)


@query("f29_metadata_overlap", f"""{CM}, x AS (SELECT doc_id, list_distinct(string_split(topic || ' ' || replace(subtopic, '/', ' ') || ' ' || concept_type, ' ')) AS w FROM chunk_meta), y AS (SELECT doc_id, len(list_intersect(['src1', 'en', 'example', 'more'], w)) / 4.0::DOUBLE AS o FROM x)
SELECT doc_id, round(o, 6) AS overlap, round(0.7 * (doc_id % 10) / 10.0::DOUBLE + 0.3 * o, 6) AS hybrid FROM y""")
def f29(s: SparkSession, d: str) -> DataFrame:
    words = F.split(F.concat_ws(" ", "topic", F.translate("subtopic", "/", " "), "concept_type"), " ")
    o = r.overlap(F.array(*[F.lit(w) for w in ("src1", "en", "example", "more")]), words)
    return chunk_meta(s, d).select("doc_id", rounded(o, 6).alias("overlap"), rounded(0.7 * (F.col("doc_id") % 10) / 10.0 + 0.3 * o, 6).alias("hybrid"))


@query("f33_sparse_expansion", f"""{CM}, n AS (SELECT topic, count(*) AS c FROM chunk_meta GROUP BY topic), tp AS (SELECT DISTINCT topic FROM chunk_meta), pr(topic, more) AS (VALUES ('src1', 'src2'), ('src3', 'src5'))
SELECT topic AS query_id, topic, 0 AS ord FROM tp UNION ALL SELECT topic, more, 1 FROM tp JOIN n USING (topic) JOIN pr USING (topic) WHERE c < 60""")
def f33(s: SparkSession, d: str) -> DataFrame:
    cm = chunk_meta(s, d)
    topics = cm.select("topic").distinct().withColumn("query_id", F.col("topic"))
    pre = literal_table(s, (("src1", "src0", 0), ("src1", "src2", 1), ("src3", "src5", 0)), "topic string, prereq string, ord int")
    return r.expanded_topics(topics, cm.groupBy("topic").agg(F.count("*").alias("chunks")), pre, 60)


OVERLAP = f"len(list_intersect(list_distinct(string_split(query, ' ')), {TOK})) / len(list_distinct(string_split(query, ' ')))::DOUBLE"


@query("o5_rerank", f"""WITH {Q_SQL}, {BM25}, f AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) - 1 AS rank FROM bm) WHERE rank < 20),
g AS (SELECT f.query_id, f.doc_id, f.rank, CASE WHEN count(*) OVER (PARTITION BY f.query_id) > 5 THEN {OVERLAP} ELSE 0 END AS s FROM f JOIN documents USING (doc_id) JOIN q USING (query_id)),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank) AS place FROM g) SELECT query_id, doc_id, place, round(s, 6) AS rerank_score FROM h WHERE place <= 5""")
def o5(s: SparkSession, d: str) -> DataFrame:
    found = r.top_per_query(words_index(s, d).bm25(lit_queries(s)), 20, [F.desc(rounded("score", 9)), F.asc("doc_id")]).join(docs(s, d), "doc_id").join(lit_queries(s), "query_id")
    score = r.overlap(t.tokens(F.lower("query")), t.tokens(F.lower("text")))
    return r.rerank(found, score, 5, [F.asc("rank")]).select("query_id", "doc_id", "place", rounded("rerank_score", 6).alias("rerank_score"))


@query("a32_retrieval_metrics", f"""WITH {Q_SQL}, {BM25}, {BMR}, x AS (SELECT b.query_id, rank + 1 AS rank, contains(lower(d.text), string_split(q.query, ' ')[3]) AS hit FROM bmr b JOIN documents d ON d.doc_id = b.key JOIN q USING (query_id) WHERE rank < 10),
p AS (SELECT query_id, max(CASE WHEN rank <= 5 AND hit THEN 1.0 ELSE 0.0 END) AS recall, coalesce(max(CASE WHEN hit THEN 1.0 / rank END), 0) AS rr FROM x GROUP BY query_id) SELECT round(avg(recall), 6) AS recall_at_5, round(avg(rr), 6) AS mrr, count(*) AS queries FROM p""")
def a32(s: SparkSession, d: str) -> DataFrame:
    found = r.top_per_query(words_index(s, d).bm25(lit_queries(s)), 10, [F.desc(rounded("score", 9)), F.asc("doc_id")], start=1).join(docs(s, d), "doc_id")
    x = found.join(lit_queries(s).select("query_id", F.get(F.split("query", " "), F.lit(2)).alias("keyword")), "query_id")
    return r.recall_and_rank(x).agg(rounded(F.avg("recall"), 6).alias("recall_at_5"), rounded(F.avg("reciprocal_rank"), 6).alias("mrr"), F.count("*").alias("queries"))


@query("a33_best_course_scores", f"WITH {SIM} SELECT vec_id, round(max(score), 6) AS best FROM sim GROUP BY vec_id")
def a33(s: SparkSession, d: str) -> DataFrame:
    best = p.highest_similarities(vectors(s, d).select("vec_id", "embedding"), vector_queries(s, d))
    return best.groupBy("vec_id").agg(rounded(F.max("score"), 6).alias("best"))


@query("w13_semantic_breaks", f"""WITH x AS (SELECT vec_id, vec_id // 50 AS doc, embedding, lag(embedding) OVER (PARTITION BY vec_id // 50 ORDER BY vec_id) AS prev FROM embeddings),
b AS (SELECT vec_id, doc, CASE WHEN prev IS NULL THEN 0 WHEN {DOT.format(a='embedding', b='prev')} < 0.4 THEN 1 ELSE 0 END AS brk FROM x)
SELECT vec_id, doc, sum(brk) OVER (PARTITION BY doc ORDER BY vec_id)::BIGINT AS segment FROM b""")
def w13(s: SparkSession, d: str) -> DataFrame:
    from ..operators.context import semantic_segments

    v = vectors(s, d).withColumn("doc", F.floor(F.col("vec_id") / 50))
    return semantic_segments(v, "doc", "vec_id", 0.4).select("vec_id", "doc", "segment")


@query("j2_index_search")
def j2_index(s: SparkSession, d: str) -> DataFrame:
    found = vectors_index(s, d).search(vector_queries(s, d), 5)
    return found.select("query_id", "vec_id", (F.col("rank") + 1).alias("rank"), rounded("score", 6).alias("score"))


@query("j2_lsh_join")
def j2(s: SparkSession, d: str) -> DataFrame:
    from ..operators.lsh import approximate_pairs

    v = vectors(s, d)
    return approximate_pairs(v, v.where("vec_id % 100 = 0"), 1.2).select("query_id", "vec_id", rounded("similarity", 5).alias("similarity"))


def _chunks(s: SparkSession, d: str) -> DataFrame:
    return chunk_meta(s, d)


def hybrid_queries(s: SparkSession, d: str) -> DataFrame:
    """Topics of the corpus, and every benchmark item by its first words: these are no topics and search everything."""
    rows = tuple((f"{topic}-{want}", topic, want) for topic in ("src1", "src2", "src3", "src4") for want in ("easy", "hard"))
    words = F.array_join(F.slice(t.tokens(F.col("text")), 1, 8), " ")
    items = table(s, d, "benchmark").select(F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("query_id"), words.alias("topic"), F.lit("medium").alias("difficulty"))
    return literal_table(s, rows, "query_id string, topic string, difficulty string").unionByName(items)


def found_for_queries(s: SparkSession, d: str) -> DataFrame:
    pre = literal_table(s, (("src1", "src0", 0), ("src1", "src2", 1), ("src3", "src5", 0)), "topic string, prereq string, ord int")
    cm, asked = _chunks(s, d), hybrid_queries(s, d)
    used = asked.select("query_id", "topic").join(cm.where("doc_id % 97 = 0").select("topic", F.trim(F.substring("text", 1, 80)).alias("used_key")), "topic")
    edges = concept_graph(concepts(cm))
    return r.hybrid(cm, asked, pre, used, concepts=r.graph_concepts(asked.select("query_id", "topic"), edges))


@query("c3_hybrid_retrieval")
def c3(s: SparkSession, d: str) -> DataFrame:
    return found_for_queries(s, d).drop("text")


@query("c4_vector_and_metadata", f"""WITH {SIM}, f AS (SELECT * FROM (SELECT *, {TOP} AS r FROM sim) WHERE r <= 15), h AS (SELECT query_id, vec_id, label, round({HYBRID}, 6) AS score FROM f),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM h) WHERE rank <= 5)
SELECT query_id, string_agg('[' || rank || '] topic ' || label || ' vector ' || vec_id, chr(10) ORDER BY rank) AS context FROM k GROUP BY query_id""")
def c4(s: SparkSession, d: str) -> DataFrame:
    from ..operators.context import numbered_context

    best = o3(s, d).join(vectors(s, d).select("vec_id", "topic"), "vec_id")
    body = F.concat(F.lit("topic "), F.col("topic").cast("string"), F.lit(" vector "), F.col("vec_id").cast("string"))
    return numbered_context(best, "query_id", "rank", body)


@query("f39_context_blocks", f"""{CM}, x AS (SELECT topic, doc_id, text, row_number() OVER (PARTITION BY topic ORDER BY doc_id) AS rank FROM chunk_meta) SELECT topic AS query_id, md5(string_agg('[' || rank || '] ' || substr(text, 1, 60), chr(10) ORDER BY rank)) AS context_md5 FROM x WHERE rank <= 5 GROUP BY topic""")
def f39(s: SparkSession, d: str) -> DataFrame:
    from ..operators.context import numbered_context

    rows = chunk_meta(s, d).select(F.col("topic").alias("query_id"), "doc_id", F.substring("text", 1, 60).alias("b"), F.lit(0).alias("score"))
    top = r.top_per_query(rows, 5, [F.asc("doc_id")], start=1)
    return numbered_context(top, "query_id", "rank", F.col("b")).select("query_id", F.md5("context").alias("context_md5"))
