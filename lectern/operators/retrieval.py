"""Search for tables of queries: BM25, vector similarity, fusion, boosts, diversity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.hooks import embedder
from ..sources.workspace import kept
from .products import BLOCK, best_similarities, similarities  # noqa: F401  the last is part of this module's interface

K1, B, EPSILON, RRF_K = 1.5, 0.75, 0.25, 60
#: Queries above which they are not broadcast but joined by shuffle.
BROADCAST_ROWS = 100_000
#: Components of the vectors that stand in for a model's.
WIDTH = 256
#: Suffixes of a topic's query variants.
VARIANTS = ("", " explanation", " example", " definition", " concepts", " applications")
EXPANDED = ("", " explanation", " example", " definition")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast if counted to be small; else as it is, and the join shuffles."""
    return F.broadcast(df) if df.count() <= rows else df


def postings(docs: DataFrame) -> DataFrame:
    """doc_id, term, tf, doc_len from docs(doc_id, text)."""
    words = docs.select("doc_id", t.tokens(F.lower("text")).alias("w"))
    return words.select("doc_id", F.size("w").alias("doc_len"), F.explode("w").alias("term")).groupBy("doc_id", "doc_len", "term").agg(F.count("*").alias("tf"))


def bm25_statistics(docs: DataFrame) -> DataFrame:
    """One row: number of documents and mean length."""
    return docs.select(F.size(t.tokens(F.lower("text"))).alias("n")).agg(F.count("*").alias("docs"), F.avg("n").alias("mean_len"))


def term_weights(posted: DataFrame, stats: DataFrame) -> DataFrame:
    """term, df, idf; a negative idf becomes EPSILON times the mean idf of all terms."""
    return term_idf(posted.groupBy("term").agg(F.count("*").alias("df")), stats)


def term_idf(df: DataFrame, stats: DataFrame) -> DataFrame:
    """As ``term_weights``, from the number of documents of each term (term, df)."""
    raw = df.join(F.broadcast(stats)).select("term", "df", (F.log(F.col("docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    return raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))


def bm25(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, doc_id, score for docs(doc_id, text) and queries(query_id, query). Repeated query words count again.

    Postings are cut to the queries' terms before anything is joined to them.
    """
    asked = queries.select("query_id", F.explode(t.tokens(F.lower("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    posted = postings(docs)
    stats = bm25_statistics(docs)
    weights = term_weights(posted, stats)
    hits = posted.join(small(asked), "term").join(F.broadcast(stats)).join(weights.select("term", "idf"), "term")
    tf = F.col("tf")
    part = F.col("times") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("doc_len") / F.col("mean_len")))
    return hits.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def top_per_query(scored: DataFrame, k: int, order: list[Column], start: int = 0) -> DataFrame:
    """The first k rows of each query, with ``rank`` counted from ``start``."""
    # the plain comparison lets Spark cut each task's rows to k a query before it shuffles them
    w = W.partitionBy("query_id").orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank") + (start - 1))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    n = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def with_fallback(filtered: DataFrame, everything: DataFrame) -> DataFrame:
    """Filtered results; of queries without any, the unfiltered ones."""
    return filtered.unionByName(everything.join(filtered.select("query_id").distinct(), "query_id", "left_anti"))


def within_topics(chunks: DataFrame, queries: DataFrame, allowed: DataFrame) -> DataFrame:
    """Rows of ``queries`` (query_id, query_vec, base, ...) with the ``chunks`` (doc_id, embedding, topic, subtopic) whose
    topic or subtopic ``allowed`` (query_id, allowed) names for their base, and ``score``. An equality join on the names:
    no other chunk is scored, and one that two names fit is scored once."""
    lists = allowed.groupBy(F.col("query_id").alias("base")).agg(F.sort_array(F.collect_set("allowed")).alias("names"))
    asked = queries.join(lists, "base").withColumn("name", F.explode("names"))
    named = chunks.withColumn("own", F.array_distinct(F.array("topic", "subtopic"))).withColumn("name", F.explode("own"))
    met = named.join(small(asked), "name").where(F.col("name") == F.get(F.array_intersect("own", "names"), F.lit(0)))
    return met.withColumn("score", dot(F.col("embedding"), F.col("query_vec"))).drop("own", "names", "name", "query_vec")


def fuse(*ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """query_id, key, fused: sum of 1 / (k + rank) over the rankings (query_id, key, rank from 0)."""
    every = ranked[0].select("query_id", "key", "rank")
    for r in ranked[1:]:
        every = every.unionByName(r.select("query_id", "key", "rank"))
    return every.groupBy("query_id", "key").agg(F.sum(1 / (k + F.col("rank"))).alias("fused"))


def concept_bonus(concept: Column) -> Column:
    return F.when(concept == "explanation", 0.05).when(concept == "example", 0.03).otherwise(0.0)


def difficulty_bonus(have: Column, want: Column) -> Column:
    order = lambda c: F.when(c == "easy", 0).when(c == "hard", 2).otherwise(1)
    gap = F.abs(order(have) - order(want))
    return F.when(gap == 0, 0.08).when(gap == 1, 0.03).otherwise(0.0)


def fresh(ranked: DataFrame, used: DataFrame, least: int = 3) -> DataFrame:
    """``ranked`` (query_id, text, ...) without texts used recently (query_id, used_key), unless fewer than ``least`` rows of the query stay."""
    key = F.trim(F.substring("text", 1, 80))
    left = ranked.withColumn("used_key", key).join(used.select("query_id", "used_key").distinct().withColumn("seen", F.lit(True)), ["query_id", "used_key"], "left")
    left = left.withColumn("free", F.count(F.when(F.col("seen").isNull(), 1)).over(W.partitionBy("query_id")))
    return left.where(F.col("seen").isNull() | (F.col("free") < least)).drop("used_key", "seen", "free")


def diverse(ranked: DataFrame, order: list[Column]) -> DataFrame:
    """The best row of each query and subtopic; without a known subtopic, of each beginning of the text."""
    group = F.when(t.known(F.col("subtopic")), F.concat(F.lit("s:"), "subtopic")).otherwise(F.concat(F.lit("t:"), F.trim(F.substring("text", 1, 60))))
    w = W.partitionBy("query_id", "__group").orderBy(*order)
    return ranked.withColumn("__group", group).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__group", "__n")


def query_variants(topics: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """query_id, variant, query: six forms of each topic, one for each concept (query_id, concept, ord), four for each
    further topic in ``extra`` (query_id, concept or more, ord)."""
    base = topics.select("query_id", F.posexplode(F.array(*[F.concat("topic", F.lit(v)) for v in VARIANTS])).alias("variant", "query"))
    if extra is None:
        return base
    concepts = extra.where("concept is not null").join(topics, "query_id").select("query_id", (F.lit(100) + F.col("ord")).alias("variant"), F.concat_ws(" ", "topic", "concept").alias("query"))
    more = extra.where("more is not null").select("query_id", F.col("ord"), F.posexplode(F.array(*[F.concat("more", F.lit(v)) for v in EXPANDED])).alias("i", "query"))
    return base.unionByName(concepts).unionByName(more.select("query_id", (F.lit(200) + 10 * F.col("ord") + F.col("i")).alias("variant"), "query"))


def topic_keys(topics: DataFrame) -> DataFrame:
    """query_id, ord, key: the topic in lower case, its pairs of words, its words."""

    def keys(words: Column) -> Column:
        pairs = F.when(F.size(words) >= 2, F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array(F.array_join(words, " ")), pairs, words)

    split = F.split(F.lower("topic"), "[ /]+")
    return topics.select("query_id", F.posexplode(F.get(F.transform(F.array(split), keys), F.lit(0))).alias("ord", "key"))


def graph_concepts(topics: DataFrame, edges: DataFrame, top: int = 2) -> DataFrame:
    """query_id, concept, ord: best-connected neighbours of the first of a topic's keys that the graph has."""
    keys = topic_keys(topics)
    nodes = edges.select(F.col("c1").alias("key")).distinct()
    hit = keys.join(nodes, "key").groupBy("query_id").agg(F.min_by("key", "ord").alias("c1"))
    degree = edges.groupBy("c1").agg(F.count("*").alias("degree")).withColumnRenamed("c1", "c2")
    near = hit.join(edges, "c1").join(degree, "c2", "left")
    w = W.partitionBy("query_id").orderBy(F.desc(F.coalesce("degree", F.lit(0))), "c2")
    return near.select("query_id", F.col("c2").alias("concept"), (F.row_number().over(w) - 1).alias("ord")).where(F.col("ord") < top)


def expanded_topics(topics: DataFrame, counts: DataFrame, prereqs: DataFrame, least: int = 5) -> DataFrame:
    """query_id, topic, ord: the topic itself, and the last of its prerequisites if it has fewer than ``least`` chunks."""
    last = prereqs.groupBy("topic").agg(F.max_by("prereq", "ord").alias("more"))
    j = topics.join(counts.select("topic", "chunks"), "topic", "left").join(last, "topic", "left")
    added = j.where((F.coalesce("chunks", F.lit(0)) < least) & F.col("more").isNotNull())
    return topics.select("query_id", "topic", F.lit(0).alias("ord")).unionByName(added.select("query_id", F.col("more").alias("topic"), F.lit(1).alias("ord")))


def overlap(a: Column, b: Column) -> Column:
    """Share of the different words of ``a`` that ``b`` holds."""
    words = F.array_distinct(a)
    return F.when(F.size(words) > 0, F.size(F.array_intersect(words, b)) / F.size(words)).otherwise(0.0)


def rerank(rows: DataFrame, score: Column, k: int, order: list[Column]) -> DataFrame:
    """Second stage: k best rows of each query by ``score``; a query of k rows or fewer passes as it is."""
    n = F.count("*").over(W.partitionBy("query_id"))
    w = W.partitionBy("query_id").orderBy(F.desc("rerank_score"), *order)
    return rows.withColumn("n", n).withColumn("rerank_score", F.when(F.col("n") > k, score).otherwise(0.0)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).drop("n")


def recall_and_rank(results: DataFrame, k: int = 5) -> DataFrame:
    """query_id, recall, reciprocal_rank of results (query_id, rank from 1, text, keyword)."""
    hit = F.contains(F.lower("text"), F.lower("keyword"))
    return results.groupBy("query_id").agg(
        F.max(F.when((F.col("rank") <= k) & hit, 1.0).otherwise(0.0)).alias("recall"), F.coalesce(F.max(F.when(hit, 1.0 / F.col("rank"))), F.lit(0.0)).alias("reciprocal_rank")
    )


def hybrid(chunks: DataFrame, queries: DataFrame, prereqs: DataFrame, used: DataFrame, k: int = 5, concepts: DataFrame | None = None, encode: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """Retrieval for a table of queries (query_id, topic, difficulty) over chunks (doc_id, text and tags).

    Topics are expanded; the vector of each variant is searched within them, or among all chunks if nothing is there (a
    block of them in one pass, more in a vector index); results
    are deduplicated by their beginning, fused with BM25 of the topics, boosted by tags, freed of recent texts and made
    diverse. Vectors are those of ``encode`` or, without a model, hashed TF-IDF.
    """
    counts = chunks.groupBy("topic").agg(F.count("*").alias("chunks"))
    topics = queries.select("query_id", "topic")
    wide = expanded_topics(topics, counts, prereqs)
    allowed = wide.select("query_id", F.col("topic").alias("allowed")).distinct()
    extra = wide.where("ord > 0").select("query_id", F.lit(None).cast("string").alias("concept"), F.col("topic").alias("more"), "ord")
    if concepts is not None:
        extra = extra.unionByName(concepts.select("query_id", "concept", F.lit(None).cast("string").alias("more"), "ord"))
    variants = kept(query_variants(topics, extra).withColumn("query", F.translate("query", "/", " ")), "variants")
    tagged = chunks.withColumn("body", F.concat_ws(" ", F.translate("topic", "/", " "), F.translate("subtopic", "/", " "), "concept_type", "difficulty", "text"))
    body = tagged.select("doc_id", F.col("body").alias("text"))
    # chunks and variants are embedded together, so that both have the same word weights
    asked = variants.select(F.concat(F.lit("q"), F.concat_ws("#", "query_id", "variant")).alias("doc_id"), F.col("query").alias("text"), "query_id", "variant")
    embedded = kept(embedder(body.select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("doc_id"), "text").unionByName(asked.select("doc_id", "text")), encode, WIDTH), "embedded")
    of_query = embedded.where("doc_id like 'q%'").join(asked.drop("text"), "doc_id").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("query_vec"), F.col("query_id").alias("base"), "variant")
    every = embedded.where("doc_id like 'c%'").select(F.substring("doc_id", 2, 20).cast("long").alias("doc_id"), "embedding")
    of_chunk = every.join(chunks.select("doc_id", "topic", "subtopic"), "doc_id")
    best = [F.desc(F.round("score", 9)), F.asc("doc_id")]
    inside = kept(top_per_query(within_topics(of_chunk, of_query, allowed), k, best).select("query_id", "base", "variant", "doc_id", "score", "rank"), "inside")
    # queries that find nothing in their topics search everything: to make an index takes more than a block's products
    left = kept(of_query.join(inside.select("query_id").distinct(), "query_id", "left_anti"), "left")
    found = inside
    if n := left.count():
        if n <= BLOCK:
            scored = best_similarities(every, left.select("query_id", "query_vec"), k, "doc_id").where("score is not null")
            anywhere = top_per_query(scored, k, best).join(left.drop("query_vec"), "query_id")
        else:
            from .vector_index import build_index

            anywhere = build_index(every, key="doc_id", k=k).search(left, k)
        found = inside.unionByName(kept(anywhere.select(*inside.columns), "anywhere"))
    # what was found is small beside the chunks, whose texts stay where they are
    listed = chunks.join(small(found.select(F.col("base").alias("query_id"), "variant", "rank", "doc_id", F.col("score").alias("similarity"))), "doc_id")
    unique = listed.withColumn("n", F.row_number().over(W.partitionBy("query_id", F.substring("text", 1, 100)).orderBy("variant", "rank"))).where("n = 1")
    semantic = kept(unique.select("query_id", F.col("doc_id").alias("key"), (F.row_number().over(W.partitionBy("query_id").orderBy("variant", "rank")) - 1).alias("rank"), "similarity"), "semantic")
    words = wide.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("topic")), " ").alias("ts")).select("query_id", F.concat(F.translate("ts", "/", " "), F.lit(" concepts usage working")).alias("query"))
    from .word_scores import BLOCK as WORDS_BLOCK
    from .word_scores import best_bm25

    if words.count() <= WORDS_BLOCK:
        lexical = best_bm25(body, words, 3 * k)
    else:
        from .keyword_index import build_keyword_index

        lexical = top_per_query(build_keyword_index(body).bm25(words), 3 * k, best)
    fused = fuse(semantic, lexical.select("query_id", F.col("doc_id").alias("key"), "rank")).join(semantic.select("query_id", "key", "similarity"), ["query_id", "key"], "left")
    fused = chunks.join(small(kept(fused, "fused")), F.col("key") == F.col("doc_id")).join(small(queries.select("query_id", F.col("difficulty").alias("want"))), "query_id")
    bonus = concept_bonus(F.col("concept_type")) + difficulty_bonus(F.col("difficulty"), F.col("want"))
    boosted = fused.withColumn("score", F.coalesce("similarity", F.lit(0.0)) + F.col("fused") + bonus)
    chosen = top_per_query(diverse(fresh(boosted, used), best), k, best, start=1)
    return chosen.select("query_id", "rank", "doc_id", "topic", "subtopic", "difficulty", "concept_type", F.round("score", 4).alias("score"), "text")
