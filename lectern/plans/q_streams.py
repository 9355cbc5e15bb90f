"""Queries of sources, sinks, hooks and streams."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hooks
from ..registry import query, rounded
from ..sources import files
from ..sources.workspace import workspace
from ..streaming import live, upserts
from .views import attempts, courses, table


@contextlib.contextmanager
def stateful(spark: SparkSession):
    """The state store that stateful processors need, while a query runs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, live.STATE_STORE)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def _event_files(spark: SparkSession, d: str) -> str:
    """The events as files, as a stream would bring them."""
    path = workspace(spark, "events")
    table(spark, d, "events").repartitionByRange("ts").write.parquet(path)
    return path


def _deliveries(spark: SparkSession, d: str, path: str, n: int = 3):
    """Append the events to a folder in ``n`` deliveries, one after the other in order of time."""
    events = table(spark, d, "events").withColumn("__at", F.unix_micros(F.col("ts").cast("timestamp")))
    cuts = [float("-inf"), *events.approxQuantile("__at", [i / n for i in range(1, n)], 0.01), float("inf")]
    for lo, hi in zip(cuts, cuts[1:]):
        events.where((F.col("__at") > lo) & (F.col("__at") <= hi)).drop("__at").write.mode("append").parquet(path)
        yield


#: Deliveries of the streams in disorder: how many, and the rows of the first third that come after all others.
DELIVERIES, LATE = 3, 97
LATE_SQL = f"""bounds AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events),
timely AS (SELECT *, least(value / CASE user_id % 3 WHEN 0 THEN 10.0 WHEN 1 THEN 30.0 ELSE 60.0 END::DOUBLE, 1.0::DOUBLE) AS score FROM events, bounds
WHERE NOT (event_id % {LATE} = 0 AND epoch_us(ts) < lo + (hi - lo) // {DELIVERIES}))"""


def _disordered(spark: SparkSession, d: str, path: str, again: bool = False):
    """Append the events to a folder: ``DELIVERIES`` by time, where each tenth event comes up to 12 hours late, then one
    of rows later than any watermark and a row of student -1 far ahead, which moves the watermark past all others.
    ``again`` sends each twentieth event twice within 12 hours, and the events of the first third at the end."""
    events, n = table(spark, d, "events"), DELIVERIES
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    lo, hi = events.agg(F.min(at), F.max(at)).first()
    half_day, span = 12 * 3600 * 1_000_000, hi - lo + 1
    early = at < lo + (hi - lo) // n
    late = early & (F.col("event_id") % LATE == 0)
    part = lambda shift: F.least(F.floor((at + shift - lo) * n / span), F.lit(n - 1))
    rows = [events.withColumn("__part", F.when(late, n).otherwise(part(F.when(F.col("event_id") % 10 == 0, half_day).otherwise(0))))]
    if again:
        rows += [events.where((F.col("event_id") % 20 == 0) & ~late).withColumn("__part", part(F.lit(half_day))), events.where(early).withColumn("__part", F.lit(n))]
    ahead = events.orderBy(F.desc("ts"), "event_id").limit(1).withColumn("ts", F.expr("ts + interval 60 days")).withColumn("user_id", F.lit(-1).cast("bigint"))
    rows.append(ahead.withColumn("event_id", F.lit(-1).cast("bigint")).withColumn("__part", F.lit(n)))
    for i in range(n + 1):
        for r in rows:
            r.where(F.col("__part") == i).drop("__part").write.mode("append").parquet(path)
        yield i


def _drained(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """All that a stream gives, written as it comes with the number of its micro-batch."""
    spark = stream.sparkSession
    out = workspace(spark, name)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(out)

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", workspace(spark, name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


@query("s1_file_scan")
def s1(s: SparkSession, d: str) -> DataFrame:
    path = workspace(s, "text")
    table(s, d, "documents").select("text", "source").write.partitionBy("source").text(path)
    return files.scan_files(s, path, ("txt",)).groupBy("extension").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


@query("s4_section_contract", """WITH x AS (SELECT fmt, text, CASE WHEN doc_id % 10 = 0 THEN 'malformed' WHEN doc_id % 10 = 1 THEN 'no file path' WHEN doc_id % 10 = 2 THEN 'no text' WHEN doc_id % 10 = 3 THEN 'bad page number' ELSE 'section' END AS kind FROM documents, (VALUES ('json'), ('parquet')) f(fmt))
SELECT fmt, kind, count(*) AS records, CASE WHEN kind = 'section' THEN sum(length(text)) END::BIGINT AS chars FROM x GROUP BY fmt, kind""")
def s4_contract(s: SparkSession, d: str) -> DataFrame:
    k, found = F.col("doc_id") % 10, []
    rows = table(s, d, "documents").select(
        F.when(k == 1, " ").otherwise(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))).alias("file_path"), F.col("source").alias("file_name"),
        F.when(k == 0, "two").when(k == 3, "-1").otherwise(k.cast("string")).alias("page_number"), F.col("lang").alias("section"), F.when(k != 2, F.col("text")).alias("text"), "doc_id",
    )
    for fmt in ("json", "parquet"):
        path, bad = workspace(s, fmt), workspace(s, "quarantine")
        if fmt == "json":  # lines of malformed records are cut as well
            line = F.to_json(F.struct("*"))
            rows.select(F.when(k == 0, F.substring(line, 1, 40)).otherwise(line).alias("value")).write.text(path)
        else:
            rows.write.parquet(path)
        good = files.section_table(s, path, fmt, bad).agg(F.count("*").alias("records"), F.sum(F.length("text")).alias("chars")).withColumn("kind", F.lit("section"))
        rest = s.read.parquet(bad).groupBy(F.col("reason").alias("kind")).agg(F.count("*").alias("records"))
        found.append(good.unionByName(rest, allowMissingColumns=True).withColumn("fmt", F.lit(fmt)))
    return found[0].unionByName(found[1]).select("fmt", "kind", "records", "chars")


@query("s7_csv_scan", "SELECT page_id, url FROM pages")
def s7(s: SparkSession, d: str) -> DataFrame:
    path = workspace(s, "csv")
    files.write_csv(courses(s, d).select("page_id", "url"), path)
    return files.read_csv(s, path, "page_id bigint, url string")


@query("s11_csv_sink", "SELECT user_id AS student, count(*) AS answers FROM events GROUP BY user_id")
def s11(s: SparkSession, d: str) -> DataFrame:
    path = workspace(s, "csv")
    files.write_csv(attempts(s, d).select("student", "topic", "step", "score", "d", "q"), path)
    return files.read_csv(s, path, files.ATTEMPTS).groupBy("student").agg(F.count("*").alias("answers"))


@query("s12_json_sink", "SELECT event_type AS topic, count(*) AS answers FROM events GROUP BY event_type")
def s12(s: SparkSession, d: str) -> DataFrame:
    path = workspace(s, "json")
    files.write_json(attempts(s, d).groupBy("topic").agg(F.count("*").alias("answers")), path)
    return s.read.schema("topic string, answers bigint").json(path)


@query("h1_embedder")
def h1(s: SparkSession, d: str) -> DataFrame:
    e = hooks.embedder(table(s, d, "documents"))
    return e.select("doc_id", F.size("embedding").alias("width"), rounded(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), 4).alias("norm"))


@query("h2_tagger")
def h2(s: SparkSession, d: str) -> DataFrame:
    return hooks.tagger(table(s, d, "documents"))


@query("h3_scorer", """WITH x AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations), w AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r]+'), lambda w: w <> '')) AS a,
list_filter(regexp_split_to_array(lower(b), '[ \\t\\n\\r]+'), lambda w: w <> '') AS b FROM x WHERE b IS NOT NULL) SELECT conv_id, turn, round(CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a)::DOUBLE ELSE 0 END, 6) AS score FROM w""")
def h3(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    x = table(s, d, "conversations").withColumn("b", F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))).where("b is not null").withColumnRenamed("text", "a")
    return hooks.scorer(x).select("conv_id", "turn", rounded("score", 6).alias("score"))


STATE_SQL = """WITH a AS (SELECT user_id AS student, event_type AS topic, ts, event_id, least(value / CASE user_id % 3 WHEN 0 THEN 10.0 WHEN 1 THEN 30.0 ELSE 60.0 END::DOUBLE, 1.0::DOUBLE) AS score, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY student, topic ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY student, topic) AS n FROM a)
SELECT student, topic, max(n) AS attempts, round(avg(score), 6) AS mean, round(CASE WHEN max(n) >= 2 THEN greatest(-1.0, least(1.0, regr_slope(score, i) FILTER (i > n - 10))) ELSE 0.0 END, 6) AS trend, max(k % 3) AS top_d, max((k // 3) % 3) AS top_q FROM r GROUP BY ALL"""


@query("st1_live_state", STATE_SQL)
def st1(s: SparkSession, d: str) -> DataFrame:
    with stateful(s):
        out = workspace(s, "live")
        live.append_files(live.live_state(live.attempts_stream(s, _event_files(s, d), 3)), out, f"{out}-checkpoint").awaitTermination()
    rows = s.read.parquet(out)
    last = rows.groupBy("student", "topic").agg(F.max_by(F.struct("attempts", "mean", "trend", "top_d", "top_q"), "attempts").alias("r")).select("student", "topic", "r.*")
    return last.select("student", "topic", "attempts", rounded("mean", 6).alias("mean"), rounded("trend", 6).alias("trend"), "top_d", "top_q")


@query("st2_answer_batches", """WITH a AS (SELECT user_id AS student, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, least(value / CASE user_id % 3 WHEN 0 THEN 10.0 WHEN 1 THEN 30.0 ELSE 60.0 END::DOUBLE, 1.0::DOUBLE) AS score FROM events)
SELECT student, (step - 1) // 20 AS batch, count(*) AS answers, round(avg(score), 6) AS mean_score FROM a GROUP BY ALL HAVING count(*) >= 2""")
def st2(s: SparkSession, d: str) -> DataFrame:
    path, out = workspace(s, "events"), workspace(s, "batches")
    with stateful(s):
        for _ in _deliveries(s, d, path):
            live.append_files(live.answer_batches(live.attempts_stream(s, path)), out, f"{out}-checkpoint").awaitTermination()
        left = workspace(s, "left-over")
        live.left_over(s, f"{out}-checkpoint").write.parquet(left)  # while the state store that wrote it is set
    return s.read.parquet(out).select("student", "batch", "answers", "mean_score").unionByName(s.read.parquet(left)).select("student", "batch", "answers", rounded("mean_score", 6).alias("mean_score"))


@query("st3_session_reports", """WITH a AS (SELECT user_id AS student, ts, event_id, least(value / CASE user_id % 3 WHEN 0 THEN 10.0 WHEN 1 THEN 30.0 ELSE 60.0 END::DOUBLE, 1.0::DOUBLE) AS score FROM events),
b AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS brk FROM a WINDOW w AS (PARTITION BY student ORDER BY ts, event_id)), g AS (SELECT *, sum(brk) OVER (PARTITION BY student ORDER BY ts, event_id) AS g FROM b)
SELECT student, count(*) AS answers, round(avg(score), 6) AS mean_score, floor(epoch(min(ts)))::BIGINT AS start_s FROM g GROUP BY student, g.g""")
def st3(s: SparkSession, d: str) -> DataFrame:
    a = attempts(s, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return live.session_reports(a).select("student", "answers", rounded("mean_score", 6).alias("mean_score"), F.unix_timestamp("start").alias("start_s"))


@query("st3_session_stream", f"""WITH {LATE_SQL}, b AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS brk FROM timely WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM b)
SELECT user_id AS student, count(*) AS answers, round(avg(score), 6) AS mean_score, floor(epoch(min(ts)))::BIGINT AS start_s FROM g GROUP BY user_id, g.g""")
def st3_stream(s: SparkSession, d: str) -> DataFrame:
    path, out = workspace(s, "events"), workspace(s, "sessions")
    for _ in _disordered(s, d, path):
        live.append_files(live.session_reports(live.attempts_stream(s, path), late="1 day"), out, f"{out}-checkpoint").awaitTermination()
    return s.read.parquet(out).select("student", "answers", rounded("mean_score", 6).alias("mean_score"), F.unix_timestamp("start").alias("start_s"))


@query("st2_session_batches", f"""WITH {LATE_SQL}, b AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 36 * 3600000000 THEN 0 ELSE 1 END AS brk FROM timely WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM b), r AS (SELECT *, row_number() OVER w AS step, min(epoch_us(ts)) OVER w AS start_us FROM g WINDOW w AS (PARTITION BY user_id, g ORDER BY ts, event_id))
SELECT user_id AS student, start_us, (step - 1) // 20 AS batch, count(*) AS answers, round(avg(score), 6) AS mean_score FROM r GROUP BY ALL HAVING count(*) >= 2""")
def st2_sessions(s: SparkSession, d: str) -> DataFrame:
    path, out = workspace(s, "events"), workspace(s, "batches")
    with stateful(s):
        for _ in _disordered(s, d, path):
            live.append_files(live.session_batches(live.attempts_stream(s, path), 36 * 3600, "1 day"), out, f"{out}-checkpoint").awaitTermination()
    return s.read.parquet(out).select("student", "start_us", "batch", "answers", rounded("mean_score", 6).alias("mean_score"))


@query("st4_answered_once", "SELECT event_id, user_id AS student FROM events")
def st4(s: SparkSession, d: str) -> DataFrame:
    path = _event_files(s, d)
    table(s, d, "events").write.mode("append").parquet(path)  # every event a second time
    return _drained(live.once_each(live.attempts_stream(s, path), "36500 days"), "append", "once").select("event_id", "student")


@query("st4_late_repeats", f"WITH {LATE_SQL} SELECT event_id, user_id AS student FROM timely")
def st4_late(s: SparkSession, d: str) -> DataFrame:
    path, out = workspace(s, "events"), workspace(s, "once")
    for _ in _disordered(s, d, path, again=True):
        once = live.once_each(live.attempts_stream(s, path), "1 day").select("event_id", "student")
        live.append_files(once, out, f"{out}-checkpoint").awaitTermination()
    return s.read.parquet(out).where("event_id >= 0")


@query("st5_incremental_upsert", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'seen' ELSE lang END AS lang FROM documents")
def st5(s: SparkSession, d: str) -> DataFrame:
    path, target = workspace(s, "docs"), workspace(s, "upsert")
    docs = table(s, d, "documents").select("doc_id", "lang")
    marked = lambda n, word: docs.where(F.col("doc_id") % n == 0).withColumn("lang", F.lit(word))
    for rows in (docs, marked(6, "once"), marked(3, "seen")):  # three deliveries
        rows.write.mode("append").parquet(path)
        stream = s.readStream.schema("doc_id bigint, lang string").parquet(path)
        upserts.upsert_stream(stream, "doc_id", target, f"{target}-checkpoint").awaitTermination()
    return upserts.read_version(s, target, docs.schema)


@query("st6_append_sink", "SELECT event_id, user_id AS student FROM events")
def st6(s: SparkSession, d: str) -> DataFrame:
    out = workspace(s, "appended")
    live.append_files(live.attempts_stream(s, _event_files(s, d)).select("event_id", "student"), out, f"{out}-checkpoint").awaitTermination()
    return s.read.parquet(out)
