"""Streams under disorder, lateness, replays and repeated runs, beside the queries that compare them with SQL."""

from __future__ import annotations

import datetime as dt

import pytest
from lectern.plans.q_streams import stateful
from lectern.sources.workspace import workspace
from lectern.streaming import live, upserts
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event(i, minute, user=1):
    return (i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute), user, "t", 5.0, '{"k":1}')


def deliver(spark, path, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(path)


def test_rest_of_a_session_comes_when_the_watermark_passes_the_silence(spark):
    path, out = workspace(spark, "events"), workspace(spark, "out")
    seen = []
    with stateful(spark):
        for rows in (
            [event(i, i) for i in range(20, 43)],  # 23 answers, of which the first 20 come later
            [event(i, i) for i in range(20)] + [event(100, 95)],  # in time: the watermark is at minute 12 at most
            [event(200, 500, user=2), event(201, 5)],  # 201 is later than the watermark
            [event(300, 900, user=3)],
        ):
            deliver(spark, path, rows)
            live.append_files(live.session_batches(live.attempts_stream(spark, path), 1800, "60 minutes"), out, f"{out}-c").awaitTermination()
            seen.append(sorted((r["student"], r["batch"], r["answers"]) for r in spark.read.parquet(out).collect()))
    assert seen[0] == [] and seen[1] == [(1, 0, 20)]  # all up to minute 35 are ordered, the rest may still change
    assert seen[2] == seen[3] == [(1, 0, 20), (1, 1, 20), (1, 2, 3)]  # one answer alone (100, 200) gives no row


def test_repeats_are_forgotten_with_the_watermark(spark):
    path, out = workspace(spark, "events"), workspace(spark, "out")
    for day in range(4):
        rows = [event(1000 * day + i, 1440 * day + i) for i in range(300)]
        deliver(spark, path, rows + rows[-50:] + ([event(7, 7)] if day else []))  # repeats, and one that is too late
        live.append_files(live.once_each(live.attempts_stream(spark, path), "1 hour").select("event_id"), out, f"{out}-c").awaitTermination()
    got = [r[0] for r in spark.read.parquet(out).collect()]
    assert sorted(got) == [1000 * d + i for d in range(4) for i in range(300)]
    assert spark.read.format("statestore").load(f"{out}-c").count() <= 125  # two hours of 1,200 events


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert_touches_only_the_buckets_of_its_keys(spark):
    target = workspace(spark, "upsert")
    docs = spark.range(200).select("id", F.lit("a").alias("v"), F.col("id").alias("__new_too"))
    upserts.apply_batch(docs, 0, "id", target, 8)
    before = upserts._folders(spark, target)[2]
    one = docs.where("id = 5").withColumn("v", F.lit("b"))
    upserts.apply_batch(one.unionByName(one.withColumn("v", F.lit("c"))), 1, "id", target, 8, order="v")
    after = upserts._folders(spark, target)[2]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    want = docs.withColumn("v", F.when(F.col("id") == 5, "c").otherwise("a"))
    assert rows_of(upserts.read_version(spark, target, docs.schema)) == rows_of(want)
    upserts.apply_batch(one, 1, "id", target, 8)  # a replay of the epoch
    upserts.apply_batch(one.where("false"), 2, "id", target, 8)
    assert rows_of(upserts.read_version(spark, target, docs.schema)) == rows_of(want)
    assert rows_of(upserts.read_version(spark, target, docs.schema, 0)) == rows_of(docs)
    assert rows_of(upserts.versions(spark, target)) == [(0, 0, 8), (1, 1, 8)]
    assert upserts.remove_unused(spark, target, keep=2) == 0 and upserts.remove_unused(spark, target) == 1
    assert rows_of(upserts.read_version(spark, target, docs.schema)) == rows_of(want)


def test_upsert_of_nothing_and_of_null_keys(spark):
    target = workspace(spark, "upsert")
    schema = "id long, v string"
    assert upserts.read_version(spark, target, spark.createDataFrame([], schema).schema).count() == 0
    upserts.apply_batch(spark.createDataFrame([(None, "a"), (1, None)], schema), 0, "id", target)
    upserts.apply_batch(spark.createDataFrame([(None, "b"), (None, None)], schema), 1, "id", target)
    got = upserts.read_version(spark, target, spark.createDataFrame([], schema).schema)
    assert sorted(map(str, got.collect())) == ["Row(id=1, v=None)", "Row(id=None, v='b')"]


def test_a_batch_that_failed_before_its_commit_leaves_the_table_as_it_was(spark, monkeypatch):
    target = workspace(spark, "upsert")
    docs = spark.range(10).select("id", F.lit("a").alias("v"))
    upserts.apply_batch(docs, 0, "id", target, 2)
    with monkeypatch.context() as m:
        m.setattr(type(spark), "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            upserts.apply_batch(docs.withColumn("v", F.lit("b")), 1, "id", target, 2)
    assert rows_of(upserts.read_version(spark, target, docs.schema)) == rows_of(docs)
    upserts.apply_batch(docs.withColumn("v", F.lit("b")), 1, "id", target, 2)
    assert {r["v"] for r in upserts.read_version(spark, target, docs.schema).collect()} == {"b"}


def test_state_is_kept_by_bucket_and_right_for_every_key(spark):
    """Calls to the state store grow with the buckets, not with the students; nulls stay values of their own."""
    path, live_out, full_out = (workspace(spark, n) for n in ("events", "live", "full"))
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i * 37 % 500), None if i % 41 == 0 else i % 40, "t", None if i % 29 == 0 else i % 9 + 0.5, None if i % 7 == 0 else f'{{"k":{i % 8}}}') for i in range(900)]
    with stateful(spark):
        for part in (rows[:500], rows[500:]):
            deliver(spark, path, part)
            live.append_files(live.live_state(live.attempts_stream(spark, path), buckets=3), live_out, f"{live_out}-c").awaitTermination()
            live.append_files(live.answer_batches(live.attempts_stream(spark, path).where("score is not null"), buckets=3), full_out, f"{full_out}-c").awaitTermination()
        for out in (live_out, full_out):
            assert spark.read.format("statestore").option("stateVarName", "held").load(f"{out}-c").count() <= 3
        left = {(r["student"], r["batch"]): r["answers"] for r in live.left_over(spark, f"{full_out}-c").collect()}
    got = {r["student"]: r for r in spark.read.parquet(live_out).orderBy("attempts").collect()}  # the last row of each student
    full = {(r["student"], r["batch"]): r["answers"] for r in spark.read.parquet(full_out).collect()}
    by: dict = {}
    for i, at, user, _, value, props in rows:
        scale = 60.0 if user is None else (10.0, 30.0, 60.0)[user % 3]
        k = None if props is None else int(props[5:-1])
        by.setdefault(user, []).append((at, i, 1.0 if value is None else min(value / scale, 1.0), k))
    assert set(got) == set(by)
    for user, answers in by.items():
        r, scores = got[user], [x[2] for x in answers if x[2] is not None]
        ks = [x[3] for x in answers if x[3] is not None]
        assert r["attempts"] == len(answers) and r["mean"] == pytest.approx(sum(scores) / len(scores))
        assert (r["top_d"], r["top_q"]) == ((max(k % 3 for k in ks), max(k // 3 % 3 for k in ks)) if ks else (None, None))
        last = [(j, x[2]) for j, x in enumerate(sorted(answers, key=lambda x: x[:2])[-10:]) if x[2] is not None]
        mx, my = sum(j for j, _ in last) / len(last), sum(y for _, y in last) / len(last)
        want = sum((j - mx) * (y - my) for j, y in last) / sum((j - mx) ** 2 for j, _ in last)
        assert r["trend"] == pytest.approx(max(-1.0, min(1.0, want)))
        assert sum(n for (u, _), n in {**full, **left}.items() if u == user) == len(scores) - (1 if len(scores) % 20 == 1 else 0)
