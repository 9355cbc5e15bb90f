"""Structured Streaming over attempts: live knowledge state, batches of answers, session reports, upserts."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# the processors go to the workers as they are, so these need no copy of the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LIVE = "student long, topic string, attempts long, mean double, trend double, top_d long, top_q long"
BATCHES = "student long, batch long, answers long, mean_score double"
SESSION_BATCHES = "student long, start_us long, batch long, answers long, mean_score double"
SESSION_COLUMNS = ["student", "start_us", "batch", "answers", "mean_score"]


def attempts_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """Attempts read from a folder of event files; event time is a timestamp, as watermarks need."""
    reader = spark.readStream.schema(EVENTS).option("pathGlobFilter", "*.parquet")
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    k = F.get_json_object("props", "$.k").cast("int")
    scale = F.when(F.col("user_id") % 3 == 0, 10.0).when(F.col("user_id") % 3 == 1, 30.0).otherwise(60.0)
    return reader.parquet(path).select(
        F.col("user_id").alias("student"), F.col("event_type").alias("topic"), "event_id", F.col("ts").cast("timestamp").alias("ts"),
        F.least(F.col("value") / scale, F.lit(1.0)).alias("score"), (k % 3).cast("long").alias("d"), (F.floor(k / 3) % 3).cast("long").alias("q"),
    )


#: Buckets of keys. The state of a bucket is one value, taken and put once a micro-batch, so the calls to the state store
#: do not grow with the students.
KEY_BUCKETS = 256


def _by_bucket(attempts: DataFrame, *keys: str, buckets: int = KEY_BUCKETS):
    return attempts.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets))).groupBy("bucket")


def _packed(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows, preserve_index=False).replace_schema_metadata()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(state: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(state).read_all().to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)


class Bucketed(StatefulProcessor):
    """Keeps the named tables of a bucket of keys as Arrow bytes."""

    TABLES: tuple[tuple[str, list[str]], ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", T.StructType([T.StructField(n, T.BinaryType()) for n, _ in self.TABLES]))

    def tables(self) -> list[pd.DataFrame | None]:
        held = self.held.get()
        return [_unpacked(bytes(v)) for v in held] if held is not None else [None] * len(self.TABLES)

    def put(self, *tables: pd.DataFrame) -> None:
        self.held.update(tuple(_packed(t[names]) for t, (_, names) in zip(tables, self.TABLES)))

    def rows(self, parts: Iterator[pd.DataFrame], unit: str) -> pd.DataFrame:
        """The rows that came, with ``at`` as a number."""
        rows = pd.concat(list(parts), ignore_index=True)
        rows["at"] = rows["ts"].astype(f"datetime64[{unit}]").astype("int64")
        for c in ("student", "event_id", "d", "q"):
            rows[c] = rows[c].astype("Int64")
        return rows

    def wake_at(self, ms: int | None) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
        if ms is not None:
            self.handle.registerTimer(int(ms))

    def close(self) -> None:
        pass


def _with(old: pd.DataFrame | None, new: pd.DataFrame) -> pd.DataFrame:
    return new if old is None or not len(old) else pd.concat([old, new], ignore_index=True) if len(new) else old


def _codes(*columns: pd.Series) -> np.ndarray:
    """Numbers of the combinations of values from 0, in order of appearance; null is a value."""
    out = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        of, found = pd.factorize(c, use_na_sentinel=False)
        out = pd.factorize(out * (len(found) + 1) + of)[0]
    return out


def slopes(of: np.ndarray, score: np.ndarray, groups: int) -> np.ndarray:
    """Least-squares slope of each group's scores, in their order, over their places, within -1..1; 0 for fewer than two.
    Scores that are null leave their place empty."""
    place = np.arange(len(of)) - np.searchsorted(of, of)
    there = ~np.isnan(score)
    of, x, y = of[there], place[there].astype(float), score[there]
    n = np.maximum(np.bincount(of, minlength=groups), 1)
    x -= (np.bincount(of, x, groups) / n)[of]
    y = y - (np.bincount(of, y, groups) / n)[of]
    xx = np.bincount(of, x * x, groups)
    return np.clip(np.where(xx > 0, np.bincount(of, x * y, groups) / np.where(xx > 0, xx, 1.0), 0.0), -1.0, 1.0)


def slope(scores: list[float]) -> float:
    """``slopes`` of one group."""
    return float(slopes(np.zeros(len(scores), np.int64), np.array(scores, float), 1)[0])


class KnowledgeState(Bucketed):
    """Per student and topic: attempts, sum of scores, highest levels, and the last ten scores by event time."""

    LAST = 10
    TABLES = (("totals", ["student", "topic", "n", "scored", "total", "d", "q"]), ("recent", ["student", "topic", "at", "event_id", "score"]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001
        new = self.rows(rows, "ns")
        totals, recent = self.tables()
        each = new[["student", "topic", "d", "q"]].assign(n=1, scored=new["score"].notna().astype("int64"), total=new["score"].fillna(0.0))
        each = _with(totals, each)
        code = _codes(each["student"], each["topic"])
        came = np.zeros(code.max() + 1, bool)
        came[code[len(each) - len(new) :]] = True
        by = each.groupby(code)
        sums = by[["n", "scored", "total"]].sum().join(by[["d", "q"]].max())
        firsts = each.loc[np.unique(code, return_index=True)[1], ["student", "topic"]].reset_index(drop=True)
        totals = pd.concat([firsts, sums.reset_index(drop=True)], axis=1)

        last = _with(recent, new[["student", "topic", "at", "event_id", "score"]])
        # keys have the same numbers as above: those held come first there, and new ones in the order of the rows
        names = pd.concat([totals[["student", "topic"]], last[["student", "topic"]]], ignore_index=True)
        last["code"] = _codes(names["student"], names["topic"])[len(totals) :]
        # in whatever order they come, the last ten by event time are kept
        last = last.sort_values(["code", "at", "event_id", "score"], ignore_index=True)
        last = last[last.groupby("code").cumcount(ascending=False) < self.LAST]
        self.put(totals, last)
        trend = slopes(last["code"].to_numpy(), last["score"].to_numpy(np.float64, na_value=np.nan), len(totals))
        mean = totals["total"].astype("float64") / totals["scored"].astype("float64").where(totals["scored"] > 0)
        out = pd.DataFrame({"student": totals["student"], "topic": totals["topic"], "attempts": totals["n"], "mean": mean, "trend": trend, "top_d": totals["d"], "top_q": totals["q"]})
        yield out[came]


def _cut(n: np.ndarray, total: np.ndarray, of: np.ndarray, score: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Cut the scores of each group (``of``, ascending) to batches of ``size``, where ``n`` and ``total`` of the group stand
    in its first one already. Returns the batch's group, place from 0, count and sum."""
    place = (n[of] + np.arange(len(of)) - np.searchsorted(of, of)) // size
    starts = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(place, prepend=-1) != 0))
    of, at = of[starts], place[starts]
    count, sums = np.diff(np.append(starts, len(score))), np.add.reduceat(score, starts) if len(starts) else score
    return of, at, count + np.where(at == 0, n[of], 0), sums + np.where(at == 0, total[of], 0.0)


class AnswerBatches(Bucketed):
    """Per student a row for every ``SIZE`` answers; with ``silence_ms``, what is left is given out when the student has
    been silent for so long.

    Batches are cut in order of event time if the micro-batches come in that order; within one, answers are sorted.
    """

    SIZE = 20
    COLUMNS = ["student", "batch", "answers", "mean_score"]
    TABLES = (("students", ["student", "batch", "n", "total", "until"]),)

    def __init__(self, silence_ms: int | None = None):
        super().__init__()
        self.silence_ms = silence_ms

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001
        new = self.rows(rows, "us")
        until = timer.getCurrentProcessingTimeInMs() + self.silence_ms if self.silence_ms is not None else 0
        fresh = new[["student"]].drop_duplicates().assign(batch=0, n=0, total=0.0, until=until)
        (old,) = self.tables()
        held = _with(old, fresh)
        code = _codes(pd.concat([held["student"], new["student"]], ignore_index=True))
        held = held.iloc[np.unique(code[: len(held)], return_index=True)[1]].reset_index(drop=True)
        new = new.assign(code=code[len(code) - len(new) :]).sort_values(["code", "at", "event_id"])
        batch, n, total = held["batch"].to_numpy(np.int64), held["n"].to_numpy(np.int64), held["total"].to_numpy(np.float64)
        of, place, count, sums = _cut(n, total, new["code"].to_numpy(), new["score"].to_numpy(np.float64), self.SIZE)
        full = count == self.SIZE
        ends = np.flatnonzero(np.diff(of, append=-1))  # the last batch of each student goes on
        out = pd.DataFrame({"student": held["student"].array[of], "batch": batch[of] + place, "answers": count, "mean_score": sums / count})[full]
        batch[of[ends]] += place[ends] + full[ends]
        n[of[ends]], total[of[ends]] = np.where(full, 0, count)[ends], np.where(full, 0.0, sums)[ends]
        last = held["until"].to_numpy(np.int64)
        last[of[ends]] = until
        self.put(held.assign(batch=batch, n=n, total=total, until=last))
        if self.silence_ms is not None:
            self.wake_at(last.min())
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001
        (held,) = self.tables()
        if held is None:
            return
        over = (held["until"] <= timerValues.getCurrentProcessingTimeInMs()).to_numpy(bool)
        rest = held[~over]
        if len(rest):
            self.put(rest)
            self.wake_at(rest["until"].min())
        else:
            self.held.clear()
        yield rest_of_batches(held[over])


def rest_of_batches(held: pd.DataFrame) -> pd.DataFrame:
    """Batches of two answers or more that are not full."""
    held = held[held["n"] >= 2]
    return pd.DataFrame({"student": held["student"], "batch": held["batch"], "answers": held["n"], "mean_score": held["total"].astype("float64") / held["n"].astype("float64")})


class SessionBatches(Bucketed):
    """Per student and session a row for every ``SIZE`` answers, and one for the rest, of two answers or more, once the
    watermark is ``silence_us`` past the last answer.

    Answers wait until the watermark has passed them and are then taken in order of event time, so batches and sessions
    do not depend on the order of delivery. State: the answers within the watermark, and one open batch a student.
    """

    SIZE = 20
    TABLES = (("waiting", ["student", "at", "event_id", "score"]), ("open", ["student", "start", "last", "batch", "n", "total"]))

    def __init__(self, silence_us: int):
        super().__init__()
        self.silence_us = silence_us

    def _wake(self, waiting: pd.DataFrame, open_: pd.DataFrame) -> None:
        at = [int(waiting["at"].min())] if len(waiting) else []
        at += [int(open_["last"].min()) + self.silence_us + 1000] if len(open_) else []
        self.wake_at(-(-min(at) // 1000) if at else None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001
        waiting, open_ = self.tables()
        names = self.TABLES[1][1]
        open_ = pd.DataFrame({c: pd.Series([], dtype="float64" if c == "total" else "Int64") for c in names}) if open_ is None else open_
        waiting = _with(waiting, self.rows(rows, "us")[self.TABLES[0][1]])
        self.put(waiting, open_)
        self._wake(waiting, open_)
        yield pd.DataFrame([], columns=SESSION_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting, held = self.tables()
        if waiting is None:
            return
        passed = (waiting["at"] <= now).to_numpy(bool)
        ready, waiting = waiting[passed], waiting[~passed]
        code = _codes(pd.concat([held["student"], ready["student"]], ignore_index=True))
        students = pd.concat([held["student"], ready["student"]], ignore_index=True).array
        ready = ready.assign(code=code[len(held) :]).sort_values(["code", "at", "event_id"])
        at, of, score = ready["at"].to_numpy(np.int64), ready["code"].to_numpy(), ready["score"].to_numpy(np.float64)
        # the open batch of each student, whose code is its place; a student without one has none to continue
        number = code.max() + 1 if len(code) else 0
        start, last, batch, n = (np.zeros(number, np.int64) for _ in range(4))
        total, has = np.zeros(number), np.arange(number) < len(held)
        for into, c in ((start, "start"), (last, "last"), (batch, "batch"), (n, "n"), (total, "total")):
            into[: len(held)] = held[c].to_numpy(into.dtype)

        first = np.diff(of, prepend=-1) != 0
        gap = at - np.where(first, last[of], np.insert(at[:-1], 0, 0)) > self.silence_us
        breaks = np.where(first, ~has[of] | gap, gap)
        opens = np.flatnonzero(first | breaks)  # sessions, of which some go on from an open batch
        student, goes_on = of[opens], ~breaks[opens]
        s_start, s_batch = np.where(goes_on, start[student], at[opens]), np.where(goes_on, batch[student], 0)
        s_last = at[np.append(opens[1:], len(at)) - 1] if len(opens) else at
        newest = np.diff(student, append=-1) != 0
        over = ~newest | (s_last + self.silence_us < now)
        session = np.cumsum(first | breaks) - 1
        g, place, count, sums = _cut(np.where(goes_on, n[student], 0), np.where(goes_on, total[student], 0.0), session, score, self.SIZE)
        full = count == self.SIZE
        gives = full | (over[g] & (count >= 2) & (np.diff(g, append=-1) != 0))
        found = pd.DataFrame({"student": students[_first_of(code, student[g])], "start_us": s_start[g], "batch": s_batch[g] + place, "answers": count, "mean_score": sums / count})[gives]

        # open batches that no session goes on from end with a new session, or with the silence
        met = np.zeros(number, bool)
        met[student] = True
        on = np.zeros(number, bool)
        on[student[goes_on]] = True
        ended = has & ~on & (met | (last + self.silence_us < now))
        rest = held[ended[: len(held)] & (n[: len(held)] >= 2)]
        rest = pd.DataFrame({"student": rest["student"], "start_us": rest["start"], "batch": rest["batch"], "answers": rest["n"], "mean_score": rest["total"].astype("float64") / rest["n"].astype("float64")})
        stays = held[(has & ~met & ~ended)[: len(held)]]
        ends = np.flatnonzero((np.diff(g, append=-1) != 0) & ~over[g])
        e = g[ends]
        opened = pd.DataFrame({
            "student": students[_first_of(code, student[e])], "start": s_start[e], "last": s_last[e], "batch": s_batch[e] + place[ends] + full[ends],
            "n": np.where(full, 0, count)[ends], "total": np.where(full, 0.0, sums)[ends],
        })
        open_ = _with(stays, opened)
        if len(waiting) or len(open_):
            self.put(waiting, open_)
        else:
            self.held.clear()
        self._wake(waiting, open_)
        yield pd.concat([f for f in (rest, found) if len(f)] or [found])


def _first_of(code: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each of the wanted codes stands first."""
    return np.unique(code, return_index=True)[1][wanted] if len(code) else wanted


def live_state(attempts: DataFrame, buckets: int = KEY_BUCKETS) -> DataFrame:
    """Knowledge state of each student and topic after each micro-batch that has answers of theirs; the row of most
    attempts is the latest."""
    return _by_bucket(attempts, "student", "topic", buckets=buckets).transformWithStateInPandas(KnowledgeState(), outputStructType=LIVE, outputMode="Append", timeMode="None")


def answer_batches(attempts: DataFrame, silence_ms: int | None = None, buckets: int = KEY_BUCKETS) -> DataFrame:
    """Full batches of answers. Timers keep a stream open, so ``silence_ms`` is for queries that run on."""
    mode = "None" if silence_ms is None else "ProcessingTime"
    return _by_bucket(attempts, "student", buckets=buckets).transformWithStateInPandas(AnswerBatches(silence_ms), outputStructType=BATCHES, outputMode="Append", timeMode=mode)


def left_over(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What ``answer_batches`` still held, two answers or more, when the query of this checkpoint ended."""
    held = spark.read.format("statestore").option("stateVarName", "held").load(checkpoint).select("value.students")

    def rest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield from (rest_of_batches(_unpacked(bytes(state))) for state in part["students"])

    return held.mapInPandas(rest, BATCHES)


def session_batches(attempts: DataFrame, silence_s: int = 1800, late: str = "1 hour", buckets: int = KEY_BUCKETS) -> DataFrame:
    """Batches of answers within sessions that end after ``silence_s`` seconds without an answer, the rest of each
    session included. Answers later than the watermark are dropped."""
    p = SessionBatches(silence_s * 1_000_000)
    rows = _by_bucket(attempts.withWatermark("ts", late), "student", buckets=buckets)
    return rows.transformWithStateInPandas(p, outputStructType=SESSION_BATCHES, outputMode="Append", timeMode="EventTime")


def session_reports(attempts: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """student, start, end, answers, mean_score of each session; works on tables and on streams."""
    if attempts.isStreaming:
        attempts = attempts.withWatermark("ts", late)
    w = F.session_window("ts", gap)
    out = attempts.groupBy("student", w.alias("w")).agg(F.count("*").alias("answers"), F.avg("score").alias("mean_score"))
    return out.select("student", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "answers", "mean_score")


def once_each(attempts: DataFrame, late: str = "1 hour") -> DataFrame:
    """Answers without those that came twice within the watermark. A row that is later than the watermark is dropped,
    whether it came before or not, so ids are forgotten once the watermark is ``late`` past them."""
    return attempts.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def append_files(stream: DataFrame, target: str, checkpoint: str):
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
