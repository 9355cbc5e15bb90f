"""Means that lie on a threshold come out as in the checking SQL, which sums a student's scores in the order of steps."""

from __future__ import annotations

import pandas as pd
from lectern.plans import q_mastery  # noqa: F401
from lectern.registry import ORACLES, QUERIES

from .oracle import connect, rows

#: Values by topic of a student whose scores are value / 60: in the order of steps their means lie on one side of the
#: mean named, exactly summed on the other.
VALUES = {
    "view": [2.38, 38.15, 58.47],  # 0.55
    "click": [17.16, 17.66, 46.18],  # 0.45
    "purchase": [35.47, 7.47, 20.06],  # 0.35
    "signup": [29.66, 39.1, 23.18, 56.65, 46.41],  # 0.65
    "error": [51.69, 58.86, 3.43, 38.64, 12.38],  # 0.55
}
#: As above, for bounds of 0.5 and 0.75.
HALVES = {"view": [37.9, 39.36, 12.74], "click": [32.41, 5.19, 52.4], "purchase": [30.16, 35.22, 39.94, 14.68], "signup": [39.66, 37.9, 57.44], "error": [57.12, 36.16, 36.19, 39.22, 56.31]}


def same(spark, data, tmp_path, name: str, values: dict[str, list[float]]) -> None:
    """The query and its SQL agree on events of one student, and the same in reverse of another."""
    events = [(student, topic, v) for student, sign in ((2, 1), (5, -1)) for topic, vs in values.items() for v in vs[::sign]]
    df = pd.DataFrame([(i, i, student, topic, v, '{"k": %d}' % (i % 100)) for i, (student, topic, v) in enumerate(events)], columns=["event_id", "s", "user_id", "event_type", "value", "props"])
    con = connect(data)
    con.register("made", df)
    con.sql(f"COPY (SELECT event_id, TIMESTAMP '2024-01-01' + to_seconds(s) AS ts, user_id, event_type, value, props FROM made) TO '{tmp_path}/events.parquet'")
    con.sql(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    con.sql("SET threads = 1")
    assert rows(QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(con.sql(ORACLES[name]).df())


def test_sufficiency_on_a_threshold(spark, data, tmp_path):
    same(spark, data, tmp_path, "a17_sufficiency", VALUES)


def test_weak_topics_on_a_threshold(spark, data, tmp_path):
    same(spark, data, tmp_path, "a19_weak_topics", HALVES)


def test_dashboard_on_a_threshold(spark, data, tmp_path):
    same(spark, data, tmp_path, "a23_dashboard", HALVES)


def test_valid_actions_on_a_threshold(spark, data, tmp_path):
    same(spark, data, tmp_path, "f35_valid_actions", VALUES)


def test_prerequisites_on_a_threshold(spark, data, tmp_path):
    same(spark, data, tmp_path, "j11_prerequisites_met", VALUES)
