"""Streams run over the events file until it is read; their results must equal the batch queries'."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.plans.registry import query
from netloom.streaming import deltas


def _events(t):
    return deltas.event_stream(t.spark, t.sf_dir, names="events.parquet")


def _run(stream):
    return deltas.run_to_files(stream)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def stream_tumbling(t):
    return _run(deltas.tumbling(_events(t), "1 hour", "1 day")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL (30 * i) MINUTE AS start, count(*)::BIGINT AS n FROM events, range(0, 2) r(i) GROUP BY 1")
def stream_sliding(t):
    return _run(deltas.sliding(_events(t), "1 hour", "30 minutes", "1 day")).select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT user_id, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY user_id")
def stream_latest_state(t):
    return _run(deltas.latest_state(_events(t).select("user_id", "event_id", "value"), "user_id", "event_id"))


@query("AND r AS (SELECT user_id AS design, event_id AS run, round(0.5 * value + 0.5 * (event_id % 7), 6) AS cost FROM events) SELECT design, arg_min(run, (cost, run)) AS run, min(cost) AS cost, count(*)::BIGINT AS runs FROM r GROUP BY design")
def stream_leaderboard(t):
    r = _events(t).select(F.col("user_id").alias("design"), F.col("event_id").alias("run"), "value")
    return _run(deltas.leaderboard(r, F.round(F.lit(0.5) * F.col("value") + F.lit(0.5) * (F.col("run") % 7), 6)))
