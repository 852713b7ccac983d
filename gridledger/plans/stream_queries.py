"""ST1-ST5, run over what the tables hold."""

from pyspark.sql import functions as F

from ..streaming import streams as S
from . import query


def table_stream(v, table):
    """The table's file or folder as a stream."""
    return S.file_stream(v.spark, v.sf_dir, f"{table}.parquet", getattr(v, table).schema)


def event_calls(v):
    e = S.with_event_time(table_stream(v, "events"))
    return e.select(F.col("user_id").alias("attempt_id"), F.col("event_id").alias("step"), "ts", (F.col("event_id") % 5).cast("string").alias("model"),
                    F.floor(F.col("value") * 100).alias("prompt_tokens"), (F.floor(F.col("value") * 100) / 1000).alias("cost"), "value", "event_type")


@query("st1_stream_pending", "attempts gradings", """
SELECT id, task_id FROM attempts a WHERE NOT agent_failed AND NOT deprecated AND NOT EXISTS (
 SELECT 1 FROM gradings g WHERE g.attempt_id = a.id AND NOT failed AND NOT g.deprecated AND grader_model = 'g1')""")
def _(v):
    o = table_stream(v, "orders")
    attempts = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("task_id"), (F.col("o_orderstatus") == "F").alias("agent_failed"), (F.col("o_orderkey") % 10 == 0).alias("deprecated"))
    return S.run_append(S.stream_pending(attempts, v.gradings, "g1").select("id", "task_id"), "pending")


@query("st2_stream_dedupe", "", "SELECT DISTINCT event_id AS step FROM events")
def _(v):
    calls = event_calls(v)
    twice = calls.unionByName(event_calls(v))
    return S.run_append(S.stream_dedupe(twice, "step", "2 days").select("step"), "dedupe")


@query("st3_running_waits", "calls", "SELECT attempt_id, ROUND(SUM(CAST(prompt_tokens AS DOUBLE) / 1000), 4) AS wait_s, COUNT(*) AS n_retries FROM calls WHERE type = 'error' GROUP BY attempt_id")
def _(v):
    records = event_calls(v).filter("event_type = 'error'").select("attempt_id", F.col("cost").alias("delay_s"))
    return S.run_update(S.running_waits(records), ["attempt_id"], "waits").withColumn("wait_s", F.round("wait_s", 4))


@query("st4_windowed_cost", "calls", """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, model, COUNT(*) AS n_calls, CAST(SUM(prompt_tokens) AS BIGINT) AS tokens, ROUND(SUM(prompt_tokens / 1000), 4) AS cost FROM calls GROUP BY 1, 2""")
def _(v):
    out = S.run_update(S.windowed_cost(event_calls(v), "1 hour", None, "1 day"), ["w", "model"], "cost")
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "model", "n_calls", "tokens", F.round("cost", 4).alias("cost"))


@query("st4_sliding_cost", "calls", """
SELECT strftime(date_trunc('hour', ts) - INTERVAL (45) MINUTE + INTERVAL (15) MINUTE * (CAST(FLOOR(EXTRACT(minute FROM ts) / 15) AS INT) + k.k), '%Y-%m-%d %H:%M:%S') AS start, model, COUNT(*) AS n_calls, CAST(SUM(prompt_tokens) AS BIGINT) AS tokens
FROM calls, (SELECT UNNEST(range(0, 4)) AS k) k GROUP BY 1, 2""")
def _(v):
    out = S.run_update(S.windowed_cost(event_calls(v), "1 hour", "15 minutes", "1 day"), ["w", "model"], "slide")
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "model", "n_calls", "tokens")


# a session is written once the watermark (last event less the delay) has passed its end
@query("st5_stall_sessions", "calls", """
WITH g AS (SELECT attempt_id, ts, CASE WHEN ts < LAG(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM calls WINDOW w AS (PARTITION BY attempt_id ORDER BY ts)),
s AS (SELECT *, SUM(new) OVER (PARTITION BY attempt_id ORDER BY ts, new DESC) AS n FROM g),
q AS (SELECT attempt_id, MIN(ts) AS a, MAX(ts) + INTERVAL 2 HOUR AS b, COUNT(*) AS n_calls FROM s GROUP BY attempt_id, n)
SELECT attempt_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS start, n_calls FROM q WHERE b <= (SELECT MAX(ts) FROM calls) - INTERVAL 1 HOUR""")
def _(v):
    out = S.run_append(S.stall_sessions(event_calls(v), "2 hours", "1 hour"), "stall")
    return out.select("attempt_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n_calls")
