"""Streams run to their end over the events table, and the same folds on a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.plans.adapters import table
from provena.plans.registry import query
from provena.session import shared_folder
from provena.streaming import state, windows


def drained(spark: SparkSession, stream: DataFrame, keys: list[str]) -> DataFrame:
    """The last state of each key's row of an aggregating stream over files that are there already.

    Each micro-batch writes the rows that it changed to the shared folder, so the
    driver holds none, and the stream drops its state behind the watermark."""
    folder = f"{shared_folder(spark)}/drained-{uuid.uuid4().hex}"

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")

    stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch int").parquet(f"{folder}/rows")
    others = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("last")).select(*keys, *[f"last.{c}" for c in others])


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet").parquet(f"{path}*").withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("w_start", "w_end")})


WINDOW = "SELECT {0} AS w_start, {0} + INTERVAL 1 HOUR AS w_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM {1} GROUP BY ALL"


@query("stream_tumbling", WINDOW.format("time_bucket(INTERVAL 1 HOUR, ts)", "events"))
def stream_tumbling(spark, sf_dir):
    return _plain(drained(spark, windows.tumbling(event_stream(spark, sf_dir)), ["w_start", "w_end", "event_type"]))


@query("stream_sliding", WINDOW.format("time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(CAST(k * 15 AS INT))", "(SELECT *, unnest(range(4)) AS k FROM events)"))
def stream_sliding(spark, sf_dir):
    return _plain(drained(spark, windows.sliding(event_stream(spark, sf_dir)), ["w_start", "w_end", "event_type"]))


@query("stream_session", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER o >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS w_start, max(ts) + INTERVAL 30 MINUTE AS w_end, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_session(spark, sf_dir):
    return windows.sessions(table(spark, sf_dir, "events"))


def _keyed(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), "event_type", F.col("value").alias("size_mb"))


KEYED = "SELECT event_id, user_id, CAST(epoch(ts) AS DOUBLE) AS secs, event_type, value AS size_mb FROM events"


def folded_sql(events: str, columns: str, start: str, seen: str, step: str, given: str) -> str:
    """The fold of each user's events in order as a recursive query: ``start`` is the state before the first, ``seen`` what an event sees of it, ``step`` the state after it (names as in ``start``), ``given`` the result's columns."""
    return f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY secs, event_id) AS k FROM ({events})),
f AS (SELECT user_id, CAST(0 AS BIGINT) AS k, {start} FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL SELECT user_id, k, {step} FROM (SELECT e.*, {seen} FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1))
SELECT {columns}, {given} FROM e JOIN f USING (user_id, k)"""


def _rate_sql(columns: str) -> str:
    return folded_sql(KEYED, columns, "CAST([] AS DOUBLE[]) AS times, false AS admitted", "list_filter(f.times, lambda x: x > e.secs - 43200) AS w", "CASE WHEN len(w) < 5 THEN list_append(w, secs) ELSE w END, len(w) < 5", "admitted, CAST(len(times) AS INT) AS recent")


@query("stream_rate_limit", _rate_sql("event_id, user_id, secs AS \"at\", event_type, size_mb"))
def stream_rate_limit(spark, sf_dir):
    return state.over_table(_keyed(spark, sf_dir), "user_id", ["at", "event_id"], state.rate_limit(5, 43200), "admitted boolean, recent int")


@query("stream_rate_limit_live", _rate_sql("event_id, user_id, secs AS \"at\""))
def stream_rate_limit_live(spark, sf_dir):
    e = event_stream(spark, sf_dir).select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    output, folder = "admitted boolean, recent int", f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    state.over_stream(e, "user_id", ["at", "event_id"], state.rate_limit(5, 43200), output, folder, {"availableNow": True}).awaitTermination()
    return state.folded(e, output, folder)


@query("login_lockout", folded_sql(
    f"SELECT *, event_type = 'view' AS ok FROM ({KEYED}) WHERE event_type IN ('error', 'view')", "event_id, user_id, secs AS \"at\", event_type, size_mb, ok", "CAST([] AS DOUBLE[]) AS times, false AS blocked",
    "list_filter(f.times, lambda x: x > e.secs - 86400) AS w", "CASE WHEN len(w) >= 2 THEN w WHEN ok THEN [] ELSE list_append(w, secs) END, len(w) >= 2", "blocked, CAST(len(times) AS INT) AS failures",
))
def login_lockout(spark, sf_dir):
    e = _keyed(spark, sf_dir).where("event_type IN ('error', 'view')").withColumn("ok", F.col("event_type") == "view")
    return state.over_table(e, "user_id", ["at", "event_id"], state.lockout(2, 86400), "blocked boolean, failures int")


@query("job_states", folded_sql(
    f"SELECT *, CASE event_type WHEN 'view' THEN 'claim' WHEN 'click' THEN 'transient' WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'permanent' ELSE 'reprocess' END AS kind FROM ({KEYED})",
    "event_id, user_id, secs AS \"at\", event_type, size_mb, kind", "'queued' AS status, CAST(0 AS INT) AS attempts", "f.status AS was, f.attempts AS n",
    """CASE WHEN kind = 'claim' AND was = 'queued' THEN 'processing' WHEN kind = 'success' AND was = 'processing' THEN 'ready' WHEN kind = 'transient' AND was = 'processing' THEN CASE WHEN n + 1 < 3 THEN 'queued' ELSE 'dead_letter' END
    WHEN kind = 'permanent' AND was = 'processing' THEN 'dead_letter' WHEN kind = 'reprocess' AND was = 'dead_letter' THEN 'queued' ELSE was END,
    CAST(CASE WHEN kind = 'transient' AND was = 'processing' AND n + 1 < 3 THEN n + 1 WHEN kind = 'reprocess' AND was = 'dead_letter' THEN 0 ELSE n END AS INT)""", "status, attempts",
))
def job_states(spark, sf_dir):
    kinds = F.create_map(*[x for k, v in (("view", "claim"), ("click", "transient"), ("purchase", "success"), ("error", "permanent"), ("signup", "reprocess")) for x in (F.lit(k), F.lit(v))])
    e = _keyed(spark, sf_dir).withColumn("kind", kinds[F.col("event_type")])
    return state.over_table(e, "user_id", ["at", "event_id"], state.job(3), "status string, attempts int")


@query("session_expiry", folded_sql(
    f"SELECT *, CASE event_type WHEN 'signup' THEN 'open' ELSE 'use' END AS kind FROM ({KEYED})", "event_id, user_id, secs AS \"at\", event_type, size_mb, kind", "CAST(0 AS DOUBLE) AS until, false AS alive",
    "e.kind = 'open' OR f.until > e.secs AS lives", "CASE WHEN lives THEN secs + 86400 ELSE 0 END, lives", "alive",
))
def session_expiry(spark, sf_dir):
    e = _keyed(spark, sf_dir).withColumn("kind", F.when(F.col("event_type") == "signup", "open").otherwise("use"))
    return state.over_table(e, "user_id", ["at", "event_id"], state.expiry(86400), "alive boolean")


@query("alert_firing", """WITH h AS (SELECT event_type AS series, time_bucket(INTERVAL 6 HOUR, ts) AS w_start, avg(value) AS rate FROM events GROUP BY ALL)
SELECT series, w_start, min(CAST(rate > 30 AS INT)) OVER o = 1 AND count(*) OVER o = 2 AS firing FROM h WINDOW o AS (PARTITION BY series ORDER BY w_start ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)""")
def alert_firing(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    h = e.groupBy(F.col("event_type").alias("series"), F.window("ts", "6 hours").alias("w")).agg(F.avg("value").alias("rate")).select("series", F.col("w.start").alias("w_start"), "rate")
    return windows.alerts(h, 30.0, 2).select("series", "w_start", "firing")
