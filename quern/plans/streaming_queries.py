"""Streams over the events table, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..streaming import events as E
from ..streaming import state as S
from .registry import query


def stream(t):
    return E.event_stream(t.spark, f"{t.folder}/events.parquet", t.events.schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query("str_tumbling", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def str_tumbling(t):
    out = E.drained(E.tumbling(stream(t), "ts", "event_type", "value"), "update", "start", "event_type")
    return out.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("str_sliding", "SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events) GROUP BY 1, 2")
def str_sliding(t):
    out = E.drained(E.sliding(stream(t), "ts", "event_type", "value", "1 hour", "30 minutes"), "update", "start", "event_type")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


@query("str_deduplicated", "SELECT event_id FROM events")
def str_dedup(t):
    return E.drained(E.deduplicated(stream(t), "ts", "event_id").select("event_id"), "append")


@query("str_alerts", """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) / 1e6 AS s FROM events), f AS (SELECT user_id, min(s) AS p FROM e GROUP BY 1
   UNION ALL SELECT user_id, (SELECT min(e.s) FROM e WHERE e.user_id = f.user_id AND e.s >= f.p + 7200) FROM f WHERE p IS NOT NULL) SELECT user_id AS key, round(p, 3) AS t FROM f WHERE p IS NOT NULL""")
def str_alerts(t):
    return E.drained(E.suppressed_alerts(stream(t), "user_id", "ts", 7200), "append").select("key", F.round("t", 3).alias("t"))


@query("str_sessions", """SELECT user_id, round(min(s), 3) AS start, count(*) AS n FROM (SELECT user_id, s, sum(new) OVER (PARTITION BY user_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS g
   FROM (SELECT user_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s) < 1800 THEN 0 ELSE 1 END AS new FROM (SELECT user_id, epoch_us(ts) / 1e6 AS s FROM events))) GROUP BY user_id, g""")
def str_sessions(t):
    out = E.drained(E.sessions(stream(t), "ts", "user_id"), "complete")
    return out.select("user_id", F.round(F.unix_micros("start") / 1e6, 3).alias("start"), "n")


@query("str_rejects", "SELECT event_type, count(*) FILTER (value >= 0) AS kept, count(*) FILTER (NOT coalesce(value >= 0, false)) AS rejected FROM events GROUP BY 1")
def str_rejects(t):
    """Micro-batches merged into one folder, rows that fail the condition into another."""
    folder = f"{E.shared_dir(t.spark)}/{uuid.uuid4().hex}"
    put = lambda name: lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{folder}/{name}/epoch={epoch}")
    E.upsert_batches(stream(t), put("kept"), f"{folder}/state", F.col("value") >= 0, put("rejected")).awaitTermination()
    rows = [t.spark.read.schema(t.events.schema).parquet(f"{folder}/{name}").select("event_type", F.lit(name).alias("side")) for name in ("kept", "rejected")]
    both = rows[0].unionByName(rows[1]).groupBy("event_type")
    return both.agg(F.count_if(F.col("side") == "kept").alias("kept"), F.count_if(F.col("side") == "rejected").alias("rejected"))


#: What the watermark has passed at the end of the stream.
SETTLED = "d AS (SELECT *, epoch_us(ts) AS t FROM events WHERE epoch_us(ts) // 1000 < (SELECT max(epoch_us(ts)) // 1000 - 600000 FROM events))"


@query("str_rate_limited", f"""WITH RECURSIVE {SETTLED}, e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM d),
  f AS (SELECT user_id, event_id, k, true AS passed, [t] AS h FROM e WHERE k = 1
   UNION ALL SELECT user_id, event_id, k, len(g) < 3, CASE WHEN len(g) < 3 THEN list_append(g, t) ELSE g END
   FROM (SELECT e.user_id, e.event_id, e.k, e.t, list_filter(f.h, lambda x: x > e.t - 86400000000) AS g FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1))
  SELECT user_id, event_id, passed, len(h)::INT AS n FROM f""")
def str_limited(t):
    """At most three events of a user in any day."""
    out = E.drained(S.rate_limited(stream(t), "user_id", "ts", "event_id", 3, 86400), "append")
    return out.select(F.col("key").alias("user_id"), F.col("tie").alias("event_id"), "passed", "n")


@query("str_rolling_anomalies", f"""WITH {SETTLED}, e AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > 432000000000 THEN 1 ELSE 0 END AS new FROM d),
  g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS g FROM e),
  l AS (SELECT *, list_filter(list(value) OVER (PARTITION BY user_id, g ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lambda x: x IS NOT NULL) AS all_before FROM g),
  h AS (SELECT *, coalesce(all_before[-20:], []) AS h FROM l),
  s AS (SELECT user_id, event_id, len(h)::INT AS n, CASE WHEN len(h) >= 5 AND list_stddev_pop(h) > 0 THEN abs(value - list_avg(h)) / list_stddev_pop(h) END AS z FROM h)
  SELECT user_id, event_id, n, round(z, 4) AS score, CASE WHEN z > 5 THEN 'critical' WHEN z > 4 THEN 'high' WHEN z > 3.5 THEN 'medium' WHEN z > 2 THEN 'low' END AS severity FROM s""")
def str_rolling(t):
    """Each value against the user's last twenty, forgotten after five days without one."""
    out = E.drained(S.rolling_anomalies(stream(t), "user_id", "ts", "event_id", "value", window=20, z=2.0, least=5, keep=432000), "append")
    return out.select(F.col("key").alias("user_id"), F.col("tie").alias("event_id"), "n", F.round("score", 4).alias("score"), "severity")
