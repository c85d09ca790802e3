"""Telemetry and time queries over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import rnd
from ..functions.times import epoch
from ..streaming import monitor as S
from .base import query

R6 = lambda x: f"(floor(({x}) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE)"
one = lambda: F.count(F.lit(1))


def samples(load):
    return load("events").select("ts", F.col("event_type").alias("series"), "value")


def events(name: str, sql: str):
    return lambda fn: query(name, sql)(lambda load: fn(load("events")))


query("tumbling_monitor",
    f"SELECT epoch(time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01'))::BIGINT AS window_start, event_type AS series, count(*) AS n, {R6('avg(value)')} AS avg_value, max(value) AS max_value, min(value) AS min_value FROM events GROUP BY 1, 2")(
    lambda load: S.tumbling_monitor(samples(load)))
query("sliding_window",
    f"WITH s AS (SELECT ts, event_type AS series, value, unnest([0, 1]) AS k FROM events) SELECT epoch(time_bucket(INTERVAL 12 HOURS, ts, TIMESTAMP '1970-01-01') - to_hours(12 * k))::BIGINT AS window_start, series, count(*) AS n, {R6('avg(value)')} AS avg_value, max(value) AS max_value, min(value) AS min_value FROM s GROUP BY 1, 2")(
    lambda load: S.tumbling_monitor(samples(load), "24 hours", "12 hours"))
query("session_window",
    "WITH g AS (SELECT event_type AS series, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) < INTERVAL 30 MINUTES "
    "THEN 0 ELSE 1 END AS new FROM events), h AS (SELECT *, sum(new) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k "
    "FROM g) SELECT floor(epoch(min(ts)))::BIGINT AS session_start, series, count(*) AS n FROM h GROUP BY series, k")(
    lambda load: S.session_monitor(samples(load), "30 minutes"))
#: One step of the recursion is one request; log holds the times of the allowed ones in the window.
_LIMIT = """WITH RECURSIVE e AS (
  SELECT user_id AS identifier, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events
), r AS (
  SELECT identifier, t, i, true AS allowed, [t] AS log FROM e WHERE i = 1
  UNION ALL
  SELECT identifier, t, i, len(kept) < 3 AS allowed, CASE WHEN len(kept) < 3 THEN list_append(kept, t) ELSE kept END AS log
  FROM (SELECT e.identifier, e.t, e.i, list_filter(r.log, lambda x: e.t - x < 86400000000) AS kept FROM r JOIN e ON e.identifier = r.identifier AND e.i = r.i + 1)
) SELECT identifier, t, allowed FROM r"""
query("rate_limit", _LIMIT)(lambda load: S.rate_limit(load("events").select(F.col("user_id").alias("identifier"), F.col("ts").alias("t"))))
events("monitor_summary",
    f"SELECT event_type AS series, {R6('avg(value)')} AS avg_value, max(value) AS max_value, min(value) AS min_value FROM events GROUP BY 1")(
    lambda e: e.groupBy(F.col("event_type").alias("series")).agg(rnd(F.avg("value"), 6).alias("avg_value"), F.max("value").alias(
            "max_value"), F.min("value").alias("min_value")))
events("timer_stats",
    f"SELECT event_type AS timer, count(*) AS n, {R6('avg(value)')} AS avg_s, min(value) AS min_s, max(value) AS max_s, arg_max(value, (ts, event_id)) AS last_s FROM events GROUP BY 1")(
    lambda e: e.groupBy(F.col("event_type").alias("timer")).agg(one().alias("n"), rnd(F.avg("value"), 6).alias("avg_s"), F.min("value")
        .alias("min_s"), F.max("value").alias("max_s"), F.max_by("value", F.struct("ts", "event_id")).alias("last_s")))
_OK = "value < 50"
events("tool_stats",
    f"SELECT event_type AS tool, count(*) AS executions, count(*) FILTER (WHERE {_OK}) AS successes, count(*) FILTER (WHERE NOT {_OK}) AS errors, floor(count(*) FILTER (WHERE {_OK}) * 100.0::DOUBLE / count(*) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS success_rate FROM events GROUP BY 1")(
    lambda e: e.groupBy(F.col("event_type").alias("tool")).agg(one().alias("executions"), F.count_if(F.expr(_OK)).alias("successes"),
        F.count_if(~F.expr(_OK)).alias("errors")).withColumn("success_rate", rnd(F.col("successes") * F.lit(100.0) / F.col("executions"),
            2)))
events("status_distribution",
    "SELECT event_type AS status, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")(lambda e: e.groupBy(F.col(
            "event_type").alias("status")).agg(one().alias("n"), F.countDistinct("user_id").alias("users")))
events("op_metrics",
    f"SELECT user_id, count(*) AS started, count(*) FILTER (WHERE event_type = 'purchase') AS completed, {R6(chr(49) + '00.0::DOUBLE * count(*) FILTER (WHERE event_type = ' + chr(39) + 'purchase' + chr(39) + ') / count(*)')} AS success_percent FROM events GROUP BY 1")(
    lambda e: e.groupBy("user_id").agg(one().alias("started"), F.count_if(F.col("event_type") == "purchase").alias("completed")).withColumn(
        "success_percent", rnd(F.lit(100.0) * F.col("completed") / F.col("started"), 6)))
events("availability",
    f"SELECT event_type AS host, {R6('100.0::DOUBLE * count(*) FILTER (WHERE value IS NOT NULL AND value <> 0) / count(*)')} AS availability_percent FROM events GROUP BY 1")(
    lambda e: e.groupBy(F.col("event_type").alias("host")).agg(F.count_if(F.col("value").isNotNull() & (F.col("value") != 0)).alias("k"),
        one().alias("n")).select("host", rnd(F.lit(100.0) * F.col("k") / F.col("n"), 6).alias("availability_percent")))
events("error_report",
    "WITH x AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events WHERE value > "
    "90) SELECT event_type, count(*) AS n, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) FILTER (WHERE r <= 5) AS examples FROM x "
    "GROUP BY 1")(lambda e: e.where("value > 90").withColumn("r", F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")))
    .groupBy("event_type").agg(one().alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 5, F.col(
                "event_id")))), lambda x: x.cast("string")), ",").alias("examples")))
events("top_k_metric", "SELECT event_id, user_id, value FROM events ORDER BY value DESC, event_id LIMIT 10")(lambda e: e.orderBy(F.desc(
            "value"), "event_id").limit(10).select("event_id", "user_id", "value"))
events("threshold_status",
    "SELECT event_id, CASE WHEN value > 90 THEN 'critical' WHEN value > 80 THEN 'warning' ELSE 'healthy' END AS status FROM events")(
    lambda e: e.select("event_id", F.when(F.col("value") > 90, "critical").when(F.col("value") > 80, "warning").otherwise("healthy").alias(
            "status")))
events("latency_band",
    "SELECT event_id, CASE WHEN value < 50 THEN 'Excellent' WHEN value < 100 THEN 'Good' WHEN value < 200 THEN 'Fair' ELSE 'Poor' END AS "
    "band FROM events")(lambda e: e.select("event_id", F.when(F.col("value") < 50, "Excellent").when(F.col("value") < 100, "Good")
        .when(F.col("value") < 200, "Fair").otherwise("Poor").alias("band")))
events("health_score",
    "WITH m AS (SELECT user_id, max(value) FILTER (WHERE event_type = 'view') AS mem, max(value) FILTER (WHERE event_type = 'click') AS "
    "cpu FROM events GROUP BY 1), s AS (SELECT user_id, 100 - CASE WHEN mem > 90 THEN 20 WHEN mem > 80 THEN 10 ELSE 0 END - CASE WHEN cpu "
    "> 90 THEN 20 WHEN cpu > 80 THEN 10 ELSE 0 END AS score FROM m) SELECT user_id, score::BIGINT AS score, CASE WHEN score >= 80 THEN "
    "'good' WHEN score >= 60 THEN 'fair' ELSE 'poor' END AS health FROM s")(lambda e: e.groupBy("user_id").agg(*[F.max(F.when(F.col(
                "event_type") == t, F.col("value"))).alias(n) for n, t in (("mem", "view"), ("cpu", "click"))]).select("user_id",
        (F.lit(100) - sum((F.when(F.col(c) > 90, 20).when(F.col(c) > 80, 10).otherwise(0) for c in ("mem", "cpu")), F.lit(0))).cast("long")
        .alias("score")).withColumn("health", F.when(F.col("score") >= 80, "good").when(F.col("score") >= 60, "fair").otherwise("poor")))
events("hourly_throughput",
    "SELECT epoch(date_trunc('hour', ts))::BIGINT AS hour, count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-10' - INTERVAL 1 DAY "
    "AND ts <= TIMESTAMP '2024-01-10' GROUP BY 1")(lambda e: e.where(
        "ts > timestamp_ntz'2024-01-10' - interval 1 day and ts <= timestamp_ntz'2024-01-10'").groupBy(epoch(F.date_trunc("hour", "ts"))
        .alias("hour")).agg(one().alias("n")))
_PAST = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"
events("running_mean",
    f"SELECT event_id, (sum(round(value * 100)::BIGINT) {_PAST})::DOUBLE / (count(*) {_PAST})::DOUBLE AS running_mean_cents FROM events")(
    lambda e: e.select("event_id", (F.sum(F.round(F.col("value") * 100).cast("long")).over(w := Window.partitionBy("user_id").orderBy("ts",
                "event_id").rowsBetween(Window.unboundedPreceding, 0)).cast("double") / one().over(w)).alias("running_mean_cents")))
events("last_n_per_key",
    "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) "
    "WHERE r <= 3")(lambda e: e.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc(
                "event_id")))).where("r <= 3").select("user_id", "event_id"))
events("ttl_cache_asof",
    "WITH o AS (SELECT *, max(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS "
    "UNBOUNDED PRECEDING) AS set_at FROM events) SELECT event_id, CASE WHEN set_at IS NULL THEN 'miss' WHEN ts > set_at + INTERVAL 1 DAY "
    "THEN 'expired' ELSE 'hit' END AS outcome FROM o WHERE event_type <> 'purchase'")(lambda e: e.withColumn("set_at", F.max(F.when(F.col(
                "event_type") == "purchase", F.col("ts"))).over(Window.partitionBy("user_id").orderBy("ts",
                "event_id").rowsBetween(Window.unboundedPreceding, 0))).where("event_type <> 'purchase'").select("event_id", F.when(F.col(
                "set_at").isNull(), "miss").when(F.col("ts") > F.col("set_at") + F.expr("interval 1 day"), "expired").otherwise("hit")
        .alias("outcome")))
events("json_path", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")(lambda e: e.select("event_id",
        F.get_json_object("props", "$.k").cast("long").alias("k")))
events("backoff_schedule",
    "SELECT user_id, attempt::BIGINT AS attempt, (1.0::DOUBLE * pow(2.0::DOUBLE, attempt)) AS delay_s FROM (SELECT DISTINCT user_id FROM "
    "events), (SELECT unnest(range(0, 4)) AS attempt)")(lambda e: e.select("user_id").distinct().select("user_id",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("attempt")).withColumn("delay_s", F.pow(F.lit(2.0), F.col(
                "attempt"))))
