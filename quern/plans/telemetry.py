"""Queries on telemetry, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import corpus, metrics, quantiles
from quern.plans.declare import Tables, query
from quern.session import materialise
from quern.sources import attempts, records
from quern.streaming import telemetry as S

_P95 = "list_sort(list({0}))[greatest(1, ceil(count(*) * 0.95))::INT]"


@query("a15_consumption", "SELECT coalesce(event_type, 'total') AS dataset, count(*) AS n_batches, sum(event_id % 9)::BIGINT AS n_instances FROM events WHERE user_id % 10 > 0 GROUP BY ROLLUP (event_type)")
def a15(t: Tables) -> DataFrame:
    e = t.events.where("user_id % 10 > 0")
    return e.rollup("event_type").agg(F.count(F.lit(1)).alias("n_batches"), F.sum(F.col("event_id") % 9).alias("n_instances")).select(F.coalesce("event_type", F.lit("total")).alias("dataset"), "n_batches", "n_instances")


@query("a16_wait_p95", f"SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, {_P95.format('value')} AS p95, sum(event_id % 9)::BIGINT AS n_instances FROM events GROUP BY user_id")
def a16(t: Tables) -> DataFrame:
    out = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.sum(F.col("event_id") % 9).alias("n_instances"))
    return quantiles.join_groups(out, quantiles.nearest_ranks(t.events, ["user_id"], "value", p95=0.95).drop("n"), ["user_id"])


@query("a17_throughput", "SELECT user_id, round(sum(event_id % 9) * 8 / nullif(epoch(max(ts)) - epoch(min(ts)), 0), 6) AS per_second, round((epoch(max(ts)) - epoch(min(ts))) / nullif(count(*), 0), 4) AS step_seconds FROM events GROUP BY user_id")
def a17(t: Tables) -> DataFrame:
    e = t.events.withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    span = F.max("s") - F.min("s")
    return e.groupBy("user_id").agg(F.round(F.try_divide(F.sum(F.col("event_id") % 9) * 8, span), 6).alias("per_second"), F.round(F.try_divide(span, F.count(F.lit(1))), 4).alias("step_seconds"))


@query("a25_latest_attempt", "SELECT user_id, max(event_id) AS latest, max(event_id) FILTER (event_type <> 'error') AS latest_ok, max(event_id) FILTER (event_type = 'purchase') AS latest_full FROM events GROUP BY user_id")
def a25(t: Tables) -> DataFrame:
    r = metrics.latest(t.events, "user_id", "event_id", ["event_id", "event_type"], latest_ok="event_type <> 'error'", latest_full="event_type = 'purchase'")
    return r.select("user_id", *(F.col(f"{c}.event_id").alias(c) for c in ("latest", "latest_ok", "latest_full")))


@query("s21_attempt_log", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def s21(t: Tables) -> DataFrame:
    """Three writers append to one log; the view is the latest row of each key."""
    log = records.scratch(t.spark, "attempts")
    rows = t.events.select("user_id", "event_id", "event_type")
    for k in range(3):
        attempts.append(log, rows.where(F.col("event_id") % 3 == k))
    return attempts.latest(attempts.read(t.spark, log, rows.schema), "user_id", "event_id")


@query("a28_smoothed_steps", "WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events), r AS (SELECT user_id, k, n, value AS ema FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.k, o.n, 0.3 * o.value + 0.7 * r.ema FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1) SELECT user_id, n, round(ema, 6) AS ema FROM r WHERE k = n")
def a28(t: Tables) -> DataFrame:
    return metrics.smoothed(t.events, "user_id", "event_id", "value", 0.3).select("user_id", "n", F.round("ema", 6).alias("ema"))


@query("a32_consumption_report", "SELECT event_type AS dataset, printf('%s: planned %d, consumed %d', event_type, count(*), count(*) FILTER (user_id % 10 > 0)) AS line FROM events GROUP BY event_type")
def a32(t: Tables) -> DataFrame:
    r = t.events.groupBy(F.col("event_type").alias("dataset")).agg(F.count(F.lit(1)).alias("p"), F.count_if(F.expr("user_id % 10 > 0")).alias("c"))
    return r.select("dataset", F.format_string("%s: planned %d, consumed %d", "dataset", "p", "c").alias("line"))


@query("a33_run_summary", "SELECT count(*) AS n_waits, round(sum(value), 4) AS total_wait, round(max(value), 6) AS peak, sum(event_id % 9)::BIGINT AS n_instances FROM events")
def a33(t: Tables) -> DataFrame:
    return t.events.agg(F.count(F.lit(1)).alias("n_waits"), F.round(F.sum("value"), 4).alias("total_wait"), F.round(F.max("value"), 6).alias("peak"), F.sum(F.col("event_id") % 9).alias("n_instances"))


@query("w10_log_deltas", "SELECT event_id, event_id - lag(event_id) OVER w AS delta_id, round(value - lag(value) OVER w, 6) AS delta FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def w10(t: Tables) -> DataFrame:
    e = corpus.lagged(t.events.select("user_id", "event_id", "value"), ["user_id"], ["event_id"], last_id="event_id", last_value="value")
    return e.select("event_id", (F.col("event_id") - F.col("last_id")).alias("delta_id"), F.round(F.col("value") - F.col("last_value"), 6).alias("delta"))


@query("w11_bounded_window", "SELECT event_id, list_sort(list(value) OVER r)[ceil(count(*) OVER r * 0.95)::INT] AS recent_p95, round(avg(value) OVER a + 1e-9, 6) AS lifetime_mean FROM events WINDOW r AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 15 PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def w11(t: Tables) -> DataFrame:
    """Each row is handed on to the 15 after it, so a window is a group of 16 rows however many a user has."""
    e = corpus.running(t.events.select("user_id", "event_id", "value"), ["user_id"], ["event_id"], total=F.col("value"), place=F.lit(1))
    e = materialise(e, "places")
    near = e.select("user_id", F.explode(F.sequence(F.col("place"), F.col("place") + 15)).alias("place"), F.col("value").alias("x"))
    recent = near.groupBy("user_id", "place").agg(metrics.nearest_rank_of(F.collect_list("x"), 0.95).alias("recent_p95"))
    mean = F.round(F.col("total") / F.col("place") + 1e-9, 6).alias("lifetime_mean")
    return e.join(recent, ["user_id", "place"]).select("event_id", "recent_p95", mean)


@query("w12_logging_windows", "SELECT event_type, event_id // 100 AS log_window, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def w12(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type", F.expr("event_id div 100").alias("log_window")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


_HOURS = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL"


@query("st1_windowed_stream", f"SELECT * FROM ({_HOURS}) WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def st1(t: Tables) -> DataFrame:
    """Windows that the watermark has passed: those are written once, and forgotten."""
    return S.run_to_table(S.windowed(S.event_stream(t.spark, f"{t.sf_dir}/events.parquet")))


@query("st1_windowed_batch", _HOURS)
def st1b(t: Tables) -> DataFrame:
    e = t.events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return e.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


@query("st2_consumed_stream", "SELECT DISTINCT event_id, event_type FROM events WHERE user_id % 10 > 0")
def st2(t: Tables) -> DataFrame:
    e = S.event_stream(t.spark, f"{t.sf_dir}/events.parquet")
    return S.run_to_table(S.consumed(e, "user_id % 10 > 0").select("event_id", "event_type"), "append")


@query("st4_attempt_upsert", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def st4(t: Tables) -> DataFrame:
    e = S.event_stream(t.spark, f"{t.sf_dir}/events.parquet").select("user_id", "event_id", "event_type")
    return S.upsert_latest(e, "user_id", "event_id")


@query("f24_json_navigation", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def f24(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("f23_timestamps", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, substr(props, 1, 2000) AS clipped FROM events")
def f23(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), F.substring("props", 1, 2000).alias("clipped"))


@query(
    "st5_open_units",
    "WITH e AS (SELECT user_id AS worker, event_id AS step, event_type || event_id % 4 AS unit, lag(event_id) OVER (PARTITION BY user_id, event_type, event_id % 4 ORDER BY event_id) AS before FROM events), n AS (SELECT a.worker, a.step, count(DISTINCT b.unit) AS between_ FROM e a LEFT JOIN e b ON b.worker = a.worker AND b.step > a.before AND b.step < a.step GROUP BY ALL) SELECT worker, step, unit AS opened FROM e JOIN n USING (worker, step) WHERE before IS NULL OR between_ >= 3",
)
def st5(t: Tables) -> DataFrame:
    """A unit is opened unless fewer than the capacity of others were used since its last use."""
    e = S.event_stream(t.spark, f"{t.sf_dir}/events.parquet")
    e = e.select(F.col("user_id").alias("worker"), F.col("event_id").alias("step"), F.concat("event_type", (F.col("event_id") % 4).cast("string")).alias("unit"))
    return S.run_to_table(S.open_units(e, "worker", "step", "unit", 3)).select("worker", "step", "opened")


@query("st6_ema_state", "WITH RECURSIVE o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events), r AS (SELECT event_type, k, value AS ema FROM o WHERE k = 1 UNION ALL SELECT o.event_type, o.k, 0.5 * o.value + 0.5 * r.ema FROM r JOIN o ON o.event_type = r.event_type AND o.k = r.k + 1) SELECT event_type, round(arg_max(ema, k), 6) AS ema FROM r GROUP BY event_type")
def st6(t: Tables) -> DataFrame:
    """Smoothing as streaming state; the view is the last row of each run."""
    e = S.event_stream(t.spark, f"{t.sf_dir}/events.parquet").select("event_type", "event_id", "value", "ts")
    out = S.run_to_table(S.smoothed(e, "event_type", "event_id", "value", 0.5, "ts"), "update")
    return out.groupBy("event_type").agg(F.round(F.max_by("ema", "n"), 6).alias("ema"))
