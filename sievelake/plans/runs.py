"""Runs of sources: health, streaks, windows, incidents, telemetry. The events table stands in for the runs.

A user is a source; an event is a run, its type the outcome (`purchase` succeeded, `signup` partial, `error` failed, the
others are under way), its value the items and seconds.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sievelake.operators import aggregates as A
from sievelake.operators.joins import with_flag
from sievelake.operators.latest import keyset_page, latest_by
from sievelake.plans.base import at, query, table

NOW, CUTOFF = "2024-01-25 00:00:00", "2024-01-15 00:00:00"


def newest():
    return F.col("ts").desc(), F.col("event_id").desc()


@query("""
WITH latest AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events),
agg AS (SELECT user_id, count(*) AS n_runs, count(*) FILTER (WHERE event_type = 'purchase') AS n_succeeded, count(*) FILTER (WHERE event_type = 'error') AS n_failed,
  round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY user_id)
SELECT l.user_id, l.event_id AS last_event, l.event_type AS last_status, l.ts AS last_ts, a.n_runs, a.n_succeeded, a.n_failed, a.p95 FROM latest l JOIN agg a USING (user_id) WHERE rn = 1""")
def latest_run_health(spark, sf_dir):
    """Each source's newest run beside what all its runs come to."""
    events = table(spark, sf_dir, "events")
    latest = latest_by(events, ["user_id"], newest())
    totals = events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_runs"), F.count_if(F.col("event_type") == "purchase").alias("n_succeeded"), F.count_if(F.col("event_type") == "error").alias("n_failed"), F.round(A.continuous("value", 0.95), 6).alias("p95")
    )
    return latest.select("user_id", F.col("event_id").alias("last_event"), F.col("event_type").alias("last_status"), F.col("ts").alias("last_ts")).join(totals, "user_id")


@query(f"""
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events
WHERE ts >= TIMESTAMP '{CUTOFF}' AND ts < TIMESTAMP '{NOW}' AND event_type IN ('purchase', 'signup', 'error')) WHERE rn = 1""")
def latest_run_in_window(spark, sf_dir):
    """The newest finished run of each source in a window."""
    ended = table(spark, sf_dir, "events").where((F.col("ts") >= at(CUTOFF)) & (F.col("ts") < at(NOW)) & F.col("event_type").isin("purchase", "signup", "error"))
    return latest_by(ended, ["user_id"], newest()).select("user_id", "event_id", "event_type")


@query("""
SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS n_large, round(sum(value), 4) AS total, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean FROM events GROUP BY event_type""")
def run_aggregates(spark, sf_dir):
    return (
        table(spark, sf_dir, "events")
        .groupBy("event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("n_large"), F.round(F.sum("value"), 4).alias("total"), F.round(A.continuous("value", 0.95), 6).alias("p95"), F.round(F.avg("value"), 6).alias("mean"))
    )


@query("""SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS code, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1, 2""")
def errors_by_code(spark, sf_dir):
    """Counts by source and error code, one row each; `errors_by_code_map` folds them into a map."""
    return error_codes(table(spark, sf_dir, "events")).groupBy("user_id", "code").agg(F.count(F.lit(1)).alias("n"))


def error_codes(events):
    return events.where("event_type = 'error'").withColumn("code", F.get_json_object("props", "$.k").cast("long") % 5)


@query("""
WITH c AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS code, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1, 2)
SELECT user_id, string_agg(code || ':' || n, ',' ORDER BY code) AS codes FROM c GROUP BY user_id""")
def errors_by_code_map(spark, sf_dir):
    counts = error_codes(table(spark, sf_dir, "events")).groupBy("user_id", "code").agg(F.count(F.lit(1)).alias("n"))
    folded = counts.groupBy("user_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("code", "n")))).alias("codes"))
    return folded.select("user_id", F.array_join(F.transform(F.map_entries("codes"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",").alias("codes"))


STREAK_SQL = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events),
b AS (SELECT *, sum(CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS broken FROM r WHERE rn <= 32),
streaks AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error' AND broken = 0) AS streak FROM b GROUP BY user_id)"""


def streaks(events):
    failed = F.col("event_type") == "error"
    return A.failure_streak(events, "user_id", newest(), failed, F.col("event_type").isin("purchase", "signup", "error"), 32)


@query(STREAK_SQL + " SELECT user_id, streak FROM streaks")
def failure_streaks(spark, sf_dir):
    return streaks(table(spark, sf_dir, "events"))


@query(STREAK_SQL + ", last AS (SELECT user_id, max(ts) FILTER (WHERE event_type = 'purchase') AS last_success FROM events GROUP BY user_id) SELECT s.user_id, s.streak, l.last_success FROM streaks s JOIN last l USING (user_id) WHERE s.streak >= 2")
def open_incidents(spark, sf_dir):
    """Sources that have failed twice or more in a row, and when they last succeeded."""
    events = table(spark, sf_dir, "events")
    last = events.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("last_success"))
    return streaks(events).where("streak >= 2").join(last, "user_id").select("user_id", "streak", "last_success")


@query("""
WITH ordered AS (SELECT *, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type IN ('purchase', 'signup', 'error')),
isl AS (SELECT *, rn - row_number() OVER (PARTITION BY user_id, bad ORDER BY ts, event_id) AS grp FROM ordered)
SELECT user_id, min(ts) AS opened, max(ts) AS last_failure, count(*) AS failures FROM isl WHERE bad = 1 GROUP BY user_id, grp HAVING count(*) >= 2""")
def incident_history(spark, sf_dir):
    """Every stretch of two or more failures, by gaps and islands."""
    ended = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "signup", "error")).withColumn("bad", F.col("event_type") == "error")
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    island = F.row_number().over(by) - F.row_number().over(Window.partitionBy("user_id", "bad").orderBy("ts", "event_id"))
    return ended.withColumn("island", island).where("bad").groupBy("user_id", "island").agg(F.min("ts").alias("opened"), F.max("ts").alias("last_failure"), F.count(F.lit(1)).alias("failures")).where("failures >= 2").drop("island")


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type IN ('purchase', 'signup'))
SELECT user_id, CASE WHEN count(*) >= 3 THEN round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) / nullif(sum(value), 0), 6) END AS share, count(*) AS n_runs FROM r WHERE rn <= 3 GROUP BY user_id""")
def target_share(spark, sf_dir):
    """Share of the target's items over a source's last three finished runs; null with fewer."""
    ended = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "signup")).withColumn("target", F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0))
    return A.share_of_last(ended, "user_id", newest(), 3, "target", "value")


@query("""SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS used, greatest(60 - count(*), 0) AS remaining, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def quota_windows(spark, sf_dir):
    """What a day's quota has left."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("window_start"), "event_type")
        .agg(F.count(F.lit(1)).alias("used"), F.round(F.sum("value"), 4).alias("total"))
        .withColumn("remaining", F.greatest(60 - F.col("used"), F.lit(0)).cast("long"))
    )


@query("""SELECT date_trunc('minute', ts) AS window_start, count(*) AS requests FROM events GROUP BY 1 HAVING count(*) > 1""")
def minute_windows(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("window_start")).agg(F.count(F.lit(1)).alias("requests")).where("requests > 1")


@query(f"""
SELECT user_id, count(*) FILTER (WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 1 DAY) AS runs_24h, count(*) FILTER (WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 7 DAY) AS runs_7d,
round((epoch_us(TIMESTAMP '{NOW}') - epoch_us(max(ts))) / 3600000000.0, 4) AS age_hours, count(*) FILTER (WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 7 DAY) >= 3 AS sufficient
FROM events WHERE ts <= TIMESTAMP '{NOW}' GROUP BY user_id""")
def source_quality(spark, sf_dir):
    """Freshness and how many runs the last day and week had."""
    since = lambda days: F.count_if(F.col("ts") > at(NOW) - F.expr(f"INTERVAL '{days}' DAY"))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    rows = table(spark, sf_dir, "events").where(F.col("ts") <= at(NOW)).groupBy("user_id")
    return rows.agg(since(1).alias("runs_24h"), since(7).alias("runs_7d"), F.round((micros(at(NOW)) - micros(F.max("ts"))) / 3_600_000_000, 4).alias("age_hours")).withColumn("sufficient", F.col("runs_7d") >= 3)


@query(f"""
SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'PRESENT' WHEN ts < TIMESTAMP '{CUTOFF}' THEN 'STALE' ELSE 'STORED' END AS outcome, ts AS last_seen FROM events""")
def late_items(spark, sf_dir):
    """What is too old is not stored, yet its presence is noted; dates fall back from published to updated to first stored."""
    events = table(spark, sf_dir, "events")
    effective = F.coalesce(F.when(F.col("event_type") != "view", F.col("ts")), F.when(F.col("event_type") == "view", F.col("ts")))
    outcome = F.when(F.col("event_type").isin("view", "click"), "PRESENT").when(effective < at(CUTOFF), "STALE").otherwise("STORED")
    return events.select("event_id", outcome.alias("outcome"), F.col("ts").alias("last_seen"))


@query(f"""
WITH g AS (SELECT user_id, count(*) AS n, max(ts) AS last_ts, min(ts) AS first_ts FROM events WHERE ts <= TIMESTAMP '{NOW}' GROUP BY user_id HAVING count(*) > 1),
c AS (SELECT user_id, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_ts)) / 1000000.0 AS age, (epoch_us(last_ts) - epoch_us(first_ts)) / 1000000.0 / (n - 1) AS cadence FROM g)
SELECT user_id, round(age, 3) AS age_s, round(cadence, 3) AS cadence_s, round(age / cadence, 6) AS overdue FROM c WHERE cadence > 0 AND age > 2 * cadence""")
def collection_gaps(spark, sf_dir):
    """Sources unseen for more than twice their own cadence, by how far they are overdue."""
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    runs = table(spark, sf_dir, "events").where(F.col("ts") <= at(NOW)).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"), F.min("ts").alias("first_ts")).where("n > 1")
    aged = runs.withColumns({"age": seconds(at(NOW)) - seconds(F.col("last_ts")), "cadence": (seconds(F.col("last_ts")) - seconds(F.col("first_ts"))) / (F.col("n") - 1)})
    late = aged.where((F.col("cadence") > 0) & (F.col("age") > 2 * F.col("cadence")))
    return late.select("user_id", F.round("age", 3).alias("age_s"), F.round("cadence", 3).alias("cadence_s"), F.round(F.col("age") / F.col("cadence"), 6).alias("overdue"))


@query("""SELECT event_type, CAST(sum(greatest(CAST(round(value) AS BIGINT) - 10 - CAST(json_extract_string(props, '$.k') AS BIGINT), 0)) AS BIGINT) AS confirmed FROM events GROUP BY event_type""")
def presence_confirmed(spark, sf_dir):
    """Items seen again without being processed again: never less than none."""
    left = F.round("value").cast("long") - 10 - F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.greatest(left, F.lit(0).cast("long"))).alias("confirmed"))


@query(f"""
WITH latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE ts >= TIMESTAMP '{CUTOFF}') WHERE rn = 1)
SELECT CAST(c.c_custkey AS BIGINT) AS source_id, CASE WHEN c.c_acctbal < 0 THEN 'BLOCKED' WHEN c.c_nationkey = 0 THEN 'NOT_ENABLED' WHEN l.user_id IS NULL THEN 'NOT_RUN' WHEN l.event_type = 'error' THEN 'FAILED' WHEN l.value < 10 THEN 'ZERO' ELSE 'OK' END AS state
FROM customer c LEFT JOIN latest l ON l.user_id = c.c_custkey""")
def source_coverage(spark, sf_dir):
    """Why each source has, or has not, collected anything of late."""
    latest = latest_by(table(spark, sf_dir, "events").where(F.col("ts") >= at(CUTOFF)), ["user_id"], newest())
    joined = table(spark, sf_dir, "customer").join(latest, F.col("user_id") == F.col("c_custkey"), "left")
    state = F.when(F.col("c_acctbal") < 0, "BLOCKED").when(F.col("c_nationkey") == 0, "NOT_ENABLED").when(F.col("user_id").isNull(), "NOT_RUN").when(F.col("event_type") == "error", "FAILED").when(F.col("value") < 10, "ZERO").otherwise("OK")
    return joined.select(F.col("c_custkey").cast("long").alias("source_id"), state.alias("state"))


@query(f"""SELECT CAST(c_custkey AS BIGINT) AS source_id FROM customer WHERE EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type = 'purchase' AND ts > TIMESTAMP '{CUTOFF}')""")
def complete_run_since(spark, sf_dir):
    """Sources with a complete run after the cutoff."""
    complete = table(spark, sf_dir, "events").where((F.col("event_type") == "purchase") & (F.col("ts") > at(CUTOFF))).select(F.col("user_id").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(complete, "c_custkey", "left_semi").select(F.col("c_custkey").cast("long").alias("source_id"))


@query(f"""SELECT event_id, ts, user_id FROM events WHERE (ts > TIMESTAMP '{CUTOFF}') OR (ts = TIMESTAMP '{CUTOFF}' AND event_id > 500) ORDER BY ts, event_id LIMIT 50""")
def keyset_next_page(spark, sf_dir):
    """The page after a cursor of time and id."""
    return keyset_page(table(spark, sf_dir, "events"), ["ts", "event_id"], [at(CUTOFF), F.lit(500).cast("long")], 50).select("event_id", "ts", "user_id")


@query("""
WITH d AS (SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1000000.0 AS s FROM events)
SELECT user_id, round(avg(s), 4) AS mean_s, round(stddev_pop(s), 4) AS sd_s, count(s) AS n FROM d GROUP BY user_id""")
def run_variation(spark, sf_dir):
    """Mean and population spread of the seconds between a source's runs."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    gaps = table(spark, sf_dir, "events").withColumn("s", (micros - F.lag(micros).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))) / 1e6)
    return gaps.groupBy("user_id").agg(F.round(F.avg("s"), 4).alias("mean_s"), F.round(F.stddev_pop("s"), 4).alias("sd_s"), F.count("s").alias("n"))


@query("""SELECT user_id, string_agg(DISTINCT event_type, '+' ORDER BY event_type) AS statuses FROM events GROUP BY user_id""")
def status_set(spark, sf_dir):
    """Different statuses, sorted and joined."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), "+").alias("statuses"))


@query("""
SELECT event_type, count(DISTINCT user_id) FILTER (WHERE value > 20) AS jobs, count(*) FILTER (WHERE json_extract_string(props, '$.k') IS NULL) AS orphans,
round(CAST(count(*) FILTER (WHERE value > 50) AS DOUBLE) / nullif(count(*), 0), 6) AS success_rate FROM events GROUP BY event_type""")
def task_metrics(spark, sf_dir):
    """Jobs by task, calls without one, and the share that succeeded."""
    return (
        table(spark, sf_dir, "events")
        .groupBy("event_type")
        .agg(F.count_distinct(F.when(F.col("value") > 20, F.col("user_id"))).alias("jobs"), F.count_if(F.get_json_object("props", "$.k").isNull()).alias("orphans"), A.rate(F.count_if(F.col("value") > 50), F.count(F.lit(1))).alias("success_rate"))
    )


@query(f"""
WITH p AS (SELECT CASE WHEN ts < TIMESTAMP '{CUTOFF}' THEN 'before' ELSE 'after' END AS period, value FROM events),
t AS (SELECT period, count(*) AS requests, sum(value) AS tokens FROM p GROUP BY period)
SELECT b.requests AS before_requests, a.requests AS after_requests, round(a.tokens - b.tokens, 4) AS token_delta, round((a.tokens - b.tokens) / greatest(abs(b.tokens), 1), 6) AS relative
FROM (SELECT * FROM t WHERE period = 'before') b, (SELECT * FROM t WHERE period = 'after') a""")
def period_comparison(spark, sf_dir):
    """Two periods side by side, in one pass."""
    before = F.col("ts") < at(CUTOFF)
    sums = table(spark, sf_dir, "events").agg(
        F.count_if(before).alias("before_requests"), F.count_if(~before).alias("after_requests"), F.sum(F.when(before, F.col("value"))).alias("b"), F.sum(F.when(~before, F.col("value"))).alias("a")
    )
    delta = F.col("a") - F.col("b")
    return sums.select("before_requests", "after_requests", F.round(delta, 4).alias("token_delta"), F.round(delta / F.greatest(F.abs("b"), F.lit(1.0)), 6).alias("relative"))


@query(f"""
WITH ops AS (SELECT user_id, min(ts) AS started, max(ts) FILTER (WHERE event_type IN ('purchase', 'error')) AS ended, count(*) AS attempts, bool_or(event_type = 'error') AND bool_or(event_type = 'purchase') AS recovered FROM events GROUP BY user_id)
SELECT date_trunc('day', started) AS cohort, count(*) AS started, count(ended) AS terminal, count(*) - count(ended) AS in_flight, count(*) FILTER (WHERE recovered) AS recovered, CAST(sum(attempts) AS BIGINT) AS attempts FROM ops WHERE started < TIMESTAMP '{NOW}' GROUP BY 1""")
def operation_cohorts(spark, sf_dir):
    """Operations by the day that they started."""
    kind = F.col("event_type")
    ops = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.min("ts").alias("began"), F.max(F.when(kind.isin("purchase", "error"), F.col("ts"))).alias("ended"), F.count(F.lit(1)).alias("tries"), (F.bool_or(kind == "error") & F.bool_or(kind == "purchase")).alias("recovered_op")
    )
    return (
        ops.where(F.col("began") < at(NOW))
        .groupBy(F.date_trunc("day", "began").cast("timestamp_ntz").alias("cohort"))
        .agg(F.count(F.lit(1)).alias("started"), F.count("ended").alias("terminal"), F.count_if(F.col("ended").isNull()).alias("in_flight"), F.count_if("recovered_op").alias("recovered"), F.sum("tries").alias("attempts"))
    )


@query("""
SELECT user_id, count(*) AS n, CASE WHEN count(*) >= 10 THEN round(quantile_cont(value, 0.5), 6) END AS p50, CASE WHEN count(*) >= 10 THEN round(quantile_cont(value, 0.95), 6) END AS p95 FROM events WHERE event_type = 'view' GROUP BY user_id""")
def latency_summary(spark, sf_dir):
    """Percentiles, or nothing with too few samples."""
    n = F.count(F.lit(1))
    return table(spark, sf_dir, "events").where("event_type = 'view'").groupBy("user_id").agg(n.alias("n"), A.at_least(10, n, F.round(A.continuous("value", 0.5), 6)).alias("p50"), A.at_least(10, n, F.round(A.continuous("value", 0.95), 6)).alias("p95"))


@query("""
SELECT event_type, round(quantile_cont(value, 0.9), 6) AS continuous, quantile_disc(value, 0.9) AS nearest,
list_sort(list(value))[CAST(round_even(0.9 * (count(*) - 1), 0) AS BIGINT) + 1] AS rounded FROM events GROUP BY event_type""")
def percentile_kinds(spark, sf_dir):
    """Three definitions side by side; they differ, and reports must not mix them."""
    rows = table(spark, sf_dir, "events")
    rounded = A.rounded_index(rows, ["event_type"], "value", 0.9).withColumnRenamed("value", "rounded")
    return rows.groupBy("event_type").agg(F.round(A.continuous("value", 0.9), 6).alias("continuous"), A.nearest_rank("value", 0.9).alias("nearest")).join(rounded, "event_type", "left")


@query("""SELECT count(*) AS pairs FROM (SELECT DISTINCT user_id, event_type FROM events)""")
def distinct_pairs(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_type").distinct().agg(F.count(F.lit(1)).alias("pairs"))


@query("""
SELECT user_id, max(ts) AS last_attempt, max(ts) FILTER (WHERE event_type = 'purchase') AS last_success, max(ts) FILTER (WHERE event_type = 'error') AS last_failure FROM events GROUP BY user_id""")
def job_observations(spark, sf_dir):
    """When each job last ran, succeeded and failed, each kept by itself."""
    when = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("ts")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_attempt"), when("purchase").alias("last_success"), when("error").alias("last_failure"))


@query(f"""SELECT event_type, count(*) FILTER (WHERE ts + INTERVAL 10 DAY > TIMESTAMP '{NOW}') AS valid, count(*) FILTER (WHERE ts + INTERVAL 10 DAY <= TIMESTAMP '{NOW}') AS expired FROM events GROUP BY event_type""")
def cache_validity(spark, sf_dir):
    """Cached rows within and beyond their time to live."""
    valid = F.col("ts") + F.expr("INTERVAL '10' DAY") > at(NOW)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(valid).alias("valid"), F.count_if(~valid).alias("expired"))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT user_id, bool_and(event_type = 'error') AS failing FROM r WHERE rn <= 2 GROUP BY user_id HAVING count(*) = 2""")
def host_failing(spark, sf_dir):
    """Whether all of a host's newest two results failed."""
    last = latest_by(table(spark, sf_dir, "events"), ["user_id"], newest(), 2)
    return last.groupBy("user_id").agg(F.bool_and(F.col("event_type") == "error").alias("failing"), F.count(F.lit(1)).alias("n")).where("n = 2").drop("n")


@query("""
WITH l AS (SELECT conv_id, turn, role, length(text) AS n, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations)
SELECT conv_id, turn, role, CASE WHEN turn = last THEN n END AS response_chars FROM l""")
def attempt_records(spark, sf_dir):
    """A row for each attempt of a nested call; only the last has the response."""
    nested = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.length("text").cast("long").alias("n")))).alias("attempts"))
    rows = nested.select("conv_id", F.size("attempts").alias("size"), F.posexplode("attempts").alias("k", "a"))
    return rows.select("conv_id", "a.turn", "a.role", F.when(F.col("k") == F.col("size") - 1, F.col("a.n")).alias("response_chars"))


@query("""
SELECT event_type, 'k' AS code, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1""")
def reasons_by_status(spark, sf_dir):
    """The entries of a JSON object as rows, then counted."""
    entries = table(spark, sf_dir, "events").select("event_type", F.explode(F.from_json("props", "map<string,bigint>")).alias("code", "value"))
    return entries.groupBy("event_type", "code").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("""
WITH r AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
allowed(a, b) AS (VALUES ('view', 'click'), ('click', 'purchase'), ('signup', 'view'), ('view', 'view'), ('error', 'view'))
SELECT before, event_type AS after, count(*) AS n, bool_or(a IS NOT NULL) AS allowed FROM r LEFT JOIN allowed ON a = before AND b = event_type WHERE before IS NOT NULL GROUP BY 1, 2""")
def status_transitions(spark, sf_dir):
    """Which moves between states happened, and which of them the machine allows."""
    moves = table(spark, sf_dir, "events").withColumn("before", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("before is not null")
    counted = moves.groupBy("before", F.col("event_type").alias("after")).agg(F.count(F.lit(1)).alias("n"))
    allowed = spark.createDataFrame([("view", "click"), ("click", "purchase"), ("signup", "view"), ("view", "view"), ("error", "view")], "before string, after string")
    return with_flag(counted, allowed, ["before", "after"], "allowed").select("before", "after", "n", "allowed")
