"""Batch state, resolution, scoring and streams."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from sievelake.operators import aggregates, resolution, scoring, state
from sievelake.operators.evidence import EvidenceStore
from sievelake.operators.latest import rotated, seeded_sample
from sievelake.streaming import ingest as streams

DAY = dt.timedelta(days=1)
NOW = dt.datetime(2024, 3, 1)
BATCH = "identity string, payload_hash string, semantic_hash string, fetched_at timestamp, ordinal int, published_at timestamp, updated_at timestamp, off_target boolean"


def test_ingest_in_order(spark):
    batch = spark.createDataFrame(
        [("a", "1", "1", NOW, 0, NOW, None, False), ("a", "1", "1", NOW, 1, NOW, None, False), ("b", "2", "2", NOW, 2, NOW - 90 * DAY, None, False), ("c", "3", "3", NOW, 3, None, None, True), ("d", "4", "4", NOW, 4, None, None, False), ("e", "6", "6", NOW, 5, None, None, False), ("e", "5", "5", NOW, 6, None, None, False)], BATCH
    )
    known = spark.createDataFrame([("e", "5", "5", NOW - 60 * DAY), ("f", "1", "1", NOW)], "identity string, payload_hash string, semantic_hash string, stored_at timestamp")
    got = {(r.identity, r.ordinal): r.outcome for r in state.ingest(batch, known, F.lit(NOW - 30 * DAY)).collect()}
    assert got == {("a", 0): "NEW", ("a", 1): "OBSERVED", ("b", 2): "STALE", ("c", 3): "SKIPPED", ("d", 4): "NEW", ("e", 5): "STALE", ("e", 6): "OBSERVED"}


def test_presence_closure_and_pointers(spark):
    occurrences = spark.createDataFrame([("a", NOW), ("b", NOW)], "identity string, last_seen timestamp")
    seen = spark.createDataFrame([("a", NOW - DAY), ("b", NOW + DAY)], "identity string, seen_at timestamp")
    assert {r.identity: r.last_seen for r in state.presence(occurrences, seen).collect()} == {"a": NOW, "b": NOW + DAY}
    rows = spark.createDataFrame([(1, "s", NOW - 3 * DAY, "ACTIVE"), (1, "t", NOW, "ACTIVE"), (2, "s", NOW - 3 * DAY, "ACTIVE"), (3, "s", NOW, "CLOSED"), (4, "u", NOW - 9 * DAY, "ACTIVE")], "posting_id int, source_id string, last_seen timestamp, status string")
    runs = spark.createDataFrame([("s", NOW, True), ("t", NOW, True), ("u", NOW, False)], "source_id string, started_at timestamp, complete boolean")
    assert {r.posting_id: r.status for r in state.reconcile(rows, runs).collect()} == {1: "ACTIVE", 2: "CLOSED", 3: "ACTIVE", 4: "ACTIVE"}
    old = spark.createDataFrame([(1, 5, "x"), (2, 1, "y")], "k int, at int, v string")
    new = spark.createDataFrame([(1, 4, "late"), (2, 3, "z"), (3, 1, "n")], "k int, at int, v string")
    assert {r.k: r.v for r in state.pointer(old, new, ["k"], ["at"]).collect()} == {1: "x", 2: "z", 3: "n"}


def test_refresh_retention_and_recompute(spark):
    stored = spark.createDataFrame([(1, "r", "e", NOW, 1), (2, "r", "e", NOW, 1), (3, "r", "e", NOW, 1)], "id int, family string, body string, updated_at timestamp, version int")
    candidate = spark.createDataFrame([(1, "r2", "", NOW + DAY), (2, "r", "e2", NOW - DAY)], "id int, family string, body string, updated_at timestamp")
    got = {r.id: (r.family, r.body, r.version, r.changed) for r in state.refreshed(stored, candidate, "id", ["family"], ["body"]).collect()}
    assert got == {1: ("r2", "e", 2, True), 2: ("r", "e", 1, False), 3: ("r", "e", 1, False)}
    kept, gone = state.retention(stored, [spark.createDataFrame([(1,)], "id int")], "id", F.col("id") < 3)
    assert {r.id for r in kept.collect()} == {1, 3} and {r.id for r in gone.collect()} == {2}
    once = state.recomputed(stored.withColumn("rules", F.lit("v1")), "rules", "v2", {"family": F.upper("family")})
    twice = state.recomputed(once, "rules", "v2", {"family": F.concat("family", F.lit("!"))})
    assert {r.family for r in twice.collect()} == {"R"}


def test_machines_gates_and_hits(spark):
    df = spark.createDataFrame([("ACTIVE", "CLOSED"), ("CLOSED", "STALE"), ("X", "Y")], "a string, b string")
    assert [r.x for r in df.select(state.allowed(state.POSTING_MOVES, F.col("a"), F.col("b")).alias("x")).collect()] == [True, False, False]
    rows = spark.createDataFrame([(True, 0, 0.0, 999.0, 5), (False, 0, 0.0, 999.0, 5), (True, 3, 100.0, 999.0, 5), (True, 0, 0.0, 9.0, 5), (True, 0, 0.0, 999.0, 0)], "due boolean, f int, sf double, ss double, b int")
    gate = state.gate(F.col("due"), F.col("f"), F.col("sf"), F.col("ss"), 60, F.col("b"))
    assert [r.x for r in rows.select(gate.alias("x")).collect()] == ["RUN", "NOT_DUE", "BACKOFF", "TOO_SOON", "HOST_BUDGET"]
    hits = spark.createDataFrame([("k", 1, "b", 0.5, "x"), ("k", 0, "a", 0.9, "y"), ("k", 2, "b", 0.9, "z")], "k string, ordinal int, term string, score double, excerpt string")
    got = state.merged_hits(hits, "k").collect()[0]
    assert (got.terms, got.score, got.excerpt, got.n_hits) == (["a", "b"], 0.9, "y", 3)
    versions = spark.createDataFrame([("a", 1, "h"), ("a", 2, "h"), ("a", 3, "g")], "id string, at int, semantic_hash string")
    assert [r.cosmetic for r in state.cosmetic(versions, ["id"], ["at"]).orderBy("at").collect()] == [False, True, False]


def test_resolution(spark):
    df = spark.createDataFrame([(1, "c", NOW, 1), (2, "c", NOW + 10 * DAY, 1), (3, "c", NOW + 30 * DAY, 1), (4, "d", NOW, 1)], "id int, company string, at timestamp, version int")
    pairs = lambda d=None: {(r.a, r.b) for r in resolution.candidate_pairs(df, ["company"], "id", "at", 14, d).collect()}
    assert pairs() == {(1, 2)}
    assert pairs(spark.createDataFrame([(1, 2, 1, 1)], "a int, b int, a_version int, b_version int")) == set()
    assert pairs(spark.createDataFrame([(1, 2, 1, 0)], "a int, b int, a_version int, b_version int")) == {(1, 2)}
    matches = lambda *rows: spark.createDataFrame(list(rows), "id int, target int")
    found = resolution.cascade([("url", matches((1, 10), (2, 20), (2, 21))), ("print", matches((1, 11), (2, 22)))], "id")
    assert {r.id: (r.target, r.level) for r in found.collect()} == {1: (10, "url"), 2: (22, "print")}
    rows = spark.createDataFrame([(1, "a", "REQUIRED"), (1, "b", "UNKNOWN"), (2, "a", "REQUIRED"), (2, "a", "PREFERRED")], "g int, v string, r string")
    value, conflict = resolution.merged_field("v")
    got = {r.g: (r.v, r.c, r.r) for r in rows.groupBy("g").agg(value.alias("v"), conflict.alias("c"), resolution.merged_requirement("r").alias("r")).collect()}
    assert got == {1: (None, True, "REQUIRED"), 2: ("a", False, "UNKNOWN")}


def test_scores_at_the_edges(spark):
    one = spark.range(1)
    raw = {f.name: scoring.number(1) for f in scoring.FACTORS}
    value = lambda c: one.select(c.alias("x")).collect()[0].x
    none = F.lit(None).cast(scoring.EXACT)
    assert value(scoring.score(raw)) == Decimal("100.0000")
    assert value(scoring.score(raw | {"TIMEZONE": none, "CONTRACT_COMPENSATION": none})) == Decimal("100.0000")
    assert value(scoring.score(raw | {"TECHNOLOGY_FIT": none})) == Decimal("86.2500")
    assert value(scoring.score(dict.fromkeys(raw, none), scoring.OLD)) == Decimal("50.0000")
    assert value(scoring.confidence(raw | {"RECENCY": none}, scoring.number(1))) == Decimal("0.9500")
    no = F.lit(False)
    for points, want in ((80, "HIGH_PRIORITY"), (79.9999, "RECOMMENDED"), (65, "RECOMMENDED"), (50, "WATCHLIST"), (49.9999, "LOW_MATCH")):
        assert value(scoring.verdict(F.lit(points), F.lit("ELIGIBLE"), no, no, no)) == want
    assert value(scoring.verdict(F.lit(90), F.lit("INELIGIBLE"), F.lit(True), no, no)) == "INELIGIBLE"
    assert value(scoring.verdict(F.lit(90), F.lit("UNKNOWN"), F.lit(True), no, no)) == "REVIEW_REQUIRED"
    assert value(scoring.verdict(F.lit(90), F.lit("ELIGIBLE"), no, F.lit(True), no)) == "WATCHLIST"
    tests = {scoring.TRUE: "ELIGIBLE", scoring.UNKNOWN: "UNKNOWN", scoring.FALSE: "INELIGIBLE", scoring.NOT_APPLICABLE: "ELIGIBLE"}
    for x, want in tests.items():
        assert value(scoring.eligibility([F.lit(scoring.TRUE), F.lit(x)])) == want


def test_small_helpers(spark):
    assert rotated(["a", "b", "c"], 2, 1) == ["c", "a"] and rotated([], 2, 1) == []
    df = spark.range(100)
    assert [r.id for r in seeded_sample(df, "id", 1, 5).collect()] == [r.id for r in seeded_sample(df.repartition(7), "id", 1, 5).collect()]
    assert aggregates.batch_counts(spark.createDataFrame([(1, 1), (1, 9), (2, 1)], "k int, v int"), "k", {"small": F.col("v") < 5, "large": F.col("v") > 5}).collect() == [("small", 2), ("large", 1)]


def run_stream(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None


def test_stream_to_silver_equals_batch(spark, tmp_path):
    rows = [(f"i{k % 7}", f"p{k % 5}", f"p{k % 5}", NOW, k, NOW - (k % 3) * 30 * DAY, None, k % 11 == 0) for k in range(60)]
    bronze = spark.createDataFrame(rows, BATCH)
    bronze.coalesce(1).write.parquet(str(tmp_path / "bronze"))
    silver, seen = str(tmp_path / "silver"), str(tmp_path / "seen")
    columns = "identity string, payload_hash string, semantic_hash string, stored_at timestamp, batch_id long"
    stream = spark.readStream.schema(BATCH).parquet(str(tmp_path / "bronze"))
    cut = F.lit(NOW - 45 * DAY)
    run_stream(streams.to_silver(stream, silver, seen, cut, str(tmp_path / "checkpoint")))
    twin = state.ingest(bronze, spark.createDataFrame([], columns), cut)
    key = lambda df: sorted(map(tuple, df.select("identity", "payload_hash").collect()))
    store = EvidenceStore(spark, silver, streams.SILVER)
    assert key(store.rows()) == key(twin.where("outcome = 'NEW'"))
    again = store.append(twin.where("outcome = 'NEW'").select("identity", "payload_hash", "semantic_hash", F.col("fetched_at").alias("stored_at"), F.lit(0).cast("long").alias("batch_id")), "batch-0")
    assert again == store.version() == 1 and key(store.rows()) == key(twin.where("outcome = 'NEW'"))
    assert spark.read.parquet(seen).groupBy("outcome").count().orderBy("outcome").collect() == twin.groupBy("outcome").count().orderBy("outcome").collect()


def test_stream_of_incidents_equals_batch(spark, tmp_path):
    rows = [(s, NOW + k * dt.timedelta(minutes=7), (k * (s + 3)) % 5 < 3) for s in range(4) for k in range(40)]
    runs = spark.createDataFrame(rows, "source_id long, ts timestamp, failed boolean")
    runs.coalesce(1).write.parquet(str(tmp_path / "runs"))
    out = str(tmp_path / "out")
    stream = spark.readStream.schema("source_id long, ts timestamp, failed boolean").parquet(str(tmp_path / "runs"))
    run_stream(streams.incidents(stream).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", str(tmp_path / "c")))
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    assert got == sorted(map(tuple, streams.closed_incidents(runs).collect())) and got


def test_windows_over_a_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    events.coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    run_stream(streams.tumbling(stream, "ts", "1 hour", "1 day", ["event_type"]).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")))
    got = {(r.window_start, r.event_type): r.n for r in spark.table("windows").collect()}
    want = {(r.d, r.event_type): r.n for r in events.groupBy(F.date_trunc("day", "ts").alias("d"), "event_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == want


def test_steps_of_a_composite_do_not_stop_one_another():
    from sievelake.operators import state

    def broken():
        raise ValueError("no")

    assert state.run_steps([("a", lambda: 3), ("b", broken), ("c", lambda: 1)]) == [("a", "DONE", 3), ("b", "FAILED: ValueError", 0), ("c", "DONE", 1)]
    assert state.run_steps([("a", lambda: 3)], should_stop=lambda: True) == [("a", "STOPPED", 0)]


def test_rows_of_an_absorbed_posting_move(spark):
    from sievelake.operators import state

    merges = spark.createDataFrame([(1, 2, "CONFIRM", 1, 2), (3, 4, "CYCLE", None, None)], "a long, b long, outcome string, survivor long, absorbed long")
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (4, "z"), (None, "w")], "posting long, what string")
    assert sorted((r.what, r.posting) for r in state.reparented(rows, merges, "posting").collect()) == [("w", None), ("x", 1), ("y", 1), ("z", 4)]


def test_personal_data_goes(spark):
    from sievelake.functions import text

    said = "see linkedin.com/in/me or call +55 11 91234-5678, id 12345678901, key sk-ABCDEFGHIJ1234567890 and Bearer abcdefghij.klmnop_qrst"
    record = '{"Name": "x", "a": [{"email": "y", "b": {"phone": 1, "c": 2}}]}'
    df = spark.createDataFrame([(said, record), (None, "{no json")], "t string, r string")
    got = df.select(text.mask_personal(df.t).alias("t"), text.drop_personal_keys("r").alias("r")).collect()
    assert got[0].t == "see [personal-url] or call [phone], id [tax-id], key [secret] and [secret]"
    assert [r.r for r in got] == ['{"a":[{"b":{"c":2}}]}', None]
