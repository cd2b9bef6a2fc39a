"""Components with guards, and keyed state: stream, batch twin and plain Python agree."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelake.operators import entities as E
from sievelake.streaming import keyed

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def plain_clusters(links):
    of = {n: n for n, _ in links}

    def root(n):
        while of[n] != n:
            n = of[n]
        return n

    by_key = {}
    for n, k in links:
        if k is not None:
            by_key.setdefault(k, []).append(n)
    for ns in by_key.values():
        for n in ns[1:]:
            a, b = sorted((root(ns[0]), root(n)))
            of[b] = a
    return {n: root(n) for n in of}


def test_clusters_of_chains_hubs_and_the_alone(spark):
    pick = np.random.default_rng(4)
    links = [(k, f"c{k // 2}") for k in range(1, 40)] + [(k, f"c{(k + 1) // 2}") for k in range(1, 40)] + [(k, "hub") for k in range(100, 400)] + [(500, None), (500, None), (501, "x"), (399, "y"), (1000, "y")]
    links += [(int(a), f"r{int(b)}") for a, b in pick.integers(2000, 2200, (80, 2))]
    df = spark.createDataFrame([*links, (None, "hub")], "node long, key string")
    assert {r.node: r.cluster for r in E.clusters(df).collect()} == plain_clusters(links)
    assert E.clusters(df.where("1 = 0")).count() == 0


def test_a_chain_of_five_merges_is_settled_in_one_batch(spark):
    day = lambda k: dt.datetime(2024, 1, k)
    postings = spark.createDataFrame([(k, day(10 - k), 1, None) for k in range(1, 7)] + [(7, day(1), 1, None), (8, day(1), 1, None), (9, day(1), 1, 3), (10, day(1), 1, None)], "id long, created timestamp, version long, duplicate_of long")
    pairs = [(k, k + 1, 1, 1, "PENDING") for k in range(1, 6)] + [(7, 8, 1, 1, "PENDING"), (9, 10, 1, 1, "PENDING"), (7, 99, 1, 1, "PENDING"), (8, 10, 2, 1, "PENDING"), (1, 10, 1, 1, "REJECTED"), (10, 10, 1, 1, "PENDING"), (1, 2, 1, 1, "PENDING")]
    candidates = spark.createDataFrame(pairs, "a long, b long, a_version long, b_version long, status string")
    active = spark.createDataFrame([(2,), (7,), (8,), (7,)], "id long")
    decisions, moved = E.settled_merges(candidates, postings, active)
    got = {(r.a, r.b): (r.outcome, r.survivor) for r in decisions.collect()}
    assert got == {(k, k + 1): ("CONFIRM", 6) for k in range(1, 6)} | {(7, 8): ("CONFLICT", None), (9, 10): ("CYCLE", None), (7, 99): ("NOT_FOUND", None), (8, 10): ("VERSION", None), (1, 10): ("REJECTED", None), (10, 10): ("CYCLE", None)}
    assert {r.absorbed: r.survivor for r in moved.collect()} == dict.fromkeys(range(1, 6), 6)


def test_companies_by_all_their_keys(spark):
    schema = "id long, name string, domain string, aliases array<string>"
    companies = spark.createDataFrame([(-1, "acme", "acme.example", ["acme corp"]), (-2, "bolt", None, None), (-3, "cog", "cog.example", None)], schema)
    said = [(1, "acme corp", None, None), (2, "new one", "acme.example", None), (3, "bolt", "bolt.example", None), (4, "both", None, ["bolt", "cog"]), (5, "cog", "other.example", None), (6, " ", "x.example", None), (7, "fresh", "f.example", None), (8, "fresher", "f.example", ["fresh"]), (9, None, None, None), (10, "lone", "", [])]
    got = {r.candidate: (r.outcome, r.company) for r in E.reconciled(spark.createDataFrame(said, schema), companies).collect()}
    assert got == {1: ("MATCHED", -1), 2: ("MATCHED", -1), 3: ("AMBIGUOUS", None), 4: ("AMBIGUOUS", None), 5: ("AMBIGUOUS", None), 6: ("INVALID", None), 7: ("CREATED", 7), 8: ("CREATED", 7), 9: ("INVALID", None), 10: ("CREATED", 10)}
    alone = {r.candidate: r.outcome for r in E.reconciled(spark.createDataFrame([said[4]], schema), companies).collect()}
    assert alone == {5: "DOMAIN"}


def requests(seed, n=500):
    pick = np.random.default_rng(seed)
    rows, start = [], dt.datetime(2024, 1, 1)
    for k in range(n):
        host = "hot" if pick.random() < 0.4 else f"h{pick.integers(6)}"
        rows.append((host, k, start + dt.timedelta(seconds=int(pick.integers(0, 30_000))), bool(pick.random() < 0.2), float(pick.integers(1, 900)) if pick.random() < 0.1 else None))
    return sorted(rows, key=lambda r: (r[2], r[1]))


SCHEMA = "host string, request long, at timestamp, low_yield boolean, retry_after_s double"


def plain_admitted(rows, ceiling, low_ceiling, window):
    """The rules once more, host by host."""
    state, out = {}, {}
    for host, request, at, low, retry in rows:
        s = state.setdefault(host, {"begun": at, "used": 0, "until": None})
        if (at - s["begun"]).total_seconds() >= window:
            s |= {"begun": at, "used": 0}
        if s["until"] and at < s["until"]:
            out[request] = ("COOLDOWN", s["used"])
        elif s["used"] >= (low_ceiling if low else ceiling):
            out[request] = ("BUDGET", s["used"])
        else:
            s["used"] += 1
            if retry is not None:
                s["until"] = at + dt.timedelta(seconds=retry)
            out[request] = ("TAKEN", s["used"])
    return out


@pytest.mark.parametrize("window", [300, 3600])
def test_admission_stream_equals_twin_equals_plain(spark, tmp_path, window):
    rows = requests(window)
    budget = keyed.Budget(3, window, 0.4)
    want = plain_admitted(rows, 1, 3, window)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert {r.request: (r.decision, r.used) for r in keyed.admitted(df, budget).collect()} == want
    assert set(d for d, _ in want.values()) == {"TAKEN", "BUDGET", "COOLDOWN"}
    # the stream takes the same requests in four files, in their order
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        got = {}
        for k in range(4):
            spark.createDataFrame(rows[k * 125 : (k + 1) * 125], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            source = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
            keyed.admit_stream(source, budget).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
        got = {r.request: (r.decision, r.used) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    assert got == want


def test_a_hot_host_is_cut_where_its_state_begins_anew(spark):
    rows = [("hot", k, dt.datetime(2024, 1, 1) + dt.timedelta(days=k // 10, seconds=k), False, None) for k in range(100)]
    plan = keyed.admitted(spark.createDataFrame(rows, SCHEMA), keyed.Budget(5, 3600))
    assert "stretch" in plan._jdf.queryExecution().toString()
    assert plan.where("decision = 'TAKEN'").count() == 40


def test_cache_stream_equals_twin(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    at = lambda m: start + dt.timedelta(minutes=m)
    said = [("a", 0, at(0), "put", "one"), ("a", 1, at(5), "get", None), ("a", 2, at(61), "get", None), ("a", 3, at(62), "put", "two"), ("a", 4, at(30), "put", "late"), ("a", 5, at(63), "get", None), ("b", 6, at(64), "get", None), ("b", 7, at(65), "put", None), ("b", 8, at(66), "get", None), ("a", 9, at(121), "get", None), ("a", 10, at(122), "get", None), ("a", 11, at(300), "get", None), ("a", 12, at(301), "put", "three"), ("a", 13, at(302), "get", None), (None, 14, at(303), "get", None)]
    schema = "url string, seq long, at timestamp, op string, content string"
    want = {1: (True, "one"), 2: (False, None), 5: (True, "two"), 6: (False, None), 8: (True, None), 9: (True, "two"), 10: (False, None), 11: (False, None), 13: (True, "three")}
    twin = keyed.cache_reads(spark.createDataFrame(said, schema), 3600)
    assert {r.seq: (r.hit, r.content) for r in twin.collect()} == want
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        for k in range(0, len(said), 4):
            spark.createDataFrame(said[k : k + 4], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = keyed.read_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 3600, "1 hour")
            query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
            query.awaitTermination()
        left = [json.loads(p.json)["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if json.loads(p.json)["stateOperators"]]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    assert {r.seq: (r.hit, r.content) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want
    assert left and left[-1] <= 4  # what has expired is forgotten


def test_url_hash(spark):
    import hashlib

    assert spark.range(1).select(keyed.url_hash(F.lit("ü")).alias("h")).first().h == hashlib.sha256("ü".encode()).hexdigest()


def test_conflicts_of_nulls_nans_and_zeros(spark):
    from sievelake.operators import resolution as R

    rows = [(1, None, None), (1, None, float("nan")), (1, None, float("nan")), (2, "a", 0.0), (2, None, -0.0), (3, "a", 1.0), (3, "b", None), (4, "UNKNOWN", 1.0), (4, "a", 2.0)]
    value, conflict = R.merged_field("v")
    df = spark.createDataFrame(rows, "g long, v string, x double").groupBy("g").agg(value.alias("v"), conflict.alias("c"), R.merged_requirement("v").alias("r"), R.compensation_conflict("x", "x", "v", "v").alias("p"))
    assert {r.g: (r.v, r.c, r.r, r.p) for r in df.collect()} == {1: (None, False, "UNKNOWN", False), 2: ("a", False, "a", False), 3: (None, True, "UNKNOWN", True), 4: (None, True, "a", True)}


def test_hot_keys_and_labels_are_met_like_others_and_no_row_is_doubled(spark):
    links = [(k, "hub") for k in range(100, 160)] + [(k, f"p{k // 2}") for k in range(40)] + [(159, "p3")]
    df = spark.createDataFrame(links, "node long, key string")
    for most in (5, 1_000_000):
        assert {r.node: r.cluster for r in E.clusters(df, most).collect()} == plain_clusters(links)
    told = E._told(df, "key", df.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")), 5)
    assert sorted((r.node, r.key) for r in told.collect()) == sorted(links)
    # the table that is told was eight times itself before it was joined
    assert "Generate" not in told._jdf.queryExecution().optimizedPlan().toString()
