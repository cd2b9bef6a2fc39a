"""The evidence store opens only what may hold a batch's identities, and its versions are all or nothing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelake.operators.evidence import Conflict, EvidenceStore, bloom_of, may_hold

SCHEMA = "identity string, payload_hash string, stored_at long"


def rows(spark, ids, at):
    return spark.createDataFrame([(i, f"p{i}", at) for i in ids], SCHEMA)


def test_a_filter_never_misses():
    pick = np.random.default_rng(1)
    held = pick.integers(-(2**63), 2**63 - 1, 5000)
    bloom = bloom_of(held)
    assert all(may_hold(bloom, held[k : k + 1]) for k in range(0, 5000, 7))
    others = pick.integers(-(2**63), 2**63 - 1, 2000)
    assert sum(may_hold(bloom, others[k : k + 1]) for k in range(2000)) < 60
    assert not may_hold(bloom, held[:0]) and may_hold(bloom_of(held[:1]), held[:1])


def test_files_read_grow_with_the_batch(spark, tmp_path):
    store = EvidenceStore(spark, f"file://{tmp_path}", SCHEMA, buckets=4)
    assert store.lookup(rows(spark, ["a"], 0)).count() == 0 and store.version() == 0
    for k in range(5):
        assert store.append(rows(spark, [f"i{k * 100 + j}" for j in range(100)] + [None], k), f"b{k}") == k + 1
    total = store.manifest().count()
    assert store.rows().count() == 500 and total >= 15
    few = store.lookup(rows(spark, ["i7", "nowhere"], 9))
    assert [(r.identity, r.stored_at) for r in few.collect()] == [("i7", 0)]
    small, large = len(store.files_for(rows(spark, ["i7"], 9))), len(store.files_for(rows(spark, [f"i{k}" for k in range(0, 500, 3)], 9)))
    assert small <= 3 < large <= total and len(few.inputFiles()) <= 4 + 4
    assert sorted(r.identity for r in store.lookup(rows(spark, [f"i{k}" for k in range(0, 500, 50)], 9)).collect()) == sorted(f"i{k}" for k in range(0, 500, 50))


def test_versions_are_atomic_and_replays_change_nothing(spark, tmp_path):
    store = EvidenceStore(spark, f"file://{tmp_path}", SCHEMA, buckets=2)
    store.append(rows(spark, ["a", "b", "b"], 1), "one")
    assert store.append(rows(spark, ["a", "b", "b"], 1), "one") == 1 and store.rows().count() == 3
    base = store.version()
    store.append(rows(spark, ["c"], 2), "two")
    with pytest.raises(Conflict):  # a writer that began before "two" was committed
        store._commit(store.manifest(base), base)
    assert sorted(r.identity for r in store.rows().collect()) == ["a", "b", "b", "c"]
    store.append(rows(spark, ["a"], 3), "three")
    before = sorted(map(tuple, store.rows().collect()))
    version, n = store.version(), store.manifest().count()
    assert store.compact() == version + 1
    assert sorted(map(tuple, store.rows().collect())) == before and store.manifest().where("bucket >= 0").count() < n
    assert store.append(rows(spark, ["c"], 2), "two") == version + 1  # still known
    assert sorted((r.identity, r.stored_at) for r in store.lookup(rows(spark, ["a"], 0)).collect()) == [("a", 1), ("a", 3)]
    assert store.clean(keep=1) > 0 and sorted(map(tuple, store.rows().collect())) == before
    assert store.rows().where(F.col("identity").isNull()).count() == 0
