"""Vector codes and shards: against plain versions, on hot groups, and on odd rows."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest

from sievelake.llm import codes, shards


def plain_codes(rows, rounds=4):
    """Every round from all vectors, in Python's whole numbers; rows (id, vector, label)."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for n in {-(-len(v) // 4) * 4 for _, v, _ in kept}:
        mine = [(i, v + [0] * (-len(v) % 4), label) for i, v, label in kept if -(-len(v) // 4) * 4 == n]
        mine.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        width = n // 4
        cut = [[v[k * width : (k + 1) * width] for k in range(4)] for _, v, _ in mine]
        books = [[c[k] for c in cut[:256]] for k in range(4)]
        best = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), j) for j, e in enumerate(book))
        for _ in range(rounds):
            for k in range(4):
                parts = collections.defaultdict(list)
                for c in cut:
                    parts[best(c[k], books[k])[1]].append(c[k])
                for j, ps in parts.items():
                    books[k][j] = [sum(x) // len(ps) for x in zip(*ps, strict=True)]
        digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
        for (i, v, label), c in zip(mine, cut, strict=True):
            found = [best(c[k], books[k]) for k in range(4)]
            out.setdefault((i, label, tuple(v)), []).append(("".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found), digest))
    errors = collections.Counter()
    for (_, label, _), found in out.items():
        errors[label] += sum(e for _, e, _ in found)
    return sorted(((-9 if i is None else i, code, error, errors[label], digest) for (i, label, _), found in out.items() for code, error, digest in found), key=str)


SCHEMA = "vec_id long, embedding array<double>, label int, x string, code string"


def coded(df):
    return sorted(((-9 if r.vec_id is None else r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in codes.digests(df).collect()), key=str)


def test_codes_equal_a_plain_lloyd(spark):
    pick = np.random.default_rng(5)
    centres = pick.normal(size=(40, 8))
    rows = [(int(i), [float(x) for x in centres[pick.integers(40)] * 0.3 + pick.normal(size=8) * 0.05], None if i % 3 else int(i % 5), "x", "y") for i in pick.permutation(420)]
    assert coded(spark.createDataFrame(rows, SCHEMA).repartition(5)) == plain_codes([r[:3] for r in rows])


def test_codes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(1, [0.1, 0.2, 0.3, 0.4]), (1, [0.1, 0.2, 0.3, 0.5]), (2, None), (3, [nan, 0.0, 0.0, 0.0]), (4, [inf, 0.0, 0.0, 0.0]), (5, [None, 0.0, 0.0, 0.0]), (None, [0.0, -0.0, 0.5, -0.0001]), (6, [0.0] * 4), (6, [0.0] * 4), (7, []), (8, [1.0, 2.0, 3.0, 4.0, 5.0]), (9, [1e9, -1e9, 3.5e11, -2e10]), (10, [0.1, 0.2, 0.3, 0.4])]
    rows = [(i, v, None if i == 6 else 1, "x", "y") for i, v in vectors]
    df = spark.createDataFrame(rows, SCHEMA)
    assert coded(df) == plain_codes([r[:3] for r in rows])
    assert codes.digests(df.where("1 = 0")).count() == 0
    huge = spark.createDataFrame([(1, [1e300, -1e300, 0.0, 0.0], 1, "x", "y"), (2, [0.0] * 4, 1, "x", "y")], SCHEMA)
    assert codes.digests(huge).count() == 2


def test_codes_shuffle_only_what_moved():
    """A part that stayed where it was adds nothing; one that moved takes away there and adds here."""
    import pyarrow as pa

    x = pa.array([[1, 2, 3, 4], [5, 6, 7, 8]], pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_pydict({"x": x, "old": pa.array([bytes([0, 0, 0, 0]), bytes([1, 1, 1, 1])]), "code": pa.array([bytes([0, 0, 0, 0]), bytes([1, 1, 2, 1])])})
    got = {(r["part"], r["entry"], r["position"]): r["high"] * codes.HALF + r["low"] for b in codes._changes(iter([batch])) for r in b.to_pylist()}
    assert got == {(2, 1, -1): -1, (2, 1, 0): -7, (2, 2, -1): 1, (2, 2, 0): 7}


def test_codes_decode_to_their_entries(spark):
    rows = [(i, [i / 10, -i / 7, 0.25, 1.0], 1, "x", "y") for i in range(20)]
    encoded, books = codes.encode(spark.createDataFrame(rows, SCHEMA))
    for r in codes.decode(encoded, books).collect():
        assert r.error == sum((a - round(1024 * b)) ** 2 for a, b in zip(r.x, r.decoded, strict=True))


def greedy(sizes, capacity):
    n, at = 1, 0
    for s in sizes:
        if at + s > capacity:
            n, at = n + 1, 0
        at += s
    return n


def least_capacity(sizes, n):
    """By trying every capacity that some run of groups adds up to."""
    runs = sorted({sum(sizes[a:b]) for a in range(len(sizes)) for b in range(a + 1, len(sizes) + 1)})
    return next(c for c in runs if c >= max(sizes) and greedy(sizes, c) <= n)


@pytest.mark.parametrize("seed, n, hot", [(1, 4, 0), (2, 7, 0), (3, 5, 60), (4, 16, 400), (5, 3, 3)])
def test_shards_hold_the_least_that_they_can(spark, monkeypatch, seed, n, hot):
    monkeypatch.setattr(shards, "MOST_GROUPS", 3 if seed % 2 else 65_536)
    pick = np.random.default_rng(seed)
    texts = ["x" * int(pick.integers(0, 60)) + str(pick.integers(0, 40)) for _ in range(70)] + ["the same"] * hot + [None, "", "ü" * 30]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    rows = shards.sharded(df, n).collect()
    assert len(rows) == len(texts) and all(0 <= r.shard < n for r in rows)
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in enumerate(texts)}
    place = collections.defaultdict(set)
    for r in rows:
        place[texts[r.doc_id] or ""].add(r.shard)
    assert all(len(s) == 1 for s in place.values())
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # groups above a fair share stand alone; the others' greatest shard is the least that any cut gives
    hashes = {r.doc_id: r.g for r in df.select("doc_id", shards.group_of("text").alias("g")).collect()}
    size = collections.Counter()
    for r in rows:
        size[hashes[r.doc_id]] += r.size
    alone, left, k = [], sum(size.values()), n
    for g, s in sorted(size.items(), key=lambda x: (-x[1], x[0])):
        if k == 1 or s * k <= left:
            break
        alone, left, k = [*alone, g], left - s, k - 1
    filled = collections.Counter()
    for r in rows:
        if hashes[r.doc_id] not in alone:
            filled[r.shard] += r.size
    others = [size[g] for g in sorted(size) if g not in alone]
    assert max(filled.values()) <= least_capacity(others, k)
    assert hot < 400 or alone


def test_shards_of_odd_rows(spark):
    rows = [(1, None, "a"), (1, "", "b"), (None, "x", "c"), (None, "x", "c"), (2, "long " * 200_000, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    found = shards.sharded(df.withColumn("slot", df.shard).withColumn("g", df.shard).withColumn("_file", df.shard))
    got = sorted((r.size, r.slot) for r in found.collect())
    assert [s for s, _ in got] == [1, 1, 2, 2, 1_000_001]
    assert shards.sharded(df.where("1 = 0")).count() == 0
    planned = shards.plan(df, 3)
    assert {r.s for r in df.select(planned.of(shards.group_of("text")).alias("s")).collect()} == {0, 1, 2}
