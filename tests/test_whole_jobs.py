"""Queries that do a whole job for which there is no SQL, against brute force in plain Python."""

import numpy as np
import pytest

from sievelake.operators.leaks import split_leaks
from sievelake.operators.nearest import nearest_by_cosine
from sievelake.operators.resolution import leaks, similar_titles
from sievelake.plans import registry
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def nearest(rows, asked, k):
    out = {}
    for q in asked:
        v = rows[q]
        out[q] = sorted((round(float(1 - v @ x / np.sqrt((v @ v) * (x @ x))), 6), i) for i, x in rows.items() if i != q and len(x) == len(v))[:k]
    return out


def compare(found, want):
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.distance, r.vec_id)):
        got.setdefault(r.query_id, []).append((r.distance, r.vec_id))
    assert {q: [i for _, i in x] for q, x in got.items()} == {q: [i for _, i in x] for q, x in want.items() if x}
    for q, x in got.items():
        assert [d for d, _ in x] == pytest.approx([d for d, _ in want[q]], abs=2e-6)


def test_every_twentieth_row_is_a_query(spark):
    rows = {r.vec_id: np.array(r.embedding, dtype=float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    compare(registry.QUERIES["cosine_nearest_whole"](spark, SF).collect(), nearest(rows, [i for i in rows if i % 20 == 0], 10))


def test_nearest_in_small_blocks_and_of_odd_rows(spark):
    pick = np.random.default_rng(2)
    good = {k: pick.normal(size=4) for k in range(90)} | {k: np.array([1.0, 2.0, 3.0, 4.0]) for k in range(100, 130)} | {200: np.array([1e200, 0.0, 0.0, 1e200]), 220: np.ones(3), 221: np.array([1.0, 0.0, 0.0])}
    bad = [(300, None), (320, [0.0] * 4), (340, [1.0, None, 1.0, 1.0]), (360, [float("nan")] * 4), (380, [float("inf"), 1.0, 1.0, 1.0]), (400, []), (None, [1.0] * 4)]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in good.items()] + bad, "vec_id long, embedding array<double>")
    for block in (7, 2048):
        scaled = good | {200: np.array([1.0, 0.0, 0.0, 1.0])}
        compare(nearest_by_cosine(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0, 5, block).collect(), nearest(scaled, [k for k in good if k % 20 == 0], 5))
    assert nearest_by_cosine(df.where("1 = 0"), "vec_id", "embedding", F.col("vec_id") % 20 == 0, 5).count() == 0


def leaking(rows):
    """Members, pairs and groups of (id, text, split, group), by comparing all."""
    sets = {}
    for i, t, split, _ in rows:
        w = (t or "").lower().split()
        if i is not None and w:
            sets[i] = (frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))), split)
    least = {s: min(i for i, (x, _) in sets.items() if x == s) for s, _ in sets.values()}
    held = [{s for s, split in sets.values() if split == k} for k in (0, 1)]
    found = [("member", i, least[s]) for i, (s, _) in sets.items()]
    found += [("pair", least[x], least[y], round(len(x & y) / len(x | y), 6)) for x in held[0] for y in held[1] if 5 * len(x & y) >= 4 * len(x | y)]
    for g in {r[3] for r in rows} - {None}:
        a, b = ([i for i, _, s, h in rows if h == g and s == k and i is not None] for k in (0, 1))
        if a and b:
            found.append(("group", min(a), min(b), g))
    return sorted(found)


def tuples(df):
    return sorted((r.kind, r.a, r.b, *([r.jaccard] if r.kind == "pair" else [r.name] if r.kind == "group" else [])) for r in df.collect())


def test_leaks_between_splits_of_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = leaking([(r.doc_id, r.text, r.doc_id % 2, r.source) for r in docs])
    assert tuples(registry.QUERIES["split_leaks_whole"](spark, SF)) == want and any(x[0] == "pair" for x in want)


def test_leaks_of_near_copies_short_texts_and_groups(spark):
    import random

    pick = random.Random(3)
    base = [f"w{k}" for k in range(60)]
    rows = [(0, "Too short", 0, "g"), (1, "too  SHORT", 1, "h"), (2, "too", 1, "h"), (3, None, 0, "g"), (4, " ", 1, "g"), (None, "too short", 1, "i")]
    for k in range(60):
        text = list(base)
        for at in range(pick.randint(0, 3)):
            text[pick.randrange(60)] = f"x{k}{at}"
        rows.append((10 + k, " ".join(text[: pick.randint(40, 60)]), k % 2, None if k % 3 else f"n{k % 7}"))
    rows += [(100 + k, " ".join(pick.choices(base[:4], k=pick.randint(1, 9))), k % 2, "i") for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, split int, grp string")
    assert tuples(split_leaks(df, "doc_id", "text", F.col("split"), "grp")) == leaking(rows)


def test_leaks_of_large_groups_in_small_blocks(spark):
    """Groups far above a block: chains of near copies, copies in both splits, a passage that all have, and an id with two texts."""
    import random

    pick = random.Random(5)
    rows, common = [], [f"c{k}" for k in range(12)]
    for g in range(3):
        text = [f"g{g}w{k}" for k in range(50)]
        for k in range(40):
            text = list(text)
            text[pick.randrange(50)] = f"y{g}{k}"
            rows.append((1000 * g + k, " ".join(text + common), k % 3 % 2, "i"))
    rows += [(9000 + k, rows[k][1].upper(), 1, None) for k in range(0, 40, 4)] + [(9100 + k, " ".join([*common, *(f"z{k}{n}" for n in range(pick.randint(0, 60)))]), k % 2, None) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, split int, grp string")
    want = leaking(rows)
    assert sum(x[0] == "pair" for x in want) > 80
    for block in (7, 256):
        assert tuples(split_leaks(df, "doc_id", "text", F.col("split"), "grp", block)) == want


def test_a_texts_shingles_are_one_set_however_it_is_hashed():
    from sievelake.operators.leaks import CHUNK, shingle_sets

    long = "one two three four five six seven " * (CHUNK // 20)
    texts = ["a b", None, "", " ", "a  b", long, "a b c d e f", long + "x"]
    together = [s.tolist() for s in shingle_sets(texts)]
    assert together == [s.tolist() for t in texts for s in shingle_sets([t])]
    assert [len(s) for s in together] == [1, 0, 0, 0, 1, 7, 2, 8] and together[0] == together[4]


def test_a_short_item_leaks(spark):
    docs = spark.createDataFrame([(1, "yes Of course"), (2, "yes of course not so")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "Yes of course")], "item_id long, text string")
    assert [tuple(r) for r in leaks(docs, items, "doc_id", "item_id", 0.5).collect()] == [(1, 7, 1, 1.0)]


def alike_titles(rows, least):
    """All pairs of keys, and their ratio, of (key, block, title)."""
    from difflib import SequenceMatcher

    names = {}
    for k, block, t in rows:
        if t is not None and k is not None:
            names.setdefault((block, t), []).append(k)
    out, ordered = [], sorted((min(ks), block, t) for (block, t), ks in names.items() if block is not None)
    out += [("member", k, min(ks), 1.0) for ks in names.values() for k in ks]
    for n, (a, block, t) in enumerate(ordered):
        for b, other, u in ordered[n + 1 :]:
            if other == block and (r := SequenceMatcher(None, t, u).ratio()) >= least:
                out.append(("pair", a, b, round(r, 6)))
    return sorted(out)


def test_titles_of_one_brand_and_size(spark):
    parts = spark.read.parquet(f"{SF}/part.parquet").collect()
    found = registry.QUERIES["likely_same_titles"](spark, SF).collect()
    assert sorted(map(tuple, found)) == alike_titles([(r.p_partkey, f"{r.p_brand}/{r.p_size}", f"{r.p_name} {r.p_type}") for r in parts], 0.55)


def test_equal_titles_and_hot_blocks(spark):
    rows = [(k, "hot", f"title {k % 23} of {k % 5}") for k in range(120)] + [(200, "x", "same"), (201, "x", "same"), (202, "y", "same"), (203, "x", None), (None, "x", "same"), (204, None, "same"), (205, None, "same")]
    df = spark.createDataFrame(rows, "k long, block string, title string")
    for size in (7, 512):
        assert sorted(map(tuple, similar_titles(df, "k", "block", "title", 0.8, size).collect())) == alike_titles(rows, 0.8)


def test_all_sentences_of_an_answer_are_covered_or_not(spark, tmp_path):
    turns = [(1, 0, "user", "one two three four"), (1, 1, "assistant", "One. Two. Three. Four. Five. Six"), (2, 0, "user", "one"), (2, 1, "assistant", "One. One")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r.conv_id: r.coverage for r in registry.QUERIES["summary_measures"](spark, str(tmp_path)).collect()}
    assert found == pytest.approx({1: 4 / 6, 2: 1.0})
