"""Near duplicates, components, neighbours, packing and the pipeline: against brute force and on odd rows."""

import functools
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from sievelake.llm import neighbours, packing, similarity
from sievelake.llm.components import components

RANKS = P.path("byte_bpe_50k.tiktoken")


def near_duplicates(rows):
    """(id, set size, least id reachable) of every row, by all pairs with a shingle in common."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets.append({tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for k, s in enumerate(sets):
        both = {}
        for t in s:
            for j in holders.setdefault(t, []):
                both[j] = both.get(j, 0) + 1
            holders[t].append(k)
        for j, n in both.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[root(k)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i), i)
    return sorted((i, len(sets[k]), least[root(k)]) for k, (i, _) in enumerate(rows))


def made_rows(seed):
    pick = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    bases = [[pick.choice(words) for _ in range(pick.randint(3, 120))] for _ in range(25)]
    passage = [pick.choice(words) for _ in range(60)]
    rows = []
    for k in range(500):
        text = list(pick.choice(bases))
        for _ in range(pick.randint(0, 5)):
            text[pick.randrange(len(text))] = pick.choice(words)
        if pick.random() < 0.2:
            text = [pick.choice(words) for _ in range(pick.randint(1, 200))]
        rows.append((k, ("\n " if pick.random() < 0.5 else " ").join(text + passage * (pick.random() < 0.3))))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "a b"), (1004, "A  b"), (1005, "a b c d e"), (3, rows[3][1]), (1006, rows[3][1]), (1007, "long " * 40_000), (1008, "LONG " * 40_001)]
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,group_sets", [(1, similarity.GROUP_SETS), (2, 7)])
def test_near_duplicates_equal_all_pairs(spark, seed, group_sets):
    rows = made_rows(seed)
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, n string, component_id long").repartition(5)
    assert sorted(tuple(r) for r in similarity.near_duplicates(df, group_sets=group_sets).collect()) == near_duplicates(rows)


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert similarity.near_duplicates(empty).count() == 0
    blank = spark.createDataFrame([(1, None), (2, ""), (None, "a")], "doc_id long, text string")
    assert sorted(map(tuple, similarity.near_duplicates(blank).collect()), key=str) == [(1, 0, 1), (2, 0, 2), (None, 1, None)]
    # rows without an id take part
    text = " ".join(f"w{k}" for k in range(40))
    found = similarity.near_duplicates(spark.createDataFrame([(None, text), (7, text + " more"), (None, text)], "doc_id long, text string")).collect()
    assert sorted((r.n_shingles, r.component_id) for r in found) == [(36, 7), (36, 7), (37, 7)]


def test_words_that_a_polynomial_hash_confuses_stay_apart(spark):
    """A Thue-Morse string and its complement agree under any polynomial modulo a power of two."""
    bits = [bin(k).count("1") % 2 for k in range(2048)]
    a, b = ("".join("ab"[x ^ flip] for x in bits) for flip in (0, 1))
    assert len(set(similarity.word_hashes(f"{a} {b} {a[1:]} {b[1:]} {a[:-1]}".encode())[1].tolist())) == 5
    other = " ".join(f"w{k}" for k in range(7))
    got = similarity.near_duplicates(spark.createDataFrame([(1, a), (2, b), (3, f"{a} {other}"), (4, f"{b} {other}")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 2), (3, 3), (4, 4)]


def test_a_chained_group_in_many_blocks(spark):
    """Texts made of common passages: one weak group of many classes, cut into blocks, loses no link."""
    pick = random.Random(11)
    passages = [[f"p{k}x{j}" for j in range(12)] for k in range(30)]
    rows = []
    for k in range(400):
        words = [w for p in pick.sample(passages, 6) for w in p]
        rows.append((k, " ".join(words)))
        if k % 3 == 0:
            words[pick.randrange(len(words))] = "changed"
            rows.append((1000 + k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, similarity.near_duplicates(df, group_sets=20).collect())) == near_duplicates(rows)


def test_a_repeated_id_with_other_texts(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text), (1, "quite another text of six words"), (2, text + " more"), (3, "quite another text of six words"), (4, text)]
    got = similarity.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(1, 2, 1), (1, 36, 1), (2, 37, 1), (3, 2, 1), (4, 36, 1)]


def test_near_duplicates_of_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert sorted(map(tuple, similarity.near_duplicates(df).collect())) == near_duplicates([tuple(r) for r in df.collect()])


def test_shingles_do_not_depend_on_batches():
    pick = random.Random(0)
    texts = ["".join(pick.choice(["ab", "C", " ", "\n", "é", "\x0b"]) for _ in range(pick.randint(0, 400))) for _ in range(60)] + ["x y " * 300_000]
    one_by_one = [similarity.shingle_sets([t])[0] for t in texts]
    for a, b in zip(one_by_one, similarity.shingle_sets(texts), strict=True):
        assert np.array_equal(a, b)


def test_divide_skip_finds_what_counting_finds():
    pick = random.Random(4)
    index, sets = similarity.Inverted(), []
    for k in range(200):
        s = sorted(pick.sample(range(80), pick.randint(1, 40)) if k % 3 else pick.sample(range(20), pick.randint(1, 20)))
        sets.append(s)
        index.add(k, s)
    for _ in range(60):
        q, least = pick.sample(range(80), pick.randint(5, 40)), pick.randint(1, 12)
        want = [(k, n) for k, s in enumerate(sets) if (n := len(set(s) & set(q))) >= least]
        assert sorted(index.search(q, least)) == want


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7), (300, 299)]
    for edges_a_task in (1000, 9):
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(6), "test", edges_a_task).collect()}
        assert got == {**{k: 0 for k in range(1, 61)}, **{100 + k: 100 for k in range(1, 50)}, 300: 299}
    assert components(spark.createDataFrame([], "a long, b long"), "test").count() == 0


def nearest(rows, queries, k=10):
    out = []
    for q in queries:
        v = dict(rows)[q]
        out += [(q, rank, i, d) for rank, (d, i) in enumerate(sorted((float(np.sqrt(((np.array(x) - v) ** 2).sum())), i) for i, x in rows if i != q)[:k], 1)]
    return out


def test_neighbours_of_odd_rows(spark):
    pick = np.random.default_rng(1)
    rows = [(k, pick.normal(size=5).tolist()) for k in range(120)] + [(k, [1.0, 2.0, 3.0, 4.0, 5.0]) for k in range(200, 260)]
    bad = [(300, None), (400, [0.0] * 5), (500, [1.0, None, 1.0, 1.0, 1.0]), (600, [float("nan")] * 5), (700, [float("inf"), 1.0, 1.0, 1.0, 1.0]), (800, [1.0]), (None, [1.0] * 5)]
    df = spark.createDataFrame([(i, v, 1.0, 2) for i, v in rows + bad], "vec_id long, embedding array<double>, score double, cell int")
    got = [tuple(r) for r in neighbours.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    want = nearest(rows, [0, 100, 200])
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want])
    few = df.where("vec_id in (0, 1, 2, 300)")
    assert neighbours.search(few, F.col("vec_id") == 0).count() == 2
    assert neighbours.search(df.where("1 = 0"), F.col("vec_id") == 0).count() == 0


def test_neighbours_are_rows_not_ids(spark):
    """Each row of a repeated id is a candidate, and a query; vectors of another length are searched among themselves."""
    rows = [(0, [1.0, 0.1]), (1, [1.0, 0.1]), (1, [0.9, 0.0]), (0, [0.5, 0.5]), (0, [1.0, 0.1]), (3, [1.0, 2.0, 3.0]), (100, [1.0, 2.0, 4.0])]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, _query string, row string")
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in neighbours.search(df, F.col("vec_id") % 100 == 0).collect())
    want = []
    for k, (i, v) in enumerate(rows):
        if i % 100 == 0:
            others = sorted((float(np.sqrt(((np.array(w) - v) ** 2).sum())), j) for n, (j, w) in enumerate(rows) if n != k and len(w) == len(v))
            want += [(i, rank, j, round(d, 6)) for rank, (d, j) in enumerate(others, 1)]
    assert got == sorted(want)


def test_neighbours_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, dtype=float)) for r in df.collect()]
    want = {(q, i) for q, _, i, _ in nearest(rows, [i for i, _ in rows if i % 100 == 0])}
    got = {(r.query_id, r.vec_id) for r in neighbours.search(df, F.col("vec_id") % 100 == 0).collect()}
    assert len(got & want) / len(want) >= 0.9


def test_walks_in_structured_vectors_hardly_grow():
    """Of vectors in clusters, a walk passes a number of entries that four times as many entries leave about as it is."""
    pick = np.random.default_rng(8)
    needed = {}
    for n in (4_000, 16_000):
        centres = pick.normal(size=(n // 40, 32)) * 5
        x = centres[pick.integers(len(centres), size=n)] + pick.normal(size=(n, 32)) * 0.3
        size = round((n / neighbours.ENTRIES_A_CELL) ** 0.5)
        a, b = neighbours.halves(x)
        c1, c2 = neighbours.centroids(a, size, 1), neighbours.centroids(b, size, 2)
        cell = neighbours.cells_of(x, c1, c2)
        counts = np.bincount(cell, minlength=len(c1) * len(c2))
        d = neighbours.squares(x[:100], x)
        d[np.arange(100), np.arange(100)] = np.inf
        import pandas as pd

        near = pd.DataFrame([(t, cell[j]) for t in range(100) for j in np.argsort(d[t])[:10]], columns=["trial", "cell"])
        needed[n] = neighbours.entries_needed(pd.DataFrame({"v": list(x[:100])}), near, c1, c2, counts, 0.95)
    assert needed[16_000] < 2 * needed[4_000] and needed[16_000] < 0.05 * 16_000


@pytest.mark.parametrize("block", [7, 50])
def test_neighbours_in_many_blocks(spark, monkeypatch, block):
    """Blocks of entries and of queries, with cells over several of both, lose nothing that the walk passes."""
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 5)
    pick = np.random.default_rng(2)
    rows = [(k, pick.normal(size=6).tolist()) for k in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r)[:3] for r in neighbours.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [w[:3] for w in nearest(rows, range(0, 400, 20))]


def test_multi_index_walk_is_in_order():
    pick = np.random.default_rng(3)
    d1, d2 = pick.random(9), pick.random(7)
    order = neighbours.walk(d1, d2, np.ones(63, int), 1e9)
    assert order == sorted(range(63), key=lambda c: d1[c // 7] + d2[c % 7])


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def plain_pieces(text, capacity=2048):
    ids = np.array(tokenizer().encode(text, add_special_tokens=False).ids + [0], dtype="<u4")
    first = len(ids) % capacity or capacity
    edges = [0, *range(min(first, len(ids)), len(ids) + 1, capacity)]
    return [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]


def test_packing(spark):
    texts = [None, "", "one <|endoftext|> two", "word " * 9000, "日本語\x00 é" * 50, "x" * 3000, "a b c"] + ["lorem ipsum " * k for k in range(1, 400, 7)]
    rows = [(k, t, 5) for k, t in enumerate(texts)] + [(6, "a b c", 5)]
    for capacity, docs in ((2048, packing.GROUP_DOCS), (2048, 9)):
        found = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, part int"), RANKS, P.PATTERN, capacity, group_docs=docs, tokenizer_path=P.path("byte_bpe_50k.json")).collect()
        got = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found)
        assert got == sorted((i, *p) for i, t, _ in rows for p in plain_pieces(t or "", capacity))
        held = {}
        for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == held.get(r.sequence_id, 0)
            held[r.sequence_id] = r.offset + r.length
        assert max(held.values()) <= capacity
        least = -(-sum(r.length for r in found) // capacity)
        assert len(held) <= least + max(1, -(-len(rows) // docs))
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), RANKS, P.PATTERN).count() == 0


def test_packing_takes_added_tokens_as_the_tokenizer_does(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    from sievelake.llm import queries

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = ["one <|endoftext|> two", end, end * 2, f"{end}\n a", f"a  {end}  {end} é", "<|endoftext|", "<|<|endoftext|>|>", f"word {end} " * 2000, None, "日本語\x00 é"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for k, t in enumerate(texts):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        want += [(k, j, a, n, zlib.crc32(ids[a : a + n].tobytes())) for j, (a, n) in enumerate(packing.pieces_of(ids, 2048))]
    for found in (queries.op2_best_fit_packing(spark, str(tmp_path)), corpus_pipeline.packing_stage(spark, docs, "")):
        assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found.collect()) == want


@pytest.mark.parametrize("low,high,n,fewer", [(300, 1000, 4000, 20), (600, 760, 1500, 40), (400, 700, 1000, 10), (1, 2047, 3000, 0), (1, 90, 3000, 0)])
def test_local_search_saves_bins_and_ends_where_no_exchange_is_left(low, high, n, fewer):
    pick = random.Random(n)
    lengths = [pick.randint(low, high) for _ in range(n)]
    bins = packing.Bins(lengths, 2048)
    bins.best_fit()
    before, squares = len(bins.items), sum(f * f for f in bins.fill)
    bins.improve()
    after, bound = sum(1 for f in bins.fill if f), -(-sum(lengths) // 2048)
    assert sorted(k for b in bins.items for k in b) == list(range(n))
    assert [sum(lengths[k] for k in b) for b in bins.items] == bins.fill and max(bins.fill) <= 2048
    assert bound <= after <= before - fewer and sum(f * f for f in bins.fill) >= squares
    assert not bins.improve()


def test_no_single_exchange_would_raise_the_squares():
    """By trying all of them: moves, one for one and two for one."""
    pick = random.Random(5)
    lengths = [pick.randint(20, 70) for _ in range(60)]
    bins = packing.Bins(lengths, 100)
    bins.best_fit()
    bins.improve()
    if sum(1 for f in bins.fill if f) == -(-sum(lengths) // 100):
        return
    for a, x in enumerate(bins.items):
        parts = [(i,) for i in x] + [(i, j) for i in x for j in x if i < j]
        for b, y in enumerate(bins.items):
            for part in parts if a != b and y else ():
                for back in (None, *y):
                    d = sum(lengths[i] for i in part) - (lengths[back] if back is not None else 0)
                    raises = (bins.fill[a] - d) ** 2 + (bins.fill[b] + d) ** 2 > bins.fill[a] ** 2 + bins.fill[b] ** 2
                    assert not (d > 0 and bins.fill[b] + d <= 100 and raises and (back is not None or len(part) == 1))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    clean = {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").where("quality = 1").collect()}
    columns = docs.columns
    clean -= {r.doc_id for r in docs.collect() if len(r.text.split()) < 50}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.written(stage(spark, docs, "/root/testdata/sf0.001"), "test")
        assert docs.columns == columns
        kept[name] = {r.doc_id for r in docs.collect()}
        if name == "near_duplicates":
            assert kept[name] == {least for _, _, least in near_duplicates([tuple(r) for r in before.select("doc_id", "text").collect()])}
        if name in ("language_id", "quality_rules"):
            assert len(clean - kept[name]) <= 0.02 * len(clean)
    assert docs.where(F.col("text").rlike("[0-9a-f]{24,}")).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert {r.doc_id for r in packed.collect()} == kept["secret_scan"]


def test_pipeline_of_odd_rows(spark):
    """Which rows each stage keeps of null ids and texts, repeated ids with other texts, copies and repeated rows."""
    import corpus_pipeline

    prose = [" ".join(f"word{k}x{j}" for j in range(60)) for k in range(4)]
    copy = prose[1] + " end"
    rows = [(1, None), (2, ""), (None, prose[0]), (3, prose[1]), (3, prose[1]), (3, prose[2]), (4, copy), (None, prose[3]), (None, prose[3]), (5, "..."), (6, "the house of water")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, salt string, id long"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1) for i, t in rows], schema)
    columns, content = docs.columns, lambda df: sorted(((r.doc_id or 0, r.text) for r in df.collect()), key=str)
    want = {
        "language_id": sorted(((i or 0, t) for i, t in rows if t and t != "..."), key=str),
        "quality_rules": sorted(((i or 0, t) for i, t in rows if t in (*prose, copy)), key=str),
        "near_duplicates": sorted([(0, prose[0]), (3, prose[1]), (3, prose[2]), (0, prose[3])], key=str),
        "secret_scan": sorted([(0, prose[0]), (3, prose[1]), (3, prose[2]), (0, prose[3])], key=str),
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, ""), "test")
        assert docs.columns == columns
        assert content(docs) == want[name], name
    assert sorted((r.doc_id or 0, r.piece) for r in corpus_pipeline.packing_stage(spark, docs, "").collect()) == [(0, 0), (0, 0), (3, 0), (3, 0)]
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        empty = corpus_pipeline.written(stage(spark, empty, ""), "test")
    assert empty.count() == 0


def test_near_duplicate_stage_keeps_one_of_each_class(spark):
    import corpus_pipeline

    text = [" ".join(f"t{k}w{j}" for j in range(30)) for k in range(5)]
    rows = [(1, text[0]), (1, text[1]), (2, text[2]), (3, text[2] + " x"), (None, text[2]), (None, text[3]), (None, text[3] + " y"), (4, None), (4, None), (5, ""), (6, text[4]), (6, text[4])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id or 0, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()), key=str)
    third = next(t for i, t in got if i == 0)
    assert third in (text[3], text[3] + " y")
    assert got == sorted([(1, text[0]), (1, text[1]), (2, text[2]), (0, third), (4, None), (4, None), (5, ""), (6, text[4])], key=str)


def test_quality_stage_of_odd_ids(spark):
    import corpus_pipeline

    good = [" ".join(f"word{k}x{j}" for j in range(60)) for k in range(4)]
    rows = [(None, good[0]), (1, good[1]), (1, "too short"), (2, good[2]), (2, good[3]), (None, "short too"), (3, None), (4, good[0]), (4, good[0])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.quality_stage(spark, docs, "")
    assert found.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in found.collect()) == sorted((i or 0, t) for i, t in rows if t in good)


def test_pipeline_keeps_columns_of_any_name(spark):
    """Names that stages use themselves come out as they went in; a corpus without languages is not dropped."""
    import corpus_pipeline

    prose = [" ".join(f"word{k}x{j}" for j in range(60)) for k in range(4)]
    rows = [(k, t, None, "s", len(t), f"own {k}", k / 2, [k], "r", "w", "d") for k, t in enumerate([*prose, prose[1], "short"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row string, _found double, _r array<int>, weight string, salt string, digest string")
    want = {r[0]: r for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, ""), "test")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "_row", "_found", "_r", "weight", "salt", "digest"]
        got = [tuple(r) for r in docs.collect()]
        assert all(r == want[r[0]] for r in got)
        assert len(got) == {"language_id": 6, "quality_rules": 5}.get(name, 4)


def test_pipeline_of_labels_that_teach_nothing(spark):
    """Labels on held-out documents only are as good as none."""
    import corpus_pipeline
    from sievelake.llm import language

    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("some words of a text").alias("text"), F.lit("en").alias("lang")).where(language.held_out())
    assert docs.count() and corpus_pipeline.language_stage(spark, docs, "").count() == docs.count()


def test_a_written_tables_shuffle_is_removed(spark):
    import time

    from sievelake.llm.common import REMOVED, written

    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for k in range(files.size()) if (f := files.apply(k).getName()).startswith("shuffle_")}

    before, conf = shuffled(), spark.conf.get(REMOVED)
    table = written(spark.range(10_000).repartition(5, "id"), "test")
    until = time.time() + 10
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before and spark.conf.get(REMOVED) == conf
    assert table.count() == 10_000
