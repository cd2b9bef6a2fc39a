"""The inverted table finds and ranks as a scan of all documents does, and as plain Python does."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelake.functions import search
from sievelake.operators.inverted import Index

WORDS = "data engineer senior remote cloud python spark the of lead team rights all reserved license".split()


def made(n, seed):
    pick = np.random.default_rng(seed)
    text = lambda most: " ".join(pick.choice(WORDS, pick.integers(0, most)))
    return [(k, text(5), text(4), text(60), text(3)) for k in range(n)]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "id long, a string, b string, c string, d string")
    return df.select("id", search.document(*map(F.col, "abcd")).alias("d"))


def plain(rows, query):
    """id -> rank, every run of places tried."""
    weights, out = list(search.WEIGHTS.values()), {}
    for i, *fields in rows:
        places, at = [], 0
        for k, f in enumerate(fields):
            stems = search.terms(f)
            places += [(at + j, w, k) for j, w in enumerate(stems)]
            at += len(stems) + 1
        stands = {(p, k): w for p, w, k in places}
        begins = lambda phrase: [(p, k) for p, _, k in places if all(not w or stands.get((p + j, k)) == w for j, w in enumerate(phrase))]
        found = [sorted({x for phrase in g for x in begins(phrase)}) for g in query.groups]
        if not found or not all(found) or any(begins(p) for p in query.excluded):
            continue
        edges = sorted({p for g in found for p, _ in g})
        covers = [(a, b) for a in edges for b in edges if a <= b and all(any(a <= p <= b for p, _ in g) for g in found)]
        least = [(a, b) for a, b in covers if not any((c, d) != (a, b) and a <= c and d <= b for c, d in covers)]
        total = 0
        for a, b in least:
            last = [max((p, k) for p, k in g if a <= p <= b) for g in found]
            n = len(found)
            total += int(1_000_000 * (n / sum(1 / weights[k] for _, k in last)) / (1 + max(b - a + 1 - n, 0)))
        out[i] = total / 1_000_000
    return out


QUERIES = ("data", "data engineer", '"data engineer" cloud', "senior OR lead python", 'data -"all rights"', '"team of lead"', "license reserved rights", "nothing here", "the", "data engineer senior remote cloud python spark lead team rights license -reserved")


@pytest.mark.parametrize("asked", QUERIES)
def test_index_equals_a_scan(spark, tmp_path_factory, asked, index):
    rows, found = index
    query = search.parse(asked)
    want = plain(rows, query)
    assert {r.id: r["rank"] for r in found.matches(query).collect()} == pytest.approx(want)
    scanned = frame(spark, rows).where(search.matches(F.col("d"), query)).select("id", search.rank(F.col("d"), query).alias("rank"))
    assert {r.id: r["rank"] for r in scanned.collect()} == pytest.approx(want)
    best = found.best(query, 5)
    top = sorted(want.items(), key=lambda x: (-x[1], x[0]))[:5]
    assert sorted(((r.id, r["rank"]) for r in best.rows.collect()), key=lambda x: (-x[1], x[0])) == top
    assert best.blocks_read <= best.blocks


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = made(400, 1)
    return rows, Index(spark, f"file://{tmp_path_factory.mktemp('index')}").add(frame(spark, rows))


def test_every_word_of_a_long_query_counts():
    asked = search.parse("one two three four five six seven eight nine ten eleven twelve -thirteen")
    assert len(asked.groups) == 12 and asked.excluded == (("thirteen",),)


def test_batches_replace_documents(spark, tmp_path):
    first, second = made(40, 2), made(20, 3)
    gone = [(39, None, "", None, "")]
    index = Index(spark, f"file://{tmp_path}").add(frame(spark, first)).add(frame(spark, second)).add(frame(spark, gone))
    now = second + first[20:39]
    for asked in ("data", "python OR spark team"):
        query = search.parse(asked)
        want = plain(now, query)
        assert {r.id: r["rank"] for r in index.matches(query).collect()} == pytest.approx(want)
        top = sorted(want.items(), key=lambda x: (-x[1], x[0]))[:3]
        assert sorted(((r.id, r["rank"]) for r in index.best(query, 3).rows.collect()), key=lambda x: (-x[1], x[0])) == top


def test_a_search_reads_its_terms_and_ends_early(spark, index, tmp_path):
    query = search.parse("python")
    plan = index[1].matches(query)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "In(term" in plan.replace("EqualTo(term", "In(term")
    rows = [(k, "rare" if k == 7 else None, None, "rare " + "word " * (k % 300), None) for k in range(2000)]
    long = Index(spark, f"file://{tmp_path}").add(frame(spark, rows)).best(search.parse("rare"), 1)
    assert [r.id for r in long.rows.collect()] == [7] and long.blocks_read < long.blocks


def test_documents_are_taken_apart_where_they_are_read(spark, tmp_path):
    """Every place of every document was shuffled by document and term; only ids that stand twice need it."""
    import pyarrow as pa

    from sievelake.operators import inverted

    place = pa.list_(pa.struct([("term", pa.string()), ("code", pa.int32())]))
    at = lambda *x: [{"term": t, "code": c} for t, c in x]
    batch = pa.RecordBatch.from_arrays([pa.array([5, 6, 7], pa.int64()), pa.array([1, 2, 3], pa.int32()), pa.array([at(("b", 9), ("a", 4), ("b", 2)), [], at(("b", 0))], place)], ["id", "block", "p"])
    got = [tuple(r.values()) for b in inverted._postings(iter([batch])) for r in b.to_pylist()]
    assert sorted(got) == [("a", 1, 5, [4]), ("b", 1, 5, [2, 9]), ("b", 3, 7, [0])]
    rows = [(1, "data", "", "engineer data", ""), (1, "", "cloud", "data", ""), (2, "data", "", "", ""), (None, "data", "", "", "")]
    found = Index(spark, f"file://{tmp_path}/index").add(frame(spark, rows))
    assert {(r.term, r.id) for r in found.postings().collect()} == {("data", 1), (search.stem("engineer"), 1), ("cloud", 1), ("data", 2)}
