"""Dead letters, sitemaps and native sections."""

import datetime as dt
import gzip
import json
import zlib

import pytest
from pyspark.sql import functions as F

from sievelake.functions import text
from sievelake.sources import feeds, inbound, sitemaps

GOOD = {"greenhouse": {"id": 1, "title": "T"}, "lever": {"id": "1", "text": "T"}, "ashby": {"id": "1", "title": "T"}, "workable": {"shortcode": "1", "title": "T"}, "teamtailor": {"id": "1", "title": "T"}, "remotive": {"id": 1, "title": "T", "company_name": "c"}, "hacker_news": {"id": 1, "text": "Acme | Engineer | Remote<p>x"}}


def body(source, items):
    key = inbound.LAYOUTS[source].items
    return json.dumps(items if key is None else {key: items})


@pytest.mark.parametrize("source", sorted(inbound.LAYOUTS))
def test_a_corrupt_file_of_each_feed_is_listed_with_its_reason(spark, source):
    layout = inbound.LAYOUTS[source]
    item = GOOD[source]
    no_title = {k: v for k, v in item.items() if k != layout.title}
    no_id = {k: v for k, v in item.items() if k not in layout.ids}
    bad_time = item | ({layout.times[0]: "soon"} if layout.times else {})
    files = [("cut", body(source, [item])[:-3]), ("none", None), ("blank", " \n"), ("shape", '{"x": 1}'), ("text", '"jobs"'), ("mixed", body(source, [item, no_title, 7, no_id, bad_time])), ("empty", body(source, []))]
    records, dead = inbound.isolated(source, spark.createDataFrame(files, "path string, body string"), "Acme")
    got = sorted((r.path, -1 if r.ordinal is None else r.ordinal, r.reason) for r in dead.collect())
    want = [("blank", -1, "EMPTY"), ("cut", -1, "MALFORMED"), ("mixed", 1, "NO_TITLE"), ("mixed", 2, "NOT_A_RECORD"), ("mixed", 3, "NO_ID"), ("none", -1, "EMPTY"), ("shape", -1, "NO_ITEMS"), ("text", -1, "NO_ITEMS")]
    if layout.times:
        want.append(("mixed", 4, "BAD_TIME"))
    assert got == sorted(want)
    assert records.count() == 2  # the good one, and the one without a readable time


def test_corrupt_pages_are_listed(spark):
    offer = '<li class="job-offer-item" data-id="1"><a href="/1">Dev</a></li>'
    pages = spark.createDataFrame([("good", offer), ("bare", '<li class="job-offer-item"></li>'), ("other", "<p>x</p>"), ("none", None)], "path string, body string")
    records, dead = inbound.isolated("factorial", pages, "Acme")
    assert records.count() == 1 and {(r.path, r.reason) for r in dead.collect()} == {("bare", "NO_TITLE"), ("other", "NO_ITEMS"), ("none", "EMPTY")}
    ld = lambda s: f'<script type="application/ld+json">{s}</script>'
    posting = json.dumps({"@type": "JobPosting", "title": "Dev"})
    pages = spark.createDataFrame([("good", ld(posting) + ld("{broken")), ("untitled", ld('{"@type": "JobPosting"}')), ("other", ld('{"@type": "Person"}'))], "path string, body string")
    records, dead = inbound.isolated("json_ld", pages, "")
    assert records.count() == 1 and {(r.path, r.reason) for r in dead.collect()} == {("good", "MALFORMED"), ("untitled", "NO_TITLE"), ("other", "NO_ITEMS")}


def test_dead_letters_from_run_to_run(spark):
    at = lambda n: F.lit(dt.datetime(2024, 1, n))
    dead = lambda rows: spark.createDataFrame([("lever", *r, "raw") for r in rows], inbound.DEAD)
    files = lambda *paths: spark.createDataFrame([("lever", p) for p in paths], "source_type string, path string")
    table = spark.createDataFrame([], inbound.ATTEMPTS)
    runs = [([("a", 1, "NO_ID"), ("a", 1, "NO_ID"), ("b", None, "EMPTY")], ("a", "b")), ([("a", 1, "NO_TITLE")], ("a", "b")), ([("a", 1, "NO_TITLE"), ("b", None, "EMPTY")], ("a", "b", "c")), ([], ("c",))]
    for k, (rows, paths) in enumerate(runs):
        table = spark.createDataFrame(inbound.attempted(table, dead(rows), files(*paths), at(k + 1), most=3).collect(), inbound.ATTEMPTS)
    got = {(r.path, r.ordinal): (r.reason, r.attempts, r.first_seen.day, r.last_seen.day, r.status) for r in table.collect()}
    assert got == {("a", 1): ("NO_TITLE", 3, 1, 3, "GIVEN_UP"), ("b", None): ("EMPTY", 1, 3, 3, "OPEN")}


def test_landed_files_as_a_stream_are_those_of_a_batch(spark, tmp_path):
    for k in range(6):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"f{k}.json").write_text(body("lever", [{"id": f"{k}-{j}", "text": f"T{j}\n"} for j in range(3)]))
    source = f"file://{tmp_path}/in"
    batch = feeds.collect("lever", feeds.landed(spark, source), "Acme").select("external_id", "title")
    for _ in range(2):  # the second run goes on where the first one stopped, and finds nothing new
        rows = feeds.collect("lever", inbound.landed_stream(spark, source), "Acme").select("external_id", "title")
        rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(tuple, batch.collect())) and batch.count() == 18


def test_sitemap_files_are_inflated_within_bounds():
    xml = b"<urlset>" + b"".join(b"<url><loc> https://x/%d?a=1&amp;b=2 </loc></url>" % k for k in range(20_000)) + b"</urlset>"
    index, found, reason = sitemaps.locations(gzip.compress(xml))
    assert (index, len(found), reason) == (False, 20_000, None) and found[7] == "https://x/7?a=1&b=2"
    assert sitemaps.locations(xml)[1] == found
    bomb = gzip.compress(b" " * 30_000_000)
    assert sitemaps.locations(bomb)[2] == "BOMB" and sitemaps.locations(gzip.compress(xml), most_bytes=1000)[2] == "TOO_LARGE"
    assert sitemaps.locations(gzip.compress(xml)[:-30])[2] == "BROKEN" and sitemaps.locations(b"\x1f\x8bnothing")[2] == "BROKEN"
    assert sitemaps.locations(b"<!DOCTYPE x><loc>a</loc>")[2] == "DOCTYPE" and sitemaps.locations(b"")[2] == "NO_LOCATIONS"
    assert sitemaps.locations(b"<ns:sitemapindex><ns:loc><![CDATA[u]]></ns:loc></ns:sitemapindex>") == (True, ["u"], None)
    assert max(len(p) for p in sitemaps.pieces(gzip.compress(zlib.compress(xml) + xml))) <= sitemaps.PIECE


def test_a_cycle_of_sitemaps_ends(spark):
    loc = lambda *urls: "".join(f"<loc>{u}</loc>" for u in urls)
    files = [("a", f"<sitemapindex>{loc('b', 'c', 'gone')}</sitemapindex>"), ("b", f"<sitemapindex>{loc('a', 'c')}</sitemapindex>"), ("c", f"<urlset>{loc('p', 'q')}</urlset>"), ("unread", loc("z"))]
    df = spark.createDataFrame([(u, b.encode()) for u, b in files], "url string, content binary")
    got = {(r.sitemap, r.depth, r.loc, r.reason) for r in sitemaps.crawl(df, spark.createDataFrame([("a",), (None,)], "url string")).collect()}
    assert got == {("a", 0, "b", None), ("a", 0, "c", None), ("a", 0, "gone", None), ("b", 1, "a", None), ("b", 1, "c", None), ("c", 1, "p", None), ("c", 1, "q", None), ("gone", 1, None, "MISSING")}
    assert sitemaps.crawl(df, spark.createDataFrame([], "url string")).count() == 0


ODD = ["", " ", "\n\n", "Heading:\nbody. More\n\n\nRequirements\n- x!\n- y\nPrivacy policy text\nmore\n\nSalary: USD 5", "## Über uns\nwe are\r\nSALÁRIO\n\x1cR$ 5\x85\n\xa0About us\nremote\nx", "no space" * 40, "a b. c d? e\nf", "Equal opportunity\n\n\n\n\nx\n  \nFollow us\nVISA ok\nno", "é. ü! " * 30, "x" * 300]


@pytest.mark.parametrize("limit", [5, 40, 400])
def test_sections_are_native_and_the_same(spark, limit):
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(-1, None)], "k int, t string")
    out = df.select("k", text.truncate_at_sentence(F.col("t"), limit).alias("cut"), text.fit_by_section(F.col("t"), limit).alias("fit"), text.clean_description(F.col("t")).alias("clean"), text.section_parts(F.col("t")).alias("parts"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.k: r for r in out.collect()}
    for k, t in enumerate(texts):
        assert got[k].cut == text.at_sentence(t, limit), t[:200]
        assert got[k].fit == text.fitted(t, limit), t[:200]
        assert got[k].clean == text.without_boilerplate(t), t[:200]
        assert [(p.first, p.text) for p in got[k].parts] == text.sections(t), t[:200]
    assert got[-1].cut is None and got[-1].fit is None and got[-1].clean is None
