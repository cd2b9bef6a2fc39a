"""Feed parsers on small landed files of invented records."""

import json

import pytest

from sievelake.sources import feeds

JOBS = {
    "greenhouse": {"jobs": [{"id": 1, "title": "Data Engineer", "updated_at": "2024-01-02T00:00:00Z", "location": {"name": "Remote, Brazil"}, "absolute_url": "https://x.example/1", "content": "&lt;p&gt;Hi&lt;/p&gt;", "departments": [{"name": "Data"}]}, {"id": 2, "title": None}], "meta": {"total": 2}},
    "lever": [{"id": "a", "text": "QA", "hostedUrl": "https://x.example/a", "descriptionPlain": "d", "categories": {"location": "Lisbon"}, "createdAt": 1704067200000, "salaryRange": {"min": 1, "max": 2, "currency": "EUR"}}],
    "ashby": {"jobs": [{"title": "SRE", "location": "Berlin", "secondaryLocations": [{"location": "Paris"}], "isListed": True, "jobUrl": "https://x.example/s", "publishedAt": "2024-01-03T10:00:00Z"}, {"title": "Hidden", "isListed": False}]},
    "workable": {"jobs": [{"shortcode": "W1", "title": "Dev", "url": "https://x.example/w", "location": {"city": "Porto", "country_name": "Portugal"}, "description": "short", "full_description": "long", "published_on": "2024-01-04", "state": "published"}, {"shortcode": "W2", "title": "Gone", "state": "archived"}]},
    "teamtailor": {"items": [{"id": "t", "title": "PM", "url": "https://x.example/t", "date_published": "2024-01-05T00:00:00Z", "content_html": "<p>x</p>", "_jobposting": {"validThrough": "2024-03-01", "jobLocation": [{"address": {"addressLocality": "Malmo", "addressCountry": "SE"}}], "hiringOrganization": {"name": "Own"}}}]},
    "remotive": {"jobs": [{"id": 9, "url": "https://x.example/9", "title": "Writer", "company_name": "Co", "tags": ["a"], "publication_date": "2024-01-06T00:00:00", "candidate_required_location": "Worldwide", "salary": "", "description": "d"}]},
    "hacker_news": {"children": [{"id": 5, "created_at": "2024-01-07T00:00:00Z", "text": "Acme | Backend Engineer | Remote (US) | https:&#x2F;&#x2F;acme.example<p>We build things."}, {"id": 6, "text": "just talk"}]},
}
TITLES = {"greenhouse": "Data Engineer", "lever": "QA", "ashby": "SRE", "workable": "Dev", "teamtailor": "PM", "remotive": "Writer", "hacker_news": "Backend Engineer"}


def landed(spark, tmp_path, body, name="f.json"):
    (tmp_path / name).write_text(body if isinstance(body, str) else json.dumps(body))
    return feeds.landed(spark, str(tmp_path))


@pytest.mark.parametrize("kind", sorted(JOBS))
def test_json_feeds(spark, tmp_path, kind):
    rows = feeds.collect(kind, landed(spark, tmp_path, JOBS[kind]), "Acme").collect()
    assert [r.title for r in rows] == [TITLES[kind]]
    assert tuple(rows[0].asDict()) == feeds.RECORD
    assert rows[0].source_type == kind and rows[0].external_id and rows[0].url
    assert rows[0].published_at or rows[0].updated_at


def test_details_of_some(spark, tmp_path):
    for name, body in (("wl", {"total": 2, "jobPostings": [{"title": "A", "externalPath": "/a", "locationsText": "X", "bulletFields": ["R1"]}, {"title": "B", "externalPath": "/b"}]}), ("wd", {"jobPostingInfo": {"title": "A full", "jobDescription": "d", "jobReqId": "R1", "externalPath": "/a"}}), ("il", {"jobsPage": [{"jobId": "1", "displayName": "I", "status": "published", "location": "Y"}, {"jobId": "2", "displayName": "J", "status": "draft"}]}), ("id", {"jobId": "1", "description": "d", "publishedAt": "2024-01-01", "locationComplement": "Z"})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "f.json").write_text(json.dumps(body))
    at = lambda n: feeds.landed(spark, str(tmp_path / n))
    rows = {r.external_id: r for r in feeds.workday(at("wl"), at("wd"), "Acme", "https://x.example").collect()}
    assert rows["R1"].title == "A full" and rows["R1"].description == "d" and rows["/b"].title == "B"
    rows = feeds.inhire(at("il"), at("id"), "Acme", "https://x.example/").collect()
    assert [(r.title, r.location_text) for r in rows] == [("I", "Y, Z")]


def test_pages(spark, tmp_path):
    post = {"@context": "https://schema.org", "@type": "JobPosting", "title": "T1", "url": "https://x.example/1", "hiringOrganization": {"name": "Org"}, "jobLocation": {"address": {"addressLocality": "Rome", "addressCountry": "IT"}}, "datePosted": "2024-01-01", "baseSalary": {"currency": "EUR", "value": {"minValue": 10, "maxValue": 20, "unitText": "HOUR"}}}
    wrap = lambda x: f'<html><script type="application/ld+json">{json.dumps(x)}</script></html>'
    landed(spark, tmp_path, wrap(post), "a.html")
    landed(spark, tmp_path, wrap([post | {"title": "T2"}, {"@type": "Person"}]), "b.html")
    landed(spark, tmp_path, wrap({"@graph": [post | {"title": "T3"}]}), "c.html")
    df = landed(spark, tmp_path, "<html><script type='application/ld+json'>{broken</script></html>", "d.html")
    rows = feeds.json_ld(df).collect()
    assert sorted(r.title for r in rows) == ["T1", "T2", "T3"]
    assert rows[0].location_text == "Rome, IT" and '"min":"10"' in rows[0].metadata
    assert [r.path.endswith("d.html") for r in feeds.json_ld_errors(df).collect()] == [True]


def test_offer_page(spark, tmp_path):
    page = '<ul><li class="job-offer-item x" data-id="7" data-location="Barcelona"><a href="/j/7">Cook</a></li><li>other</li></ul>'
    rows = feeds.factorial(landed(spark, tmp_path, page, "p.html"), "Acme").collect()
    assert [(r.external_id, r.title, r.location_text, r.url) for r in rows] == [("7", "Cook", "Barcelona", "/j/7")]


def test_exports_and_tables(spark, tmp_path):
    (tmp_path / "c.csv").write_text("COMPANY NAME,Website,aliases\nAcme,https://a.example,A; B;A\n,,\n")
    rows = feeds.company_export(spark, str(tmp_path / "c.csv"), "csv").collect()
    assert [(r.name, r.aliases) for r in rows] == [("Acme", ["A", "B"])]
    (tmp_path / "c.json").write_text(json.dumps({"results": [{"Company Name": "Beta", "Priority": "high"}]}))
    assert [(r.name, r.priority) for r in feeds.company_export(spark, str(tmp_path / "c.json"), "json").collect()] == [("Beta", "HIGH")]
    (tmp_path / "t.md").write_text("| Name | Link |\n|---|:-:|\n| Acme | [x](https://a.example/b) |\n")
    table = feeds.markdown_table(spark, str(tmp_path / "t.md")).collect()
    assert [r.cells for r in table] == [["Name", "Link"], ["Acme", "[x](https://a.example/b)"]] and table[1].links == ["https://a.example/b"]
    df = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, v string")
    feeds.export_rows(df, "t", str(tmp_path / "out"))
    assert sorted(map(tuple, feeds.import_rows(spark, str(tmp_path / "out"), "t", "id string, v string", {"1": "9"}).collect())) == [("2", "b"), ("9", "a")]
    feeds.write_report(df, str(tmp_path / "report"))
    with pytest.raises(Exception):
        feeds.write_report(df, str(tmp_path / "report"))
    assert [r.id for r in feeds.paged(df, "id", 1, 1).collect()] == ["2"]


def test_web_results_and_sitemaps(spark, tmp_path):
    df = landed(spark, tmp_path, {"results": [{"url": "https://A.example/x/?utm_source=q", "title": "1", "score": 0.2}, {"url": "https://a.example/x", "title": "2", "score": 0.9}]})
    assert [(r.canonical, r.title) for r in feeds.web_results(df).collect()] == [("https://a.example/x", "2")]
    maps = spark.createDataFrame([("a", "<urlset><url><loc> https://a.example/1 </loc></url></urlset>"), ("b", "<!DOCTYPE x><urlset><loc>no</loc></urlset>")], "path string, body string")
    assert [(r["loc"], r.is_index) for r in feeds.sitemap(maps).collect()] == [("https://a.example/1", False)]
    assert feeds.manual(spark, [("1", "T", "text"), ("2", " ", "none")]).count() == 1
    with pytest.raises(ValueError):
        feeds.collect("nope", df, "x")


def test_equal_scores_go_to_the_greatest_title(spark, tmp_path):
    hits = [{"url": "https://a.example/x", "title": t, "score": s} for t, s in (("b", 0.9), ("c", 0.9), ("a", 0.9), ("d", 0.1))]
    for k, order in enumerate((hits, hits[::-1])):
        at = tmp_path / str(k)
        at.mkdir()
        assert [(r.canonical, r.title, r.score) for r in feeds.web_results(landed(spark, at, {"results": order})).collect()] == [("https://a.example/x", "c", 0.9)]
