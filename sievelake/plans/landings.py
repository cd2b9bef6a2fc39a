"""Feeds end to end: the parts table written as each layout's landed documents, a document for each brand, and read back as records."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelake.plans.base import query, table
from sievelake.session import scratch
from sievelake.sources import feeds, inbound, sitemaps

#: What a posting of each part says: the SQL twin of offered().
OFFERED = """
WITH o AS (SELECT p_partkey AS id, p_brand AS brand, CASE WHEN p_size % 10 > 0 THEN p_name || ' of ' || p_brand END AS title, 'https://x.example/' || p_partkey AS url, CASE p_size % 3 WHEN 0 THEN 'Lisbon' WHEN 1 THEN 'Porto, Portugal' END AS place,
  p_type AS body, CAST('2024-01-01' AS DATE) + CAST(p_size AS INTEGER) AS day, p_size FROM part)
"""
RECORDS = "SELECT CAST(id AS VARCHAR) AS external_id, url, title, {company} AS company_name, {place} AS location_text, {body} AS description, {day} AS published FROM o WHERE title IS NOT NULL"


def records_sql(company: str = "'Acme'", place: str = "place", body: str = "body", day: str = "day") -> str:
    return OFFERED + RECORDS.format(company=company, place=place, body=body, day=day)


def offered(spark, sf_dir):
    size = F.col("p_size")
    title = F.when(size % 10 > 0, F.concat_ws(" of ", "p_name", "p_brand"))
    place = F.when(size % 3 == 0, "Lisbon").when(size % 3 == 1, "Porto, Portugal")
    day = F.date_add(F.lit("2024-01-01").cast("date"), size)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), title.alias("title"), F.concat(F.lit("https://x.example/"), F.col("p_partkey").cast("string")).alias("url"), place.alias("place"), F.col("p_type").alias("body"), F.concat(day.cast("string"), F.lit("T00:00:00")).alias("day"), size.alias("p_size"))


#: A landed document holds items of so many numbers at most, so it does not grow with the table.
DOCUMENT_ITEMS = 2_000


def documents_of(rows, item, key: str | None):
    """Landed documents of each brand, of DOCUMENT_ITEMS numbers each: their items under the key, or as a bare list."""
    listed = F.collect_list(item)
    body = F.to_json(F.struct(listed.alias(key))) if key else F.to_json(listed)
    return rows.groupBy("brand", F.floor(F.col("id") / DOCUMENT_ITEMS)).agg(body.alias("body")).select(F.col("brand").alias("path"), "body")


def read(records):
    return records.select("external_id", "url", "title", "company_name", "location_text", "description", F.col("published_at").cast("date").alias("published"))


@query(records_sql())
def feed_greenhouse(spark, sf_dir):
    item = F.struct("id", "title", F.struct(F.col("place").alias("name")).alias("location"), F.col("url").alias("absolute_url"), F.col("body").alias("content"), F.col("day").alias("first_published"))
    return read(feeds.collect("greenhouse", documents_of(offered(spark, sf_dir), item, "jobs"), "Acme"))


@query(records_sql(day="NULL::DATE"))
def feed_lever(spark, sf_dir):
    item = F.struct(F.col("id").cast("string").alias("id"), F.col("title").alias("text"), F.col("url").alias("hostedUrl"), F.col("body").alias("descriptionPlain"), F.struct(F.col("place").alias("location")).alias("categories"))
    return read(feeds.collect("lever", documents_of(offered(spark, sf_dir), item, None), "Acme"))


@query(OFFERED + """SELECT CAST(id AS VARCHAR) AS external_id, url, title, 'Acme' AS company_name, nullif(concat_ws('; ', place, CASE WHEN p_size % 4 = 0 THEN 'Paris' END), '') AS location_text, body AS description, day AS published FROM o WHERE title IS NOT NULL AND p_size % 5 <> 1""")
def feed_ashby(spark, sf_dir):
    """Only what is listed; second places stand after the first."""
    second = F.when(F.col("p_size") % 4 == 0, F.array(F.struct(F.lit("Paris").alias("location")))).otherwise(F.array().cast("array<struct<location:string>>"))
    item = F.struct(F.col("id").cast("string").alias("id"), "title", F.col("place").alias("location"), second.alias("secondaryLocations"), (F.col("p_size") % 5 != 1).alias("isListed"), F.col("body").alias("descriptionHtml"), F.col("day").alias("publishedAt"), F.col("url").alias("jobUrl"))
    return read(feeds.collect("ashby", documents_of(offered(spark, sf_dir), item, "jobs"), "Acme"))


@query(OFFERED + """SELECT CAST(id AS VARCHAR) AS external_id, url, title, 'Acme' AS company_name, CASE WHEN place IS NULL THEN 'Oslo, Norway' ELSE place END AS location_text, CASE WHEN p_size % 2 = 0 THEN body || ' in full' ELSE body END AS description, day AS published FROM o WHERE title IS NOT NULL AND p_size % 7 <> 3""")
def feed_workable(spark, sf_dir):
    """Published ones only; the full text before the short one, a whole place before its parts."""
    place = F.struct(F.col("place").alias("location_str"), F.lit("Oslo").alias("city"), F.lit("Norway").alias("country_name"))
    item = F.struct(F.col("id").cast("string").alias("shortcode"), "title", "url", place.alias("location"), F.col("body").alias("description"), F.when(F.col("p_size") % 2 == 0, F.concat("body", F.lit(" in full"))).alias("full_description"), F.col("day").alias("published_on"), F.when(F.col("p_size") % 7 == 3, "archived").otherwise("published").alias("state"))
    return read(feeds.collect("workable", documents_of(offered(spark, sf_dir), item, "jobs"), "Acme"))


@query(records_sql(company="CASE WHEN p_size % 2 = 0 THEN 'Own' ELSE 'Acme' END", place="coalesce(place || ', PT', 'PT')"))
def feed_teamtailor(spark, sf_dir):
    address = F.struct(F.col("place").alias("addressLocality"), F.lit("PT").alias("addressCountry"))
    posting = F.struct(F.array(F.struct(address.alias("address"))).alias("jobLocation"), F.when(F.col("p_size") % 2 == 0, F.struct(F.lit("Own").alias("name"))).alias("hiringOrganization"))
    item = F.struct(F.col("id").cast("string").alias("id"), "title", "url", F.col("day").alias("date_published"), F.col("body").alias("content_html"), posting.alias("_jobposting"))
    return read(feeds.collect("teamtailor", documents_of(offered(spark, sf_dir), item, "items"), "Acme"))


@query(OFFERED + """SELECT CASE WHEN p_size % 2 = 0 THEN 'R' || id ELSE '/' || id END AS external_id, 'https://x.example/' || id AS url, CASE WHEN p_size % 2 = 0 THEN title || ' in full' ELSE title END AS title, 'Acme' AS company_name, CASE WHEN p_size % 2 = 0 THEN 'Rome' ELSE place END AS location_text, CASE WHEN p_size % 2 = 0 THEN body END AS description, CASE WHEN p_size % 2 = 0 THEN day END AS published FROM o WHERE title IS NOT NULL""")
def feed_workday(spark, sf_dir):
    """A list, and details of half of its rows."""
    rows, path = offered(spark, sf_dir), F.concat(F.lit("/"), F.col("id").cast("string"))
    listed = documents_of(rows, F.struct("title", path.alias("externalPath"), F.col("place").alias("locationsText")), "jobPostings")
    detail = F.struct(F.struct(F.concat("title", F.lit(" in full")).alias("title"), F.col("body").alias("jobDescription"), F.concat(F.lit("R"), F.col("id").cast("string")).alias("jobReqId"), F.lit("Rome").alias("location"), F.col("day").alias("startDate"), path.alias("externalPath")).alias("jobPostingInfo"))
    return read(feeds.workday(listed, rows.where("p_size % 2 = 0").select(F.to_json(detail).alias("body")), "Acme", "https://x.example"))


@query(OFFERED + """SELECT CAST(id AS VARCHAR) AS external_id, url, title, 'Acme' AS company_name, nullif(concat_ws(', ', place, CASE WHEN p_size % 2 = 0 THEN 'Centro' END), '') AS location_text, CASE WHEN p_size % 2 = 0 THEN body END AS description, CASE WHEN p_size % 2 = 0 THEN day END AS published FROM o WHERE title IS NOT NULL AND p_size % 7 <> 3""")
def feed_inhire(spark, sf_dir):
    rows, key = offered(spark, sf_dir), F.col("id").cast("string").alias("jobId")
    listed = documents_of(rows, F.struct(key, F.col("title").alias("displayName"), F.when(F.col("p_size") % 7 == 3, "draft").otherwise("published").alias("status"), F.col("place").alias("location")), "jobsPage")
    details = rows.where("p_size % 2 = 0").select(F.to_json(F.struct(key, F.col("body").alias("description"), F.col("day").alias("publishedAt"), F.lit("Centro").alias("locationComplement"))).alias("body"))
    return read(feeds.inhire(listed, details, "Acme", "https://x.example/"))


@query(records_sql(body="NULL::VARCHAR", day="NULL::DATE"))
def feed_factorial(spark, sf_dir):
    """Offers of a page's list items."""
    place = F.when(F.col("place").isNotNull(), F.concat(F.lit(' data-location="'), F.col("place"), F.lit('"'))).otherwise("")
    item = F.concat(F.lit('<li class="job-offer-item x" data-id="'), F.col("id").cast("string"), F.lit('"'), place, F.lit('><a href="'), F.col("url"), F.lit('">'), F.coalesce("title", F.lit("")), F.lit("</a></li><li>else</li>"))
    pages = offered(spark, sf_dir).groupBy("brand").agg(F.concat(F.lit("<ul>"), F.array_join(F.collect_list(item), ""), F.lit("</ul>")).alias("body")).select(F.col("brand").alias("path"), "body")
    return read(feeds.collect("factorial", pages, "Acme"))


@query(records_sql(company="brand"))
def feed_remotive(spark, sf_dir):
    item = F.struct("id", "url", "title", F.col("brand").alias("company_name"), F.col("day").alias("publication_date"), F.col("place").alias("candidate_required_location"), F.col("body").alias("description"))
    return read(feeds.collect("remotive", documents_of(offered(spark, sf_dir), item, "jobs"), ""))


@query(records_sql(company="brand", place="CASE WHEN p_size % 2 = 0 THEN 'Remote (US)' END"))
def feed_hacker_news(spark, sf_dir):
    """Comments whose first line is cut by bars."""
    place = F.when(F.col("p_size") % 2 == 0, " | Remote (US)").otherwise("")
    text = F.concat(F.col("brand"), F.coalesce(F.concat(F.lit(" | "), F.col("title")), F.lit("")), place, F.lit(" | "), F.replace(F.col("url"), F.lit("/"), F.lit("&#x2F;")), F.lit("<p>"), F.col("body"))
    return read(feeds.collect("hacker_news", documents_of(offered(spark, sf_dir), F.struct("id", F.col("day").alias("created_at"), text.alias("text")), "children"), ""))


def embedding_pages(spark, sf_dir):
    """A page for each part: a posting by itself, in a list, in a graph, or a script that is broken."""
    rows = offered(spark, sf_dir)
    post = F.to_json(F.struct(F.lit("JobPosting").alias("@type"), "title", "url", F.struct(F.col("id").cast("string").alias("value")).alias("identifier"), F.struct(F.col("brand").alias("name")).alias("hiringOrganization"), F.struct(F.struct(F.col("place").alias("addressLocality"), F.lit("PT").alias("addressCountry")).alias("address")).alias("jobLocation"), F.col("body").alias("description"), F.col("day").alias("datePosted")))
    way = F.col("p_size") % 4
    held = F.when(way == 0, post).when(way == 1, F.concat(F.lit('[{"@type": "Person"}, '), post, F.lit("]"))).when(way == 2, F.concat(F.lit('{"@graph": ['), post, F.lit("]}"))).otherwise(F.lit("{broken"))
    return rows.select(F.col("id").cast("string").alias("path"), F.concat(F.lit('<html><script type="application/ld+json">'), held, F.lit("</script></html>")).alias("body"))


@query(records_sql(company="brand", place="coalesce(place || ', PT', 'PT')") + " AND p_size % 4 < 3")
def feed_json_ld(spark, sf_dir):
    return read(feeds.collect("json_ld", embedding_pages(spark, sf_dir), ""))


@query(OFFERED + "SELECT CAST(id AS VARCHAR) AS path FROM o WHERE p_size % 4 = 3")
def feed_json_ld_errors(spark, sf_dir):
    """Pages without a posting are told by name."""
    return feeds.json_ld_errors(embedding_pages(spark, sf_dir))


@query(OFFERED + """SELECT 'https://x.example/p' || id % 50 AS canonical, arg_max(title, (CAST(p_size * 1000 + id % 997 AS DOUBLE), title)) AS title, CAST(max(p_size * 1000 + id % 997) AS DOUBLE) AS score FROM o WHERE title IS NOT NULL GROUP BY 1""")
def feed_web_results(spark, sf_dir):
    """Search results by canonical address: the best of each."""
    score = (F.col("p_size") * 1000 + F.col("id") % 997).cast("double")
    address = F.concat(F.lit("https://X.example/p"), (F.col("id") % 50).cast("string"), F.when(F.col("id") % 2 == 0, "/?utm_source=a").otherwise("#top"))
    hits = documents_of(offered(spark, sf_dir).where("title IS NOT NULL"), F.struct(address.alias("url"), "title", F.col("body").alias("content"), score.alias("score")), "results")
    best = feeds.web_results(hits)
    return best.select("canonical", "title", "score")


@query(OFFERED + """SELECT brand AS path, url AS loc, CAST(right(brand, 1) AS INTEGER) % 2 = 0 AS is_index FROM o WHERE right(brand, 1) <> '3'""")
def feed_sitemap(spark, sf_dir):
    """Addresses of sitemaps and of indexes of them; documents with a type definition are refused."""
    last = F.right("brand", F.lit(1))
    locs = F.array_join(F.collect_list(F.concat(F.lit("<url><loc> "), F.col("url"), F.lit("\n</loc></url>"))), "")
    maps = offered(spark, sf_dir).groupBy("brand", F.floor(F.col("id") / DOCUMENT_ITEMS)).agg(locs.alias("locs"))
    head = F.when(last == "3", '<!doctype x><urlset>').when(last.cast("int") % 2 == 0, "<sitemapindex>").otherwise("<urlset>")
    return feeds.sitemap(maps.select(F.col("brand").alias("path"), F.concat(head, F.col("locs")).alias("body")))


@query(OFFERED + """, d AS (SELECT *, brand || '/' || id // 200 AS path, right(brand, 1) AS last, row_number() OVER (PARTITION BY brand, id // 200 ORDER BY id) - 1 AS ordinal FROM o), s AS (SELECT unnest(['greenhouse', 'lever', 'teamtailor']) AS source_type)
SELECT DISTINCT source_type, path, CAST(NULL AS INTEGER) AS ordinal, CASE last WHEN '3' THEN 'MALFORMED' WHEN '4' THEN 'EMPTY' ELSE 'NO_ITEMS' END AS reason FROM d, s WHERE last IN ('3', '4', '5')
UNION ALL SELECT source_type, path, CAST(ordinal AS INTEGER), CASE WHEN title IS NULL THEN 'NO_TITLE' WHEN id % 13 = 0 THEN 'NO_ID' ELSE 'BAD_TIME' END FROM d, s WHERE last NOT IN ('3', '4', '5') AND (title IS NULL OR id % 13 = 0 OR (id % 17 = 0 AND source_type <> 'lever'))""")
def feed_dead_letters(spark, sf_dir):
    """What can't be read of landed files of which some are cut off, empty or of another shape, and some items lack what they must have: each with its reason."""
    rows = offered(spark, sf_dir).withColumn("doc", F.floor(F.col("id") / 200))
    key, day = F.when(F.col("id") % 13 > 0, F.col("id").cast("string")), F.when(F.col("id") % 17 == 0, "soon").otherwise(F.col("day"))
    found = []
    for source_type, at, item in (
        ("greenhouse", "jobs", F.struct(key.alias("id"), "title", day.alias("first_published"))),
        ("lever", None, F.struct(key.alias("id"), F.col("title").alias("text"))),
        ("teamtailor", "items", F.struct(key.alias("id"), "title", day.alias("date_published"))),
    ):
        listed = F.array_sort(F.collect_list(F.struct(F.col("id").alias("n"), item.alias("item"))))["item"]
        body = F.to_json(F.struct(listed.alias(at))) if at else F.to_json(listed)
        docs = rows.groupBy("brand", "doc").agg(body.alias("body"))
        last = F.right("brand", F.lit(1))
        broken = F.when(last == "3", F.substr("body", F.lit(1), F.length("body") - 3)).when(last == "4", "  ").when(last == "5", '{"other": []}').otherwise(F.col("body"))
        landed = docs.select(F.concat_ws("/", "brand", F.col("doc").cast("string")).alias("path"), broken.alias("body"))
        found.append(inbound.isolated(source_type, landed, "Acme")[1].drop("raw"))
    return found[0].unionByName(found[1]).unionByName(found[2])


ROOT = "https://x.example/root.xml"


@F.pandas_udf(T.BinaryType())
def gzipped(texts: pd.Series) -> pd.Series:
    return pd.Series([gzip.compress(t.encode()) for t in texts], dtype=object)


@query(OFFERED + """, f AS (SELECT DISTINCT brand, id // 500 AS doc, right(brand, 1) AS last, 'https://x.example/' || replace(brand, '#', '') || '-' || id // 500 || '.xml' AS name FROM o), root AS (SELECT 'https://x.example/root.xml' AS root),
e AS (SELECT url, brand, id // 500 AS doc FROM o)
SELECT root AS sitemap, 0 AS depth, true AS is_index, unnest([name, root, 'https://x.example/none.xml']) AS loc, CAST(NULL AS VARCHAR) AS reason FROM (SELECT DISTINCT root, name FROM root, f) WHERE false
UNION ALL SELECT root, 0, true, name, NULL FROM root, f UNION ALL SELECT root, 0, true, root, NULL FROM root UNION ALL SELECT root, 0, true, 'https://x.example/none.xml', NULL FROM root
UNION ALL SELECT 'https://x.example/none.xml', 1, false, NULL, 'MISSING'
UNION ALL SELECT name, 1, false, NULL, 'DOCTYPE' FROM f WHERE last = '3'
UNION ALL SELECT name, 1, true, root, NULL FROM f, root WHERE last = '7' UNION ALL SELECT name, 1, true, name || '.deep', NULL FROM f WHERE last = '7'
UNION ALL SELECT name || '.deep', 2, false, url, NULL FROM f JOIN e USING (brand, doc) WHERE last = '7'
UNION ALL SELECT name, 1, false, url, NULL FROM f JOIN e USING (brand, doc) WHERE last NOT IN ('3', '7')""")
def sitemap_frontier(spark, sf_dir):
    """All addresses that a root index leads to, by indexes of indexes, one of which leads back; some files are packed, one is missing, some are refused."""
    rows = offered(spark, sf_dir).withColumn("doc", F.floor(F.col("id") / 500).cast("string"))
    name, last = F.concat(F.lit("https://x.example/"), F.replace("brand", F.lit("#"), F.lit("")), F.lit("-"), F.col("doc"), F.lit(".xml")), F.right("brand", F.lit(1))
    loc = lambda c: F.concat(F.lit("<loc>"), c, F.lit("</loc>"))
    maps = rows.groupBy("brand", "doc").agg(F.array_join(F.collect_list(loc(F.col("url"))), "").alias("urls")).select(name.alias("url"), last.alias("last"), "urls")
    plain = F.concat(F.lit("<urlset>"), F.col("urls"), F.lit("</urlset>"))
    up = F.concat(F.lit("<sitemapindex>"), loc(F.lit(ROOT)), loc(F.concat("url", F.lit(".deep"))), F.lit("</sitemapindex>"))
    body = F.when(F.col("last") == "3", F.concat(F.lit("<!doctype x>"), plain)).when(F.col("last") == "7", up).otherwise(plain)
    files = maps.select("url", F.when(F.col("last").isin("0", "2", "4", "6", "8"), gzipped(body)).otherwise(F.encode(body, "utf-8")).alias("content"))
    deep = maps.where("last = '7'").select(F.concat("url", F.lit(".deep")).alias("url"), F.encode(plain, "utf-8").alias("content"))
    named = maps.agg(F.array_join(F.collect_list(loc(F.col("url"))), "").alias("urls"))
    root = named.select(F.lit(ROOT).alias("url"), F.encode(F.concat(F.lit("<sitemapindex>"), "urls", loc(F.lit(ROOT)), loc(F.lit("https://x.example/none.xml")), F.lit("</sitemapindex>")), "utf-8").alias("content"))
    return sitemaps.crawl(files.union(deep).union(root), spark.createDataFrame([(ROOT,)], "url string"))


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def exported_suppliers(spark, sf_dir):
    """A table written as lines of JSON with its name, and read back from among others."""
    path = scratch(spark, "export")
    feeds.export_rows(table(spark, sf_dir, "supplier"), "supplier", f"{path}/supplier")
    feeds.export_rows(table(spark, sf_dir, "region"), "region", f"{path}/region")
    return feeds.import_rows(spark, f"{path}/*", "supplier", "s_suppkey bigint, s_name string, s_acctbal double")


@query("SELECT c_name AS name, CASE WHEN c_custkey % 3 > 0 THEN 'https://' || c_custkey || '.example' END AS website, CASE WHEN c_custkey % 2 = 0 THEN 'a' || c_custkey || '|b' || c_custkey END AS aliases, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS priority FROM customer WHERE c_custkey % 11 > 0")
def company_exports(spark, sf_dir):
    """Companies from a CSV export: headings in any case, aliases split, each once, rows without a name left out."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(F.when(k % 11 > 0, F.col("c_name")).alias("COMPANY Name"), F.when(k % 3 > 0, F.concat(F.lit("https://"), k.cast("string"), F.lit(".example"))).alias("Website"), F.when(k % 2 == 0, F.concat(F.lit("a"), k.cast("string"), F.lit("; b"), k.cast("string"), F.lit(";;a"), k.cast("string"))).alias("aliases"), F.when(k % 5 > 0, F.lower("c_mktsegment")).alias("PRIORITY"))
    path = scratch(spark, "companies")
    rows.write.csv(path, header=True)
    found = feeds.company_export(spark, path, "csv")
    return found.select("name", "website", F.array_join("aliases", "|").alias("aliases"), "priority")


@query("SELECT n_name AS name, 'https://x.example/' || n_nationkey AS link, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def markdown_catalogue(spark, sf_dir):
    """Rows of pipe tables in landed files: cells, and the links in them; heads, rules and prose are passed over."""
    line = F.concat(F.lit("| ["), "n_name", F.lit("](https://x.example/"), F.col("n_nationkey").cast("string"), F.lit(") | "), F.col("n_regionkey").cast("string"), F.lit(" |"))
    path = scratch(spark, "markdown")
    table(spark, sf_dir, "nation").select(F.concat(F.lit("Some prose.\n\n| Name | Region |\n|:---|---:|\n"), line)).write.text(path)
    rows = feeds.markdown_table(spark, path).where(F.size("links") > 0)
    return rows.select(F.regexp_extract(F.get("cells", F.lit(0)), r"\[(.*?)\]", 1).alias("name"), F.get("links", F.lit(0)).alias("link"), F.get("cells", F.lit(1)).alias("region"))


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey LIMIT 7 OFFSET 14")
def third_page(spark, sf_dir):
    """A page of a full scan: its size is the feature."""
    return feeds.paged(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey", 7, 2)


@query("SELECT l_shipmode AS mode, n FROM (SELECT l_returnflag AS l_shipmode, count(*) AS n FROM lineitem GROUP BY 1)")
def written_report(spark, sf_dir):
    """A report as an immutable file of JSON, read back."""
    path = scratch(spark, "report")
    feeds.write_report(table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("mode")).agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.schema("mode string, n long").json(path)
