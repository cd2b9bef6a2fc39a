"""Feeds as tables: one parser for each layout, all to the same record.

Landed files are read as text by Spark, a document in a row; built-in JSON functions take them apart. Only the layouts that
are no JSON (pages, comments) go through a parser of their own, in Arrow batches.
"""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelake.functions.text import visible_text
from sievelake.functions.urls import canonicalize_url

RECORD = ("source_type", "external_id", "url", "title", "company_name", "location_text", "description", "published_at", "updated_at", "valid_through", "metadata")


def landed(spark: SparkSession, path: str) -> DataFrame:
    """One row for each landed file: its path and whole content."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("body"))


def parsed(df: DataFrame, schema: str, body: str = "body") -> DataFrame:
    """The body as a struct, read leniently: fields that a record lacks are null."""
    return df.withColumn("r", F.from_json(body, schema))


def record(df: DataFrame, source_type: str, **fields: Column) -> DataFrame:
    """The common record; what a layout does not have is null. Rows without a title are no postings."""
    null = F.lit(None).cast("string")
    given = {"source_type": F.lit(source_type), **fields}
    times = ("published_at", "updated_at", "valid_through")
    columns = [(given[n].try_cast("timestamp") if n in times and n in given else F.lit(None).cast("timestamp") if n in times else F.nullif(F.btrim(given[n].cast("string")), F.lit("")) if n in given else null).alias(n) for n in RECORD]
    return df.select(*columns).where("title is not null")


def greenhouse(df: DataFrame, company: str) -> DataFrame:
    schema = "jobs array<struct<id:long,title:string,updated_at:string,first_published:string,location:struct<name:string>,absolute_url:string,content:string,departments:array<struct<name:string>>>>, meta struct<total:long>"
    jobs = parsed(df, schema).select(F.explode("r.jobs").alias("j"), F.col("r.meta.total").alias("announced"))
    meta = F.to_json(F.struct(F.col("j.departments")["name"].alias("departments"), "announced"))
    return record(jobs, "greenhouse", external_id=F.col("j.id"), url=F.col("j.absolute_url"), title=F.col("j.title"), company_name=F.lit(company), location_text=F.col("j.location.name"), description=F.col("j.content"), published_at=F.col("j.first_published"), updated_at=F.col("j.updated_at"), metadata=meta)


def lever(df: DataFrame, company: str) -> DataFrame:
    schema = "array<struct<id:string,text:string,hostedUrl:string,descriptionPlain:string,categories:struct<commitment:string,department:string,location:string,team:string>,workplaceType:string,salaryRange:struct<min:double,max:double,currency:string,interval:string>,createdAt:long>>"
    posts = parsed(df, schema).select(F.explode("r").alias("j"))
    created = F.timestamp_millis(F.col("j.createdAt"))
    meta = F.to_json(F.struct("j.categories", "j.workplaceType", "j.salaryRange"))
    return record(posts, "lever", external_id=F.col("j.id"), url=F.col("j.hostedUrl"), title=F.col("j.text"), company_name=F.lit(company), location_text=F.col("j.categories.location"), description=F.col("j.descriptionPlain"), published_at=created, metadata=meta)


def ashby(df: DataFrame, company: str) -> DataFrame:
    """Only what is listed."""
    schema = "jobs array<struct<id:string,title:string,location:string,secondaryLocations:array<struct<location:string>>,department:string,isListed:boolean,isRemote:boolean,workplaceType:string,descriptionHtml:string,publishedAt:string,employmentType:string,compensation:struct<scrapeableCompensationSalarySummary:string,summaryComponents:array<struct<compensationType:string,interval:string,currencyCode:string,minValue:double,maxValue:double>>>,jobUrl:string>>"
    jobs = parsed(df, schema).select(F.explode(F.filter("r.jobs", lambda j: F.coalesce(j["isListed"], F.lit(True)))).alias("j"))
    place = F.concat_ws("; ", "j.location", F.col("j.secondaryLocations")["location"])
    meta = F.to_json(F.struct("j.department", "j.workplaceType", "j.isRemote", "j.employmentType", "j.compensation"))
    return record(jobs, "ashby", external_id=F.coalesce("j.id", "j.jobUrl"), url=F.col("j.jobUrl"), title=F.col("j.title"), company_name=F.lit(company), location_text=place, description=F.col("j.descriptionHtml"), published_at=F.col("j.publishedAt"), metadata=meta)


def workable(df: DataFrame, company: str) -> DataFrame:
    schema = "jobs array<struct<shortcode:string,title:string,url:string,location:struct<location_str:string,city:string,country_name:string,telecommuting:boolean,workplace_type:string>,description:string,full_description:string,published_on:string,created_at:string,state:string>>"
    jobs = parsed(df, schema).select(F.explode("r.jobs").alias("j")).where("coalesce(j.state, 'published') = 'published'")
    place = F.coalesce("j.location.location_str", F.concat_ws(", ", "j.location.city", "j.location.country_name"))
    return record(jobs, "workable", external_id=F.col("j.shortcode"), url=F.col("j.url"), title=F.col("j.title"), company_name=F.lit(company), location_text=place, description=F.coalesce("j.full_description", "j.description"), published_at=F.coalesce("j.published_on", "j.created_at"), metadata=F.to_json(F.col("j.location")))


def teamtailor(df: DataFrame, company: str) -> DataFrame:
    """A JSON feed whose items embed a posting."""
    schema = "items array<struct<id:string,title:string,url:string,date_published:string,content_html:string,_jobposting:struct<validThrough:string,jobLocation:array<struct<address:struct<addressLocality:string,addressCountry:string>>>,hiringOrganization:struct<name:string>,employmentType:string>>>"
    items = parsed(df, schema).select(F.explode("r.items").alias("j"))
    address = F.get(F.col("j._jobposting.jobLocation"), F.lit(0))["address"]
    place = F.concat_ws(", ", address["addressLocality"], address["addressCountry"])
    return record(items, "teamtailor", external_id=F.col("j.id"), url=F.col("j.url"), title=F.col("j.title"), company_name=F.coalesce("j._jobposting.hiringOrganization.name", F.lit(company)), location_text=place, description=F.col("j.content_html"), published_at=F.col("j.date_published"), valid_through=F.col("j._jobposting.validThrough"), metadata=F.to_json(F.struct("j._jobposting.employmentType")))


def list_with_details(listed: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """A list's rows with their details where these were fetched; a detail that is missing leaves the row as it was."""
    return listed.join(details, key, "left")


def workday(lists: DataFrame, details: DataFrame, company: str, base: str) -> DataFrame:
    listed = parsed(lists, "total long, jobPostings array<struct<title:string,externalPath:string,locationsText:string,postedOn:string,bulletFields:array<string>>>").select(F.explode("r.jobPostings").alias("j")).select("j.*")
    found = parsed(details, "jobPostingInfo struct<id:string,title:string,jobDescription:string,jobReqId:string,location:string,startDate:string,externalPath:string>").select("r.jobPostingInfo.*").select("externalPath", F.col("title").alias("full_title"), "jobDescription", "jobReqId", "location", "startDate")
    rows = list_with_details(listed, found, "externalPath")
    return record(rows, "workday", external_id=F.coalesce("jobReqId", F.get("bulletFields", F.lit(0)), "externalPath"), url=F.concat(F.lit(base), "externalPath"), title=F.coalesce("full_title", "title"), company_name=F.lit(company), location_text=F.coalesce("location", "locationsText"), description=F.col("jobDescription"), published_at=F.col("startDate"), metadata=F.to_json(F.struct("postedOn", "bulletFields")))


def inhire(lists: DataFrame, details: DataFrame, company: str, base: str) -> DataFrame:
    listed = parsed(lists, "jobsPage array<struct<jobId:string,displayName:string,status:string,workplaceType:string,location:string>>").select(F.explode("r.jobsPage").alias("j")).select("j.*").where("coalesce(status, 'published') = 'published'")
    found = parsed(details, "jobId string, description string, contractType array<string>, publishedAt string, locationComplement string, salaryCurrency string, salaryMin double, salaryMax double").select("r.*")
    rows = list_with_details(listed, found, "jobId")
    meta = F.to_json(F.struct("workplaceType", "contractType", "salaryCurrency", "salaryMin", "salaryMax"))
    return record(rows, "inhire", external_id=F.col("jobId"), url=F.concat(F.lit(base), "jobId"), title=F.col("displayName"), company_name=F.lit(company), location_text=F.concat_ws(", ", "location", "locationComplement"), description=F.col("description"), published_at=F.col("publishedAt"), metadata=meta)


def remotive(df: DataFrame) -> DataFrame:
    schema = "jobs array<struct<id:long,url:string,title:string,company_name:string,category:string,tags:array<string>,job_type:string,publication_date:string,candidate_required_location:string,salary:string,description:string>>"
    jobs = parsed(df, schema).select(F.explode("r.jobs").alias("j"))
    meta = F.to_json(F.struct("j.category", "j.tags", "j.job_type", "j.salary"))
    return record(jobs, "remotive", external_id=F.col("j.id"), url=F.col("j.url"), title=F.col("j.title"), company_name=F.col("j.company_name"), location_text=F.col("j.candidate_required_location"), description=F.col("j.description"), published_at=F.col("j.publication_date"), metadata=meta)


class _Offers(HTMLParser):
    """List items of a class, with their data attributes, link and text."""

    def __init__(self, css: str) -> None:
        super().__init__(convert_charrefs=True)
        self.css, self.offers, self.open = css, [], False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "li" and self.css in (a.get("class") or "").split():
            self.offers.append({"data": {k: v for k, v in a.items() if k.startswith("data-")}, "url": None, "text": []})
            self.open = True
        elif tag == "a" and self.open and self.offers[-1]["url"] is None:
            self.offers[-1]["url"] = a.get("href")

    def handle_endtag(self, tag):
        self.open = self.open and tag != "li"

    def handle_data(self, data):
        if self.open and data.strip():
            self.offers[-1]["text"].append(data.strip())


OFFER = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("id", "url", "title", "location")]))


@F.pandas_udf(OFFER)
def page_offers(pages: pd.Series) -> pd.Series:
    out = []
    for page in pages:
        parser = _Offers("job-offer-item")
        parser.feed(page or "")
        out.append([{"id": o["data"].get("data-id"), "url": o["url"], "title": o["text"][0] if o["text"] else None, "location": o["data"].get("data-location") or (o["text"][1] if len(o["text"]) > 1 else None)} for o in parser.offers])
    return pd.Series(out, dtype=object)


def factorial(df: DataFrame, company: str) -> DataFrame:
    offers = df.select(F.explode(page_offers("body")).alias("j"))
    return record(offers, "factorial", external_id=F.coalesce("j.id", "j.url"), url=F.col("j.url"), title=F.col("j.title"), company_name=F.lit(company), location_text=F.col("j.location"))


#: Words of a thread's comment segments that tell what a segment is.
PLACE = re.compile(r"(?i)remote|on-?site|hybrid|worldwide|,\s*[A-Z]{2}\b|\b(usa?|uk|europe|brazil|london|berlin|new york|san francisco)\b")
LINK = re.compile(r"https?://[^\s|<>\"]+")


def comment_fields(source: str | None) -> dict[str, str | None]:
    """Company, role and place by the bars of a comment's first line."""
    text = visible_text(source or "")
    head, _, rest = text.partition("\n")
    parts = [p.strip() for p in head.split("|") if p.strip()]
    if len(parts) < 2:
        return dict.fromkeys(("company", "title", "location", "url", "description"))
    places = [p for p in parts[1:] if PLACE.search(p)]
    roles = [p for p in parts[1:] if p not in places and not LINK.search(p)]
    link = LINK.search(text)
    return {"company": LINK.sub("", parts[0]).strip(" ()"), "title": roles[0] if roles else None, "location": "; ".join(places) or None, "url": link.group() if link else None, "description": rest.strip() or None}


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("company", "title", "location", "url", "description")]))
def parse_comment(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([comment_fields(t) for t in texts], columns=["company", "title", "location", "url", "description"])


def hacker_news(df: DataFrame) -> DataFrame:
    """Top-level comments of a thread."""
    comments = parsed(df, "children array<struct<id:long,created_at:string,text:string>>").select(F.explode("r.children").alias("c")).withColumn("p", parse_comment("c.text"))
    return record(comments, "hacker_news", external_id=F.col("c.id"), url=F.col("p.url"), title=F.col("p.title"), company_name=F.col("p.company"), location_text=F.col("p.location"), description=F.col("p.description"), published_at=F.col("c.created_at"))


LD_JSON = r'(?is)<script[^>]*type\s*=\s*["\x27]?application/ld\+json["\x27]?[^>]*>(.*?)</script>'


def _postings(node) -> list[dict]:
    """Postings in an object, a list or a graph."""
    if isinstance(node, list):
        return [p for x in node for p in _postings(x)]
    if not isinstance(node, dict):
        return []
    kinds = node.get("@type")
    own = [node] if "JobPosting" in (kinds if isinstance(kinds, list) else [kinds]) else []
    return own + _postings(node.get("@graph"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def job_postings(scripts: pd.Series) -> pd.Series:
    out = []
    for found in scripts:
        nodes = []
        for s in found if found is not None else []:
            try:
                nodes += _postings(json.loads(s))
            except ValueError:
                continue
        out.append([json.dumps(n, ensure_ascii=False) for n in nodes])
    return pd.Series(out, dtype=object)


def json_ld(df: DataFrame) -> DataFrame:
    """Postings that pages embed; a page without any gives no row, and `json_ld_errors` names it."""
    nodes = df.select("path", F.explode(job_postings(F.regexp_extract_all("body", F.lit(LD_JSON), 1))).alias("n"))
    at = lambda *p: F.coalesce(*[F.get_json_object("n", x) for x in p])
    place = F.concat_ws(", ", at("$.jobLocation.address.addressLocality", "$.jobLocation[0].address.addressLocality"), at("$.jobLocation.address.addressCountry", "$.jobLocation[0].address.addressCountry"))
    applicants = at("$.applicantLocationRequirements.name", "$.applicantLocationRequirements[0].name")
    salary = F.struct(at("$.baseSalary.value.minValue", "$.baseSalary.value.value").alias("min"), at("$.baseSalary.value.maxValue", "$.baseSalary.value.value").alias("max"), at("$.baseSalary.currency").alias("currency"), at("$.baseSalary.value.unitText").alias("unit"))
    meta = F.to_json(F.struct(salary.alias("salary"), applicants.alias("applicants"), at("$.employmentType").alias("employmentType"), at("$.jobLocationType").alias("jobLocationType")))
    return record(nodes, "json_ld", external_id=at("$.identifier.value", "$.identifier"), url=F.coalesce(at("$.url"), F.col("path")), title=at("$.title"), company_name=at("$.hiringOrganization.name", "$.hiringOrganization"), location_text=place, description=at("$.description"), published_at=at("$.datePosted"), valid_through=at("$.validThrough"), metadata=meta)


def json_ld_errors(df: DataFrame) -> DataFrame:
    return df.where(F.size(job_postings(F.regexp_extract_all("body", F.lit(LD_JSON), 1))) == 0).select("path")


def web_results(df: DataFrame) -> DataFrame:
    """Search results as proposals, one for each canonical address: its best score; of equal ones the greatest title, then content."""
    hits = parsed(df, "results array<struct<url:string,title:string,content:string,score:double>>").select(F.explode("r.results").alias("h")).select("h.*")
    return hits.withColumn("canonical", canonicalize_url("url")).where("canonical is not null").groupBy("canonical").agg(F.max(F.struct("score", "title", "content")).alias("best")).select("canonical", "best.title", "best.content", "best.score")


def manual(spark: SparkSession, items: list[tuple[str, str, str]]) -> DataFrame:
    """What an operator has typed: (id, title, text)."""
    rows = spark.createDataFrame(items, "id string, title string, text string")
    return record(rows, "manual", external_id=F.col("id"), title=F.col("title"), description=F.col("text"))


def company_export(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A CSV or JSON export of companies; the case of headings does not matter, aliases are split at semicolons."""
    if kind == "csv":
        rows = spark.read.csv(path, header=True, multiLine=True)
    else:
        whole = landed(spark, path)
        listed = F.coalesce(F.from_json("body", "array<map<string,string>>"), F.from_json(F.coalesce(*[F.get_json_object("body", f"$.{k}") for k in ("results", "items", "companies")]), "array<map<string,string>>"))
        rows = whole.select(F.explode(listed).alias("m")).select(*[F.col("m")[n].alias(n) for n in ("Company Name", "Website", "Aliases", "Priority")])
    names = {c.lower().replace("_", " "): c for c in rows.columns}
    pick = lambda n: F.nullif(F.btrim(F.col(f"`{names[n]}`")), F.lit("")) if n in names else F.lit(None).cast("string")
    return rows.select(pick("company name").alias("name"), pick("website").alias("website"), F.array_distinct(F.filter(F.transform(F.split(pick("aliases"), ";"), lambda x: F.btrim(x)), lambda x: x != "")).alias("aliases"), F.upper(pick("priority")).alias("priority")).where("name is not null")


def markdown_table(spark: SparkSession, path: str) -> DataFrame:
    """Rows of pipe tables: their cells, and the links in them."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"^\s*\|") & ~F.col("value").rlike(r"^\s*\|[\s:|-]+\|\s*$"))
    cells = F.transform(F.split(F.regexp_replace(F.btrim("value"), r"^\||\|$", ""), r"\|"), lambda x: F.btrim(x))
    return lines.select(cells.alias("cells"), F.regexp_extract_all("value", F.lit(r"\]\((https?://[^)]+)\)"), 1).alias("links"))


def sitemap(df: DataFrame) -> DataFrame:
    """Addresses of a sitemap or of an index of sitemaps; documents with a type definition are refused."""
    safe = df.where(~F.upper("body").contains("<!DOCTYPE"))
    return safe.select("path", F.explode(F.regexp_extract_all("body", F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), 1)).alias("loc"), F.col("body").rlike(r"(?i)<sitemapindex").alias("is_index"))


def export_rows(df: DataFrame, name: str, path: str) -> None:
    """A table as lines of JSON with its name; refuses to overwrite."""
    df.select(F.to_json(F.struct(F.lit(name).alias("table"), F.struct(*df.columns).alias("row"))).alias("value")).write.mode("errorifexists").text(path)


def import_rows(spark: SparkSession, path: str, name: str, schema: str, ids: dict[str, str] | None = None) -> DataFrame:
    """The rows of one table of an export, with ids renamed."""
    rows = spark.read.text(path).select(F.from_json("value", f"table string, row struct<{schema}>").alias("r")).where(F.col("r.table") == name).select("r.row.*")
    if ids:
        renamed = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
        rows = rows.withColumn("id", F.coalesce(renamed[F.col("id")], F.col("id")))
    return rows


def write_report(df: DataFrame, path: str) -> None:
    """A report is written once."""
    df.write.mode("errorifexists").json(path)


def paged(df: DataFrame, order: str, size: int, number: int) -> DataFrame:
    return df.orderBy(order).offset(size * number).limit(size)


#: Parsers of one landed table by the type of their source.
COLLECTORS = {"greenhouse": greenhouse, "lever": lever, "ashby": ashby, "workable": workable, "teamtailor": teamtailor, "factorial": factorial, "remotive": lambda df, _: remotive(df), "hacker_news": lambda df, _: hacker_news(df), "json_ld": lambda df, _: json_ld(df)}


def collect(source_type: str, df: DataFrame, company: str) -> DataFrame:
    """Landed files of a source as records; an unknown type is an error."""
    if source_type not in COLLECTORS:
        raise ValueError(f"no parser for source type {source_type!r}")
    return COLLECTORS[source_type](df, company)
