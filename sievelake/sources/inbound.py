"""Poison isolation: a bad item of a landed file is a row with its reason, and the good ones beside it are read.

A body is checked as a whole, then cut into its items, and each item is read by its layout's parser by itself. What can't be
read is a dead letter: the source, the path, the item's number (null for a whole body), the reason and the raw text. The
table of dead letters is carried from run to run: an item that fails again counts an attempt more, and is given up after so
many; one whose file came again without it failing is resolved.

Reasons: EMPTY, a body without text; MALFORMED, one that is no JSON (or a page's script that is none); NO_ITEMS, one that
does not hold what its layout calls its items; NOT_A_RECORD, an item that is no object; NO_TITLE, NO_ID, an item without
them; BAD_TIME, one whose time is none (it is read all the same, without the time).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.sources import feeds

DEAD = "source_type string, path string, ordinal int, reason string, raw string"


@dataclass(frozen=True)
class Layout:
    """Where a layout has its items (null: the body is their array), and where an item has what it must have."""

    items: str | None
    ids: tuple[str, ...]
    title: str
    times: tuple[str, ...] = ()


#: The public layouts' names.
LAYOUTS = {
    "greenhouse": Layout("jobs", ("id",), "title", ("first_published", "updated_at")),
    "lever": Layout(None, ("id",), "text"),
    "ashby": Layout("jobs", ("id", "jobUrl"), "title", ("publishedAt",)),
    "workable": Layout("jobs", ("shortcode",), "title", ("published_on", "created_at")),
    "teamtailor": Layout("items", ("id",), "title", ("date_published",)),
    "remotive": Layout("jobs", ("id",), "title", ("publication_date",)),
    "hacker_news": Layout("children", ("id",), "text", ("created_at",)),
}


def _blank(c: Column) -> Column:
    return ~F.coalesce(c.rlike(r"\S"), F.lit(False))


def landed_stream(spark: SparkSession, path: str) -> DataFrame:
    """feeds.landed() as a stream: each file once, as it comes; offsets are the stream's own, so it goes on where it stopped."""
    return spark.readStream.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def items_of(source_type: str, df: DataFrame) -> DataFrame:
    """(path, ordinal, raw, reason) of landed bodies (path, body): each item, or the one reason why there are none."""
    layout = LAYOUTS[source_type]
    body = F.col("body")
    json = F.try_parse_json(body)
    listed = body if layout.items is None else F.get_json_object(body, f"$.{layout.items}")
    raw = F.from_json(listed, "array<string>")
    is_list = F.coalesce(F.schema_of_variant(json if layout.items is None else F.try_variant_get(json, f"$.{layout.items}", "variant")).startswith("ARRAY"), F.lit(False))
    reason = F.when(_blank(body), "EMPTY").when(json.isNull(), "MALFORMED").when(~is_list | raw.isNull(), "NO_ITEMS")
    rows = df.select("path", "body", reason.alias("reason"), F.when(reason.isNull(), raw).alias("raw"))
    each = rows.select("path", "reason", "body", F.posexplode_outer("raw").alias("ordinal", "item"))
    return each.select("path", "ordinal", F.when(F.col("reason").isNotNull(), F.col("body")).otherwise(F.col("item")).alias("raw"), "reason").where("ordinal is not null or reason is not null")


def checked(source_type: str, df: DataFrame) -> DataFrame:
    """items_of() with the reason of each item that can't be read, or that is read without its time."""
    layout = LAYOUTS[source_type]
    raw = F.col("raw")
    field = lambda name: F.get_json_object(raw, f"$.{name}")
    no_id = F.coalesce(*[F.nullif(F.btrim(field(n)), F.lit("")) for n in layout.ids]).isNull()
    bad_time = F.lit(False)
    for name in layout.times:
        bad_time = bad_time | (field(name).isNotNull() & field(name).try_cast("timestamp").isNull())
    own = F.when(~F.coalesce(raw.startswith("{"), F.lit(False)), "NOT_A_RECORD").when(_blank(field(layout.title)), "NO_TITLE").when(no_id, "NO_ID").when(bad_time, "BAD_TIME")
    return items_of(source_type, df).withColumn("reason", F.coalesce("reason", own))


def isolated(source_type: str, df: DataFrame, company: str) -> tuple[DataFrame, DataFrame]:
    """(records, dead letters) of landed bodies. A record is read from its own item alone."""
    if source_type in PAGES:
        return feeds.collect(source_type, df, company), PAGES[source_type](df).select(F.lit(source_type).alias("source_type"), "path", "ordinal", "reason", "raw")
    rows, layout = checked(source_type, df), LAYOUTS[source_type]
    good = rows.where(F.col("reason").isNull() | (F.col("reason") == "BAD_TIME"))
    wrapped = F.concat(F.lit("[") if layout.items is None else F.lit(f'{{"{layout.items}":['), F.col("raw"), F.lit("]") if layout.items is None else F.lit("]}"))
    records = feeds.collect(source_type, good.select("path", wrapped.alias("body")), company)
    return records, rows.where("reason is not null").select(F.lit(source_type).alias("source_type"), "path", F.col("ordinal").cast("int").alias("ordinal"), "reason", "raw")


def dead_offers(df: DataFrame) -> DataFrame:
    """Pages of list items: without any, or items without a title or an id."""
    offers = df.select("path", "body", feeds.page_offers("body").alias("o"))
    whole = F.when(_blank(F.col("body")), "EMPTY").when(F.size("o") == 0, "NO_ITEMS")
    pages = offers.where(whole.isNotNull()).select("path", F.lit(None).cast("int").alias("ordinal"), whole.alias("reason"), F.col("body").alias("raw"))
    each = offers.select("path", F.posexplode("o").alias("ordinal", "j"))
    reason = F.when(_blank(F.col("j.title")), "NO_TITLE").when(F.coalesce("j.id", "j.url").isNull(), "NO_ID")
    return pages.union(each.where(reason.isNotNull()).select("path", "ordinal", reason, F.to_json("j")))


def dead_postings(df: DataFrame) -> DataFrame:
    """Pages with embedded postings: scripts that are no JSON, pages without a posting, postings without a title."""
    scripts = df.select("path", "body", F.regexp_extract_all("body", F.lit(feeds.LD_JSON), 1).alias("s"))
    nodes = feeds.job_postings("s")
    none = F.when(_blank(F.col("body")), "EMPTY").when(F.size(nodes) == 0, "NO_ITEMS")
    pages = scripts.where(none.isNotNull()).select("path", F.lit(None).cast("int").alias("ordinal"), none.alias("reason"), F.col("body").alias("raw"))
    broken = scripts.select("path", F.posexplode("s").alias("ordinal", "raw")).where(F.try_parse_json("raw").isNull()).select("path", "ordinal", F.lit("MALFORMED"), "raw")
    titled = scripts.select("path", F.posexplode(nodes).alias("ordinal", "raw")).where(_blank(F.get_json_object("raw", "$.title"))).select("path", "ordinal", F.lit("NO_TITLE"), "raw")
    return pages.union(broken).union(titled)


PAGES: dict[str, Callable[[DataFrame], DataFrame]] = {"factorial": dead_offers, "json_ld": dead_postings}

ATTEMPTS = "source_type string, path string, ordinal int, reason string, raw string, attempts int, first_seen timestamp, last_seen timestamp, status string"


def attempted(before: DataFrame, found: DataFrame, landed: DataFrame, now: Column, most: int = 5) -> DataFrame:
    """The table of dead letters after one more run. before: ATTEMPTS; found: DEAD; landed: (source_type, path) of all files of the run.

    OPEN, RESOLVED, or GIVEN_UP after the most-th attempt in a row. What is not in the run stays as it was; what fails
    anew after it was resolved begins anew. Equal letters of a run are one.
    """
    key = ["source_type", "path", "_n"]
    number = F.coalesce("ordinal", F.lit(-1)).alias("_n")
    new = found.select("source_type", "path", number, "reason", "raw").groupBy(*key).agg(F.min(F.struct("reason", "raw")).alias("_new"))
    came = landed.select("source_type", "path").distinct().withColumn("_came", F.lit(True))
    old = before.withColumn("_n", number)
    rows = old.join(new, key, "full").join(came, ["source_type", "path"], "left")
    again = F.col("_new").isNotNull()
    begins = F.col("status").isNull() | (F.col("status") == "RESOLVED")
    tries = F.when(~again, F.col("attempts")).when(begins, 1).otherwise(F.col("attempts") + 1).cast("int")
    status = F.when(again, F.when(tries >= most, "GIVEN_UP").otherwise("OPEN")).when(F.col("_came"), "RESOLVED").otherwise(F.col("status"))
    return rows.select(
        "source_type", "path", F.when(F.col("_n") >= 0, F.col("_n")).alias("ordinal"), F.coalesce("_new.reason", "reason").alias("reason"), F.coalesce("_new.raw", "raw").alias("raw"), tries.alias("attempts"),
        F.when(again & begins, now).otherwise(F.col("first_seen")).alias("first_seen"), F.when(again, now).otherwise(F.col("last_seen")).alias("last_seen"), status.alias("status"),
    )
