"""Which records are one entity: connected components over shared keys, and what may be done with each component.

Labels spread from records to keys and back, each taking the least that it sees, and every label is then replaced by its own
label, so a chain of n records takes about log n rounds. A key that very many records share has its one row sent to all
tasks; all others are met by equal key. Each round is a table of its own, so a lost executor costs one round's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.session import written

#: A value that more rows of a table share is hot: its one row is sent to all tasks. There are no more of these than rows divided by it.
HOT_ROWS = 1_000_000


def _told(rows: DataFrame, by: str, table: DataFrame, most: int = HOT_ROWS) -> DataFrame:
    """rows with the one row of a table (by, n, ...) that has their value of `by`, where n is how many rows have it; the few that very many rows share are sent to all tasks, so no task has all rows of a value."""
    hot = table.where(F.col("n") > most).drop("n")
    if hot.isEmpty():
        return rows.join(table.drop("n"), by)
    busy = F.broadcast(hot)
    return rows.join(busy, by).unionByName(rows.join(F.broadcast(hot.select(by)), by, "left_anti").join(table.where(F.col("n") <= most).drop("n"), by))


def clusters(links: DataFrame, most: int = HOT_ROWS) -> DataFrame:
    """(node, cluster) of links (node long, key string): nodes that a chain of shared keys connects have the least of them as their cluster. Links without a key connect nothing; null nodes are left out; repeated links count once."""
    links = written(links.where("node is not null").select(F.col("node").cast("long").alias("node"), F.coalesce(F.col("key"), F.concat(F.lit("\x00"), F.col("node").cast("string"))).alias("key")).distinct(), "links")
    labels = written(links.select("node").distinct().withColumn("cluster", F.col("node")), "labels")
    while True:
        by_key = written(links.join(labels, "node").groupBy("key").agg(F.min("cluster").alias("least"), F.count(F.lit(1)).alias("n")), "labels-of-keys")
        seen = _told(links, "key", by_key, most).groupBy("node").agg(F.min("least").alias("least"))
        nearer = written(labels.join(seen, "node").select("node", "cluster", "least"), "labels-near")
        # a label's own label: the node of that name knows it
        asked = nearer.groupBy("least").agg(F.count(F.lit(1)).alias("n"))
        names = written(nearer.select(F.col("node").alias("least"), F.col("least").alias("further")).join(asked, "least"), "labels-names")
        new = written(_told(nearer, "least", names, most).select("node", "cluster", F.least("least", "further").alias("to")), "labels-new")
        labels = new.select("node", F.col("to").alias("cluster"))
        if new.where("to < cluster").isEmpty():
            return labels


def settled_merges(candidates: DataFrame, postings: DataFrame, active: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a batch of confirmations does, chains and all: ((a, b, outcome, survivor), (absorbed, survivor)).

    candidates: a, b, a_version, b_version, status; postings: id, created, version, duplicate_of; active: id, of postings
    with an application under way. A candidate that is decided already, that names a posting that is gone, that was looked
    at in another version, or one of whose sides is the other or is absorbed already, is refused, for the first of these
    reasons. The others are taken together: the postings that they connect become one, the oldest, by (created, id).
    Postings of which two or more have an application under way are a CONFLICT, and none of their pairs is taken. Nothing
    depends on the order in which confirmations come; equal ones have one outcome.
    """
    has = active.select("id").distinct().withColumn("_active", F.lit(True))
    known = postings.join(has, "id", "left").select("id", "created", "version", "duplicate_of", F.coalesce("_active", F.lit(False)).alias("_active"))
    side = lambda k: known.select(F.col("id").alias(k), F.col("version").alias(f"_{k}_version"), F.col("duplicate_of").alias(f"_{k}_of"), F.lit(True).alias(f"_{k}_there"))
    rows = candidates.distinct().join(side("a"), "a", "left").join(side("b"), "b", "left")
    refused = (
        F.when(F.col("status") != "PENDING", F.col("status"))
        .when(F.col("_a_there").isNull() | F.col("_b_there").isNull(), "NOT_FOUND")
        .when((F.col("a_version") != F.col("_a_version")) | (F.col("b_version") != F.col("_b_version")), "VERSION")
        .when((F.col("a") == F.col("b")) | F.col("_a_of").isNotNull() | F.col("_b_of").isNotNull(), "CYCLE")
    )
    rows = written(rows.select(*candidates.columns, refused.alias("_refused")), "merge-pairs")
    pair = F.concat_ws(":", "a", "b")
    open_ = rows.where("_refused is null")
    found = clusters(open_.select(F.col("a").alias("node"), pair.alias("key")).union(open_.select(F.col("b"), pair)))
    members = written(found.join(known, found["node"] == known["id"]).select("node", "cluster", "created", "_active"), "merge-members")
    whole = members.groupBy("cluster").agg(F.min(F.struct("created", "node"))["node"].alias("survivor"), (F.count_if("_active") > 1).alias("conflict"), F.count(F.lit(1)).alias("n"))
    # a cluster's verdict reaches its members by their cluster, like any key
    placed = written(_told(members, "cluster", whole).select("node", "survivor", "conflict"), "merge-placed")
    decided = rows.join(placed.withColumnRenamed("node", "a"), "a", "left")
    outcome = F.coalesce("_refused", F.when(F.col("conflict"), "CONFLICT").otherwise("CONFIRM"))
    decisions = decided.select("a", "b", outcome.alias("outcome"), F.when(outcome == "CONFIRM", F.col("survivor")).alias("survivor"))
    return decisions, placed.where("not conflict and node <> survivor").select(F.col("node").alias("absorbed"), "survivor")


def keys_of(name: Column, domain: Column, aliases: Column) -> Column:
    """What a company is known by: its domain, its name and each of its aliases, of which a name of one may be an alias of another."""
    names = F.array_union(F.array(name), F.coalesce(aliases, F.array().cast("array<string>")))
    written_ = F.transform(F.filter(names, lambda x: F.coalesce(x, F.lit("")) != ""), lambda x: F.concat(F.lit("name:"), x))
    return F.array_distinct(F.array_compact(F.array_append(written_, F.concat(F.lit("domain:"), F.nullif(domain, F.lit(""))))))


def reconciled(candidates: DataFrame, companies: DataFrame) -> DataFrame:
    """(candidate, company, outcome) of candidates against companies, both (id, name, domain, aliases), normalised, with ids of one numbering.

    INVALID: no name. Others are one with what shares a name, an alias or a domain with them, by chains too. AMBIGUOUS:
    that holds several companies. DOMAIN: its domains differ; an empty one differs from none. MATCHED: it holds one
    company, `company`. CREATED: it holds none; `company` is the least of its candidates.
    """
    columns = ["id", "name", "domain", "aliases"]
    rows = candidates.select(*columns, F.lit(True).alias("new")).unionByName(companies.select(*columns, F.lit(False).alias("new")))
    rows = written(rows.where("id is not null"), "companies")
    named = F.coalesce(F.trim("name"), F.lit("")) != ""
    links = rows.where(named).select(F.col("id").alias("node"), F.explode(keys_of(F.col("name"), F.col("domain"), F.col("aliases"))).alias("key"))
    placed = clusters(links).join(rows.select(F.col("id").alias("node"), "domain", "new"), "node")
    placed = written(placed.select("node", "cluster", F.nullif("domain", F.lit("")).alias("domain"), "new"), "companies-placed")
    old = F.when(~F.col("new"), F.col("node"))
    whole = placed.groupBy("cluster").agg(F.count(old).alias("n"), F.min(old).alias("known"), F.min("node").alias("first"), (F.min("domain") != F.max("domain")).alias("differ"), F.count(F.lit(1)).alias("rows"))
    outcome = F.when(F.col("n") > 1, "AMBIGUOUS").when(F.coalesce("differ", F.lit(False)), "DOMAIN").when(F.col("n") == 1, "MATCHED").otherwise("CREATED")
    whole = whole.select("cluster", outcome.alias("outcome"), F.when(outcome == "MATCHED", F.col("known")).when(outcome == "CREATED", F.col("first")).alias("company"), F.col("rows").alias("n"))
    told = _told(placed.where("new").select("node", "cluster"), "cluster", whole).select(F.col("node").alias("candidate"), "company", "outcome")
    invalid = rows.where(F.col("new") & ~named).select(F.col("id").alias("candidate"), F.lit(None).cast("long").alias("company"), F.lit("INVALID").alias("outcome"))
    return told.unionByName(invalid)
