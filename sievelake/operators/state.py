"""State that batches carry on: evidence, presence, closures, machines, retention, gates. Each step is a plan over tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.session import dealt


def ingest(batch: DataFrame, known: DataFrame, stale_before: Column) -> DataFrame:
    """What becomes of each item of a batch, in the order of (fetched_at, ordinal).

    batch: identity, payload_hash, semantic_hash, fetched_at, ordinal, published_at, updated_at, off_target. known:
    identity, payload_hash, semantic_hash, stored_at. OBSERVED: the very evidence is known, from before or from earlier in the
    batch. SKIPPED: not wanted. STALE: too old by its own dates, or, if it has none, by when its identity was first
    stored. NEW: evidence to store. Each counts as presence.
    """
    key = ["identity", "payload_hash", "semantic_hash"]
    # of what is stored, only the batch's own identities are read on
    known = known.join(batch.select("identity").distinct(), "identity", "left_semi")
    before = known.groupBy(*key).agg(F.lit(True).alias("_known"))
    first = known.groupBy("identity").agg(F.min("stored_at").alias("_first"))
    order = Window.partitionBy(*key).orderBy("fetched_at", "ordinal")
    rows = batch.join(before, key, "left").join(first, "identity", "left")
    effective = F.coalesce("published_at", F.when(F.col("updated_at") < stale_before, F.col("updated_at")), "_first")
    plain = F.when(F.col("_known"), "OBSERVED").when(F.coalesce("off_target", F.lit(False)), "SKIPPED").when(effective < stale_before, "STALE").otherwise("NEW")
    # the first of equal new items is stored, and known to those after it
    rows = rows.withColumn("_plain", plain)
    stored = F.max((F.col("_plain") == "NEW").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    outcome = F.when(F.coalesce(stored, F.lit(0)) == 1, "OBSERVED").otherwise(F.col("_plain"))
    return rows.withColumn("outcome", outcome).drop("_known", "_first", "_plain")


def presence(occurrences: DataFrame, seen: DataFrame) -> DataFrame:
    """last_seen only ever moves forward. occurrences: identity, last_seen; seen: identity, seen_at."""
    latest = seen.groupBy("identity").agg(F.max("seen_at").alias("_seen"))
    return occurrences.join(latest, "identity", "left").withColumn("last_seen", F.greatest("last_seen", "_seen")).drop("_seen")


def cosmetic(df: DataFrame, keys: Sequence[str], order: Sequence[str], semantic: str = "semantic_hash") -> DataFrame:
    """Flags versions that mean what the one before them meant."""
    before = F.lag(semantic).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("cosmetic", F.coalesce(F.col(semantic) == before, F.lit(False)))


def reconcile(occurrences: DataFrame, runs: DataFrame, hours: int = 24) -> DataFrame:
    """(posting_id, status): closed once every source of a posting has run in full, well after it last saw it, without it.

    occurrences: posting_id, source_id, last_seen, status; runs: source_id, started_at, complete.
    """
    last = runs.where("complete").groupBy("source_id").agg(F.max("started_at").alias("_run"))
    gone = F.coalesce(F.col("last_seen") < F.col("_run") - F.expr(f"INTERVAL '{hours}' HOUR"), F.lit(False))
    # a greatest string is found by sorting: each task sorts its part of the postings, not a whole split
    each = dealt(occurrences.join(last, "source_id", "left").select("posting_id", gone.alias("_gone"), "status"), "posting_id")
    rows = each.groupBy("posting_id").agg(F.bool_and("_gone").alias("_gone"), F.max("status").alias("_status"))
    return rows.select("posting_id", F.when(F.col("_gone"), "CLOSED").when(F.col("_status") == "CLOSED", "ACTIVE").otherwise(F.col("_status")).alias("status"))


#: The moves that a posting and an application may make.
POSTING_MOVES = {"DISCOVERED": ("ACTIVE", "STALE", "CLOSED"), "ACTIVE": ("STALE", "CLOSED"), "STALE": ("ACTIVE", "CLOSED"), "CLOSED": ("ACTIVE",)}
APPLICATION_MOVES = {"SAVED": ("APPLIED", "WITHDRAWN"), "APPLIED": ("SCREENING", "REJECTED", "WITHDRAWN"), "SCREENING": ("INTERVIEW", "REJECTED", "WITHDRAWN"), "INTERVIEW": ("OFFER", "REJECTED", "WITHDRAWN"), "OFFER": ("ACCEPTED", "REJECTED", "WITHDRAWN")}


def allowed(moves: dict[str, tuple[str, ...]], before: Column, after: Column) -> Column:
    """Whether a machine may make a move; to stay is no move."""
    found = [(before == a) & after.isin(*b) for a, b in moves.items()]
    return F.coalesce(reduce(lambda a, b: a | b, found), F.lit(False))


def pointer(current: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest of each key, over old and new rows; equal order keeps what comes last in all its columns."""
    rest = [c for c in current.columns if c not in keys]
    best = F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_best")
    return current.unionByName(new).groupBy(*keys).agg(best).select(*keys, *[F.col("_best")[c].alias(c) for c in rest])


def refreshed(stored: DataFrame, candidate: DataFrame, key: str, rules: Sequence[str], evidence: Sequence[str], updated: str = "updated_at") -> DataFrame:
    """Fields of rules always follow the candidate; fields of evidence do unless it is older, or empty. The version counts changes."""
    new = candidate.select(key, *[F.col(c).alias(f"_{c}") for c in dict.fromkeys([*rules, *evidence, updated])])
    rows = stored.join(new, key, "left")
    matched = F.col(f"_{updated}").isNotNull()
    fresh = matched & ~F.coalesce(F.col(f"_{updated}") < F.col(updated), F.lit(False))
    values = {c: F.when(matched, F.col(f"_{c}")).otherwise(F.col(c)) for c in rules}
    values |= {c: F.when(fresh & F.col(f"_{c}").isNotNull() & (F.col(f"_{c}").cast("string") != ""), F.col(f"_{c}")).otherwise(F.col(c)) for c in evidence}
    changed = reduce(lambda a, b: a | b, [~v.eqNullSafe(F.col(c)) for c, v in values.items()])
    later = F.when(fresh, F.greatest(updated, f"_{updated}")).otherwise(F.col(updated))
    return rows.select(*[values.get(c, later if c == updated else F.col("version") + changed.cast("int") if c == "version" else F.col(c)).alias(c) for c in stored.columns], changed.alias("changed"))


def retention(rows: DataFrame, protected: Sequence[DataFrame], key: str, old: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, gone): rows go if they are old and nothing that protects them names them."""
    gone = reduce(lambda df, p: df.join(p.select(key).distinct(), key, "left_anti"), protected, rows.where(F.coalesce(old, F.lit(False))))
    return rows.join(gone.select(key), key, "left_anti"), gone


def recomputed(rows: DataFrame, version: str, current: str, values: dict[str, Column]) -> DataFrame:
    """Recomputes derived columns where their version is another; done twice, it changes nothing more."""
    stale = ~F.col(version).eqNullSafe(F.lit(current))
    return rows.withColumns({c: F.when(stale, v).otherwise(F.col(c)) for c, v in values.items()} | {version: F.lit(current)})


def gate(due: Column, failures: Column, since_failure_s: Column, since_start_s: Column, interval_s: int, budget_left: Column, base_s: float = 60.0, most_s: float = 3600.0) -> Column:
    """Why a source runs or waits: its schedule, its back-off, its interval, its host's budget, in this order."""
    wait = F.when(failures > 0, F.least(base_s * F.pow(F.lit(2.0), failures - 1), F.lit(most_s))).otherwise(0.0)
    return F.when(~due, "NOT_DUE").when(since_failure_s < wait, "BACKOFF").when(since_start_s < interval_s, "TOO_SOON").when(budget_left <= 0, "HOST_BUDGET").otherwise("RUN")


def host_budget(requests: DataFrame, host: str, time: str, window: str, limit: int, reserve: int) -> DataFrame:
    """Requests by host and window, and what is left of the limit less a reserve."""
    return requests.groupBy(host, F.window(time, window)["start"].alias("window_start")).agg(F.count(F.lit(1)).alias("used")).withColumn("left", F.greatest(F.lit(limit - reserve) - F.col("used"), F.lit(0)).cast("long"))


def complete(status: Column, capped: Column, seen: Column, announced: Column) -> Column:
    """A run is complete if it succeeded, was not capped, and saw all that was announced."""
    return (status == "SUCCEEDED") & ~F.coalesce(capped, F.lit(False)) & (announced.isNull() | (seen >= announced))


def merged_hits(hits: DataFrame, key: str) -> DataFrame:
    """Search hits of one company as one: terms in the order in which they came, the best score, the strongest excerpt."""
    ordered = F.sort_array(F.collect_list(F.struct("ordinal", "term")))
    return hits.groupBy(key).agg(F.array_distinct(ordered["term"]).alias("terms"), F.max("score").alias("score"), F.max_by("excerpt", F.struct("score", -F.col("ordinal"))).alias("excerpt"), F.count(F.lit(1)).alias("n_hits"))


def recently_attempted(attempted: Column, used_paid: Column, paid_enabled: bool, now: Column, days: int) -> Column:
    """An earlier attempt within the window came up empty; a free attempt does not shield from a paid one."""
    inside = attempted > now - F.expr(f"INTERVAL '{days}' DAY")
    return F.coalesce(inside, F.lit(False)) & (F.coalesce(used_paid, F.lit(False)) | F.lit(not paid_enabled)) & F.lit(days > 0)


def discovery_eligible(companies: DataFrame, sources: DataFrame, attempts: DataFrame, key: str, boards: Sequence[str], cutoff: Column) -> DataFrame:
    """Companies with a confirmed careers page, without a known board, and without an attempt since the cutoff. sources: key, source_type, confirmed; attempts: key, attempted_at."""
    careers = sources.where((F.col("source_type") == "careers") & F.col("confirmed")).select(key)
    known = sources.where(F.col("source_type").isin(*boards)).select(key)
    return companies.join(careers, key, "left_semi").join(known, key, "left_anti").join(attempts.where(F.col("attempted_at") >= cutoff).select(key), key, "left_anti")


def confirmed_merges(candidates: DataFrame, postings: DataFrame, active: DataFrame) -> DataFrame:
    """(a, b, outcome, survivor, absorbed) of a batch of confirmations.

    candidates: a, b, a_version, b_version, status; postings: id, created, version, duplicate_of; active: id, of postings
    with an application under way. The older of the two survives. A candidate that is decided already, that names a
    posting that is gone, that was looked at in another version, one of whose sides is absorbed already, or both of whose
    sides have applications under way, is refused, for the first of these reasons. What a batch can't do at once, as a
    posting is in an earlier pair of it, is left for the next one.
    """
    has = active.select("id").distinct().withColumn("_active", F.lit(True))
    side = lambda k: postings.join(has, "id", "left").select(F.col("id").alias(k), F.struct("created", "id").alias(f"_{k}"), F.col("version").alias(f"_{k}_version"), F.col("duplicate_of").alias(f"_{k}_of"), F.coalesce("_active", F.lit(False)).alias(f"_{k}_active"))
    rows = candidates.join(side("a"), "a", "left").join(side("b"), "b", "left")
    refused = (
        F.when(F.col("status") != "PENDING", F.col("status")).when(F.col("_a").isNull() | F.col("_b").isNull(), "NOT_FOUND").when((F.col("a_version") != F.col("_a_version")) | (F.col("b_version") != F.col("_b_version")), "VERSION")
        .when((F.col("a") == F.col("b")) | F.col("_a_of").isNotNull() | F.col("_b_of").isNotNull(), "CYCLE").when(F.col("_a_active") & F.col("_b_active"), "CONFLICT")
    )
    rows = rows.withColumn("_refused", refused)
    # a posting is in one merge of a batch at most: a pair is taken if it is the first of both its sides
    open_ = rows.where(F.col("_refused").isNull())
    first = open_.select(F.explode(F.array("a", "b")).alias("_side"), F.struct("a", "b").alias("_pair")).groupBy("_side").agg(F.min("_pair").alias("_first"))
    of = lambda k: first.select(F.col("_side").alias(k), F.col("_first").alias(f"_{k}_first"))
    rows = rows.join(of("a"), "a", "left").join(of("b"), "b", "left")
    pair = F.struct("a", "b")
    outcome = F.coalesce("_refused", F.when((F.col("_a_first") == pair) & (F.col("_b_first") == pair), "CONFIRM").otherwise("LATER"))
    done = outcome == "CONFIRM"
    return rows.select("a", "b", outcome.alias("outcome"), F.when(done, F.least("_a", "_b")["id"]).alias("survivor"), F.when(done, F.greatest("_a", "_b")["id"]).alias("absorbed"))


def reparented(rows: DataFrame, merges: DataFrame, posting: str) -> DataFrame:
    """Rows of absorbed postings under the posting that survives."""
    moved = merges.where(F.col("absorbed").isNotNull()).select(F.col("absorbed").alias(posting), F.col("survivor").alias("_to"))
    return rows.join(moved, posting, "left").withColumn(posting, F.coalesce("_to", posting)).drop("_to")


def purged(rows: DataFrame, time: str, cutoff: Column) -> DataFrame:
    """What is left once all that is older is gone; rows without a time stay. One pass: batches are the database's way to keep locks short."""
    return rows.where(~F.coalesce(F.col(time) < cutoff, F.lit(False)))


def run_steps(steps: Sequence[tuple[str, Callable[[], int]]], should_stop: Callable[[], bool] = lambda: False) -> list[tuple[str, str, int]]:
    """(step, DONE, FAILED or STOPPED, rows) of a composite whose steps don't stop one another: a failure is told, and the next step runs."""
    report = []
    for name, step in steps:
        if should_stop():
            report.append((name, "STOPPED", 0))
            continue
        try:
            report.append((name, "DONE", step()))
        except Exception as e:  # noqa: BLE001  whatever fails in one step must not keep the others from running
            report.append((name, f"FAILED: {type(e).__name__}", 0))
    return report
