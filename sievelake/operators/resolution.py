"""Which rows are one thing: similar titles in blocks, leaked passages, merges and their conflicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions.text import title_ratio
from sievelake.operators.joins import within


def shingles(text: Column, width: int = 5, short: bool = False) -> Column:
    """Different runs of words; of a text that is shorter none, or all its words as one."""

    def runs(words: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size(words) - width + 1, F.lit(1)))
        return F.array_distinct(F.transform(places, lambda k: F.when(F.size(words) >= (1 if short else width), F.array_join(F.slice(words, k, width), " "))))

    # the words are bound once, not read anew for every run
    found = F.transform(F.array(F.regexp_extract_all(F.lower(text), F.lit(r"[^\s]+"), F.lit(0))), runs)[0]
    return F.filter(found, lambda s: s.isNotNull()) if short else found


def shingle_hashes(text: Column, width: int = 5) -> Column:
    """Runs of words as pairs of hashes, 128 bits in all, repeated ones too; of a shorter text all its words as one. No run is ever made into a string."""

    def runs(words: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size(words) - width + 1, F.lit(1)))
        each = F.transform(places, lambda k: F.struct(F.xxhash64(F.slice(words, k, width)).alias("h"), F.xxhash64(F.lit(1), F.slice(words, k, width)).alias("g")))
        return F.when(F.size(words) > 0, each)

    return F.transform(F.array(F.regexp_extract_all(F.lower(text), F.lit(r"[^\s]+"), F.lit(0))), runs)[0]


#: Items' shingles that are sent to all tasks at most; of more, both sides are shuffled by hash.
SENT_SHINGLES = 1_000_000


def leaks(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, least: float) -> DataFrame:
    """(doc, item, shared, contained) where a document holds at least a share of an item's shingles.

    Documents' shingles are joined with the items' by equal hash; what no item has never leaves its task.
    """
    held = lambda df, key: df.select(key, F.explode(shingle_hashes(F.col("text"))).alias("s")).select(key, "s.h", "s.g")
    wanted = held(items, item_id).distinct()
    sizes = wanted.groupBy(item_id).agg(F.count(F.lit(1)).alias("n"))
    few = wanted.limit(SENT_SHINGLES + 1).count() <= SENT_SHINGLES
    hits = held(docs, doc_id).join(F.broadcast(wanted) if few else wanted, ["h", "g"]).distinct().groupBy(doc_id, item_id).agg(F.count(F.lit(1)).alias("shared"))
    share = F.col("shared") / F.col("n")
    return hits.join(sizes, item_id).where(share >= least).select(doc_id, item_id, "shared", F.round(share, 6).alias("contained"))


def character_bag(text: Column) -> Column:
    """A text's characters, each with its number among its equals, as strings: what two texts share is what their bags share."""
    letters = lambda t: F.filter(F.split(t, ""), lambda x: x != "")
    numbered = lambda found: F.transform(found, lambda x, i: F.concat(x, (i + 1 - F.array_position(found, x)).cast("string")))
    return F.transform(F.array(F.array_sort(letters(text))), numbered)[0]


#: At most about so many different titles of a block are compared with so many by one task.
BLOCK_TITLES = 512


def similar_titles(df: DataFrame, key: str, block: str, title: str, least: float, block_titles: int = BLOCK_TITLES) -> DataFrame:
    """(kind, key, key_b, ratio): pair, two representatives within a block whose titles are alike; member, a key and the representative, the least key, of its title, with ratio 1.

    Equal titles stand for one another, so a popular one is compared once: all alike pairs are those of members of one
    representative, and of members of the two of a pair. A null title is none, and in no row; a null block is a block.
    Titles of a hot block are dealt to parts, and parts are compared one by one.
    """
    b = f"{key}_b"
    known = df.where(F.col(title).isNotNull() & F.col(key).isNotNull()).select(F.col(key), F.struct(F.col(block).alias("block")).alias("_block"), F.col(title).alias("_a"))
    names = known.groupBy("_block", "_a").agg(F.min(key).alias(b))
    members = known.join(names, ["_block", "_a"]).select(F.lit("member").alias("kind"), key, b, F.lit(1.0).alias("ratio"))

    sizes = names.groupBy("_block").agg(F.ceil(F.count(F.lit(1)) / block_titles).cast("int").alias("_parts"))
    names = names.withColumn("_bag", character_bag(F.col("_a")))
    dealt = names.join(sizes, "_block").withColumn("_part", F.pmod(F.xxhash64("_a"), F.col("_parts")).cast("int"))
    parts = F.sequence(F.lit(0), F.col("_parts") - 1)
    # each two parts meet once, in the order of their numbers
    left = dealt.select("_block", F.col(b).alias("_ka"), "_a", F.col("_bag").alias("_bag_a"), F.col("_part").alias("_p"), F.explode(F.filter(parts, lambda x: x >= F.col("_part"))).alias("_q"))
    right = dealt.select("_block", F.col(b).alias("_kb"), F.col("_a").alias("_b"), F.col("_bag").alias("_bag_b"), F.col("_part").alias("_q"), F.explode(F.filter(parts, lambda x: x <= F.col("_part"))).alias("_p"))
    met = left.join(right, ["_block", "_p", "_q"]).where((F.col("_p") < F.col("_q")) | (F.col("_ka") < F.col("_kb")))
    ahead = F.col("_ka") < F.col("_kb")  # the likeness of two titles is asked in the order of their keys
    pairs = met.select(F.least("_ka", "_kb").alias(key), F.greatest("_ka", "_kb").alias(b), F.when(ahead, F.col("_a")).otherwise(F.col("_b")).alias("_a"), F.when(ahead, F.col("_b")).otherwise(F.col("_a")).alias("_b"), "_bag_a", "_bag_b")
    # what two titles match in is no more than the characters that both have, each as often as both have it: twice that
    # over both lengths bounds the ratio, and only pairs that it lets through are matched block by block
    longest = F.length("_a") + F.length("_b")
    pairs = pairs.where(2 * F.least(F.length("_a"), F.length("_b")) >= least * longest)
    pairs = pairs.where(2 * F.size(F.array_intersect("_bag_a", "_bag_b")) >= least * longest)
    alike = pairs.withColumn("ratio", title_ratio("_a", "_b")).where(F.col("ratio") >= least)
    return alike.select(F.lit("pair").alias("kind"), key, b, F.round("ratio", 6).alias("ratio")).union(members)


def candidate_pairs(df: DataFrame, keys: Sequence[str], key: str, time: str, days: int, decided: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) with equal keys within days of each other, but for those already decided at the same versions."""
    other = df.select(*keys, F.col(key).alias("b"), F.col(time).alias("_b_time"), F.col("version").alias("b_version"))
    near = within(df, other, keys, time, "_b_time", days * 86_400)
    pairs = near.where(F.col(key) < F.col("b")).select(F.col(key).alias("a"), "b", F.col("version").alias("a_version"), "b_version")
    return pairs if decided is None else pairs.join(decided, ["a", "b", "a_version", "b_version"], "left_anti")


def survivor(a: Column, b: Column) -> Column:
    """Of two structs of (created, id), the older one."""
    return F.least(a, b)


def _several(column: Column | str) -> Column:
    """More than one different known value: the least is not the greatest. Different values need not be gathered for it."""
    return F.coalesce(F.min(column) != F.max(column), F.lit(False))


def merged_field(column: str) -> tuple[Column, Column]:
    """(value, conflict) of a group's field: one different known value is taken, several are a conflict."""
    return F.when(F.min(column) == F.max(column), F.min(column)), _several(column)


def merged_requirement(column: str) -> Column:
    """The one class that is not UNKNOWN, else UNKNOWN."""
    known = F.nullif(F.col(column), F.lit("UNKNOWN"))
    return F.when(F.min(known) == F.max(known), F.min(known)).otherwise("UNKNOWN")


def compensation_conflict(low: str, high: str, currency: str, period: str) -> Column:
    """Sources disagree on a field, or their bounds cross."""
    several = [_several(c) for c in (low, high, currency, period)]
    found = several[0]
    for c in several[1:]:
        found = found | c
    return found | F.coalesce(F.min(low) > F.max(high), F.lit(False))


def cascade(levels: Sequence[tuple[str, DataFrame]], key: str) -> DataFrame:
    """(key, target, level): each item's match at the first level that has exactly one."""
    from functools import reduce

    found = [df.groupBy(key).agg(F.count_distinct("target").alias("_n"), F.min("target").alias("target")).where("_n = 1").select(key, "target", F.lit(k).alias("_level"), F.lit(name).alias("level")) for k, (name, df) in enumerate(levels)]
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy(key).agg(F.min_by(F.struct("target", "level"), "_level").alias("m")).select(key, "m.target", "m.level")
