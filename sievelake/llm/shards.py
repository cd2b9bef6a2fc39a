"""Shards of near equal size: a minimax contiguous partition of atomic groups.

Rows of equal text are one group, which is never cut. A row weighs the UTF-8 bytes of its text plus one. Groups stand in
the order of a 64-bit hash of their text, so that a shard is a fair mix. The smallest capacity for which a greedy pass
needs no more than the wanted shards is found by binary search; then the order is cut so that no shard holds more, each
cut as near as it can be to an equal share of what is left. A group above the fair share of what is left (a text with
very many copies) cannot be made smaller by any cut: it is a shard by itself, before the others are cut.

The driver holds no list of groups. It holds the sums of 65,536 ranges of the hash, and looks into a range (at its groups,
or at 65,536 ranges in it) only where a cut falls, so a pass is exact at every size. Texts whose hashes collide share a
group; no text is in two.

Null text is empty: size 1, checksum 0, one group with empty texts. Repeated rows and ids each have a slot of their own;
null ids are kept. Fewer groups than shards leave shards empty. An empty table gives no rows. Only the id and text columns
are read, so other columns, whatever their names, do not matter. Very long texts are measured by built-in functions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.llm.common import written

#: Bits of the hash by which a range is cut into smaller ones.
DIGIT = 16
#: A range of so many groups at most is looked at group by group.
MOST_GROUPS = 65_536
#: Rows of a written file that are numbered together.
BLOCK = 4_096
TOP = 64


@dataclass
class Ranges:
    """The groups or the ranges inside of one range of the hash, in its order: first hash, groups, and bytes before each."""

    first: np.ndarray
    count: np.ndarray
    before: np.ndarray
    bits: int


@dataclass
class Order:
    """Groups in the order of their hash, with running sums, looked into where they are asked for."""

    groups: DataFrame
    root: Ranges = None
    known: dict[tuple[int, int], Ranges] = field(default_factory=dict)

    def __post_init__(self):
        self.root = self._read([(-(1 << (TOP - 1)), TOP, 0)])[0]
        self.total = int(self.root.before[-1])
        self.largest = self.groups.agg(F.coalesce(F.max("size"), F.lit(0))).collect()[0][0]

    def _read(self, ranges: list[tuple[int, int, int]]) -> list[Ranges]:
        """Inside of ranges (first hash, bits, 0 or the count of their groups), by one job for those that are read alike."""
        out: dict[tuple[int, int], Ranges] = {}
        for listed in (True, False):
            wanted = [(first, bits) for first, bits, n in ranges if (0 < n <= MOST_GROUPS) == listed]
            if not wanted:
                continue
            bits = wanted[0][1]
            within = None
            for first, _ in wanted:
                one = F.col("g").between(first, first + (1 << bits) - 1)
                within = one if within is None else within | one
            left = bits - DIGIT
            rows = self.groups.where(within) if bits < TOP else self.groups
            if listed:
                rows = rows.select(F.col("g").alias("first"), F.lit(1).alias("n"), "size")
            else:
                rows = rows.groupBy(F.shiftright("g", left).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
                rows = rows.select((F.col("k") * F.lit(1 << left)).alias("first"), "n", "size")
            found = rows.toPandas().sort_values("first")
            first = found["first"].to_numpy("int64")
            for begin, _ in wanted:
                at = slice(np.searchsorted(first, begin), np.searchsorted(first, begin + (1 << bits) - 1, "right"))
                size = found["size"].to_numpy("int64")[at]
                out[begin, bits] = Ranges(first[at], found["n"].to_numpy("int64")[at], np.concatenate([[0], np.cumsum(size)]), 0 if listed else left)
        return [out[first, bits] for first, bits, _ in ranges]

    def prefetch(self, places: list[int]) -> None:
        """Looks into the ranges around some places by one job."""
        wanted = set()
        for x in places:
            k = int(np.searchsorted(self.root.before, x, "right")) - 1
            wanted |= {i for i in (k - 1, k, k + 1) if 0 <= i < len(self.root.first) and self.root.count[i] > 1}
        todo = [(int(self.root.first[i]), self.root.bits, int(self.root.count[i])) for i in sorted(wanted)]
        for (first, bits, _), found in zip(todo, self._read(todo) if todo else [], strict=True):
            self.known[first, bits] = found

    def edge(self, x: int, up: bool = False) -> tuple[int, int | None]:
        """The last edge of a group at or before x bytes (or the first at or after): bytes before it, and the first hash after it, None at the end."""
        if x >= self.total:
            return self.total, None
        node, base = self.root, 0
        while True:
            k = int(np.searchsorted(node.before, x - base, "right")) - 1
            at = base + int(node.before[k])
            if at == x or node.count[k] == 1:
                if at == x or not up:
                    return at, int(node.first[k])
                after = base + int(node.before[k + 1])
                return (after, int(node.first[k + 1])) if k + 1 < len(node.first) else self.edge(after)
            inside = (int(node.first[k]), node.bits)
            if inside not in self.known:
                self.known[inside] = self._read([(*inside, int(node.count[k]))])[0]
            node, base = self.known[inside], at

    def fits(self, capacity: int, n: int) -> bool:
        """Whether a greedy pass of that capacity needs no more than n shards."""
        at = 0
        for _ in range(n):
            at, _ = self.edge(at + capacity)
            if at >= self.total:
                return True
        return at >= self.total


@dataclass(frozen=True)
class Shards:
    """Groups that are a shard each, the first hash of each later shard, and the most bytes that any of those holds."""

    alone: tuple[int, ...]
    first: tuple[int, ...]
    capacity: int

    def of(self, group: Column) -> Column:
        later = F.lit(len(self.alone))
        for edge in self.first:
            later = later + (group >= edge).cast("int")
        found = later
        for k, g in enumerate(self.alone):
            found = F.when(group == g, k).otherwise(found)
        return found.cast("int")


def group_of(text: str | Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def size_of(text: str | Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def smallest_capacity(order: Order, n: int) -> int:
    """The least capacity that a greedy pass can do with, by binary search; the fair share plus the largest group always does."""
    fair = -(-order.total // n)
    low, high = max(fair, order.largest), fair + order.largest
    while low < high:
        middle = (low + high) // 2
        if order.fits(middle, n):
            high = middle
        else:
            low = middle + 1
    return low


def partition(sizes: DataFrame, n: int) -> Shards:
    """Cuts groups (g long, size long), each once, into n shards."""
    alone, left, shards = [], sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).collect()[0][0], n
    for r in sizes.orderBy(F.desc("size"), "g").limit(n).collect():
        if shards == 1 or r.size * shards <= left:
            break
        alone.append(r.g)
        left, shards = left - r.size, shards - 1
    order = Order(sizes.where(~F.col("g").isin(alone)) if alone else sizes)
    if not order.total:
        return Shards(tuple(alone), (), 0)
    order.prefetch([order.total * k // shards for k in range(1, shards)])
    capacity = smallest_capacity(order, shards)
    # the least place of each cut: what is after it must fit the shards that are left
    least = [order.total]
    for _ in range(shards - 1):
        least.append(order.edge(max(0, least[-1] - capacity), up=True)[0])
    first, at = [], 0
    for k in range(1, shards):
        most = order.edge(at + capacity)[0]
        fair = at + (order.total - at) // (shards - k + 1)
        near = [order.edge(fair), order.edge(fair, up=True)]
        low = least[shards - k]
        places = [e for e in near if low <= e[0] <= most] or [order.edge(min(max(fair, low), most))]
        at, edge = min(places, key=lambda e: abs(e[0] - fair))
        if edge is None:
            break
        first.append(edge)
    return Shards(tuple(alone), tuple(first), capacity)


def plan(df: DataFrame, n: int = 16, text_col: str = "text") -> Shards:
    """Where each text goes; `plan(df).of(group_of("text"))` is a column of df, to be written by or to be kept."""
    rows = df.select(group_of(text_col).alias("g"), size_of(text_col).alias("size"))
    sizes = rows.groupBy("g").agg(F.sum("size").alias("size")).sortWithinPartitions("g")
    return partition(written(sizes, "shard-groups"), n)


def numbered(rows: DataFrame, within: str, slot: str = "slot") -> DataFrame:
    """Numbers the rows of a table that stands in files, from 0 in each value of one column.

    Rows are known by the block of a file in which they stand, so that a hot value, and rows alike, are counted in many
    tasks; counts are summed over blocks, then over files.
    """
    rows = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at")).withColumn("_block", F.floor(F.col("_at") / BLOCK))
    counts = written(rows.groupBy("_file", "_block", within).agg(F.count(F.lit(1)).alias("_n")), "slot-counts")
    files = counts.groupBy("_file", within).agg(F.sum("_n").alias("_n"))
    before = lambda *by: Window.partitionBy(within, *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("_file", within, F.coalesce(F.sum("_n").over(before("_file")), F.lit(0)).alias("_base"))
    blocks = counts.select("_file", "_block", within, F.coalesce(F.sum("_n").over(before("_file", "_block")), F.lit(0)).alias("_before"))
    starts = blocks.join(files, ["_file", within]).select("_file", "_block", within, (F.col("_base") + F.col("_before")).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_file", "_block", within).orderBy("_at")) - 1
    ranked = rows.withColumn("_place", place)
    return ranked.join(starts.hint("merge"), ["_file", "_block", within]).withColumn(slot, F.col("_start") + F.col("_place")).drop("_file", "_at", "_block", "_place", "_start")


def sharded(df: DataFrame, n: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's size, checksum, shard, and slot in it."""
    rows = df.select(F.col(id_col).alias("id"), size_of(text_col).alias("size"), F.crc32(F.coalesce(text_col, F.lit("")).cast("binary")).alias("text_crc32"), group_of(text_col).alias("g"))
    rows = written(rows, "shard-rows")
    sizes = rows.groupBy("g").agg(F.sum("size").alias("size")).sortWithinPartitions("g")
    found = partition(written(sizes, "shard-groups"), n)
    placed = numbered(rows.withColumn("shard", found.of(F.col("g"))), "shard")
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
