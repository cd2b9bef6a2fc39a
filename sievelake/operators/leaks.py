"""Texts that stand on both sides of a split, over the whole table.

Texts with the same shingles are one class. Two classes of Jaccard 4/5 or more share 4/5 of the larger one's shingles, and
all steps follow from that, so no pair is lost at any size.

1. Of the first |s|/5 + l shingles of each, in the order of their hashes, two of a pair share l. Shingles are counted in
   buckets, each task's own ones first; a set of whose first ones too few are in any other is in no pair. Most end here.
2. Of the others, the |s|/5 + 1 rarest shingles of each are taken; two of a pair share one. Sets that do are one group.
3. Pairs are within groups. Small groups are compared in bundles; a large one is cut into blocks of sets with near least
   hashes, and blocks that share a rare shingle are compared. A comparison is a product of matrices of the shingles that
   both sides have, so it costs a set's bytes for each block that it meets, not for each set.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.operators.entities import clusters
from sievelake.session import small_batches, written

WORDS = 5
#: One in so many of a set's shingles is counted besides its first fifth.
EXTRA = 10
#: Shingles that a task gathers before it sends them on, those of a part, and buckets a part.
FLUSH, PART, BUCKETS = 250_000, 2_000_000, 2
#: Bytes of text that are hashed at a time, sets of a block, and shingles of a product.
CHUNK, BLOCK, WIDE = 1 << 17, 256, 8192

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(20_261_128).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_BASE = U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the words: sums over their bytes, each mixed with its place in the word, as differences of one running sum."""
    b = np.frombuffer(data, np.uint8)
    space = np.concatenate([[True], _SPACE[b], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, length = edge[::2], edge[1::2] - edge[::2]
    if not len(length):
        return starts, np.empty(0, np.uint64)
    first = np.cumsum(length) - length
    place = np.arange(first[-1] + length[-1]) - np.repeat(first, length)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(_BYTE[b[~space[1:-1]]] + place.astype(np.uint64) * _BASE), dtype=np.uint64)])
    return starts, _mix(run[first + length] - run[first] + length.astype(np.uint64) * _BASE)


def _combined(h: np.ndarray, width: int) -> np.ndarray:
    s = np.full(max(0, len(h) - width + 1), width, np.uint64)
    for k in range(width):
        s = _mix(s * _BASE + h[k : k + len(s)])
    return s


def _set(words: np.ndarray, runs: np.ndarray) -> np.ndarray:
    return np.unique(runs) if len(words) >= WORDS else _combined(words, len(words)) if len(words) else words


def _parts(data: bytes) -> Iterator[bytes]:
    """A long text in parts, cut at spaces."""
    at = 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        yield data[at:end]
        at = end


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Each text's set: sorted 64-bit hashes of its different runs of five words; of a shorter text, of all its words as one. Short texts are hashed together, CHUNK bytes at a time."""

    def together(held: list[bytes]) -> Iterator[np.ndarray]:
        starts, h = _words(b"\n".join(held))
        edges, runs = np.searchsorted(starts, np.cumsum([0] + [len(x) + 1 for x in held])), _combined(h, WORDS)
        for a, b in zip(edges, edges[1:]):
            yield _set(h[a:b], runs[a : max(a, b - WORDS + 1)])

    held, size = [], 0
    for text in texts:
        data = (text or "").encode()
        if held and size + len(data) > CHUNK:
            yield from together(held)
            held, size = [], 0
        if len(data) > CHUNK:
            h = np.concatenate([_words(x)[1] for x in _parts(data)])
            yield _set(h, _combined(h, WORDS))
        else:
            held.append(data)
            size += len(data)
    if held:
        yield from together(held)


def _mark(s: np.ndarray | bytes) -> bytes:
    return hashlib.blake2b(s, digest_size=16).digest()


def _key(mark: bytes) -> int:
    """Never -1, which stands for a shingle that a task has seen in two sets."""
    return int.from_bytes(mark[:8], "little") >> 1


def _first(n: int) -> int:
    """So many first shingles of a set of n share -(-n // EXTRA) with those of its like."""
    return min(n, n // 5 + -(-n // EXTRA))


def _runs(to: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(part, the columns' bytes) for each part that some rows go to."""
    order = np.argsort(to, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
        if len(part):
            yield int(to[part[0]]), *(c[part].tobytes() for c in columns)


def _different(tokens: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((keys, tokens))
    tokens, keys = tokens[order], keys[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (keys[1:] != keys[:-1])
    return tokens[new], keys[new]


def _sent(held: list[np.ndarray], own: list[int], n_buckets: int) -> pd.DataFrame:
    """Rows of (bucket, told, tokens, keys): pairs by their token's bucket, and by the key's those whose tokens two sets have here; of these tokens one pair with key -1 goes on."""
    tokens, keys = _different(np.concatenate(held), np.repeat(np.array(own, np.int64), [len(s) for s in held]))
    found, inverse, n = np.unique(tokens, return_inverse=True, return_counts=True)
    here = (n > 1)[inverse]
    rows = [(to, True, t, k) for to, t, k in _runs(keys[here] % n_buckets, tokens[here], keys[here])]
    tokens = np.concatenate([tokens[~here], found[n > 1]])
    keys = np.concatenate([keys[~here], np.full((n > 1).sum(), -1, np.int64)])
    rows += [(to, False, t, k) for to, t, k in _runs((_mix(tokens) % U(n_buckets)).astype(np.int64), tokens, keys)]
    return pd.DataFrame(rows, columns=["bucket", "told", "tokens", "keys"])


def may_pair(texts: DataFrame, n_parts: int) -> DataFrame:
    """(key, shared): of how many of a set's first shingles other sets have some among their first. Sets go by 63 bits of their mark: two that share them are taken for one and the other, which only lets more through."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, own, size = [], [], 0
        for batch in batches:
            for s in shingle_sets(batch["text"].tolist()):
                if len(s):
                    held.append(s[: _first(len(s))])
                    own.append(_key(_mark(s)))
                    size += len(held[-1])
                if size > FLUSH:
                    yield _sent(held, own, BUCKETS * n_parts)
                    held, own, size = [], [], 0
        if held:
            yield _sent(held, own, BUCKETS * n_parts)

    def count(_, rows: pd.DataFrame) -> pd.DataFrame:
        joined = lambda name, kind, told: np.frombuffer(b"".join(rows.loc[rows["told"] == told, name]), kind)
        tokens, keys = _different(joined("tokens", np.uint64, False), joined("keys", np.int64, False))
        _, inverse, n = np.unique(tokens, return_inverse=True, return_counts=True)
        common = np.zeros(len(n), bool)
        common[inverse[keys == -1]] = True
        kept = (common | (n > 1))[inverse] & (keys != -1)
        # a set's copies in other tasks may tell the same again
        tokens, keys = (np.concatenate([x[kept], joined(name, kind, True)]) for x, name, kind in ((tokens, "tokens", np.uint64), (keys, "keys", np.int64)))
        return pd.DataFrame(list(_runs(keys % n_parts, tokens, keys)), columns=["part", "tokens", "keys"])

    def total(_, rows: pd.DataFrame) -> pd.DataFrame:
        _, keys = _different(np.frombuffer(b"".join(rows["tokens"]), np.uint64), np.frombuffer(b"".join(rows["keys"]), np.int64))
        keys, n = np.unique(keys, return_counts=True)
        return pd.DataFrame({"key": keys, "shared": n})

    sent = texts.mapInPandas(send, "bucket long, told boolean, tokens binary, keys binary")
    return sent.groupBy("bucket").applyInPandas(count, "part long, tokens binary, keys binary").groupBy("part").applyInPandas(total, "key long, shared long")


def _within(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many shingles each of x shares with each of y."""
    tokens, inverse = np.unique(np.concatenate(x + y), return_inverse=True)
    cut = sum(len(s) for s in x)
    sides = []
    for sets, at in ((x, inverse[:cut]), (y, inverse[cut:])):
        sides.append((np.repeat(np.arange(len(sets)), [len(s) for s in sets]), at))
    both = np.bincount(sides[0][1], minlength=len(tokens)).astype(bool) & np.bincount(sides[1][1], minlength=len(tokens)).astype(bool)
    number = np.cumsum(both) - 1
    sides = [(row[both[at]], number[at[both[at]]]) for row, at in sides]
    out = np.zeros((len(x), len(y)), np.int64)
    for low in range(0, int(both.sum()), WIDE):
        dense = []
        for sets, (row, at) in zip((x, y), sides, strict=True):
            here = (at >= low) & (at < low + WIDE)
            m = np.zeros((len(sets), min(WIDE, int(both.sum()) - low)), np.float32)
            m[row[here], at[here] - low] = 1
            dense.append(m)
        out += np.rint(dense[0] @ dense[1].T).astype(np.int64)  # whole numbers up to WIDE are exact
    return out


FOUND = "a long, b long, i long, n long"


def _compared(x: pd.DataFrame, y: pd.DataFrame | None = None) -> pd.DataFrame:
    """Pairs from x to y and from y to x; without y, of x with itself. Columns: rid, n, in0, in1, hs."""
    same = y is None
    y = x if same else y
    i = _within(*([np.frombuffer(h, np.uint64) for h in side["hs"]] for side in (x, y)))
    n = x["n"].to_numpy()[:, None] + y["n"].to_numpy()[None, :]
    near = 5 * i >= 4 * (n - i)
    if same:
        np.fill_diagonal(near, False)
    out = []
    for a, b, flip in ((x, y, False),) if same else ((x, y, False), (y, x, True)):
        hit = (near.T if flip else near) & a["in0"].to_numpy(bool)[:, None] & b["in1"].to_numpy(bool)[None, :]
        p, q = np.nonzero(hit)
        at = (q, p) if flip else (p, q)
        out.append(pd.DataFrame({"a": a["rid"].to_numpy()[p], "b": b["rid"].to_numpy()[q], "i": i[at], "n": n[at]}))
    return pd.concat(out)


def _bundle(_, rows: pd.DataFrame) -> pd.DataFrame:
    return pd.concat([_compared(g) for _, g in rows.groupby("grp", sort=False)])


def _blocks(_, rows: pd.DataFrame) -> pd.DataFrame:
    i, j = rows["i"].iat[0], rows["j"].iat[0]
    return _compared(rows) if i == j else _compared(rows[rows["block"] == i], rows[rows["block"] == j])


def near_pairs(sets: DataFrame, n_parts: int, block: int = BLOCK) -> DataFrame:
    """(a, b, i, n): pairs of Jaccard 4/5 or more from sets of split 0 to others of split 1, what they share, and their sizes' sum. sets: (rid, n, in0, in1, hs), hs sorted and as bytes."""

    @F.pandas_udf("array<long>")
    def numbers(hs: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(h, np.int64) for h in hs])

    held = sets.select("rid", "n", F.explode(numbers("hs")).alias("h"))
    often = held.groupBy("h").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    shared = held.join(often, "h").groupBy("rid", "n").agg(F.sort_array(F.collect_list(F.struct("often", "h"))).alias("t"))
    # those that no other set has are the rarest and come first
    left = F.col("n") - F.ceil(F.col("n") * 4 / 5) + 1 - (F.col("n") - F.size("t"))
    rare = written(shared.where(left > 0).select("rid", F.explode(F.slice("t", F.lit(1), left.cast("int"))["h"]).alias("h")), "leak-rare")
    groups = clusters(rare.select(F.col("rid").alias("node"), F.col("h").cast("string").alias("key")))
    groups = groups.select(F.col("node").alias("rid"), F.col("cluster").alias("grp"))
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    grouped = written(sets.join(groups, "rid").join(sizes, "grp"), "leak-groups")
    small = grouped.where(F.col("m") <= block).withColumn("bundle", F.pmod(F.xxhash64("grp"), F.lit(8 * n_parts))).repartition(n_parts, "bundle")
    found = written(small.groupBy("bundle").applyInPandas(_bundle, FOUND), "leak-small")
    large = grouped.where(F.col("m") > block)
    if large.isEmpty():
        return found

    # near copies mostly have one least hash, so they are put in one block
    order = Window.partitionBy("grp").orderBy("least", "rid")
    least = F.substring("hs", 1, 8)
    placed = written(large.select("grp", "rid", least.alias("least")).withColumn("block", F.floor((F.row_number().over(order) - 1) / block)).select("grp", "rid", "block"), "leak-places")
    stands = written(rare.join(placed, "rid").select("grp", "h", "block").distinct(), "leak-stands")
    met = stands.select("grp", "h", F.col("block").alias("i")).join(stands.select("grp", "h", F.col("block").alias("j")), ["grp", "h"]).where("i <= j").select("grp", "i", "j").distinct()
    visits = met.select("grp", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    rows = visits.join(placed, ["grp", "block"]).join(large.select("rid", "n", "in0", "in1", "hs"), "rid").repartition(4 * n_parts, "grp", "i", "j")
    return found.union(written(rows.groupBy("grp", "i", "j").applyInPandas(_blocks, FOUND), "leak-large"))


def split_leaks(docs: DataFrame, id_col: str, text_col: str, split: Column, group_col: str, block: int = BLOCK) -> DataFrame:
    """(kind, a, b, jaccard, name): what leaks from split 0 to split 1.

    member: text a has the same shingles as text b, the least id of its class. pair: some text of class a in split 0 and
    some of class b in split 1 have a Jaccard of 0.8 or more (a and b may be one class). group: a group that is in both
    splits, by its least ids; its texts may be in pairs too. Texts without a word are in no class; rows without an id can't be
    named, and are left out. Shingles are compared by 64-bit hashes: two of a pair agree by chance once in 2^64.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), split.alias("split"), F.col(group_col).cast("string").alias("name")).where(F.col("id").isNotNull())
    side = [F.min(F.when(F.col("split") == k, F.col("id"))) for k in (0, 1)]
    groups = rows.where(F.col("name").isNotNull()).groupBy("name").agg(side[0].alias("a"), side[1].alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    texts = rows.select("id", F.col("split").cast("int").alias("split"), F.lower("text").alias("text"))

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(len(s), _mark(s)) for s in shingle_sets(batch["text"].tolist())]
            out = batch[["id", "split"]].assign(n=[n for n, _ in found], mark=[m for _, m in found], key=[_key(m) for _, m in found])
            yield out[out["n"] > 0]

    sets = written(texts.mapInPandas(signed, "id long, split int, n long, mark binary, key long"), "leak-signs")
    here = [F.max((F.col("split") == k).cast("int")) for k in (0, 1)]
    classes = written(sets.groupBy("mark", "n", "key").agg(F.min("id").alias("rid"), F.coalesce(here[0] == 1, F.lit(False)).alias("in0"), F.coalesce(here[1] == 1, F.lit(False)).alias("in1")), "leak-classes")
    members = sets.select("id", "mark").join(classes.select("mark", "rid"), "mark").select(F.lit("member").alias("kind"), F.col("id").alias("a"), F.col("rid").alias("b"))
    same = classes.where("in0 AND in1").select(F.col("rid").alias("a"), F.col("rid").alias("b"), F.lit(1.0).alias("jaccard"))

    n_parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-classes.agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0] // PART))
    # of the least set that this one may be a pair with, the one in EXTRA
    needed = F.ceil(F.ceil(F.col("n") * 4 / 5) / EXTRA)
    kept = written(classes.join(may_pair(texts.select("text"), n_parts), "key").where(F.col("shared") >= needed).select("mark", "rid", "n", "in0", "in1"), "leak-kept")

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch.drop(columns="text").assign(hs=[s.tobytes() for s in shingle_sets(batch["text"].tolist())])
            # an id may have other texts too: the set's own mark tells
            yield out[[_mark(h) == m for h, m in zip(out["hs"], out["mark"], strict=True)]].drop(columns="mark")

    read = texts.select(F.col("id").alias("rid"), "text").join(kept, "rid").select("rid", "n", "in0", "in1", "mark", "text")
    held = written(read.mapInPandas(whole, "rid long, n long, in0 boolean, in1 boolean, hs binary").dropDuplicates(["rid", "hs"]), "leak-sets")
    pairs = near_pairs(held, n_parts, block)
    near = pairs.select("a", "b", F.round(F.col("i") / (F.col("n") - F.col("i")), 6).alias("jaccard"))
    pairs = near.union(same).select(F.lit("pair").alias("kind"), "a", "b", "jaccard")
    return members.unionByName(pairs, allowMissingColumns=True).unionByName(groups.select(F.lit("group").alias("kind"), "a", "b", "name"), allowMissingColumns=True)
