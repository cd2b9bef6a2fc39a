"""N-gram Jaccard join: T-occurrence search with DivideSkip, and the classes that its links make.

Every text is the set of its 5-word shingles. Texts with equal sets are one class representative from the start. Two
sets with a Jaccard similarity of at least 3/4 share at least 3/4 of the larger; all steps below follow from that, so
no link is lost at any size.

1. Occurrence filter. In the order of their hashes, the first |s|/4 + l of s's shingles and the first |r|/4 + l of r's
   share at least l. A set of whose first shingles too few occur in any other set is linked with nothing. Shingles are
   counted in parts by hash; each task first counts its own, so a shingle that is everywhere arrives once a task.
   Most sets end here; the rest are counted again, all their shingles among themselves.
2. Weak groups. Two linked sets share one of the |s|/4 + 1 rarest shingles of each. Sets that do are united; all links
   are within these groups.
3. Join. In a group, an inverted index holds the sets read so far. For each further set, DivideSkip sets the longest
   lists aside, merges the short ones by a heap, and probes the long ones by binary search only for what the merge
   leaves within reach of T. What is connected already is not looked at again. A group above the limits of one
   task is cut into blocks by hash; blocks are joined inside, their central sets with each other, and then every set
   outside of the largest class so far is searched for in those blocks that hold one of its rare shingles, which any
   set it links with has too.
4. The links' connected components are the classes.

Shingles are 64-bit hashes, mixed at every byte's place; two shingles that are compared share one with a chance of
2 ** -64, and in that sense the join is exact. Sets are told apart by 128-bit digests of all their shingles, and go by
numbers of their own from step 2 on. How many parts the shingles are counted in follows from how many there are.

Null and empty texts have no shingle and are linked with nothing. A text of fewer than five words is one shingle.
Repeated rows are in one class, as are different texts of one id only if they are linked. Rows without an id take part;
a class has the least id of its rows, or none if none has one. Very long texts are read in pieces and are one set. An
empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import discard, fresh, partitions, written
from sievelake.llm.components import UnionFind, components

WORDS_A_SHINGLE = 5
#: One in so many of a set's shingles is counted by the occurrence filter besides its first quarter.
EXTRA = 10
#: A task's own occurrences, or rare shingles, are sent on whenever so many are held.
FLUSH = 250_000
#: Shingles are counted in parts of about so many, and in so many times more buckets than parts; a bucket is what a task holds.
PART_SHINGLES, BUCKETS_A_PART = 2_000_000, 2
#: Occurrence counts are exact up to this.
OFTEN = 64
#: A group with more sets or shingles is joined in blocks.
GROUP_SETS, GROUP_SHINGLES = 128, 125_000
#: Bytes of text that are hashed at a time.
CHUNK = 1 << 17
#: DivideSkip's tuning constant.
MU = 0.0085

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BYTE = np.random.default_rng(20_260_101).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_BASE = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the words in lower-cased bytes: sums over their bytes, each mixed with its place in the word, as differences of one running sum."""
    b = np.frombuffer(data, np.uint8)
    space = np.concatenate([[True], _SPACE[b], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    length = ends - starts
    # the bytes of words only, and the place of each in its own
    first = np.cumsum(length) - length
    place = np.arange(first[-1] + length[-1]) - np.repeat(first, length)
    each = mix(_BYTE[b[~space[1:-1]]] + place.astype(np.uint64) * _BASE)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)])
    return starts, mix(run[first + length] - run[first] + length.astype(np.uint64) * _BASE)


def _combined(h: np.ndarray, width: int) -> np.ndarray:
    n = len(h) - width + 1
    s = np.full(n, width, np.uint64)
    for k in range(width):
        s = mix(s * _BASE + h[k : k + n])
    return s


def _windows(data: bytes) -> Iterator[bytes]:
    """Parts of a long text, cut at spaces."""
    at = 0
    while len(data) - at > CHUNK:
        end = at + CHUNK
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        yield data[at:end]
        at = end
    yield data[at:]


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Each text's set: sorted 64-bit hashes of its shingles."""
    out: list[np.ndarray] = []
    held, size = [], 0

    def flush() -> None:
        starts, h = word_hashes(b"\n".join(held))
        edges = np.searchsorted(starts, np.cumsum([0] + [len(x) + 1 for x in held]))
        grams = _combined(h, WORDS_A_SHINGLE) if len(h) >= WORDS_A_SHINGLE else h[:0]
        for a, b in zip(edges, edges[1:]):
            out.append(_set(h[a:b], grams[a : max(a, b - WORDS_A_SHINGLE + 1)]))

    for text in texts:
        data = (text or "").encode().translate(_LOWER)
        if len(data) > CHUNK:
            flush()
            held, size = [], 0
            h = np.concatenate([word_hashes(x)[1] for x in _windows(data)])
            out.append(_set(h, _combined(h, WORDS_A_SHINGLE) if len(h) >= WORDS_A_SHINGLE else h[:0]))
            continue
        held.append(data)
        size += len(data)
        if size > CHUNK:
            flush()
            held, size = [], 0
    flush()
    return out


def _set(words: np.ndarray, grams: np.ndarray) -> np.ndarray:
    if len(words) >= WORDS_A_SHINGLE:
        return np.unique(grams)
    return _combined(words, len(words)) if len(words) else grams[:0]


def digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if 4 * len(a) < 3 * len(b) or 4 * len(b) < 3 * len(a):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 75 * (len(a) + len(b) - both)


def overlap_needed(a: int, b: int) -> int:
    """The least intersection of linked sets of these sizes: 7 i >= 3 (a + b)."""
    return -(-3 * (a + b) // 7)


# --- 1. occurrence filter -------------------------------------------------------------------------------------------


def prefix_length(n: int) -> int:
    return min(n, n // 4 + -(-n // EXTRA))


def _bucket(tokens: np.ndarray, n: int) -> np.ndarray:
    return ((tokens * _BASE) >> U(40)) % U(n)


def _fresh(tokens: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs, by token and then by key."""
    order = np.lexsort((keys, tokens))
    tokens, keys = tokens[order], keys[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (keys[1:] != keys[:-1])
    return tokens[new], keys[new]


def dealt(to: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(part, the columns' bytes) for each part that some rows go to."""
    order = np.argsort(to, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
        if len(part):
            yield int(to[part[0]]), *(c[part].tobytes() for c in columns)


def occurrences(tokens: np.ndarray, keys: np.ndarray, n_parts: int, least: int) -> Iterator[tuple]:
    """What a task sends on of the (token, key) pairs it holds: rows of (bucket, kind, tokens, keys, often).

    kind 0: pairs of tokens that fewer than `least` keys have here, by the token's bucket, and a pair with key -1 for each
    of the others, which are known to be common. kind 1: the pairs of these, by the key's bucket.
    """
    tokens, keys = _fresh(tokens, keys)
    found, inverse, n = np.unique(tokens, return_inverse=True, return_counts=True)
    common = n >= least
    here = common[inverse]
    often = np.full(here.sum(), OFTEN, np.uint8)
    for to, *data in dealt(keys[here] % n_parts, tokens[here], keys[here], often):
        yield to, 1, *data
    tokens = np.concatenate([tokens[~here], found[common]])
    keys = np.concatenate([keys[~here], np.full(common.sum(), -1, np.int64)])
    for to, *data in dealt(_bucket(tokens, BUCKETS_A_PART * n_parts).astype(np.int64), tokens, keys):
        yield to, 0, *data, None


SENT = "bucket int, kind int, tokens binary, keys binary, often binary"
NAMES = ["bucket", "kind", "tokens", "keys", "often"]


def _send(pairs: Iterator[tuple[int, np.ndarray]], n_parts: int, least: int) -> Iterator[pd.DataFrame]:
    """Gathers (key, tokens) up to FLUSH tokens and sends their occurrences on."""

    def flush() -> pd.DataFrame:
        keys = np.repeat(np.array(own, np.int64), [len(t) for t in held])
        return pd.DataFrame(list(occurrences(np.concatenate(held), keys, n_parts, least)), columns=NAMES)

    own, held, size = [], [], 0
    for key, tokens in pairs:
        if len(tokens):
            own.append(key)
            held.append(tokens)
            size += len(tokens)
        if size > FLUSH:
            yield flush()
            own, held, size = [], [], 0
    if held:
        yield flush()


def _joined(column: pd.Series, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind)


def _counted(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, keys, often) of a bucket's pairs: those of kind 0 whose tokens two or more keys have, and those of kind 1."""
    pairs, told = rows[rows["kind"] == 0], rows[rows["kind"] == 1]
    tokens, keys = _fresh(_joined(pairs["tokens"], np.uint64), _joined(pairs["keys"], np.int64))
    _, inverse, n = np.unique(tokens, return_inverse=True, return_counts=True)
    n = n + np.bincount(inverse[keys == -1], minlength=len(n)) * OFTEN
    often = np.minimum(n, OFTEN)[inverse].astype(np.uint8)
    kept = (often >= 2) & (keys != -1)
    return tuple(np.concatenate([x[kept], _joined(told[name], kind)]) for x, name, kind in ((tokens, "tokens", np.uint64), (keys, "keys", np.int64), (often, "often", np.uint8)))


def signatures(rows: DataFrame) -> DataFrame:
    """rows without their text, with (n, digest, key): the set's size, its digest, and the digest's first 8 bytes as a number."""

    @F.pandas_udf("n long, digest binary, key long")
    def sign(texts: pd.Series) -> pd.DataFrame:
        sets = shingle_sets(texts.tolist())
        marks = [digest(s) for s in sets]
        return pd.DataFrame({"n": [len(s) for s in sets], "digest": marks, "key": [_key(m) for m in marks]})

    others = [c for c in rows.columns if c != "text"]
    return rows.select(*others, sign("text").alias("s")).select(*others, "s.*")


def _key(mark: bytes) -> int:
    """Never -1, which stands for a common token."""
    return int.from_bytes(mark[:8], "little") >> 1


def may_link(rows: DataFrame, n_parts: int) -> DataFrame:
    """(key, shared): of how many of the first shingles of a set other sets have some. Sets that share none are not in it.

    Sets go by their digest's first 63 bits here: two that share them are counted as one, which can only let more through.
    """

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def pairs():
            for batch in batches:
                for s in shingle_sets(batch["text"].tolist()):
                    yield _key(digest(s)), s[: prefix_length(len(s))]

        return _send(pairs(), n_parts, 2)

    def count(_, rows: pd.DataFrame) -> pd.DataFrame:
        keys, n = np.unique(_counted(rows)[1], return_counts=True)
        return pd.DataFrame(list(dealt(keys % n_parts, keys, n.astype(np.int64))), columns=["part", "keys", "n"]).astype({"part": "int32"})

    def total(_, rows: pd.DataFrame) -> pd.DataFrame:
        keys, at = np.unique(_joined(rows["keys"], np.int64), return_inverse=True)
        return pd.DataFrame({"key": keys, "shared": np.bincount(at, _joined(rows["n"], np.int64)).astype(np.int64)})

    counted = rows.select("text").mapInPandas(send, SENT).groupBy("bucket").applyInPandas(count, "part int, keys binary, n binary")
    return counted.groupBy("part").applyInPandas(total, "key long, shared long")


def rare_prefixes(sets: DataFrame, n_parts: int) -> DataFrame:
    """(rid, prefix): of the sets of which three quarters or more occur in others, the shared ones among the |s|/4 + 1 rarest shingles."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def pairs():
            for batch in batches:
                for rid, tokens in zip(batch["rid"].tolist(), batch["tokens"], strict=True):
                    yield rid, np.frombuffer(tokens, np.uint64)

        return _send(pairs(), n_parts, OFTEN)

    def route(_, rows: pd.DataFrame) -> pd.DataFrame:
        tokens, keys, often = _counted(rows)
        return pd.DataFrame(list(dealt(keys % n_parts, tokens, keys, often)), columns=["part", "tokens", "keys", "often"]).astype({"part": "int32"})

    def prefixes(_, sizes: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        tokens, keys, often = _joined(rows["tokens"], np.uint64), _joined(rows["keys"], np.int64), _joined(rows["often"], np.uint8)
        order = np.lexsort((tokens, often, keys))
        tokens, keys = tokens[order], keys[order]
        n_of = dict(zip(sizes["rid"].tolist(), sizes["n"].tolist(), strict=True))
        own, first, shared = np.unique(keys, return_index=True, return_counts=True)
        out = []
        for rid, at, m in zip(own.tolist(), first.tolist(), shared.tolist(), strict=True):
            n = n_of[rid]
            # those that no other set has are the rarest and come first
            left = n // 4 + 1 - (n - m)
            if 4 * m >= 3 * n and left > 0:
                out.append((rid, tokens[at : at + left].view(np.int64).tolist()))
        return pd.DataFrame(out, columns=["rid", "prefix"]).astype({"rid": "int64"})

    parts = sets.select("rid", "tokens").mapInPandas(send, SENT).groupBy("bucket").applyInPandas(route, "part int, tokens binary, keys binary, often binary")
    sizes = sets.select("rid", "n", F.pmod("rid", F.lit(n_parts)).cast("int").alias("part"))
    return sizes.groupBy("part").cogroup(parts.groupBy("part")).applyInPandas(prefixes, "rid long, prefix array<long>")


# --- 2. weak groups -------------------------------------------------------------------------------------------------


def weak_edges(prefixes: DataFrame) -> DataFrame:
    """Edges (a, b) that unite all sets with a prefix token in common. A task unites its own first and sends each token on once, or whenever FLUSH are held."""

    def unite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush() -> pd.DataFrame:
            edges = [(None, a, b) for a, b in seen.stars()] + [(t, a, a) for t, a in first.items()]
            columns = zip(*edges, strict=True) if edges else ([], [], [])
            return pd.DataFrame({name: pd.array(list(x), dtype="Int64") for name, x in zip(("token", "a", "b"), columns, strict=True)})

        seen, first = UnionFind(), {}
        for batch in batches:
            for rid, tokens in zip(batch["rid"].tolist(), batch["prefix"], strict=True):
                for t in tokens.tolist():
                    if first.setdefault(t, rid) != rid:
                        seen.unite(first[t], rid)
                if len(first) > FLUSH:
                    yield flush()
                    seen, first = UnionFind(), {}
        yield flush()

    found = written(prefixes.mapInPandas(unite, "token long, a long, b long"), "weak-edges")
    tokens = found.where(F.col("token").isNotNull()).select("token", "a")
    least = tokens.groupBy("token").agg(F.min("a").alias("b"), F.max("a").alias("top")).where("top > b").select("token", "b")
    return found.where(F.col("token").isNull()).select("a", "b").union(tokens.join(least, "token").select("a", "b")).where("a <> b")


# --- 3. join --------------------------------------------------------------------------------------------------------


class Inverted:
    """Lists of the sets that have a token, in the order in which they came."""

    def __init__(self) -> None:
        self.lists: dict[int, list[int]] = {}

    def add(self, k: int, tokens: list[int]) -> None:
        for t in tokens:
            self.lists.setdefault(t, []).append(k)

    def search(self, tokens: list[int], least: int) -> Iterator[tuple[int, int]]:
        """(set, occurrences) of every set that is in at least `least` of the tokens' lists, by DivideSkip."""
        lists = [x for t in tokens if (x := self.lists.get(t))]
        if len(lists) < least:
            return
        lists.sort(key=len, reverse=True)
        n_long = max(0, min(least - 1, int(least / (MU * math.log2(1 + len(lists[0])) + 1))))
        long, short = lists[:n_long], lists[n_long:]
        for k, same in itertools.groupby(heapq.merge(*short)):
            n = sum(1 for _ in same)
            if n < least - n_long:
                continue
            for left, x in enumerate(long):
                if n + n_long - left < least:
                    break
                at = bisect.bisect_left(x, k)
                n += at < len(x) and x[at] == k
            if n >= least:
                yield k, n


def central(sets: list[np.ndarray]) -> int:
    """The set whose shingles are, on the average, in most of the sets."""
    tokens, inverse, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    edges = np.cumsum([0] + [len(s) for s in sets])
    means = np.add.reduceat(n[inverse].astype(float), edges[:-1]) / np.maximum(1, np.diff(edges))
    return int(means.argmax())


def join_sets(sets: list[np.ndarray], labels: list[int] | None = None, query: list[bool] | None = None) -> list[int]:
    """The least member (by place) of each set's class. labels: classes known before. query: only links with one of these are looked for."""
    known = UnionFind()
    if labels is not None:
        first: dict[int, int] = {}
        for k, x in enumerate(labels):
            known.unite(first.setdefault(x, k), k)
    pivot = central(sets)
    inner, outer = Inverted(), Inverted()
    # those that look come last; lists hold places in this order, so they are sorted as they grow
    order = sorted(range(len(sets)), key=lambda k: (query is not None and query[k], len(sets[k]), k))
    for place, k in enumerate(order):
        tokens, mine = sets[k], sets[k].tolist()
        if query is None or query[k]:
            if known.root(k) != known.root(pivot) and similar(tokens, sets[pivot]):
                known.unite(k, pivot)
            for index in (outer,) if known.root(k) == known.root(pivot) else (outer, inner):
                for at, both in index.search(mine, -(-3 * len(tokens) // 4)):
                    s = order[at]
                    if known.root(s) != known.root(k) and both >= overlap_needed(len(tokens), len(sets[s])):
                        known.unite(s, k)
        # what is in the pivot's class as it comes is looked at only by sets outside of it
        (inner if known.root(k) == known.root(pivot) else outer).add(place, mine)
    return [known.root(k) for k in range(len(sets))]


def _tokens(column: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column]


EDGES = "a long, b long, size long, central boolean"


def _join_group(group: pd.DataFrame) -> pd.DataFrame:
    """(set, least of its class, class size, whether it is the central set of the group's largest class)."""
    group = group.sort_values("rid", ignore_index=True)
    sets, rids = _tokens(group["tokens"]), group["rid"].tolist()
    roots = join_sets(sets)
    sizes = Counter(roots)
    largest = max(sizes, key=lambda r: (sizes[r], -r))
    members = [k for k, r in enumerate(roots) if r == largest]
    middle = members[central([sets[k] for k in members])]
    return pd.DataFrame([(rids[k], rids[r], sizes[r], k == middle) for k, r in enumerate(roots)], columns=["a", "b", "size", "central"])


def _join_central(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("rid", ignore_index=True)
    roots, rids = join_sets(_tokens(group["tokens"])), group["rid"].tolist()
    return pd.DataFrame([(rids[k], rids[r]) for k, r in enumerate(roots) if k != r], columns=["a", "b"], dtype="int64")


def _join_across(group: pd.DataFrame) -> pd.DataFrame:
    """Links between labels, of the query sets with all others of the block, as edges between labels."""
    group = group.sort_values(["query", "rid"], ignore_index=True)
    labels = group["label"].tolist()
    if not group["query"].any():
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    roots = join_sets(_tokens(group["tokens"]), labels, group["query"].tolist())
    edges = {(labels[k], labels[r]) for k, r in enumerate(roots) if labels[k] != labels[r]}
    return pd.DataFrame(sorted(edges), columns=["a", "b"], dtype="int64")


def links(sets: DataFrame, groups: DataFrame, prefixes: DataFrame, n_parts: int, group_sets: int = GROUP_SETS, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """Edges (a, b) whose components are the classes of all links. sets: (rid, n, tokens); groups: (rid, grp); prefixes: (rid, prefix).

    Blocks are dealt to a stated number of parts: they are few bytes and much work, and would be put together by size.
    """
    sizes = groups.join(sets.select("rid", "n"), "rid").groupBy("grp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / group_sets), F.ceil(F.sum("n") / group_shingles)).alias("n_blocks"))
    grouped = sets.join(groups.join(sizes, "grp"), "rid").withColumn("block", F.pmod(F.xxhash64("rid"), F.col("n_blocks")))
    grouped = written(grouped, "join-groups")
    inside = written(grouped.repartition(n_parts, "grp", "block").groupBy("grp", "block").applyInPandas(_join_group, EDGES), "join-inside")
    edges = inside.select("a", "b").where("a <> b")

    large = grouped.where("n_blocks > 1")
    if large.isEmpty():
        return edges
    middles = large.join(inside.where("central").select(F.col("a").alias("rid")), "rid", "left_semi")
    # of very many blocks, the central sets are joined in blocks themselves
    tied = written(middles.groupBy("grp", F.floor(F.col("block") / group_sets).alias("part")).applyInPandas(_join_central, "a long, b long"), "join-central")
    places = large.select("rid", "grp", "block", "n")
    large_edges = edges.join(places.select(F.col("rid").alias("a")), "a", "left_semi")
    label = components(large_edges.union(tied), "join-labels")
    labelled = written(places.join(label.withColumnsRenamed({"node": "rid", "component": "label"}), "rid", "left").withColumn("label", F.coalesce("label", "rid")), "join-labelled")
    by_label = labelled.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("m"))
    largest = by_label.groupBy("grp").agg(F.max_by("label", F.struct("m", -F.col("label"))).alias("top"))

    # which of a group's sets outside its largest class go to which of its blocks: those with one of their rare shingles
    rare = prefixes.join(labelled, "rid").select("rid", "n", "grp", "block", "label", F.explode("prefix").alias("token"))
    held = rare.select("grp", "token", F.col("block").alias("to")).distinct()
    asking = rare.select("rid", "n", "grp", "label", "token").join(largest, "grp").where("label <> top").drop("label", "top")
    routed = written(asking.join(held, ["grp", "token"]).select("rid", "n", "grp", "to").distinct(), "join-routed")
    visits = routed.groupBy("grp", F.col("to").alias("block")).agg(F.greatest(F.ceil(F.count(F.lit(1)) / group_sets), F.ceil(F.sum("n") / group_shingles)).alias("n_chunks"))
    columns = ["grp", "block", "chunk", "rid", "tokens", "label", "query"]
    owned = labelled.select("rid", "label")
    tokens = large.select("rid", "tokens")
    asked = routed.select("rid", "grp", F.col("to").alias("block")).join(visits, ["grp", "block"]).withColumn("chunk", F.pmod(F.xxhash64("rid", F.lit(1)), F.col("n_chunks")))
    asked = asked.join(tokens, "rid").join(owned, "rid").withColumn("query", F.lit(True)).select(columns)
    filed = large.join(visits, ["grp", "block"]).join(owned, "rid").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chunks") - 1))).withColumn("query", F.lit(False)).select(columns)
    # written, as are all results of Python workers: a task that runs two of them in a row holds twice the memory
    across = written(asked.union(filed).repartition(n_parts, "grp", "block", "chunk").groupBy("grp", "block", "chunk").applyInPandas(_join_across, "a long, b long"), "join-across")
    return edges.union(tied).union(across)


def classified(rows: DataFrame, group_sets: int = GROUP_SETS, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """rows of (id long, text, others) without their text, with (n, class, least): the set's size, its class (the least of the class's digests; null without shingles) and the class's least id."""
    spark = rows.sparkSession
    rows = rows.withColumn("mark", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    signed = written(signatures(rows), "signatures")
    # a class's text is found by its mark, as neither ids nor rows are unique
    classes = written(signed.where("n > 0").groupBy("digest", "n", "key").agg(F.min("id").alias("own"), F.min("mark").alias("mark"), F.count(F.lit(1)).alias("copies")), "classes")
    n_shingles, n_rows = classes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("copies"), F.lit(0))).collect()[0]
    n_parts = max(partitions(spark), -(-n_shingles // PART_SHINGLES))

    # of the least set that this one may link with, the one in EXTRA
    needed = F.ceil(F.ceil(F.col("n") * 3 / 4) / EXTRA)
    kept = written(classes.join(may_link(rows, n_parts), "key").where(F.col("shared") >= needed).select("digest", "n", "mark"), "may-link")
    left = written(kept.withColumn("rid", F.monotonically_increasing_id()), "numbered")

    @F.pandas_udf("binary")
    def to_set(texts: pd.Series) -> pd.Series:
        return pd.Series([s.tobytes() for s in shingle_sets(texts.tolist())])

    # each task first drops its own copies; the hint keeps the plan the same at every size
    texts = rows.groupBy("mark").agg(F.first("text").alias("text"))
    wanted = texts.join(left.select("mark", "rid", "n").hint("merge"), "mark")
    sets = written(wanted.select("rid", "n", to_set("text").alias("tokens")), "sets")

    prefixes = written(rare_prefixes(sets, n_parts), "prefixes")
    weak = components(weak_edges(prefixes), "weak")
    # the least node of a group is not listed
    groups = written(weak.select(F.col("node").alias("rid"), F.col("component").alias("grp")).union(weak.select("component", "component")).distinct(), "groups")
    found = components(links(sets, groups, prefixes, n_parts, group_sets, group_shingles), "links")
    for table in (sets, prefixes, groups):
        discard(table)
    members = found.union(found.select("component", "component")).distinct().withColumnRenamed("node", "rid").join(left, "rid").select("digest", "n", "component")
    members = written(members.join(classes, ["digest", "n"]).select("digest", "n", "component", "own"), "members")
    least = members.groupBy("component").agg(F.min("own").alias("least"), F.min("digest").alias("class"))
    labels = members.join(least, "component").select("digest", "n", "least", "class")
    linked = classes.select("digest", "n", "own", "copies").join(labels, ["digest", "n"], "left").select("digest", "n", "copies", F.coalesce("least", "own").alias("least"), F.coalesce("class", "digest").alias("class"))
    linked = written(linked, "linked")
    # classes whose copies would fill a part by themselves, 2 * n_parts at most, come to the rows; the others' rows go to them
    hot = F.broadcast(linked.where(F.col("copies") * 2 * n_parts > n_rows).drop("copies"))
    rest = linked.where(F.col("copies") * 2 * n_parts <= n_rows).drop("copies")
    others = [c for c in rows.columns if c not in ("text", "mark")]
    of_hot = signed.join(hot, ["digest", "n"])
    of_rest = signed.join(hot.select("digest", "n"), ["digest", "n"], "left_anti").join(rest, ["digest", "n"], "left")
    return of_hot.select(*others, "n", "class", "least").union(of_rest.select(*others, "n", "class", "least"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_sets: int = GROUP_SETS, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """(id, n_shingles, component_id): every row's set size, and the least id that links reach from it."""
    found = classified(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), group_sets, group_shingles)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each class of linked rows one, whole: the one with the least id, and of those with the same the one whose text has the least hash, the first of equal ones. Rows without shingles are linked with nothing, and all stay. Rows are numbered once, under a name that they do not have."""
    row = fresh(df, "row")
    blank = ~F.coalesce(F.col(f"`{text_col}`").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    worded = written(df.where(~blank).withColumn(row, F.monotonically_increasing_id()), "worded")
    found = classified(worded.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(row).alias("row"), F.md5(F.col(f"`{text_col}`").cast("binary")).alias("sum")))
    first = F.min_by("row", F.struct(F.col("id").isNull(), "id", "sum", "row"))
    chosen = written(found.groupBy("class").agg(first.alias(row)).select(row), "chosen")
    once = worded.join(chosen.hint("merge"), row, "left_semi")
    return once.select([F.col(f"`{c}`") for c in df.columns]).union(df.where(blank))
