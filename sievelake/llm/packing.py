"""Best-fit packing of token sequences, improved by a swap-based local search.

Documents are tokenised, closed by an end token and, only if longer than a sequence, cut from the back, so that every
piece but the first fills a sequence by itself; such pieces are done. The others, one a document at most, are dealt by a
hash to groups of a bounded size, each packed by one task: best fit in decreasing length first, then a local search over
the underfull sequences. It moves a document into another sequence, exchanges one for one or two for one, whenever that
raises the sum of squared fills, the largest part into the tightest room first, until no such exchange is left or the
group has as few sequences as its tokens need. Sequences that are emptied are gone. A group leaves one loosely filled
sequence or so behind; at GROUP_DOCS documents a group that is less than a thousandth of all.

Null text is empty: the end token alone, one piece. Repeated rows are packed as often as they occur. Of equal lengths the
smaller id, piece and checksum comes first. A very long text is tokenised whole, by one task; its pieces go their own ways.
An empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import base64
import functools
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import written

#: At most about so many pieces are packed together by one task.
GROUP_DOCS = 20_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, slot long"


@functools.cache
def added_tokens(tokenizer_path: str) -> dict[str, int]:
    """Ids of the tokens that a tokenizers file takes as they stand, before any merge."""
    with open(tokenizer_path, encoding="utf-8") as file:
        found = json.load(file)["added_tokens"]
    if odd := [x["content"] for x in found if x["single_word"] or x["lstrip"] or x["rstrip"]]:
        raise ValueError(f"added tokens that take in or need their surroundings: {odd}")
    return {x["content"]: x["id"] for x in found}


@functools.cache
def _encoder(ranks_path: str, pattern: str, tokenizer_path: str | None = None) -> Callable[[str], list[int]]:
    """tiktoken by the rank form of the same vocabulary gives the ids of the tokenizers file at a quarter of the time, between that file's added tokens; a test holds both together."""
    import tiktoken

    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    plain = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    added = added_tokens(tokenizer_path) if tokenizer_path else {}
    if not added:
        return plain
    # the longest of those that begin at a place; each part between them is split into words by itself
    cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")

    def encode(text: str) -> list[int]:
        parts = cut.split(text)
        ids = plain(parts[0])
        for token, part in zip(parts[1::2], parts[2::2]):
            ids.append(added[token])
            ids += plain(part)
        return ids

    return encode


def pieces_of(ids: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: all but the first as long as a sequence."""
    first = len(ids) % capacity or min(len(ids), capacity)
    edges = [0, *range(first, len(ids) + 1, capacity)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _pieces(batches: Iterator[pa.RecordBatch], capacity: int, end_id: int, ranks_path: str, pattern: str, tokenizer_path: str | None) -> Iterator[pa.RecordBatch]:
    encode, seen = _encoder(ranks_path, pattern, tokenizer_path), 0
    for batch in batches:
        out: dict[str, list] = defaultdict(list)
        for doc_id, text in zip(batch["id"], batch["text"], strict=True):
            ids = np.array(encode(text.as_py()) + [end_id], dtype="<u4")
            for k, (at, n) in enumerate(pieces_of(ids, capacity)):
                for name, x in zip(("doc_id", "piece", "start", "length", "ids_crc32", "slot"), (doc_id.as_py(), k, at, n, zlib.crc32(ids[at : at + n].tobytes()), seen), strict=True):
                    out[name].append(x)
                seen += 1
        types = {"piece": pa.int32()}
        yield pa.RecordBatch.from_arrays([pa.array(out[n], types.get(n, pa.int64())) for n in ("doc_id", "piece", "start", "length", "ids_crc32", "slot")], ["doc_id", "piece", "start", "length", "ids_crc32", "slot"])


class Bins:
    """Bins of one capacity, with the free space and the content of each at hand by size."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.items: list[list[int]] = []
        self.fill: list[int] = []

    def best_fit(self) -> None:
        """Longest first, each into the fullest bin that takes it."""
        by_free: dict[int, list[int]] = defaultdict(list)
        mask = 0
        for i in sorted(range(len(self.lengths)), key=lambda i: (-self.lengths[i], i)):
            n = self.lengths[i]
            if above := mask >> n:
                free = n + (above & -above).bit_length() - 1
                b = by_free[free].pop()
                if not by_free[free]:
                    mask ^= 1 << free
                self.items[b].append(i)
            else:
                free, b = self.capacity, len(self.items)
                self.items.append([i])
                self.fill.append(0)
            self.fill[b] += n
            if free > n:
                by_free[free - n].append(b)
                mask |= 1 << (free - n)

    def improve(self) -> bool:
        """Local search between underfull bins: each step raises the sum of squared fills; ends when no exchange does or no bin can be saved. Whether any was made."""
        capacity, lengths, fill, items = self.capacity, self.lengths, self.fill, self.items
        bound = -(-sum(lengths) // capacity)
        n_bins = sum(1 for f in fill if f)
        swaps: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))  # room once an item has left -> the item's length -> bins; length 0: nothing leaves
        spaces = 0  # the rooms that there are, as bits

        def index(b: int, add: bool) -> None:
            nonlocal spaces
            free = capacity - fill[b]
            if not free:
                return
            for n in {0, *(lengths[i] for i in items[b])}:
                space = swaps[n + free]
                if add:
                    space[n].add(b)
                    spaces |= 1 << (n + free)
                else:
                    space[n].discard(b)
                    if not space[n]:
                        del space[n]
                    if not space:
                        spaces &= ~(1 << (n + free))

        def step(a: int) -> bool:
            """Moves from bin a, which is not indexed, what raises the squares: the largest part that fits, where it fits most tightly."""
            parts: dict[int, tuple[int, ...]] = {}
            for k, i in enumerate(items[a]):
                parts.setdefault(lengths[i], (i,))
            singles = {}
            for i in items[a]:
                singles.setdefault(lengths[i], []).append(i)
            for x, xs in singles.items():
                for y, ys in singles.items():
                    if y < x:
                        parts.setdefault(x + y, (xs[0], ys[0]))
                if len(xs) > 1:
                    parts.setdefault(2 * x, (xs[0], xs[1]))
            for size in sorted(parts, reverse=True):
                if size > capacity:
                    continue
                above = spaces >> size
                space = size
                while above:
                    low = (above & -above).bit_length() - 1
                    space += low
                    for back, bins in swaps[space].items():
                        # two never come for none: one of them alone would do as well
                        if back >= size or (not back and len(parts[size]) > 1):
                            continue
                        for b in bins:
                            if fill[b] + size - back > fill[a]:
                                return exchange(a, parts[size], b, back)
                    above >>= low + 1
                    space += 1
            return False

        def exchange(a: int, part: tuple[int, ...], b: int, back: int) -> bool:
            index(b, False)
            returned = next((i for i in items[b] if lengths[i] == back), None) if back else None
            for i in part:
                items[a].remove(i)
                items[b].append(i)
                fill[a] -= lengths[i]
                fill[b] += lengths[i]
            if returned is not None:
                items[b].remove(returned)
                items[a].append(returned)
                fill[b] -= back
                fill[a] += back
            index(b, True)
            return True

        live = {b for b in range(len(items)) if 0 < fill[b] < capacity}
        for b in live:
            index(b, True)
        ever, changed = False, True
        while changed and n_bins > bound:
            changed = False
            for a in sorted(live, key=lambda b: (fill[b], b)):
                if n_bins <= bound:
                    break
                if not 0 < fill[a] < capacity:
                    continue
                index(a, False)
                while items[a] and step(a):
                    changed = ever = True
                index(a, True)
                if not items[a]:
                    index(a, False)
                    live.discard(a)
                    n_bins -= 1
        return ever


def pack(lengths: list[int], capacity: int) -> list[list[int]]:
    """Items by bin; no bin is empty."""
    bins = Bins(lengths, capacity)
    bins.best_fit()
    bins.improve()
    return [b for b in bins.items if b]


def _packed(key, group: pd.DataFrame, capacity: int) -> pd.DataFrame:
    group = group.sort_values(["length", "doc_id", "piece", "ids_crc32"], kind="stable", ignore_index=True)
    sequence, offset = np.zeros(len(group), "int64"), np.zeros(len(group), "int64")
    for k, items in enumerate(pack(group["length"].tolist(), capacity)):
        at = 0
        for i in items:
            sequence[i], offset[i] = (int(key[0]) << 32) + k, at
            at += int(group["length"][i])
    return group.assign(sequence_id=sequence, offset=offset)[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]


def pack_documents(df: DataFrame, ranks_path: str, pattern: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", group_docs: int = GROUP_DOCS, tokenizer_path: str | None = None) -> DataFrame:
    """A row for each piece: where it stands in its document and in which sequence, where. Ids are those of the tokenizers file; without one there are no added tokens."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    n_groups = max(1, -(-df.count() // group_docs))  # a document has one piece at most that does not fill a sequence
    pieces = rows.mapInArrow(lambda x: _pieces(x, capacity, end_id, ranks_path, pattern, tokenizer_path), PIECES)
    # the slot tells repeated rows apart, so that a hot id is dealt out too; full pieces have sequences of their own, with numbers below zero
    part = F.when(F.col("length") < capacity, F.pmod(F.xxhash64("doc_id", "piece", "slot"), F.lit(n_groups)))
    pieces = written(pieces.withColumn("own", -1 - F.monotonically_increasing_id()).withColumn("part", part), "pieces")
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    packed = pieces.where("part is not null").groupBy("part").applyInPandas(lambda key, x: _packed(key, x, capacity), out)
    full = pieces.where("part is null").select("doc_id", "piece", "start", "length", "ids_crc32", F.col("own").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.union(full)
