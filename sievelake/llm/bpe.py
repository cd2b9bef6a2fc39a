"""Byte-level BPE encoding and decoding by overlapping chunks.

A text of up to `chunk_chars` code points is one chunk. A longer one is dealt out as chunks that overlap, over all
tasks. Each chunk is pre-tokenised by itself; where a start of a pre-token in a chunk's head is also one in the tail
of the chunk before it, both read on alike from there (a pre-token depends only on the text after its start), and the
chunks are stitched at that place. Chunks that never resynchronise (one run of letters longer than the overlap) are
joined and read as one. Then the pre-tokens of each stitched span are encoded. Decoding concatenates raw bytes.

Null text is empty: no ids. An empty table gives an empty table. Repeated rows give repeated rows. Only the id and
text columns are read, so other columns, whatever their names, do not matter.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelake.llm.common import written

CHUNK_CHARS, OVERLAP_CHARS = 32_768, 2_048
#: Starts so near a chunk's cut end may owe themselves to the cut (half a contraction, half a run of spaces).
CUT_MARGIN = 8
#: Pre-tokens whose ids a worker remembers.
CACHE = 200_000


@functools.cache
def _tables(ranks_path: str, pattern: str):
    import regex
    import tiktoken

    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    raw = [b""] * (max(ranks.values()) + 1)
    for piece, i in ranks.items():
        raw[i] = piece
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return regex.compile(pattern), encoding._core_bpe.encode_single_piece, raw, {}


def encode_pieces(pieces: list[str], ranks_path: str, pattern: str) -> bytes:
    """The ids of pre-tokens, as little-endian unsigned 32-bit integers."""
    _, encode, _, known = _tables(ranks_path, pattern)
    try:
        return b"".join([known[p] for p in pieces])
    except KeyError:
        pass
    if len(known) > CACHE:
        known.clear()
    for p in set(pieces):
        if p not in known:
            known[p] = np.array(encode(p.encode()), dtype="<u4").tobytes()
    return b"".join([known[p] for p in pieces])


def _starts(text: str, ranks_path: str, pattern: str) -> np.ndarray:
    return np.fromiter((m.start() for m in _tables(ranks_path, pattern)[0].finditer(text)), dtype="<i4")


def resync(before: bytes, own: bytes, step: int, cut: int) -> int | None:
    """The first place in a chunk, as an offset in it, that starts a pre-token in it and in the chunk before it.

    before, own: starts of both chunks; step: how far the chunk lies after the other; cut: the other's length.
    """
    x = np.frombuffer(before, "<i4")
    x = x[(x >= step) & (x <= cut - CUT_MARGIN)] - step
    found = np.intersect1d(x, np.frombuffer(own, "<i4"), assume_unique=True)
    return int(found[0]) if len(found) else None


def _chunks(batches: Iterator[pd.DataFrame], step: int, overlap: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row_id, text in zip(batch["row_id"], batch["text"], strict=True):
            for i, at in enumerate(range(0, len(text), step)):
                yield pd.DataFrame({"row_id": [row_id], "chunk": [i], "text": [text[at : at + step + overlap]]})


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """(id_col, ids): each text's ids as little-endian unsigned 32-bit integers."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    # as many bytes as code points at least, so a text that this filter keeps may still be one chunk
    is_long = F.octet_length("text") > chunk_chars

    @F.pandas_udf("binary")
    def whole(texts: pd.Series) -> pd.Series:
        find = _tables(ranks_path, pattern)[0].findall
        return pd.Series([encode_pieces(find(t), ranks_path, pattern) for t in texts], dtype=object)

    @F.pandas_udf("binary")
    def starts(texts: pd.Series) -> pd.Series:
        return pd.Series([_starts(t, ranks_path, pattern).tobytes() for t in texts], dtype=object)

    @F.pandas_udf("int")
    def place(before: pd.Series, own: pd.Series, cut: pd.Series) -> pd.Series:
        return pd.Series([0 if b is None else resync(b, o, chunk_chars, int(c)) for b, o, c in zip(before, own, cut, strict=True)], dtype="Int32")

    @F.pandas_udf("binary")
    def span(texts: pd.Series, begin: pd.Series, end: pd.Series) -> pd.Series:
        find, out = _tables(ranks_path, pattern)[0].finditer, []
        for t, a, b in zip(texts, begin, end, strict=True):
            pieces, stop = [], len(t) if pd.isna(b) else int(b)
            for m in find(t, int(a)):
                if m.start() >= stop:
                    break
                pieces.append(m.group())
            out.append(encode_pieces(pieces, ranks_path, pattern))
        return pd.Series(out, dtype=object)

    @F.pandas_udf("binary")
    def joined(parts: pd.Series) -> pd.Series:
        return pd.Series([b"".join(p) for p in parts], dtype=object)

    short = rows.where(~is_long).select("id", whole("text").alias("ids"))
    # numbered once, in a table: both readings below, and a task that runs again, see the same numbers
    long = written(rows.where(is_long).withColumn("row_id", F.monotonically_increasing_id()), "bpe-long")
    by_row = Window.partitionBy("row_id").orderBy("chunk")
    chunks = (
        long.select("row_id", "text")
        .mapInPandas(lambda x: _chunks(x, chunk_chars, overlap), "row_id long, chunk int, text string")
        .repartition("row_id", "chunk")
        .withColumn("starts", starts("text"))
        .withColumn("before", F.lag("starts").over(by_row))
        .withColumn("cut", F.lag(F.length("text")).over(by_row))
        .withColumn("at", place("before", "starts", F.coalesce("cut", F.lit(0))))
        .withColumn("span", F.count("at").over(by_row))
    )
    # a span is a chunk, with those after it that did not resynchronise; its body ends where the next span starts
    spans = (
        chunks.groupBy("row_id", "span")
        .agg(F.min_by("at", "chunk").alias("at"), F.max("chunk").alias("last"), F.max_by("text", "chunk").alias("tail"), F.sort_array(F.collect_list(F.struct("chunk", F.substring("text", 1, chunk_chars).alias("body")))).alias("bodies"))
        .withColumn("size", F.size("bodies"))
        .withColumn("text", F.concat(F.array_join(F.slice("bodies", 1, F.greatest(F.col("size") - 1, F.lit(0)))["body"], ""), "tail"))
        .withColumn("end", F.lead("at").over(Window.partitionBy("row_id").orderBy("span")) + F.col("size") * chunk_chars)
        .select("row_id", "span", span("text", "at", "end").alias("ids"))
        .groupBy("row_id")
        .agg(F.sort_array(F.collect_list(F.struct("span", "ids"))).alias("parts"))
        .select("row_id", joined(F.col("parts")["ids"]).alias("ids"))
    )
    return short.unionByName(long.select("row_id", "id").join(spans, "row_id").select("id", "ids")).withColumnRenamed("id", id_col)


def decode(ids: F.Column, ranks_path: str, pattern: str) -> F.Column:
    """The bytes that ids (as encode() gives them) stand for."""

    @F.pandas_udf("binary")
    def raw(column: pd.Series) -> pd.Series:
        table = _tables(ranks_path, pattern)[2]
        return pd.Series([b"".join([table[i] for i in np.frombuffer(x, "<u4").tolist()]) for x in column], dtype=object)

    return raw(ids)


def digests(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    return encoded.select(
        id_col,
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(decode(F.col("ids"), ranks_path, pattern), 256).alias("decoded_sha256"),
    )
