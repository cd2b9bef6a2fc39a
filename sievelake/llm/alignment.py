"""Alignment of two tokenisers over the same texts: which tokens of one stand for which of the other.

Tokeniser A is byte-level BPE by its ranks and reads a space and the text; B is a SentencePiece model, which adds that space
itself. Both split the same bytes, so a place where a token of A and one of B both end cuts both sequences: what stands
between two such cuts is a group, and each token of A in it is linked with each of B in it.

A task takes documents in blocks of a bounded number of bytes. Token intervals of a block are tables in DuckDB: a semi join
finds the common ends, a window sum numbers the groups, ASOF joins give each token its group, and a join of the ids in each
group gives each document's id pairs with the number of their links, in wide groups without listing links. A block adds up in how many of its documents a pair stands; Spark sums these partial counts over all blocks,
finds the highest count of each id of A, and brings the counts of a block's pairs back to its documents.

Null and empty texts, and texts whose tokens of A or B do not spell the space and the text (B's model takes U+2581 for a
space), have no tokens: zeros, and an empty string for the digest. Strings of special tokens inside texts are plain text.
Repeated rows and ids count as often as they occur; null ids are kept. A very long text is a block by itself, read whole. An
empty table gives no rows. Only the id and text columns are read, so other columns, whatever their names, do not matter.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import written

#: UTF-8 bytes of the texts that are aligned at once, if not one text is longer.
BLOCK_BYTES = 2_000_000
SPACE = "▁"

ROWS = "block long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, place binary, links binary, pair_a binary, pair_b binary, pair_docs binary"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

#: In groups of so many bytes at most, links are counted as they are joined; in wider ones each id is counted first, so a long group costs its ids, not its links.
NARROW = 64
GROUPS = """CREATE OR REPLACE TEMP TABLE cuts AS
  SELECT e, d, CAST(sum(1) OVER (ROWS UNBOUNDED PRECEDING) AS INTEGER) - 1 AS g, e - coalesce(lag(e) OVER (), 0) AS width FROM (SELECT a.e, a.d FROM a SEMI JOIN b USING (e) ORDER BY a.e)"""
TOKENS = "CREATE OR REPLACE TEMP TABLE {0}_in AS SELECT x.e, x.id, c.g, c.d, c.width FROM {0} x ASOF JOIN cuts c ON x.e <= c.e"
PAIRS = f"""CREATE OR REPLACE TEMP TABLE doc_pairs AS
  SELECT x.d, x.id AS a, y.id AS b, count(*) AS links FROM (SELECT d, id, g FROM a_in WHERE width <= {NARROW}) x JOIN (SELECT id, g FROM b_in WHERE width <= {NARROW}) y USING (g) GROUP BY x.d, x.id, y.id"""
WIDE = f"""INSERT INTO doc_pairs SELECT x.d, x.id, y.id, CAST(sum(x.n * y.n) AS BIGINT)
  FROM (SELECT g, d, id, count(*) AS n FROM a_in WHERE width > {NARROW} GROUP BY g, d, id) x
  JOIN (SELECT g, id, count(*) AS n FROM b_in WHERE width > {NARROW} GROUP BY g, id) y USING (g) GROUP BY x.d, x.id, y.id"""
MERGED = "CREATE OR REPLACE TEMP TABLE doc_pairs AS SELECT d, a, b, CAST(sum(links) AS BIGINT) AS links FROM doc_pairs GROUP BY d, a, b"
BLOCK_PAIRS = "CREATE OR REPLACE TEMP TABLE pairs AS SELECT a, b, count(*) AS docs, row_number() OVER (ORDER BY a, b) - 1 AS place FROM doc_pairs GROUP BY a, b"


class Vocabulary:
    """Bytes of each id, and the ids as text: with a comma, then with what follows the last one of a group."""

    def __init__(self, raw: list[bytes], close: str):
        self.raw = raw
        self.length = np.array([len(x) for x in raw], "int64")
        self.listed = np.array([f"{i}{end}" for end in (",", close) for i in range(len(raw))], object)

    def spells(self, ids: list[int], wanted: bytes) -> bool:
        return b"".join([self.raw[i] for i in ids]) == wanted


@functools.cache
def byte_tokenizer(ranks_path: str, pattern: str):
    """The ids of texts by byte-level BPE, and the vocabulary."""
    import tiktoken

    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    raw = [b""] * (max(ranks.values()) + 1)
    for piece, i in ranks.items():
        raw[i] = piece
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    if missing := set(bytes([b]) for b in range(256)) - set(ranks):
        raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
    return (lambda texts: [encoding.encode_ordinary(f" {t}") for t in texts]), Vocabulary(raw, "|")


@functools.cache
def piece_tokenizer(model_path: str):
    """The ids of texts by a SentencePiece model, and the vocabulary in bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    bytes_of = lambda i: bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace(SPACE, " ").encode()
    return (lambda texts: model.encode(texts, num_threads=1)), Vocabulary([bytes_of(i) for i in range(model.vocab_size())], ";")


@functools.cache
def _database():
    """One database in the memory of a worker; a block is bounded, so it needs no folder."""
    import duckdb

    con = duckdb.connect(config={"threads": 1})
    con.execute("SET temp_directory = ''")
    return con


def align_block(ids: list, texts: list[str], block: int, a_files: tuple, b_files: tuple) -> pa.RecordBatch:
    """One row for each document of a block, and a last one, without an id of its own, for the pairs of the block."""
    (encode_a, a), (encode_b, b) = byte_tokenizer(*a_files), piece_tokenizer(*b_files)
    wanted = [f" {t}".encode() for t in texts]
    # tokens of A spell every text, as its vocabulary has all bytes; those of B do not where its model changes characters
    tokens = [(x, y) if t and b.spells(y, w) else ([], []) for t, w, x, y in zip(texts, wanted, encode_a(texts), encode_b(texts), strict=True)]
    n = len(texts)
    n_a, n_b = (np.array([len(t[k]) for t in tokens], "int64") for k in (0, 1))
    groups, links, digests = np.zeros(n, "int64"), np.zeros(n, "int64"), [""] * n
    empty = np.zeros(0, "int32")
    place, count, bounds = empty, empty.astype("int64"), np.zeros(n + 1, "int64")
    pairs = {"a": empty, "b": empty, "docs": empty}
    if n_a.any():
        id_a, id_b = (np.fromiter(chain.from_iterable(t[k] for t in tokens), "int32", count=int(sizes.sum())) for k, sizes in ((0, n_a), (1, n_b)))
        width = "int32" if sum(map(len, wanted)) < 1 << 31 else "int64"
        end_a, end_b = (np.cumsum(x, dtype="int64").astype(width) for x in (a.length[id_a], b.length[id_b]))
        some = np.flatnonzero(n_a)
        con = _database()
        con.register("a", pa.table({"e": end_a, "id": id_a, "d": np.repeat(np.arange(n, dtype="int32"), n_a)}))
        con.register("b", pa.table({"e": end_b, "id": id_b}))
        for statement in (GROUPS, TOKENS.format("a"), TOKENS.format("b"), PAIRS):
            con.execute(statement)
        if con.execute(f"SELECT count(*) FROM cuts WHERE width > {NARROW}").fetchone()[0]:
            con.execute(WIDE)
            con.execute(MERGED)
        con.execute(BLOCK_PAIRS)
        in_a, in_b = (con.execute(f"SELECT g FROM {x}_in ORDER BY e").fetchnumpy()["g"] for x in "ab")
        cuts = con.execute("SELECT e, d FROM cuts ORDER BY g").fetchnumpy()
        groups = np.bincount(cuts["d"], minlength=n)
        pairs = con.execute("SELECT a, b, docs FROM pairs ORDER BY place").fetchnumpy()
        found = con.execute("SELECT x.d, p.place, x.links FROM doc_pairs x JOIN pairs p USING (a, b) ORDER BY x.d, p.place").fetchnumpy()
        place, count = found["place"].astype("int32"), found["links"].astype("int64")
        bounds = np.searchsorted(found["d"], np.arange(n + 1))
        links = np.add.reduceat(np.append(count, 0), bounds[:-1]) * (np.diff(bounds) > 0)
        # the listing: a group's ids of A, then those of B; the last of each is closed by | and by ;
        size_a, size_b = np.bincount(in_a, minlength=len(cuts["e"])), np.bincount(in_b, minlength=len(cuts["e"]))
        listing = np.empty(len(id_a) + len(id_b), object)
        listing[np.arange(len(id_a)) + (np.cumsum(size_b) - size_b)[in_a]] = a.listed[id_a + len(a.raw) * (end_a == cuts["e"][in_a])]
        listing[np.arange(len(id_b)) + np.cumsum(size_a)[in_b]] = b.listed[id_b + len(b.raw) * (end_b == cuts["e"][in_b])]
        edges = np.cumsum([0, *(n_a + n_b)])
        for d in some:
            digests[d] = hashlib.sha256("".join(listing[edges[d] : edges[d + 1]].tolist())[:-1].encode()).hexdigest()
    cut = lambda x: [x[p:q].tobytes() for p, q in zip(bounds, bounds[1:])]
    whole = [None] * n
    raw = lambda name: pa.array([*whole, pairs[name].astype("int32").tobytes()], pa.binary())
    of_documents = {"id": [*ids, None], "n_a": [*n_a.tolist(), None], "n_b": [*n_b.tolist(), None], "n_groups": [*groups.tolist(), None], "n_links": [*links.tolist(), None]}
    columns = {"block": pa.array([block] * (n + 1), pa.int64())} | {k: pa.array(v, pa.int64()) for k, v in of_documents.items()}
    columns |= {"groups_sha256": pa.array([*digests, None], pa.string()), "place": pa.array([*cut(place), None], pa.binary()), "links": pa.array([*cut(count), None], pa.binary())}
    return pa.RecordBatch.from_pydict(columns | {"pair_a": raw("a"), "pair_b": raw("b"), "pair_docs": raw("docs")})


def _blocks(batches: Iterator[pa.RecordBatch], a_files: tuple, b_files: tuple, block_bytes: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    block, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
    for batch in batches:
        for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids.append(i)
            texts.append(text)
            size += len(text.encode())
            if size >= block_bytes:
                yield align_block(ids, texts, block, a_files, b_files)
                block, ids, texts, size = block + 1, [], [], 0
    if ids:
        yield align_block(ids, texts, block, a_files, b_files)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of each block as rows."""
    for batch in batches:
        for r in batch.to_pylist():
            columns = [np.frombuffer(r[name], "int32") for name in ("pair_a", "pair_b", "pair_docs")]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), r["block"])), *map(pa.array, columns)], ["block", "a", "b", "docs"])


def _scored(documents: pa.Table, pairs: pa.Table) -> pa.Table:
    """A block's documents with the sums over their links; its pairs in the order that places are counted in."""
    pairs = pairs.sort_by([("a", "ascending"), ("b", "ascending")])
    count, best = pairs["count"].to_numpy(), pairs["best"].to_numpy()
    n_best, total = [], []
    for place, links in zip(documents["place"].to_pylist(), documents["links"].to_pylist(), strict=True):
        at, n = np.frombuffer(place, "int32"), np.frombuffer(links, "int64")
        n_best.append(int(n[best[at]].sum()))
        total.append(int((n * count[at]).sum()))
    columns = {k: documents[k] for k in ("n_a", "n_b", "n_groups", "n_links")}
    return pa.table({"doc_id": documents["id"]} | columns | {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(total, pa.int64()), "groups_sha256": documents["groups_sha256"]})


def aligned(df: DataFrame, ranks_path: str, pattern: str, model_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """What each block gives: its documents, and one row with its pairs (a null `place`); written, so read as often as needed."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return written(rows.mapInArrow(lambda x: _blocks(x, (ranks_path, pattern), (model_path,), block_bytes), ROWS), "aligned")


def block_pairs(found: DataFrame) -> DataFrame:
    """(block, a, b, docs): in how many of a block's documents a pair is linked."""
    return found.where("place is null").select("block", "pair_a", "pair_b", "pair_docs").mapInArrow(_pairs, "block long, a int, b int, docs int")


def vocabulary_map(found: DataFrame) -> DataFrame:
    """(a, b, count, best): in how many documents of the corpus each pair is linked, and whether no other id of B has more for that id of A."""
    counts = written(block_pairs(found).groupBy("a", "b").agg(F.sum("docs").alias("count")), "pair-counts")
    top = counts.groupBy("a").agg(F.max("count").alias("top"))  # as many rows as A has ids, at most
    return counts.join(F.broadcast(top), "a").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))


def digests(df: DataFrame, ranks_path: str, pattern: str, model_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each document's tokens, groups and links, and how common its links are in the corpus."""
    found = aligned(df, ranks_path, pattern, model_path, block_bytes=block_bytes)
    scored = block_pairs(found).drop("docs").join(vocabulary_map(found).hint("merge"), ["a", "b"])
    documents = found.where("place is not null").drop("pair_a", "pair_b", "pair_docs")
    return documents.groupBy("block").cogroup(scored.groupBy("block")).applyInArrow(_scored, RESULT)
