"""A positional inverted table: the places of each term in each document, so that a search reads its terms only.

Postings (term, id, codes of places) are files under the bucket of their term, each sorted by term and block; a block is a
set of documents of like length. A second table has, for each term and block, the greatest sum of field weights that any
document of the block has for that term. The best n need not read all postings: a cover's score is at most the number of
concepts times the weight of the word at its left end, so concepts times those sums bounds a block. Blocks are read best
bound first until n documents are found, then all whose bound reaches the n-th score, so the result is exact.

The table grows by batches. A document of a later batch replaces what earlier ones say of it; one that comes without words
is gone. Null ids are left out. A text of any length is one document; equal texts are documents of their own. An id that
stands twice in one batch is one document with the words of both.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.functions import search as S

BUCKETS = 16
#: Hash parts of each class of lengths.
BLOCK_PARTS = 16
#: Blocks that are read first, and how many times as many next, as long as the n-th score is not known.
FIRST_BLOCKS, MORE = 16, 16

#: Documents that a task takes apart at once.
SLICE = 64

POSTED = "term string, block int, id long, codes array<int>"
POSTINGS = "term string, block int, id long, batch int, codes array<int>, bucket int"


def bucket_of(term: Column) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(BUCKETS)).cast("int")


def weight_of(code: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, S.WEIGHTS.values())), F.pmod(code, F.lit(4)) + 1)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of each term of whole documents (id, block, p), by term: a document's are gathered where it is read."""
    for batch in batches:
        for k in range(0, batch.num_rows, SLICE):
            part = batch.slice(k, SLICE)
            sizes = part["p"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            term, code = part["p"].flatten().flatten()
            if not len(term):
                continue
            coded = term.dictionary_encode()
            t, c, row = coded.indices.to_numpy(zero_copy_only=False), code.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((c, row, t))
            t, c, row = t[order], c[order], row[order]
            first = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (row[1:] != row[:-1])]))
            codes = pa.ListArray.from_arrays(pa.array(np.append(first, len(t)), pa.int32()), pa.array(c, pa.int32()))
            whose = pa.array(row[first])
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(t[first])), part["block"].take(whose), part["id"].take(whose), codes], ["term", "block", "id", "codes"])


@dataclass
class Found:
    """Documents by id and rank, and how many postings files' blocks were looked at of how many."""

    rows: DataFrame
    blocks_read: int
    blocks: int


class Index:
    """An inverted table under a folder that all tasks can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.batches = spark, path.rstrip("/"), 0

    def add(self, docs: DataFrame) -> Index:
        """docs: (id, d struct of token arrays by field). One batch more."""
        batch, self.batches = self.batches, self.batches + 1
        docs = docs.where("id is not null").select(F.col("id").cast("long").alias("id"), "d")
        length = reduce(lambda a, b: a + b, [F.size(F.col("d")[f]) for f in S.WEIGHTS])
        block = F.floor(4 * F.log2(1.0 + length)).cast("int") * BLOCK_PARTS + F.pmod(F.xxhash64("id"), F.lit(BLOCK_PARTS)).cast("int")
        placed = docs.select("id", block.alias("block"), S.places(F.col("d")).alias("p"))
        twice = docs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
        if twice.isEmpty():
            postings = placed.mapInArrow(_postings, POSTED)
        else:
            # only the words of ids that stand twice are gathered from several rows
            each = placed.join(twice, "id", "left_semi").select("id", "block", F.explode("p").alias("p")).select("id", "block", "p.term", "p.code")
            gathered = each.groupBy("id", "term").agg(F.max("block").alias("block"), F.array_sort(F.collect_list("code")).alias("codes"))
            postings = placed.join(twice, "id", "left_anti").mapInArrow(_postings, POSTED).unionByName(gathered)
        rows = postings.select("term", "block", "id", F.lit(batch).alias("batch"), "codes", bucket_of(F.col("term")).alias("bucket"))
        # a common term's postings are dealt out by block, so no task has all of them
        rows = rows.repartition("bucket", "block").sortWithinPartitions("bucket", "term", "block")
        rows.write.partitionBy("bucket").mode("append").parquet(f"{self.path}/postings")
        new = self.postings().where(F.col("batch") == batch)
        weight = F.aggregate("codes", F.lit(0.0), lambda a, c: a + weight_of(c))
        bounds = new.groupBy("bucket", "term", "block").agg(F.max(weight).alias("most"), F.count(F.lit(1)).alias("n"))
        bounds.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").mode("append").parquet(f"{self.path}/bounds")
        docs.select("id", F.lit(batch).alias("batch")).distinct().write.mode("append").parquet(f"{self.path}/documents")
        return self

    def postings(self) -> DataFrame:
        return self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings")

    def of_terms(self, table: DataFrame, terms: list[str]) -> DataFrame:
        """The rows of some terms: their buckets' files, and in these what lies between the terms."""
        buckets = sorted({zlib.crc32(t.encode()) % BUCKETS for t in terms})  # bucket_of(), without a job
        return table.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))

    def latest(self, rows: DataFrame) -> DataFrame:
        """Without what a later batch has replaced."""
        if self.batches < 2:
            return rows
        newest = self.spark.read.schema("id long, batch int").parquet(f"{self.path}/documents").groupBy("id").agg(F.max("batch").alias("batch"))
        return rows.join(newest, ["id", "batch"], "left_semi")

    def _matching(self, query: S.Query, blocks: list[int] | None) -> DataFrame:
        """(id, rank) of the documents that match, from the postings of the query's words alone."""
        words = sorted({w for p in [*[p for g in query.groups for p in g], *query.excluded] for w in p if w})
        rows = self.of_terms(self.postings(), words)
        if blocks is not None:
            rows = rows.where(F.col("block").isin(blocks))
        entry = F.collect_list(F.struct("term", "codes"))
        by_doc = self.latest(rows.groupBy("id", "batch").agg(F.map_from_entries(entry).alias("m")))
        codes = lambda w: F.coalesce(F.col("m")[w], F.array().cast("array<int>"))
        found = [F.size(g) > 0 for g in S.events(codes, query)] + [F.size(S.starts(codes, p)) == 0 for p in query.excluded]
        return by_doc.where(reduce(lambda a, b: a & b, found)).select("id", S.cover_density(S.events(codes, query)).alias("rank"))

    def matches(self, query: S.Query) -> DataFrame:
        """All documents that match, with their rank; a query of nothing finds nothing."""
        if not query.groups:
            return self.spark.createDataFrame([], "id long, rank double")
        return self._matching(query, None)

    def best(self, query: S.Query, n: int) -> Found:
        """The n best by rank, then by id."""
        if not query.groups:
            return Found(self.matches(query), 0, 0)
        terms = sorted({w for g in query.groups for p in g for w in p if w})
        bounds = self.of_terms(self.spark.read.schema("term string, block int, most double, n long, bucket int").parquet(f"{self.path}/bounds"), terms)
        of_block: dict[int, dict[str, float]] = {}
        for r in bounds.groupBy("block", "term").agg(F.max("most").alias("most")).collect():  # blocks times the query's words
            of_block.setdefault(r.block, {})[r.term] = r.most
        bound = {}
        for block, most in of_block.items():
            if all(any(all(w in most for w in p if w) for p in g) for g in query.groups):
                # a phrase begins no more often than its rarest word stands
                # the last factor: sums of doubles may fall short by a hair
                bound[block] = (1 + 1e-9) * len(query.groups) * sum(min(most[w] for w in p if w) for g in query.groups for p in g if all(w in most for w in p if w))
        order = sorted(bound, key=lambda b: (-bound[b], b))
        top = lambda df: df.orderBy(F.desc("rank"), "id").limit(n)
        done, step, best = 0, FIRST_BLOCKS, []
        while done < len(order):
            # once n are known, what cannot reach the least of them is left unread
            floor = best[-1][1] if len(best) >= n else None
            part = order[done : done + step] if floor is None else [b for b in order[done:] if bound[b] >= floor]
            if not part:
                break
            best = sorted({*best, *((r.id, r["rank"]) for r in top(self._matching(query, part)).collect())}, key=lambda x: (-x[1], x[0]))[:n]
            done += len(part)
            if floor is not None:
                break
            step *= MORE
        return Found(self.spark.createDataFrame(best, "id long, rank double"), done, len(bound))


_built: dict[tuple[str, str, str], Index] = {}


def session_index(spark: SparkSession, key: str, analyser: str, docs: DataFrame, path: str) -> Index:
    """The index of one table in this session: built by the first search, read by all later ones."""
    at = (spark.sparkContext.applicationId, key, analyser)
    if at not in _built:
        _built[at] = Index(spark, path).add(docs)
    return _built[at]
