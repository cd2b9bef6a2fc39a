"""Codes of vectors by product quantisation, whose codebooks are learnt by a delta-maintained Lloyd iteration.

Components become integers, floor(1024 x), and a vector is cut into four equal consecutive parts. Each part position has a
codebook of 256 entries, which starts as the parts of the vectors with the least ids. A round assigns each part to its
nearest entry and sets each entry to the mean of its parts, rounded down. What a part was assigned to is kept in a table,
with the vector; the driver keeps the running count and integer sums of each entry. So a round shuffles only what changes
them: minus the part at its old entry, plus the part at its new one, for parts that moved, summed within each task. All
arithmetic is on whole numbers, so running sums never drift from what a full recomputation gives.

Vectors that are null, or hold a null or non-finite component, take no part. Vectors of different lengths have codebooks of
their own by length; a length that four does not divide is filled up with zeros. Equal ids are ordered by their vectors,
null ids come after all others; repeated rows are coded as often as they occur. With fewer than 256 vectors there are fewer
entries; entries without parts stay as they are. Integers beyond 2^62 are held there, errors at the largest long. An empty
table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.llm.common import discard, looked_up, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Integers are held at this size, and sums that may leave 64 bits are taken as two halves.
MOST, HALF = 1 << 62, 1 << 32
LONGEST = (1 << 63) - 1


def usable(vector: str | Column) -> Column:
    """Not null, and neither is any component, and all are finite."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    column = F.col(vector) if isinstance(vector, str) else vector
    return F.coalesce(~F.exists(column, odd), F.lit(False))


def whole_numbers(vector: str) -> Column:
    """Components times 1024, rounded down, filled up to a multiple of the number of parts."""
    scaled = F.transform(F.col(vector), lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(MOST))), F.lit(float(-MOST)))))
    missing = F.pmod(-F.size(vector), F.lit(PARTS))
    return F.concat(scaled, F.array_repeat(F.lit(0).cast("long"), missing))


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row, the lower one of equals, and its squared distance; exact."""
    most = max(int(abs(a.astype(object)).max()) if a.size else 0 for a in (x, entries))
    if 4 * most * most * max(1, x.shape[1]) < 1 << 53:
        a, b = x.astype("float64"), entries.astype("float64")
        d = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]
    else:
        a, b = x.astype(object), entries.astype(object)
        d = np.stack([((a - e) ** 2).sum(1) if a.shape[1] else np.zeros(len(a), object) for e in b], 1)
    at = d.argmin(1)
    best = d[np.arange(len(x)), at]
    return at.astype("uint8"), best.astype(object) if best.dtype == object else best.astype("int64")


@dataclass
class Book:
    """Codebooks of one length of vectors, and what they are the means of."""

    entries: np.ndarray  # part, entry, position
    count: np.ndarray = None
    sums: np.ndarray = field(default=None)

    def __post_init__(self):
        self.count = np.zeros(self.entries.shape[:2], object)
        self.sums = np.zeros(self.entries.shape, object)

    def move(self) -> None:
        used = self.count > 0
        self.entries = self.entries.copy()
        self.entries[used] = (self.sums[used] // self.count[used][:, None]).astype("int64")

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, their vectors as a matrix) of a batch."""
    column = batch.column("x")
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    starts, flat = column.offsets.to_numpy()[:-1], column.values.to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield int(n), rows, flat[starts[rows][:, None] + np.arange(n)[None, :]]


def _assign(batches: Iterator[pa.RecordBatch], entries: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The vectors with the code they had, the one that they have now, and its error."""
    for batch in batches:
        codes, errors = np.zeros((batch.num_rows, PARTS), "uint8"), np.zeros(batch.num_rows, object)
        for n, rows, x in _by_length(batch):
            for k, part in enumerate(np.split(x, PARTS, axis=1)):
                codes[rows, k], d = nearest(part, entries[n][k])
                errors[rows] = errors[rows] + d
        columns = {name: batch.column(name) for name in ("id", "label", "x")}
        columns["old"] = batch.column("code")
        columns["code"] = pa.array([c.tobytes() for c in codes], pa.binary())
        columns["error"] = pa.array([min(int(e), LONGEST) for e in errors], pa.int64())
        yield pa.RecordBatch.from_pydict(columns)


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Plus and minus of the parts that moved, summed over a task: a row for each length, part, entry and position."""
    total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        new = np.frombuffer(b"".join(batch.column("code").to_pylist()), "uint8").reshape(-1, PARTS).astype(int)
        before = batch.column("old").to_pylist()
        had = np.array([b is not None for b in before])
        old = np.frombuffer(b"".join(b or bytes(PARTS) for b in before), "uint8").reshape(-1, PARTS).astype(int)
        for n, rows, x in _by_length(batch):
            width = n // PARTS
            count, sums = total.setdefault(n, (np.zeros((PARTS, ENTRIES), "int64"), np.zeros((PARTS, ENTRIES, width), object)))
            # sums of a batch stay in 64 bits, or are taken as Python's integers
            kind = "int64" if not x.size or int(abs(x.astype(object)).max()) * len(x) < 1 << 62 else object
            for k, part in enumerate(np.split(x, PARTS, axis=1)):
                moved = ~had[rows] | (old[rows, k] != new[rows, k])
                for sign, code, of in ((1, new, moved), (-1, old, moved & had[rows])):
                    if of.any():
                        added = np.zeros((ENTRIES, width), kind)
                        np.add.at(added, code[rows[of], k], part[of].astype(kind))
                        sums[k] += sign * added.astype(object)
                        count[k] += sign * np.bincount(code[rows[of], k], minlength=ENTRIES)
    for n, (count, sums) in total.items():
        some = [(k, e) for k in range(PARTS) for e in range(ENTRIES) if count[k, e] or sums[k, e].any()]
        # position -1 holds the count, so that it is there even if parts have no components
        rows = [(n, k, e, p, int(s) // HALF, int(s) % HALF) for k, e in some for p, s in enumerate([count[k, e], *sums[k, e]], -1)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["n", "part", "entry", "position", "high", "low"])


CHANGES = "n long, part long, entry long, position long, high long, low long"


def first_books(rows: DataFrame) -> dict[int, Book]:
    """Codebooks of the least ids, for each length."""
    order = Window.partitionBy(F.size("x")).orderBy(F.col("id").asc_nulls_last(), "x")
    least = rows.select("id", "x").withColumn("place", F.row_number().over(order)).where(F.col("place") <= ENTRIES)
    found: dict[int, list] = {}
    for r in sorted(least.select("place", "x").collect(), key=lambda r: r.place):
        found.setdefault(len(r.x), []).append(r.x)
    return {n: Book(np.array(xs, "int64").reshape(len(xs), PARTS, n // PARTS).transpose(1, 0, 2)) for n, xs in found.items()}


def encode(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, dict[int, Book]]:
    """(id, label, x, code, error) of every usable vector, and the codebooks by length; a code is a byte for each part."""
    rows = df.where(usable(vector_col)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), whole_numbers(vector_col).alias("x"), F.lit(None).cast("binary").alias("code"))
    state = written(rows, "codes-start")
    books = first_books(state)
    kinds = dict(state.dtypes)
    out = f"id {kinds['id']}, label {kinds['label']}, x array<bigint>, old binary, code binary, error long"
    for k in range(rounds + 1):
        entries = {n: b.entries for n, b in books.items()}
        assigned = written(state.mapInArrow(lambda x, e=entries: _assign(x, e), out), f"codes-round{k}")
        discard(state)
        state = assigned
        if k == rounds:
            break
        moved = state.where(F.col("old").isNull() | (F.col("old") != F.col("code"))).select("x", "old", "code")
        changes = moved.mapInArrow(_changes, CHANGES).groupBy("n", "part", "entry", "position").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
        for r in changes.collect():  # entries times components, however many vectors there are
            book, change = books[r.n], r.high * HALF + r.low
            if r.position < 0:
                book.count[r.part, r.entry] += change
            else:
                book.sums[r.part, r.entry, r.position] += change
        for book in books.values():
            book.move()
    return state.drop("old"), books


def decode(encoded: DataFrame, books: dict[int, Book]) -> DataFrame:
    """Adds `decoded`, the vectors that codes stand for."""
    entries = {n: b.entries for n, b in books.items()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(batch.column("x").offsets.to_numpy())
            codes = [np.frombuffer(c, "uint8") for c in batch.column("code").to_pylist()]
            out = [(np.concatenate([entries[int(n)][k][c] for k, c in enumerate(code)]) / SCALE).tolist() for n, code in zip(lengths, codes, strict=True)]
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in batch.schema.names} | {"decoded": pa.array(out, pa.list_(pa.float64()))})

    schema = ", ".join(f"{n} {k}" for n, k in encoded.dtypes)
    return encoded.mapInArrow(read, f"{schema}, decoded array<double>")


def digests(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Each vector's code in hex and error, the error of its label, and the digest of all codebooks of its length."""
    found, books = encode(df, id_col, vector_col, label_col)
    capped = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    labels = found.groupBy("label").agg(capped.alias("label_error"), F.count(F.lit(1)).alias("n"))
    digest = F.lit("")
    for n, book in sorted(books.items()):
        digest = F.when(F.size("x") == n, book.digest()).otherwise(digest)
    rows = found.select("id", "label", F.lower(F.hex("code")).alias("code"), "error", digest.alias("codebooks_sha256"))
    return looked_up(rows, labels, "label", "n").select(F.col("id").alias(id_col), "code", "error", "label_error", "codebooks_sha256")
