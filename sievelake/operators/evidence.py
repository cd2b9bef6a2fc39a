"""A store of evidence that a batch looks into without reading it all: buckets, a manifest with a Bloom filter for each file, atomic versions.

Rows lie in files by the bucket of their identity's hash. A manifest is a small table of the files that make up a version,
each with the number of its rows, the batch that wrote it and a Bloom filter over its identities. A lookup asks the filters
of a batch's buckets and then opens only the files that may hold one of its identities; a filter never misses one, so the
result is exact. A version is committed by giving its marker its name, which the file system lets only one writer do: of two that
started from one version the later one is refused, and starts again. A batch that comes again after its commit changes
nothing; one that failed before it left files that no manifest names. compact() joins the small files of a bucket.

Null identities are evidence of nothing and are left out. Equal rows are kept as often as they come.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a filter for each row, and places that an identity sets; one lookup in a hundred or so opens a file in vain.
BITS_A_ROW, PLACES = 10, 7
MANIFEST = "file string, bucket int, batch string, n long, bloom binary"


class Conflict(Exception):
    """Another writer has committed since the version that this one began with."""


def hash_of(identity: str | Column) -> Column:
    return F.xxhash64(identity)


def places_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    """For each hash the places that it sets, from its two halves."""
    h = hashes.astype("int64").view("uint64")
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return (a[:, None] + np.arange(PLACES, dtype="uint64")[None, :] * b[:, None]) % np.uint64(bits)


def bloom_of(hashes: np.ndarray) -> bytes:
    bits = max(64, len(hashes) * BITS_A_ROW)
    field = np.zeros(bits, bool)
    field[places_of(hashes, bits).ravel()] = True
    return bits.to_bytes(8, "little") + np.packbits(field).tobytes()


def may_hold(bloom: bytes, hashes: np.ndarray) -> bool:
    """Whether any of the hashes may be in the filter."""
    bits = int.from_bytes(bloom[:8], "little")
    field = np.unpackbits(np.frombuffer(bloom[8:], "uint8"), count=bits).astype(bool)
    return bool(field[places_of(hashes, bits)].all(1).any()) if len(hashes) else False


class EvidenceStore:
    """A store under a folder that all tasks can reach. schema: its rows', with a column `identity`."""

    def __init__(self, spark: SparkSession, path: str, schema: str, buckets: int = 16):
        self.spark, self.path, self.schema, self.buckets = spark, path.rstrip("/"), schema, buckets

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last version that was committed; 0 is empty."""
        fs, folder = self._fs(), self._path("versions")
        return max((int(f.getPath().getName()) for f in fs.listStatus(folder)), default=0) if fs.exists(folder) else 0

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        (name,) = (r[0] for r in self.spark.read.schema("name string").json(f"{self.path}/versions/{version}").collect())
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/{name}")

    def _commit(self, manifest: DataFrame, base: int) -> int:
        """Version base + 1, if no other writer has made it."""
        name = uuid.uuid4().hex
        manifest.coalesce(1).write.parquet(f"{self.path}/manifests/{name}")
        fs = self._fs()
        fs.mkdirs(self._path("versions"))
        # whole before it has its name: a writer that is lost on the way leaves no half of a version
        out = fs.create(self._path(f"manifests/{name}.json"), False)
        out.write(bytearray(f'{{"name": "{name}"}}\n'.encode()))
        out.close()
        context = self.spark.sparkContext
        files = context._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), context._jsc.hadoopConfiguration())
        plain = context._gateway.new_array(getattr(context._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(self._path(f"manifests/{name}.json"), self._path(f"versions/{base + 1}"), plain)
        except Exception as e:  # noqa: BLE001  the file system's own error, by way of Java
            raise Conflict(f"version {base + 1} is there already") from e
        return base + 1

    def _written(self, rows: DataFrame, batch: str) -> DataFrame:
        """Writes rows as files by bucket; their manifest."""
        bucket = F.pmod(hash_of("identity"), F.lit(self.buckets)).cast("int")
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.where("identity is not null").withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(folder)
        new = self.spark.read.schema(f"{self.schema}, bucket int").parquet(folder).select(F.col("_metadata.file_path").alias("file"), "bucket", hash_of("identity").alias("h"))

        def filters(key, found: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"file": [key[0]], "bucket": [int(key[1])], "batch": [batch], "n": [len(found)], "bloom": [bloom_of(found["h"].to_numpy())]})

        return new.groupBy("file", "bucket").applyInPandas(filters, MANIFEST)

    def has(self, batch: str) -> bool:
        return not self.manifest().where(F.col("batch") == batch).isEmpty()

    def append(self, rows: DataFrame, batch: str) -> int:
        """Adds a batch's rows; one that is there already is not added again. The version that holds it."""
        base = self.version()
        if self.has(batch):
            return base
        new = self._written(rows, batch)
        if base:
            new = self.manifest(base).unionByName(new)
        return self._commit(new, base)

    def files_for(self, batch: DataFrame) -> list[str]:
        """Files that may hold an identity of a batch: as many names as the version has files, at most."""
        asked = batch.where("identity is not null").select(hash_of("identity").alias("h")).distinct().withColumn("bucket", F.pmod(F.col("h"), F.lit(self.buckets)).cast("int"))

        def hits(asked: pd.DataFrame, files: pd.DataFrame) -> pd.DataFrame:
            h = asked["h"].to_numpy("int64")
            return pd.DataFrame({"file": [f for f, b in zip(files["file"], files["bloom"], strict=True) if may_hold(b, h)]}, dtype=object)

        found = asked.groupBy("bucket").cogroup(self.manifest().where("bucket >= 0").select("bucket", "file", "bloom").groupBy("bucket")).applyInPandas(hits, "file string")
        return sorted(r.file for r in found.collect())

    def lookup(self, batch: DataFrame) -> DataFrame:
        """All rows of the store with an identity of the batch, from the files that may hold one."""
        files = self.files_for(batch)
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*files).join(batch.select("identity").distinct(), "identity", "left_semi")

    def rows(self) -> DataFrame:
        """All rows of the last version."""
        files = [r.file for r in self.manifest().where("bucket >= 0").select("file").collect()]
        return self.spark.read.schema(self.schema).parquet(*files) if files else self.spark.createDataFrame([], self.schema)

    def compact(self, least: int = 2) -> int:
        """Buckets of so many files or more as one file each, under one batch's name; the batches that they hold stay known."""
        base = self.version()
        manifest = self.manifest(base)
        many = [r.bucket for r in manifest.where("n > 0").groupBy("bucket").count().where(F.col("count") >= least).collect()]
        if not many:
            return base
        old = manifest.where(F.col("bucket").isin(many))
        files = [r.file for r in old.select("file").distinct().collect() if r.file]
        joined = self._written(self.spark.read.schema(self.schema).parquet(*files), f"compacted-{base}")
        # a batch is known by its name alone, so that it does not come again; it has no file of its own any more
        names = manifest.select("batch").distinct().select(F.lit("").alias("file"), F.lit(-1).alias("bucket"), "batch", F.lit(0).cast("long").alias("n"), F.lit(None).cast("binary").alias("bloom"))
        return self._commit(manifest.where(~F.col("bucket").isin(many)).unionByName(joined).unionByName(names), base)

    def clean(self, keep: int = 2) -> int:
        """Removes data that none of the last versions names; how many files are gone. Not while a writer is at work."""
        last = self.version()
        named = {r.file for v in range(max(1, last - keep + 1), last + 1) for r in self.manifest(v).select("file").collect()}
        fs, gone = self._fs(), 0
        found = fs.listFiles(self._path("data"), True)
        todo = []
        while found.hasNext():
            todo.append(found.next().getPath())
        for p in todo:
            if p.getName().endswith(".parquet") and not any(f.endswith(p.toUri().getPath()) for f in named):
                fs.delete(p, False)
                gone += 1
        return gone
