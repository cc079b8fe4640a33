"""Tables with a key that are changed by copy on write.

Rows lie in buckets by a hash of their key. A change writes the buckets that it touches anew, into a folder of its own, and at last a manifest: the list
of folders that make up the next version. The newest manifest counts, so readers see a change whole or not at all, a change that was
killed leaves nothing but unused files, and of two changes that start from one version the second fails and can be tried again.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of a table, and files of a bucket that one change writes at most.
BUCKETS, FILES = 16, 8


class Conflict(RuntimeError):
    """Another change became the version that this one would be."""


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share: in spark.checkpoint.dir, or, on a local master alone, in a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillon-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


class Store:
    """A table at a path of any file system that Spark reaches; key: the column that is unique in it."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _at(self, *parts: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def versions(self) -> list[int]:
        files, place = self._at("versions")
        if not files.exists(place):
            return []
        names = [s.getPath().getName() for s in files.listStatus(place)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def manifest(self, version: int | None = None) -> dict | None:
        """The manifest of a version, or of the newest; None before the first change."""
        known = self.versions()
        if not known:
            return None
        name = f"{self.path}/versions/{known[-1] if version is None else version:012d}.json"
        return json.loads(self.spark.read.text(name, wholetext=True).first()[0])

    def _commit(self, manifest: dict) -> None:
        """Written beside its place first, then renamed, which fails where a manifest of that version stands already."""
        jvm = self.spark._jvm
        text = bytearray(json.dumps(manifest).encode())
        name = f"{manifest['version']:012d}.json"
        files, temporary = self._at("versions", f"_{uuid.uuid4().hex}")
        out = files.create(temporary)
        try:
            out.write(text)
        finally:
            out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        plainly = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        place = files.makeQualified(self._at("versions", name)[1])
        try:
            context.rename(files.makeQualified(temporary), place, plainly)
        except Exception as e:
            files.delete(temporary, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {manifest['version']} exists") from None
            raise

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _read(self, manifest: dict, buckets: set[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        paths = [f"{self.path}/{p}" for b, p in manifest["buckets"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, or of the newest."""
        if (found := self.manifest(version)) is None:
            raise LookupError(f"nothing was stored at {self.path}")
        return self._read(found)

    def find(self, keys: list) -> DataFrame:
        """The rows of some keys; only their buckets are read."""
        if (found := self.manifest()) is None:
            raise LookupError(f"nothing was stored at {self.path}")
        kind = T.StructType.fromJson(found["schema"])[self.key].dataType
        wanted = self.spark.createDataFrame([(k,) for k in keys], T.StructType([T.StructField("k", kind)]))
        touched = {r[0] for r in wanted.select(self._bucket(F.col("k"))).distinct().collect()}
        return self._read(found, touched).where(F.col(self.key).isin(keys))

    def _change(self, new: DataFrame | None, gone: DataFrame, before: dict | None) -> int:
        """One change: the keys of gone leave, the rows of new come; both have bucket numbers."""
        touched = {r[0] for r in gone.select("__bucket").distinct().collect()}  # at most as many as buckets
        version = before["version"] + 1 if before else 1
        if not touched:
            return before["version"] if before else 0
        rows = new
        if before:
            old = self._read(before, touched).withColumn("__bucket", self._bucket(F.col(self.key)))
            kept = old.join(gone, [self.key, "__bucket"], "left_anti")
            rows = kept if new is None else kept.unionByName(new)
        folder = f"data/{uuid.uuid4().hex}"
        schema = T.StructType.fromJson(before["schema"]) if before else T.StructType([f for f in new.schema if f.name != "__bucket"])
        rows.select(*schema.names, "__bucket").repartition("__bucket", F.pmod(F.xxhash64(F.col(self.key), F.lit(7)), F.lit(FILES))).write.partitionBy("__bucket").parquet(f"{self.path}/{folder}")
        files, place = self._at(folder)
        written = {s.getPath().getName().removeprefix("__bucket=") for s in files.listStatus(place) if s.isDirectory()}
        buckets = {b: p for b, p in (before["buckets"] if before else {}).items() if int(b) not in touched}
        buckets |= {b: f"{folder}/__bucket={b}" for b in written}
        self._commit({"version": version, "schema": json.loads(schema.json()), "buckets": buckets})
        return version

    def upsert(self, df: DataFrame, order: str | None = None) -> int:
        """Rows of df replace those of their keys, or are added; the version. Of several rows of a key in df the one with the greatest `order` counts,
        or without one the one whose hash comes last. Null keys fail; df without the key's column gets random keys. Its columns must
        be those of the table. An empty df makes no version."""
        before = self.manifest()
        if self.key not in df.columns:
            df = df.withColumn(self.key, F.uuid())
        if before:
            want = T.StructType.fromJson(before["schema"])
            if set(want.names) != set(df.columns):
                raise ValueError(f"columns must be {', '.join(want.names)}")
            df = df.select([F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in want])
        key = F.coalesce(F.col(self.key), F.raise_error(F.lit(f"{self.key} is null")).cast(df.schema[self.key].dataType))
        rows = df.withColumn(self.key, key).withColumn("__bucket", self._bucket(F.col(self.key)))
        last = F.struct(*([F.col(order)] if order else []), F.xxhash64(*df.columns).alias("h"))
        rows = rows.groupBy(self.key, "__bucket").agg(F.max_by(F.struct(*df.columns), last).alias("r")).select("r.*", "__bucket")
        return self._change(rows, rows.select(self.key, "__bucket"), before)

    def delete(self, keys: DataFrame) -> int:
        """The rows of some keys (a column with the key's name) leave; the version."""
        if (before := self.manifest()) is None:
            return 0
        gone = keys.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        return self._change(None, gone.withColumn("__bucket", self._bucket(F.col(self.key))), before)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes all but the newest `keep` manifests, and folders that none of those names: also those of killed changes, so no change
        may run meanwhile. The number of folders deleted."""
        known = self.versions()
        for v in known[: -keep or None]:
            files, place = self._at("versions", f"{v:012d}.json")
            files.delete(place, False)
        used = {p.split("/")[1] for v in known[-keep:] for p in self.manifest(v)["buckets"].values()} if keep else set()
        files, place = self._at("data")
        lost = [s.getPath() for s in files.listStatus(place) if s.getPath().getName() not in used] if files.exists(place) else []
        return sum(files.delete(p, True) for p in lost)
