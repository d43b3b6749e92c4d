"""A stored collection of vectors: id, vector, label, version."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
MAX_BUCKETS = 4096


def upsert_vectors(
    stored: DataFrame | None, new: DataFrame, id_col: str = "vec_id", version: str = "version"
) -> DataFrame:
    """Stored and new records merged: one per id, with the highest version.

    Of equal versions a new record wins over a stored one; of several new ones the one with the
    greatest other columns, in their order. Partial aggregation keeps one row per id and task.
    """
    rest = [c for c in new.columns if c not in (id_col, version)]
    sides = [(0, stored), (1, new)] if stored is not None else [(1, new)]
    parts = [
        df.select(id_col, F.struct(version, F.lit(side).alias("_side"), *rest).alias("_r")) for side, df in sides
    ]
    records = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    best = records.groupBy(id_col).agg(F.max("_r").alias("_r"))
    return best.select(*[F.col(c) if c == id_col else F.col(f"_r.{c}").alias(c) for c in new.columns])


class VectorCollection:
    """A folder of hash buckets and manifests.

    An upsert rewrites the buckets that its ids fall into, all in one job, and then writes the
    next manifest, which names the folder of every bucket. Readers take the last manifest; a
    write that fails before its manifest changes nothing, and of two writers at once the second
    fails. `expire` deletes what the last manifests do not name. Ids are not null.
    """

    def __init__(
        self, spark: SparkSession, path: str, id_col: str = "vec_id", version: str = "version", buckets: int = BUCKETS
    ):
        if not 0 < buckets <= MAX_BUCKETS:
            raise ValueError(f"1 to {MAX_BUCKETS} buckets")
        self.spark, self.path, self.id_col, self.version, self.buckets = spark, path.rstrip("/"), id_col, version, buckets
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        where = self._path(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def manifest(self, back: int = 0) -> dict | None:
        """The last manifest, or the one so many writes before it."""
        names = self._names("manifests")
        if len(names) <= back:
            return None
        stream = self._fs.open(self._path(f"{self.path}/manifests/{names[-1 - back]}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _bucket(self, n: int):
        return F.pmod(F.xxhash64(self.id_col), F.lit(n)).cast("int")

    def _read(self, manifest: dict, numbers: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        folders = [
            f"{self.path}/data/{folder}/_bucket={number}"
            for number, folder in manifest["folders"].items()
            if numbers is None or int(number) in numbers
        ]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, back: int = 0) -> DataFrame | None:
        manifest = self.manifest(back)
        return None if manifest is None else self._read(manifest)

    def upsert(self, records: DataFrame) -> DataFrame:
        manifest = self.manifest() or {"number": 0, "buckets": self.buckets, "folders": {}, "schema": None}
        n = manifest["buckets"]
        touched = [r[0] for r in records.select(self._bucket(n)).distinct().collect()]
        if touched:
            stored = None
            if manifest["schema"] is not None:
                if sorted(f["name"] for f in manifest["schema"]["fields"]) != sorted(records.columns):
                    raise ValueError("the records' columns are not those of the collection")
                stored = self._read(manifest, touched).select(*records.columns)
            merged = upsert_vectors(stored, records, self.id_col, self.version).withColumn("_bucket", self._bucket(n))
            folder = f"{manifest['number'] + 1:08d}-{uuid.uuid4().hex[:8]}"
            merged.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{folder}")
            folders = manifest["folders"] | {str(b): folder for b in touched}
        else:
            folders = manifest["folders"]
        self._publish(
            {
                "number": manifest["number"] + 1,
                "buckets": n,
                "folders": folders,
                "schema": manifest["schema"] or json.loads(records.schema.json()),
            }
        )
        return self.read()

    def _publish(self, manifest: dict) -> None:
        """Written under another name and then renamed, which fails if the number is taken."""
        draft = self._path(f"{self.path}/drafts/{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        self._fs.mkdirs(self._path(f"{self.path}/manifests"))
        target = self._path(f"{self.path}/manifests/{manifest['number']:08d}.json")
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            raise RuntimeError(f"another writer was first with number {manifest['number']}")

    def expire(self, keep: int = 1) -> int:
        """Delete bucket folders that none of the last `keep` manifests names, and older manifests; how many folders."""
        names = self._names("manifests")
        held = [self.manifest(back) for back in range(min(keep, len(names)))]
        used = {(folder, f"_bucket={number}") for m in held for number, folder in m["folders"].items()}
        gone = 0
        for folder in self._names("data"):
            if held and int(folder[:8]) > held[0]["number"]:
                continue  # of a write that is going on
            buckets = [b for b in self._names(f"data/{folder}") if b.startswith("_bucket=")]
            old = [b for b in buckets if (folder, b) not in used]
            gone += len(old)
            for name in old if len(old) < len(buckets) else [""]:
                self._fs.delete(self._path(f"{self.path}/data/{folder}/{name}".rstrip("/")), True)
        for name in names[: len(names) - keep]:
            self._fs.delete(self._path(f"{self.path}/manifests/{name}"), False)
        return gone
