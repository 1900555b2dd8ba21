"""Chains' histories in a folder that grows by appending and is thinned in place.

Rows are dealt to buckets by chain. A manifest lists each bucket's folders; the one with the highest number counts, and a new one appears by a rename, so appending and thinning
are seen at once or not at all. What is written but not in a manifest, because its writer stopped, is never read, and clean() deletes it.

Thinning: of a chain of over `at` rows all but the newest `keep` are thinned to one in `every`, and marked; what has been thinned is not thinned again. Only buckets with such a chain are rewritten. A chain's rows are
told apart by their seq, which counts on without gaps, so no chain has to be in one task.

Nulls: a row without chain_id or seq is an error. An empty table adds nothing. One writer at a time: of two, the second to switch fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

AT, KEEP, EVERY, BUCKETS = 20_000, 10_000, 50, 16


class HistoryStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._disk = self._fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- manifests ----

    def _names(self) -> list[str]:
        at = self._fs.Path(self.path)
        return [x.getPath().getName() for x in self._disk.listStatus(at)] if self._disk.exists(at) else []

    def manifest(self) -> dict:
        """The manifest that counts: its number, the rows' schema and each bucket's folders."""
        found = sorted(n for n in self._names() if n.startswith("manifest-") and n.endswith(".json"))
        if not found:
            return {"number": 0, "schema": None, "buckets": {}}
        stream = self._disk.open(self._fs.Path(f"{self.path}/{found[-1]}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _switch(self, was: dict, schema: str, buckets: dict[str, list[str]]) -> None:
        n = was["number"] + 1
        tmp, to = self._fs.Path(f"{self.path}/_{uuid.uuid4().hex}"), self._fs.Path(f"{self.path}/manifest-{n:09d}.json")
        out = self._disk.create(tmp)
        out.write(json.dumps({"number": n, "schema": schema, "buckets": buckets}).encode())
        out.close()
        if self._disk.exists(to) or not self._disk.rename(tmp, to):
            raise RuntimeError(f"{to} is there already: another writer has switched")

    # ---- rows ----

    def _written(self, df: DataFrame) -> list[str]:
        """Writes rows by bucket into a new folder; the buckets that have rows."""
        name = f"data-{uuid.uuid4().hex}"
        df.write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        return [f"{name}/{x.getPath().getName()}" for x in self._disk.listStatus(self._fs.Path(f"{self.path}/{name}")) if x.getPath().getName().startswith("bucket=")]

    def append(self, rows: DataFrame) -> None:
        was = self.manifest()
        bucket = F.pmod(F.xxhash64("chain_id"), F.lit(self.buckets)).cast("int")
        good = F.when(F.col("chain_id").isNull() | F.col("seq").isNull(), F.raise_error(F.lit("a row without chain_id or seq"))).otherwise(bucket)
        d = rows.withColumn("thinned", F.lit(False)).withColumn("bucket", good)
        buckets = {k: list(v) for k, v in was["buckets"].items()}
        for at in self._written(d):
            buckets.setdefault(at.rpartition("=")[2], []).append(at)
        self._switch(was, d.drop("bucket").schema.json(), buckets)

    def _read(self, schema: str, folders: list[str]) -> DataFrame:
        kind = T.StructType.fromJson(json.loads(schema))
        return self.spark.read.schema(kind).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], kind)

    def read(self) -> DataFrame:
        """The rows, with thinned: whether the row stands for those about it."""
        now = self.manifest()
        if now["schema"] is None:
            raise FileNotFoundError(f"no history in {self.path}")
        return self._read(now["schema"], [f for own in now["buckets"].values() for f in own])

    # ---- thinning ----

    def compact(self, at: int = AT, keep: int = KEEP, every: int = EVERY) -> int:
        """Thins the chains that have grown beyond `at` rows and returns in how many buckets there were any."""
        was = self.manifest()
        if was["schema"] is None:
            return 0
        new: dict[str, str] = {}
        sizes = None
        for k, own in sorted(was["buckets"].items()):
            rows = self._read(was["schema"], own)
            s = rows.groupBy("chain_id").agg(F.count("*").alias("n"), F.count_if("thinned").alias("old"), F.min(F.when(~F.col("thinned"), F.col("seq"))).alias("first"), F.max("seq").alias("last"))
            s = s.where((F.col("n") > at) & (F.col("n") - keep > F.col("old"))).withColumn("bucket", F.lit(int(k)))
            sizes = s if sizes is None else sizes.unionByName(s)
        full = sorted(r["bucket"] for r in sizes.select("bucket").distinct().collect()) if sizes is not None else []
        if not full:
            return 0
        rows = None
        for k in full:
            r = self._read(was["schema"], was["buckets"][str(k)]).withColumn("bucket", F.lit(k))
            rows = r if rows is None else rows.unionByName(r)
        older = F.col("last").isNotNull() & ~F.col("thinned") & (F.col("seq") <= F.col("last") - keep)
        out = rows.join(sizes.select("chain_id", "first", "last"), "chain_id", "left").where(~older | ((F.col("seq") - F.col("first")) % every == 0)).withColumn("thinned", F.col("thinned") | older)
        for folder in self._written(out.select(*rows.columns)):
            new[folder.rpartition("=")[2]] = folder
        self._switch(was, was["schema"], {k: [new[k]] if k in new else own for k, own in was["buckets"].items()})
        return len(full)

    def clean(self) -> int:
        """Deletes what no manifest of the last two names: data of earlier ones or of writers that stopped, and older manifests. How many folders and files went."""
        found = sorted(n for n in self._names() if n.startswith("manifest-"))
        kept = set(found[-2:])
        for name in found[-2:]:
            stream = self._disk.open(self._fs.Path(f"{self.path}/{name}"))
            kept |= {f.split("/")[0] for own in json.loads(bytes(stream.readAllBytes()).decode())["buckets"].values() for f in own}
            stream.close()
        gone = [n for n in self._names() if n not in kept and (n.startswith(("data-", "manifest-", "_")))]
        for n in gone:
            self._disk.delete(self._fs.Path(f"{self.path}/{n}"), True)
        return len(gone)
