"""Versioned tables in buckets: a version rewrites only the buckets it touches.

A version is a folder per table and bucket, and a manifest that says for every bucket which version
has it. The manifest is written last, so a version that broke off is never read, and one that is written again
replaces itself and finds what the one before left.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class Store:
    """Tables by name under ``path``; rows belong to buckets by the hash of their ``host``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def bucket(self, host: str = "host") -> Column:
        return F.pmod(F.xxhash64(F.col(host)), F.lit(self.buckets)).cast("int")

    def _files(self, folder: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def versions(self) -> list[int]:
        """The complete versions, in order."""
        path, fs = self._files("manifest")
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n.partition("=")[2]) for n in names if n.startswith("version=") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest/{n}/_SUCCESS")))

    def latest(self) -> int:
        return max(self.versions(), default=-1)

    def _manifest(self, version: int) -> dict[str, dict[str, int]]:
        if version < 0:
            return {}
        return json.loads(self.spark.read.text(f"{self.path}/manifest/version={version}").first()["value"])

    def read(self, name: str, schema: str, version: int, buckets: list[int] | None = None) -> DataFrame:
        """A table (or some of its buckets) as of a version; empty where no version has it."""
        where = {b: v for b, v in self._manifest(version).get(name, {}).items() if buckets is None or int(b) in buckets}
        paths = [f"{self.path}/{name}/version={v}/bucket={b}" for b, v in where.items()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def touched(self, hosts: DataFrame) -> list[int]:
        """The buckets of the hosts in a table: at most as many as there are."""
        return sorted(r["b"] for r in hosts.select(self.bucket().alias("b")).distinct().collect())

    def write(self, version: int, tables: dict[str, tuple[DataFrame, list[int]]]) -> int:
        """Write the touched buckets of some tables and complete the version."""
        manifest = self._manifest(version - 1) if version else {}
        for name, (df, touched) in tables.items():
            mine = df.withColumn("bucket", self.bucket()).where(F.col("bucket").isin(touched) if len(touched) < self.buckets else F.lit(True))
            folder = f"{self.path}/{name}/version={version}"
            mine.repartition("bucket", F.pmod(F.xxhash64("host", F.lit(1)), F.lit(4))).write.mode("overwrite").partitionBy("bucket").parquet(folder)
            _, fs = self._files("manifest")
            made = [b for b in touched if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/bucket={b}"))]
            manifest[name] = {b: v for b, v in manifest.get(name, {}).items() if int(b) not in touched} | {str(b): version for b in made}
        self.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest/version={version}")
        return version

    def forget(self, keep: int = 2) -> None:
        """Delete what the last ``keep`` versions don't read."""
        versions = self.versions()
        used = {(name, v) for k in versions[-keep:] for name, where in self._manifest(k).items() for v in where.values()}
        tables = {name for name, _ in used}
        for old in versions[:-keep]:
            for name in [*tables, "manifest"]:
                if (name, old) not in used:
                    path, fs = self._files(f"{name}/version={old}")
                    fs.delete(path, True)
