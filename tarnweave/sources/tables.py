"""Table plumbing: temporary tables in the shared folder, result sinks, page sources."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_temporary(df: DataFrame, name: str) -> DataFrame:
    """Write a table where all executors reach it (``spark.checkpoint.dir``) and read it back."""
    spark = df.sparkSession
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = sc._tarnweave_tables = getattr(sc, "_tarnweave_tables", None) or tempfile.mkdtemp(prefix="tarnweave-")
    path = f"{root.rstrip('/')}/tables/{sc.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    """A folder of downloaded pages as a stream; a batch reads a bounded number of files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def append_results(results: DataFrame, path: str) -> None:
    """Append result or statistics rows to a table."""
    results.write.mode("append").parquet(path)


def batch_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes each batch once: a repeated batch replaces its own folder."""

    def write(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return write


def host_directory(spark: SparkSession, path: str, onion: bool = False) -> DataFrame:
    """Snapshot files of hosts with the number of labels the mode asks for: (host, text). Dot files are skipped."""
    from pyspark.sql import functions as F

    files = spark.read.text(path, wholetext=True).withColumn("host", F.regexp_extract(F.col("_metadata.file_name"), r"host_(.*)\.txt$", 1))
    return files.where(F.size(F.split("host", r"\.")) == (1 if onion else 2)).select("host", F.col("value").alias("text"))


def seeds(spark: SparkSession, urls: list[str]) -> DataFrame:
    """Seed URLs as external references of depth 0."""
    rows = [(i, u) for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, "seq long, url string").withColumn("internal", F.lit(False))
