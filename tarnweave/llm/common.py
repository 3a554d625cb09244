"""Shared plumbing of the training-data operators: cut points, grouped Arrow streams, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import struct
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters of ``[\x20\x09-\x0D]`` and the ASCII alphabet.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Values of arrays below this many bytes aren't compressed.
SMALL = 200
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or in local mode an own one."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(sc, "_tarnweave_dir", None)
    if own is None:
        own = sc._tarnweave_dir = "file://" + tempfile.mkdtemp(prefix="tarnweave-")
        sc.setCheckpointDir(own)
    return own


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder (parted by the values of a column) and read it back: lineage ends there.

    The shuffle files behind it are of no more use then, and Spark is told to drop them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tarnweave/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    kept = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    finally:
        spark.conf.set(CLEANUP, kept)
    return spark.read.schema(df.schema).parquet(path)


def drop(table: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote and nothing reads any more."""
    jvm = table.sparkSession._jvm
    for folder in {f.rpartition("/part-")[0] for f in table.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def word_array(text):
    """Column: the words ``[^\\x20\\x09-\\x0D]+`` of ``text``; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def lower_ascii(text):
    """Column: ``text`` with A-Z lower-cased and nothing else changed."""
    return F.translate(text, UPPER, LOWER)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def put_arrays(*arrays, level: int = 1) -> bytes:
    """Arrays, bytes or Nones as one value: a count, a kind and size of each, then their bytes; compressed unless small."""
    raw = [b"" if x is None else x if isinstance(x, bytes) else x.tobytes() for x in arrays]
    kinds = ["no" if x is None else "by" if isinstance(x, bytes) else x.dtype.str[1:] for x in arrays]
    whole = b"".join([struct.pack("<B", len(raw)), *(struct.pack("<2sQ", k.encode(), len(r)) for k, r in zip(kinds, raw, strict=True)), *raw])
    return b"\0" + whole if len(whole) < SMALL else b"\1" + zstandard.ZstdCompressor(level).compress(whole)


def get_arrays(raw: bytes) -> tuple:
    whole = raw[1:] if raw[0] == 0 else zstandard.ZstdDecompressor().decompress(raw[1:])
    heads = [struct.unpack_from("<2sQ", whole, 1 + 10 * i) for i in range(whole[0])]
    out, at = [], 1 + 10 * len(heads)
    for kind, size in heads:
        out.append(None if kind == b"no" else whole[at : at + size] if kind == b"by" else np.frombuffer(whole, kind.decode(), size // int(kind[1:]), at))
        at += size
    return tuple(out)


def runs_of_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of equal ``key`` out of a stream that is sorted by it; a run may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_pylist()
        at = 0
        for i, k in enumerate(keys):
            if k != last:
                if i > at:
                    held.append(batch.slice(at, i - at))
                if held:
                    yield pa.Table.from_batches(held)
                held, last, at = [], k, i
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def trimmed(fn: Callable) -> Callable:
    """An Arrow iterator function that gives freed memory back to the system when its task ends: workers live on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return run


def in_key_order(df: DataFrame, key: str, fn: Callable, schema: str | T.StructType, then: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """Hash-partition by ``key``, sort, and let ``fn`` (an Arrow batch iterator function) read each partition."""
    spread = df.repartition(parts, key) if parts else df.repartition(key)
    return spread.sortWithinPartitions(key, *(then or [])).mapInArrow(trimmed(fn), schema)


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """Connected components of an edge table, as (node, root) with the smallest member as root.

    Alternating large-star and small-star steps; each step is a group-by with partial
    aggregation and a join, so no component is ever gathered in one task. Null ends are ignored.
    Raises RuntimeError if ``rounds`` steps don't settle it.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    now = materialize(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = None
    for _ in range(rounds):
        # large-star: every larger neighbour points at the smallest of the closed neighbourhood
        sym = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sym.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small-star: smaller neighbours and the node itself point at the smallest one
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new = materialize(small.where("u <> v").distinct(), "cc")
        drop(now)
        now = new
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
