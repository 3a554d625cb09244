"""The frontier and the crawl round over micro-batches.

State is a version per batch id in a bucketed store: batch n reads the buckets that its hosts are in as batch
n - 1 left them and rewrites those alone, so a batch that is repeated after a failure finds the state it
found before and leaves the same result. References of a batch are reduced to one row per item before the join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import urls
from ..functions.html import extract
from ..operators.frontier import FRONTIER, upsert
from ..operators.matching import result_rows
from ..plans.ast import Query
from ..sources.state import Store


#: More links than a page of the largest size has room for.
LINKS_PER_PAGE = 1 << 18


def links_of(pages: DataFrame, onion: bool = False) -> DataFrame:
    """References out of extracted pages (host, url, depth, cycle, links, seq): resolved, filtered and keyed.

    ``host`` is the page's registered domain; links within it are internal.
    """
    rows = pages.select("host", F.col("url").alias("_base"), "depth", "cycle", "seq", F.posexplode("links").alias("_at", "_link"))
    rows = rows.withColumn("_url", urls.resolve(F.col("_base"), F.col("_link")))
    rows = rows.where(urls.crawlable(F.col("_url"), onion))
    name = urls.repair_onion_host(urls.host(F.col("_url"))) if onion else urls.host(F.col("_url"))
    rows = rows.withColumns({"subdomain": name, "_domain": urls.registered_domain(name, onion)})
    return rows.select(
        F.col("_domain").alias("host"), "subdomain", urls.uri_key(F.col("_url")).alias("uri_key"), urls.relative(F.col("_url")).alias("url"),
        (F.col("_domain") == F.col("host")).alias("internal"), F.col("depth").alias("source_depth"), F.col("cycle").alias("source_cycle"), (F.col("seq") * LINKS_PER_PAGE + F.col("_at")).alias("seq"),
    )


def crawl_round(pages: DataFrame, frontier: DataFrame, queries: list[Query], now: Column, onion: bool = False) -> tuple[DataFrame, DataFrame]:
    """One round over downloaded pages (url, html, depth, cycle, seq): (result rows, new frontier).

    Pages are parsed once; results and links are two readings of the extraction.
    """
    from ..sources.tables import write_temporary

    named = pages.withColumn("host", urls.registered_domain(urls.host(F.col("url")), onion)).where("host is not null")
    parsed = extract(named, ["url", "host", "depth", "cycle", "seq", "html"], depth="depth")
    parsed = write_temporary(parsed, "parsed")
    results = result_rows(parsed, queries, "url", "host", "title", "html", "text", now)
    return results, upsert(frontier, links_of(parsed, onion), now)


def empty_frontier(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FRONTIER)


def frontier_sink(path: str, now: Column) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that upserts reference rows into the versions of a frontier under ``path``."""

    def apply(batch: DataFrame, epoch: int) -> None:
        store = Store(batch.sparkSession, path)
        touched = store.touched(batch)
        before = store.read("frontier", FRONTIER, epoch - 1, touched)
        store.write(epoch, {"frontier": (upsert(before, batch, now), touched)})
        store.forget()

    return apply


def stream_frontier(references: DataFrame, path: str, checkpoint: str, now: Column) -> StreamingQuery:
    """Run a stream of references into a frontier until all that is there has been read."""
    query = references.writeStream.foreachBatch(frontier_sink(path, now)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def latest_frontier(spark: SparkSession, path: str) -> DataFrame:
    store = Store(spark, path)
    return store.read("frontier", FRONTIER, store.latest())
