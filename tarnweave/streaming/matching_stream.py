"""Stored queries over a stream of texts, with queries that are loaded anew between batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.matching import with_snippets
from ..sources.queries import QuerySet
from ..sources.tables import batch_sink


def match_sink(queries: QuerySet, path: str, text: str = "text") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: refresh the queries, match the batch, replace the batch's results."""
    write = batch_sink(path)

    def apply(batch: DataFrame, epoch: int) -> None:
        write(with_snippets(batch, queries.refresh(), text), epoch)

    return apply


def stream_matches(texts: DataFrame, queries: QuerySet, path: str, checkpoint: str, text: str = "text") -> StreamingQuery:
    """Match all that the stream has into ``path``."""
    query = texts.writeStream.foreachBatch(match_sink(queries, path, text)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
