"""Loading of stored queries."""

from __future__ import annotations

import logging

from pyspark.sql import SparkSession

from ..plans.ast import Query, QueryError, query_set

log = logging.getLogger(__name__)


def load_queries(spark: SparkSession, path: str) -> list[Query]:
    """The stored queries of a JSON file, read through Spark so that any of its stores will do."""
    return query_set(spark.read.text(path, wholetext=True).first()["value"])


class QuerySet:
    """Stored queries that are loaded anew on request; an unreadable set keeps the one before."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.queries = load_queries(spark, path)

    def refresh(self) -> list[Query]:
        try:
            self.queries = load_queries(self.spark, self.path)
        except (QueryError, ValueError) as e:
            log.warning("the query set stays as it is: %s", e)
        return self.queries
