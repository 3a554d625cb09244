"""Evaluation of a set of stored queries over a table of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lower_runes
from ..plans.ast import Query
from ..plans.compile import has_words, predicate, regexp_span, regexps, word_view
from .snippets import snippet, spans


def _key(q: Query, i: int) -> str:
    return q.id or q.name or str(i)


def _laid_out(texts: DataFrame, queries: list[Query], text: str, strict: bool, lowered: bool) -> tuple[DataFrame, Column]:
    """The rows with ``_low``, the lower-cased text, and ``_words``, its word view; and the ids of the queries that match.

    The query set is part of the plan: one predicate per query, evaluated in a single pass over the
    texts, so there is no join with the queries. Text and words are laid out once for all predicates, as Spark
    doesn't inline a column that is costly and read more than once - unless a filter over it is pushed
    down; so the ids are exploded, not filtered.
    """
    df = texts.withColumn("_low", F.col(text) if lowered else lower_runes(F.col(text)))
    words = None
    if any(has_words(q.root) for q in queries):
        df = df.withColumn("_words", word_view(F.col("_low"), strict))
        words = F.col("_words")
    return df, F.array_compact(F.array(*(F.when(predicate(F.col("_low"), q.root, strict, words), F.lit(_key(q, i))) for i, q in enumerate(queries)))) if queries else F.array().cast("array<string>")


def matches(texts: DataFrame, queries: list[Query], text: str = "text", strict: bool = False, lowered: bool = False) -> DataFrame:
    """The rows of ``texts`` once per query that matches, with ``query_id``."""
    df, hits = _laid_out(texts, queries, text, strict, lowered)
    return df.withColumn("query_id", F.explode(hits)).drop("_words", "_low")


def match_counts(texts: DataFrame, queries: list[Query], by: list[str], text: str = "text", strict: bool = False) -> DataFrame:
    """Matches per query and group."""
    return matches(texts.select(*by, text), queries, text, strict).groupBy("query_id", *by).agg(F.count("*").alias("n_matches"))


FOUND = "array<struct<query_id:string,spans:array<struct<start:int,end:int>>,snippet:string>>"


def _finder(queries: list[Query], strict: bool) -> Callable:
    by = {_key(q, i): (i, q) for i, q in enumerate(queries)}
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    kind = pa.list_(pa.struct([("query_id", pa.string()), ("spans", span), ("snippet", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, hits, leaves in zip(*(batch.column(c).to_pylist() for c in ("_low", "_hits", "_leaf")), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                one = []
                for qid in hits:
                    i, q = by[qid]
                    found = spans(raw, q.root, [(x["start"], x["end"]) if x else None for x in leaves[i] or []], strict) or []
                    one.append({"query_id": qid, "spans": [{"start": a, "end": b} for a, b in found], "snippet": snippet(raw, found)})
                out.append(one)
            names = [c for c in batch.schema.names if c not in ("_leaf", "_low", "_hits")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, kind)], names=[*names, "_found"])

    return run


def with_snippets(texts: DataFrame, queries: list[Query], text: str = "text", strict: bool = False) -> DataFrame:
    """Matches with ``spans`` (byte offsets into the lower-cased text) and ``snippet``.

    Only texts that match leave the JVM, each once with the list of its queries; the rows per match are
    made afterwards. Regexp spans come from the JVM's matcher.
    """
    df, hits = _laid_out(texts, queries, text, strict, False)
    df = df.withColumn("_hits", F.explode(F.filter(F.array(hits), lambda x: F.size(x) > 0))).drop("_words")
    none = F.lit(None).cast("array<struct<start:int,end:int>>")
    leaf = [F.when(F.array_contains("_hits", _key(q, i)), F.array(*(regexp_span(F.col("_low"), x) for x in found))) if (found := regexps(q.root)) else none for i, q in enumerate(queries)]
    df = df.withColumn("_leaf", F.array(*leaf) if leaf else F.array().cast("array<array<struct<start:int,end:int>>>"))
    keep = [f for f in df.schema if f.name not in ("_leaf", "_low", "_hits")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    found = df.mapInArrow(_finder(queries, strict), f"{schema}, _found {FOUND}").withColumn("_found", F.explode("_found"))
    return found.select(*(f"`{f.name}`" for f in keep), "_found.query_id", "_found.spans", "_found.snippet")


def result_rows(pages: DataFrame, queries: list[Query], url: str, host: str, title: str, body: str, text: str = "text", now: Column | None = None, strict: bool = False) -> DataFrame:
    """Result rows: one per page and matching query; a page without a title takes its host's name."""
    now = F.current_timestamp() if now is None else now
    found = with_snippets(pages.select(F.col(url).alias("url"), F.col(host).alias("host"), F.col(title).alias("title"), F.col(body).alias("body"), F.col(text).alias("text")), queries, "text", strict)
    return found.select("query_id", now.alias("last_found"), now.alias("created_on"), F.lit(1).alias("occurrences"), "url", "body", F.coalesce("title", "host").alias("title"), "host", "snippet", F.lit("").alias("category"))


def clean_string(text: Column) -> Column:
    """The column form of snippet cleaning: newlines go, runs of white space are cut to their first character."""
    return F.regexp_replace(F.replace(text, F.lit("\n"), F.lit("")), r"(^|[\t\f\r ])[\t\f\r ]+", "$1")
