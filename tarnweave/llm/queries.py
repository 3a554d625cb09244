"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, jaccard_join, lm_scoring, packing, pii, quality, sharding, suffix_dedup, token_output, url_filters


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents")).drop("h", "class_h")


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.packed_rows(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_minimax(table(spark, sf_dir, "documents"), 24).drop("group_hash")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(table(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents")))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_token_output": op2_token_output,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_sharding": op5_sharding,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_url_filters": op7_url_filters,
    "op8_decontamination": op8_decontamination,
    "op9_quality_rules": op9_quality_rules,
    "op10_pii": op10_pii,
}

_OP7 = r"""
with parts as (
  select page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path
  from pages
), judged as (
  select page_id, coalesce(host, '') as host, coalesce(path, '') as path, case
    when '.' || host like '%.example.net' and starts_with(path, '/de/8') then 'example.net/de/8'
    when '.' || host like '%.example.com' and starts_with(path, '/en/7') then 'example.com/en/7'
    when '.' || host like '%.com' and starts_with(path, '/en/') then 'com/en/'
    when '.' || host like '%.net' and starts_with(path, '/de/') then 'net/de/'
    when '.' || host like '%.org' and starts_with(path, '/es/') then 'org/es/' end as rule,
    coalesce(regexp_matches('.' || host || '.', '[.](ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)[.]'), false) as listed
  from parts
)
select page_id, host, path, rule, case when rule in ('example.com/en/7', 'net/de/') then 'allow' when rule is not null or listed then 'block' else 'allow' end as verdict, listed from judged
"""
_OP8 = r"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), sized as (
  select item_id, w, least(13, len(w)) as m from b where len(w) > 0
), strings as (
  select distinct item_id, m, array_to_string(w[i : i + m - 1], ' ') as s from (select item_id, w, m, unnest(range(1, len(w) - m + 2)) as i from sized) x
), places as (
  select r, m, i, array_to_string(w[i : i + m - 1], ' ') as s from (select r, w, m, unnest(range(1, len(w) - m + 2)) as i from d, (select distinct m from sized) l where len(w) >= m) x
), hits as (
  select p.r, p.m, p.i, t.item_id from places p join strings t on p.m = t.m and p.s = t.s
), words as (
  select r, count(distinct k) as n_hit from (select r, unnest(range(i, i + m)) as k from hits) x group by r
), items as (
  select r, count(*) as n_items, string_agg(item, ',' order by item) as list from (select distinct r, cast(item_id as varchar) as item from hits where item_id is not null) x group by r
)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(list, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated
from d left join words on d.r = words.r left join items on d.r = items.r
"""
_OP9 = r"""
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t from documents
), w as (
  select r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from d
), windows as (
  select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as s from (select r, w, unnest(range(1, len(w) - 1)) as i from w where len(w) > 2) x
), twice as (
  select r, i from (select r, i, count(*) over (partition by r, s) as n from windows) x where n > 1
), covered as (
  select r, count(distinct k) as n_repeat_words from (select r, unnest([i, i + 1, i + 2]) as k from twice) x group by r
), lines as (
  select r, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from (select r, unnest(string_split(t, chr(10))) as line from d) x where regexp_matches(line, '[^\x20\x09-\x0D]') group by r
), m as (
  select doc_id, cast(len(w) as bigint) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
    coalesce(n_lines, 0) as n_lines, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
  from d join w on d.r = w.r left join covered on d.r = covered.r left join lines on d.r = lines.r
), bits as (
  select *, cast((case when n_words < 50 then 1 else 0 end) + (case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end) + (case when 10 * n_symbols > 4 * n_words then 4 else 0 end)
    + (case when 10 * n_dup_lines > 6 * n_lines then 8 else 0 end) + (case when word_chars < 2 * n_words then 16 else 0 end) + (case when word_chars > 40 * n_words then 32 else 0 end) as int) as rule_bits from m
)
select *, rule_bits & 3 <> 0 as base_failed, rule_bits = 0 as kept, 'standard-2' as policy from bits
"""

#: Equal rows in SQL, where it can express the operator. The others are tested against models.
ORACLE_SQL: dict[str, str] = {"op7_url_filters": _OP7, "op8_decontamination": _OP8, "op9_quality_rules": _OP9}
