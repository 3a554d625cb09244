"""URL filtering with rules and a Bloom filter cascade. DataFrame functions only.

The cascade answers membership in a list of keys exactly for every key of a known universe,
without a join: level 0 is a Bloom filter of the listed keys; level 1 one of the universe's
unlisted keys that level 0 lets through; level 2 one of the listed keys that level 1 lets
through; and so on until a level lets nothing wrong through. A key is listed when the first
level that rejects it has an odd number (or when the levels, all of which accept, are odd in
number).

The bits of each level go into the plan as a literal, so their number is bounded: keys are dealt by
their hash into as many cascades as keep every level within ``MAX_BITS``, each built from its own keys
alone. A key asks only the cascade of its hash. Lists of any size are answered this way: cascades of up
to ``PASS_BITS`` go into one projection, more of them into one after the other, each over the table
that the one before wrote.

Null keys are never listed. Listed keys outside the universe do no harm. Repeated rows are judged
alike, and repeated keys count once. Empty lists and universes give filters that list nothing, an
empty table an empty result. Hosts and paths of any length are hashed and compared whole. Extra
columns are ignored whatever their names. Of rules that fit a URL the longest wins; no two are equal.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialize

BITS_PER_KEY = 12
HASHES = 4
#: 4 MB of bits in one level, 16 MB in one projection.
MAX_BITS = 1 << 25
PASS_BITS = 1 << 27
MAX_LEVELS = 40


@dataclass(frozen=True)
class UrlRule:
    """``host`` and its subdomains, paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the contract.
RULES = (
    UrlRule("block", "com", "/en/"),
    UrlRule("allow", "example.com", "/en/7"),
    UrlRule("allow", "net", "/de/"),
    UrlRule("block", "example.net", "/de/8"),
    UrlRule("block", "org", "/es/"),
)
#: Production list: hosts under these labels are listed.
LISTED_LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


@dataclass
class Cascade:
    """Per level the number of bits and the 64-bit words, as comma-separated text."""

    bits: list[int] = field(default_factory=list)
    words: list[str] = field(default_factory=list)


def _place(key: Column, level: int, j: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), F.lit(j)), F.lit(bits))


def _accepts(key: Column, level: int, bits: int, words: str) -> Column:
    """Whether the level's filter lets the key through. The words fold to one array literal."""
    table = F.split(F.lit(words), ",").cast("array<bigint>")
    hit = F.lit(True)
    for j in range(HASHES):
        at = _place(key, level, j, bits)
        hit = hit & (F.getbit(F.element_at(table, (F.shiftright(at, 6) + 1).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return hit


def _level(keys: DataFrame, level: int, bits: int) -> str:
    """The set bits of one level, gathered as 64-bit words: at most ``bits`` / 64 rows."""
    spots = keys.select(F.explode(F.array(*(_place(F.col("key"), level, j, bits) for j in range(HASHES)))).alias("at"))
    rows = spots.groupBy(F.shiftright("at", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("x")).collect()
    words = [0] * (bits // 64)
    for r in rows:
        words[r["word"]] = r["x"]
    return ",".join(map(str, words))


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(shards)).cast("int")


def build_cascade(keys: DataFrame, bits_per_key: int = BITS_PER_KEY) -> Cascade | None:
    """Fit a cascade to a table of different keys (key, listed). None: a level would exceed ``MAX_BITS``."""
    out = Cascade()
    inside, outside = keys.where("listed").select("key"), keys.where("not listed").select("key")
    for level in range(MAX_LEVELS):
        n = inside.count()
        if not n:
            return out
        bits = max(64, 1 << (n * bits_per_key - 1).bit_length())
        if bits > MAX_BITS:
            return None
        words = _level(inside, level, bits)
        out.bits.append(bits)
        out.words.append(words)
        wrong = materialize(outside.where(_accepts(F.col("key"), level, bits, words)), "url_level")
        inside, outside = wrong, inside
    raise RuntimeError(f"the cascade did not end in {MAX_LEVELS} levels")


def build_cascades(universe: DataFrame, listed: DataFrame, bits_per_key: int = BITS_PER_KEY) -> list[Cascade]:
    """One cascade per part of the keys; both tables have one column ``key``.

    ``universe`` holds every key that will ever be asked; repeated and null keys are ignored. The parts are
    doubled until no level of any is too large.
    """
    listed = listed.select("key").where("key is not null").distinct().withColumn("is_listed", F.lit(True))
    marked = universe.select("key").where("key is not null").distinct().join(listed, "key", "left").select("key", F.coalesce("is_listed", F.lit(False)).alias("listed"))
    keys = materialize(marked, "url_keys")
    n = keys.where("listed").count()
    shards = 1 << max(0, math.ceil(math.log2(max(1, n * bits_per_key / MAX_BITS))))
    while True:
        dealt = keys if shards == 1 else materialize(keys.withColumn("shard", _shard(F.col("key"), shards)), "url_shards", by="shard")
        out: list[Cascade] = []
        for shard in range(shards):
            one = build_cascade(dealt if shards == 1 else dealt.where(F.col("shard") == shard).drop("shard"), bits_per_key)
            if one is None:
                break
            out.append(one)
        else:
            return out
        shards *= 2


def with_listed(rows: DataFrame, key: str, cascades: list[Cascade], name: str = "listed") -> DataFrame:
    """Add exact membership of ``key``, without a join."""
    passes: list[list[int]] = [[]]
    for i, one in enumerate(cascades):
        if passes[-1] and sum(sum(cascades[j].bits) for j in passes[-1]) + sum(one.bits) > PASS_BITS:
            passes.append([])
        passes[-1].append(i)
    rows = rows.withColumn(name, F.lit(False))
    for k, some in enumerate(passes):
        said = F.col(name)
        for i in some:
            inside = in_cascade(F.col(key), cascades[i])
            said = inside if len(cascades) == 1 else F.when(_shard(F.col(key), len(cascades)) == i, inside).otherwise(said)
        rows = rows.withColumn(name, said)
        if k < len(passes) - 1:
            rows = materialize(rows, "url_pass")
    return rows


def in_cascade(key: Column, cascade: Cascade) -> Column:
    """Exact membership for keys of the cascade's universe."""
    said = F.lit(len(cascade.bits) % 2 == 1)
    for level in reversed(range(len(cascade.bits))):
        said = F.when(_accepts(key, level, cascade.bits[level], cascade.words[level]), said).otherwise(F.lit(level % 2 == 1))
    return F.coalesce(key.isNotNull() & said, F.lit(False))


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty without ``://``. Only A-Z of the host is lower-cased."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def matching_rule(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> tuple[Column, Column]:
    """(rule name, its verdict) of the longest rule that fits, or nulls."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def filter_urls(pages: DataFrame, listed: DataFrame | None = None, labels: tuple[str, ...] = LISTED_LABELS, rules: tuple[UrlRule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge every URL: (page_id, host, path, rule, verdict, listed).

    The rules decide first; the rest is blocked where its host is in ``listed`` (a table of
    ``key``; default: the universe's hosts that carry one of ``labels``).
    """
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    universe = rows.select(F.col("host").alias("key")).distinct()
    if listed is None:
        universe = materialize(universe, "url_universe")
        listed = universe.where(F.arrays_overlap(F.split("key", r"\."), F.array(*map(F.lit, labels))))
    rows = with_listed(rows, "host", build_cascades(universe, listed))
    name, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    return rows.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")
