"""Sharding by minimax contiguous partition. DataFrame functions only.

Equal texts form an atomic group. Groups are laid out along the 64-bit hash of their text, and
the line is cut into ``n_shards`` contiguous pieces whose largest piece is as small as possible:
a binary search over the capacity, each try checked by a greedy walk, and the cuts taken from
the last feasible try. The walk runs on the driver over a summary of bounded size: at first
2^SUMMARY_BITS slices of the hash line, later single groups around the cuts only.

Null texts count as empty. Rows with equal text stay together whatever their number, so one
group may make a shard larger than the mean. An empty table gives an empty result. Repeated rows
are kept, each with its own slot. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

SUMMARY_BITS = 14
#: Slices next to a cut that are refined with it.
NEIGHBOURS = 24
#: Rows that share one numbering task, on average.
SLOT_ROWS = 50_000


@dataclass
class Atom:
    """A slice of the hash line: its last hash, its bytes, its largest group and its groups."""

    first: int
    last: int
    size: int
    largest: int
    groups: int


def greedy(sizes: list[int], capacity: int, n: int, splittable: list[bool]) -> tuple[bool, list[int], list[bool]]:
    """Fill shard after shard. A splittable atom may be cut anywhere, which only helps.

    Returns whether ``n`` shards suffice, for each cut the atom before which (or inside which)
    it falls, and whether it falls inside.
    """
    cuts: list[int] = []
    inside: list[bool] = []
    room = capacity
    shards = 1
    for i, size in enumerate(sizes):
        left = size
        while left > room:
            if splittable[i]:
                left -= room
                inside.append(True)
            else:
                if left > capacity:
                    return False, cuts, inside
                inside.append(False)
            cuts.append(i)
            shards += 1
            room = capacity
            if shards > n:
                return False, cuts, inside
        room -= left
    return True, cuts, inside


def smallest_capacity(atoms: list[Atom], n: int) -> tuple[int, list[int], list[bool]]:
    """Binary search for the smallest capacity with which ``n`` shards hold all atoms."""
    sizes = [a.size for a in atoms]
    split = [a.groups > 1 for a in atoms]
    low = max(max((a.largest for a in atoms), default=0), -(-sum(sizes) // n))
    high = max(sum(sizes), low)
    while low < high:
        mid = (low + high) // 2
        if greedy(sizes, mid, n, split)[0]:
            high = mid
        else:
            low = mid + 1
    _, cuts, inside = greedy(sizes, low, n, split)
    return low, cuts, inside


def _slices(groups: DataFrame, wanted: list[tuple[int, int]] | None, bits: int) -> list[Atom]:
    """Summaries of the groups, by the first ``bits`` bits of their hash; only of ``wanted`` ranges."""
    if wanted is not None:
        lows, highs = [w[0] for w in wanted], [w[1] for w in wanted]
        cond = F.lit(False)
        for lo, hi in zip(lows, highs, strict=True):
            cond = cond | F.col("h").between(lo, hi)
        groups = groups.where(cond)
    key = F.shiftright("h", 64 - bits)
    rows = groups.groupBy(key.alias("slice")).agg(F.min("h").alias("first"), F.max("h").alias("last"), F.sum("bytes").alias("size"), F.max("bytes").alias("largest"), F.count("*").alias("groups")).collect()
    return sorted((Atom(r["first"], r["last"], r["size"], r["largest"], r["groups"]) for r in rows), key=lambda a: a.first)


def minimax_cuts(groups: DataFrame, n: int) -> tuple[list[int], int]:
    """Hashes at which a new shard begins, and the capacity. ``groups``: (h long, bytes long)."""
    bits = SUMMARY_BITS
    atoms = _slices(groups, None, bits)
    while True:
        capacity, cuts, inside = smallest_capacity(atoms, n)
        open_ = [c for c, within in zip(cuts, inside, strict=True) if within]
        if not open_:
            return [atoms[c].first for c in cuts], capacity
        near = sorted({j for c in cuts for j in range(max(0, c - NEIGHBOURS), min(len(atoms), c + NEIGHBOURS + 1)) if atoms[j].groups > 1})
        span: list[tuple[int, int]] = []
        for j in near:
            if span and j - 1 in near and atoms[j - 1].groups > 1:
                span[-1] = (span[-1][0], atoms[j].last)
            else:
                span.append((atoms[j].first, atoms[j].last))
        bits = min(64, bits + max(2, SUMMARY_BITS - max(1, len(near)).bit_length() - 1))
        held = set(near)
        atoms = sorted([a for j, a in enumerate(atoms) if j not in held] + _slices(groups, span, bits), key=lambda a: a.first)


def shard_of(h: Column, cuts: list[int]) -> Column:
    """Number of cuts at or below the hash; a balanced CASE of five comparisons for 24 shards."""

    def pick(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi + 1) // 2
        return F.when(h >= F.lit(cuts[mid - 1]), pick(mid, hi)).otherwise(pick(lo, mid - 1))

    return pick(0, len(cuts))


def shard_minimax(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """Put every row into one of ``n_shards`` shards of near equal bytes, equal texts together.

    Returns (doc_id, size, text_crc32, law, shard, slot, grown_shard, group_hash).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("group_hash")), "shard_rows")
    groups = materialize(rows.groupBy(F.col("group_hash").alias("h")).agg(F.sum("size").alias("bytes")), "shard_groups")
    cuts, _ = minimax_cuts(groups, n_shards)
    placed = rows.withColumn("shard", shard_of(F.col("group_hash"), cuts).cast("int"))
    # a shard is numbered in many cells: cell offsets from counts, then row numbers inside a cell
    cells = max(1, -(-rows.count() // (SLOT_ROWS * n_shards)))
    placed = placed.withColumn("cell", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(cells)).cast("int"))
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = counts.select("shard", "cell", F.sum("n").over(W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)).alias("before"))
    numbered = placed.withColumn("rank", F.row_number().over(W.partitionBy("shard", "cell").orderBy("group_hash", "doc_id")))
    out = numbered.join(before, ["shard", "cell"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.coalesce("before", F.lit(0)) + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "group_hash")


def shard_for(key: int, cuts: list[int]) -> int:
    """The shard of one hash, as ``shard_of`` gives it."""
    return bisect_right(cuts, key)
