"""N-gram Jaccard self-join by chosen paths.

A document is the set of its shingles of five words (white-space words as they stand; a text of
fewer words has one shingle of all of them). Two sets are linked where their Jaccard similarity
is at least ``threshold``.

Chosen paths: at every node of a random tree a set picks each of its shingles with probability
1 / (threshold * size), by a hash of node and shingle that all sets share, and goes to one child
per pick. Linked sets share at least one pick per level on average, others fewer and fewer. One
run of ``DEPTH`` levels brings a linked pair together with the probability ``meeting``; the
number of runs follows from the target recall. Sets in one bucket of at most ``BUCKET`` sets are
compared by brute force, first on sketches.

Few shingles make minwise bits noisy, so sets of fewer than ``PARITY_BITS`` shingles are told apart
by an odd sketch instead: shared shingles cancel out in the XOR of two, so it has at most as many
ones as there are shingles in one set only, and rejects no pair that reaches the threshold.

Larger buckets hold near copies, or sets that share a passage. They are parted by size (each set goes
to the part of its size and to the next, so linked sets meet) and get a centre, the majority sketch of
some members. Any centre will do: distances between sketches obey the triangle inequality, so
two linked sets are both within ``STAR`` of it, and then belong to one proposed group, or both
further than ``TIGHT``. The latter are split by one more level (``REPEATS`` picks each), up to
``DEEPER`` times; only what is then left, neither near a centre nor split, is compared block against
block.

Sketch matches only propose groups; exact comparison of whole sets decides. All sets of a group of at
most ``BLOCK_SETS`` meet in a task. A larger group gets a centre too: the shingles that most of
some members have. The Jaccard distance is a metric, so with the exact distances to the centre every
pair whose sum is at most the allowed distance is linked, and every pair whose difference is larger
is not; these are counted from a histogram of the distances. Only the pairs between are compared,
in blocks of alike distance. So links are counted, never listed, and a group of n near copies within
half the allowed distance of its centre costs n steps; groups that are spread wider than that cost
more, up to all pairs between blocks.

Sets that are equal (exact copies above all) are one node throughout and expand to rows only at
the end. Shingles are 64-bit hashes, sets are told apart by 64 bits of a 128-bit digest.

Texts of any length are read whole: one that exceeds a slice has a slice of its own. Extra columns are
ignored, by ``keep_one_of_each`` kept, whatever their names. Of a class the smallest doc_id (null
first, then by the text's hash) names it. Texts without words (null, empty, blank) have an empty set and are linked to nothing. Repeated
rows are copies of each other. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, in_key_order, materialize, runs_of_key, trimmed
from .packing import slices

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
DEPTH = 2
REPEATS = 2
DEEPER = 2
BUCKET = 2048
#: Sets and shingles of a proposed group that one task compares; larger groups go in blocks.
BLOCK_SETS = 1024
BLOCK_TOKENS = 600_000
#: Bytes of text that a worker shingles at a time.
SLICE_BYTES = 3_000_000
#: Bytes of a table of ids that is broadcast; a larger one is shuffled.
BROADCAST_BYTES = 32_000_000
SKETCH_BITS = 256
PARITY_BITS = 512
#: Members that vote on a centre, about.
VOTERS = 32
#: Distances from the centre of a bucket, in parts of the set's size (odd sketch) and in bits of 256
#: (minwise sketch, parts of sizes from ``MINWISE_FROM`` on). Two linked sets are both within STAR or
#: both beyond TIGHT: 0.8 * 0.39 - 0.2 = 0.112; 28 bits and the 55 that linked sets differ by make 83.
TIGHT, STAR = (0.112, 28), (0.39, 83)
MINWISE_FROM = 300
#: Distances from the centre of a group count in millionths, rounded up.
UNIT = 1_000_000

_M1, _M2, _K = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def meeting(depth: int) -> float:
    """Probability that a pair at the threshold shares a node after ``depth`` levels of one run."""
    q = 1.0
    for _ in range(depth):
        q = 1 - math.exp(-q)
    return q


def runs_for(recall: float, depth: int = DEPTH) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - meeting(depth))))


def shingle_sets(texts: pa.Array, width: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = lists.flatten()
    blank = pc.equal(words, "")
    offsets = np.asarray(lists.offsets) - lists.offsets[0].as_py()
    coded = words.dictionary_encode()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    seq = hashes[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.empty(0, np.uint64)
    empty = blank.to_numpy(zero_copy_only=False)
    if empty.any():  # a leading or trailing blank gives an empty word
        keep = ~empty
        offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
        seq = seq[keep]
    n = len(seq)
    rolled = np.zeros(max(0, n - width + 1), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            rolled = rolled * _K + seq[j : n - width + 1 + j]
        rolled = mix(rolled)
        out = []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            if b - a >= width:
                out.append(np.unique(rolled[a : b - width + 1]))
            elif b > a:
                h = np.uint64(b - a)
                for w in seq[a:b]:
                    h = h * _K + w
                out.append(mix(np.array([h], np.uint64)))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def picks(tokens: np.ndarray, node: int, threshold: float) -> np.ndarray:
    """The shingles that a set picks at a node, as child nodes."""
    with np.errstate(over="ignore"):
        drawn = mix(tokens ^ np.uint64(node))
        limit = np.uint64(min(2**64 - 1, int(2**64 / (threshold * len(tokens)))))
        return mix(drawn[drawn < limit] + np.uint64(node) * _K)


def leaves(tokens: np.ndarray, runs: int, threshold: float, depth: int = DEPTH, roots: list[int] | None = None) -> np.ndarray:
    """Nodes at ``depth`` below the roots (by default one root per run)."""
    with np.errstate(over="ignore"):
        level = mix(np.arange(1, runs + 1, dtype=np.uint64) * _K) if roots is None else np.array(roots, np.uint64)
    for _ in range(depth):
        found = [picks(tokens, int(node), threshold) for node in level]
        level = np.concatenate(found) if found else np.empty(0, np.uint64)
    return np.unique(level)


_EDGES = np.arange(SKETCH_BITS, dtype=np.uint64) << np.uint64(64 - SKETCH_BITS.bit_length() + 1)


def sketch(tokens: np.ndarray) -> bytes:
    """One bit of the smallest shingle in each of 256 hash ranges, empty ranges borrow from the next;
    then 512 bits, each the parity of the number of shingles that hash to it."""
    at = np.searchsorted(tokens, _EDGES)
    low = tokens[at % len(tokens)]  # the first of the range, or of the next that isn't empty
    odd = np.bincount((mix(tokens ^ _K) % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(np.concatenate(((mix(low) & np.uint64(1)).astype(bool), odd.astype(bool)))).tobytes()


FEATURES = "doc_id long, h long, sid long, n int, sketch binary, nodes array<long>"


def _features(runs: int, threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                sid, n, sk, nodes = [], [], [], []
                for s in shingle_sets(part.column("text")):
                    n.append(len(s))
                    sid.append(_set_id(s) if len(s) else None)
                    sk.append(sketch(s) if len(s) else None)
                    nodes.append(leaves(s, runs, threshold).view(np.int64) if len(s) else [])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array(sid, pa.int64()), pa.array(n, pa.int32()), pa.array(sk, pa.binary()), pa.array(nodes, pa.list_(pa.int64()))], names=["doc_id", "h", "sid", "n", "sketch", "nodes"])

    return run


def _set_id(tokens: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh3_128_digest(tokens.tobytes())[:8], "little", signed=True)


def _deeper(threshold: float, repeats: int) -> Callable:
    """One more level below given nodes: rows (sid, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                sids, nodes = [], []
                for s, sid, parents in zip(shingle_sets(part.column("text")), part.column("sid").to_pylist(), part.column("parents").to_pylist(), strict=True):
                    with np.errstate(over="ignore"):
                        roots = [int(mix(np.array([p], np.int64).view(np.uint64) + np.uint64(r) * _K)[0]) for p in parents for r in range(repeats)]
                    new = leaves(s, 0, threshold, 1, roots) if len(s) else np.empty(0, np.uint64)
                    sids += [sid] * len(new)
                    nodes.append(new.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(np.concatenate(nodes) if nodes else [], pa.int64())], names=["sid", "node"])

    return run


def _differing(bits: np.ndarray, rows: slice) -> np.ndarray:
    """Differing bits of the pairs of ``rows`` with all rows."""
    out = np.zeros((len(bits[rows]), len(bits)), np.int16)
    for w in range(bits.shape[1]):
        out += np.bitwise_count(bits[rows, w][:, None] ^ bits[:, w][None, :])
    return out


def similar_sketches(bits: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs may reach the threshold, by sketch and size.

    Where the smaller set has under ``PARITY_BITS`` shingles none is missed; elsewhere misses are 4.5
    standard deviations away.
    """
    g = len(sizes)
    out = np.zeros((g, g), bool)
    sizes = sizes.astype(np.float32)
    words = SKETCH_BITS // 64
    step = max(1, 1_000_000 // g)
    for at in range(0, g, step):
        rows = slice(at, at + step)
        small = np.minimum(sizes[rows, None], sizes[None, :])
        large = np.maximum(sizes[rows, None], sizes[None, :])
        alike = _differing(bits[:, words:], rows) <= (small + large) * np.float32((1 - threshold) / (1 + threshold)) + 1e-3
        if sizes.max() >= PARITY_BITS:
            apart = _differing(bits[:, :words], rows)
            spread = np.sqrt(np.float32((threshold * (1 - threshold) + 0.36) / SKETCH_BITS))
            alike = np.where(small < PARITY_BITS, alike, 1 - 2 * apart / np.float32(SKETCH_BITS) >= threshold - 4.5 * spread)
        out[rows] = alike & (small >= threshold * large - 1e-3)
    return out


def labels(linked: np.ndarray) -> np.ndarray:
    """Component label (smallest index) of every row of a symmetric boolean matrix."""
    g = len(linked)
    out = np.arange(g, dtype=np.int32)
    step = max(1, 4_000_000 // g)
    while True:
        new = np.concatenate([np.where(linked[at : at + step], out[None, :], np.int32(g)).min(axis=1) for at in range(0, g, step)])
        new = np.minimum(new, out)
        new = new[new]
        if (new == out).all():
            return out
        out = new


def _propose(threshold: float) -> Callable:
    """Brute force over the sketches of each bucket: star edges of the groups found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[np.ndarray] = []
        right: list[np.ndarray] = []
        for group in runs_of_key(batches, "node"):
            sid, at = np.unique(group.column("sid").to_numpy(), return_index=True)
            if len(sid) < 2:
                continue
            bits = np.stack([np.frombuffer(x.as_py(), np.uint64) for x in group.column("sketch").take(pa.array(at))])
            lab = labels(similar_sketches(bits, group.column("n").to_numpy()[at], threshold))
            tied = lab != np.arange(len(lab))
            left.append(sid[tied])
            right.append(sid[lab[tied]])
            if len(left) > 5000:
                yield _edges(left, right)
                left, right = [], []
        if left:
            yield _edges(left, right)

    return run


def _edges(left: list[np.ndarray], right: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(left), pa.int64()), pa.array(np.concatenate(right), pa.int64())], names=["a", "b"])


def _centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, k, majority sketch) of each bucket's voters."""
    for group in runs_of_key(batches, "node"):
        bits = np.unpackbits(np.stack([np.frombuffer(x.as_py(), np.uint8) for x in group.column("sketch")]), axis=1)
        centre = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(bits)).tobytes()
        yield pa.RecordBatch.from_arrays([group.column("node").slice(0, 1).combine_chunks(), group.column("k").slice(0, 1).combine_chunks(), pa.array([centre], pa.binary())], names=["node", "k", "centre"])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, sid, k, star, rest): whether a member is within STAR of its bucket's centre, and beyond TIGHT."""
    split = SKETCH_BITS // 64
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("sketch", "centre"))
        apart = np.bitwise_count(a ^ b)
        n = batch.column("n").to_numpy().astype(np.float64)
        minwise = batch.column("minwise").to_numpy(zero_copy_only=False)
        d = np.where(minwise, apart[:, :split].sum(axis=1), apart[:, split:].sum(axis=1))
        star = d <= np.where(minwise, STAR[1], STAR[0] * n)
        rest = d > np.where(minwise, TIGHT[1], TIGHT[0] * n)
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("sid"), batch.column("k"), pa.array(star), pa.array(rest)], names=["node", "sid", "k", "star", "rest"])


def _majority(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(root, k, shingles that more than half of the voters have) of each group."""
    for group in runs_of_key(batches, "root"):
        tokens, count = np.unique(np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in group.column("tokens")]), return_counts=True)
        centre = tokens[2 * count > group.num_rows].tobytes()
        yield pa.RecordBatch.from_arrays([group.column("root").slice(0, 1).combine_chunks(), group.column("k").slice(0, 1).combine_chunks(), pa.array([centre], pa.binary())], names=["root", "k", "centre"])


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sid, root, k, n, q): each set's Jaccard distance from the centre of its group, in units rounded up."""
    for batch in batches:
        q = []
        for t, c in zip(batch.column("tokens"), batch.column("centre"), strict=True):
            a, b = np.frombuffer(t.as_py(), np.uint64), np.frombuffer(c.as_py(), np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            union = len(a) + len(b) - both
            q.append(-(-(union - both) * UNIT // union) if union else 0)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("sid", "root", "k", "n")), pa.array(q, pa.int32())], names=["sid", "root", "k", "n", "q"])


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles of the sets of proposed groups; rows whose text is of another set are dropped."""
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            keep, raw, n = [], [], []
            sids = part.column("sid").to_pylist()
            for i, s in enumerate(shingle_sets(part.column("text"))):
                if len(s) and _set_id(s) == sids[i]:
                    keep.append(i)
                    raw.append(s.tobytes())
                    n.append(len(s))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in ("sid", "root", "k", "size")), pa.array(n, pa.int32()), pa.array(raw, pa.binary())], names=["sid", "root", "k", "size", "n", "tokens"])


def shared_tokens(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    g = len(sets)
    owner = np.repeat(np.arange(g), [len(s) for s in sets])
    tokens = np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
    count = np.diff(np.append(first, len(tokens)))
    column = np.repeat(np.cumsum(count > 1) - 1, count)
    used = np.repeat(count > 1, count)
    owner, column = owner[used], column[used]
    out = np.zeros((g, g), np.float64)
    width = max(64, 4_000_000 // max(g, 1))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, (at, at + width))
        m = np.zeros((g, min(width, int(column[-1]) + 1 - at)), np.float32)
        m[owner[lo:hi], column[lo:hi] - at] = 1
        out += m @ m.T
    return out


def _certain(threshold: float) -> int:
    """Pairs whose distances from a centre add up to no more than this are linked."""
    return math.floor((1 - threshold) * UNIT * (1 - 1e-9))


def _verify(threshold: float) -> Callable:
    """Exact comparison of the pairs of a group or of two blocks of it: (sid, links, peer).

    ``q``: distances from the group's centre; pairs that are linked by them are left out. Null: none known.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0
        for group in runs_of_key(batches, "task"):
            sid, at = np.unique(group.column("sid").to_numpy(), return_index=True)
            n = group.column("n").to_numpy()[at].astype(np.float64)
            side = group.column("side").to_numpy()[at]
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("tokens").take(pa.array(at))]
            both = shared_tokens(sets)
            linked = both * (1 + threshold) >= threshold * (n[:, None] + n[None, :]) - 1e-6
            np.fill_diagonal(linked, False)
            if side.any():
                linked &= side[:, None] != side[None, :]
            q = group.column("q").combine_chunks().fill_null(UNIT).to_numpy()[at]
            if (q < UNIT).any():
                linked &= q[:, None] + q[None, :] > _certain(threshold)
            links = linked.sum(axis=1)
            lab = labels(linked)
            out.append((sid, links, sid[lab]))
            held += len(sid)
            if held > 20_000:
                yield _links(out)
                out, held = [], 0
        if out:
            yield _links(out)

    return run


def _links(out: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out]), pa.int64()) for i in range(3)], names=["sid", "links", "peer"])


def _few(df: DataFrame) -> DataFrame:
    """``df`` (numbers, and arrays of numbers), to be broadcast if its values have been counted to be few."""
    width = sum((F.size(f.name) * 8 + 16 if isinstance(f.dataType, T.ArrayType) else F.lit(16) for f in df.schema), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(width)).first()[0] or 0) <= BROADCAST_BYTES else df


def _with_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of the documents (doc_id, h) that ``ids`` names, with its other columns."""
    found = docs.alias("d").join(_few(ids).alias("i"), F.col("d.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("d.h") == F.col("i.h")))
    return found.select("d.text", *(f"i.{c}" for c in ids.columns if c not in ("doc_id", "h")))


def _around_centres(crowd: DataFrame, sets: DataFrame, bucket: int) -> tuple[DataFrame, DataFrame]:
    """Of crowded buckets (node, sid): star edges (a, b) of the members near a centre, and the members
    (node, sid) that may be linked beyond that. Buckets are parted by size first.
    """
    c = lambda x: F.pmod(F.xxhash64("sid"), x).cast("int")
    step = F.floor(F.log("n") / math.log(1.25)).cast("int")
    rows = crowd.join(sets.select("sid", "n", "sketch"), "sid").withColumn("_p", F.explode(F.array(step, step + 1)))
    rows = rows.select(F.xxhash64("node", "_p").alias("node"), "sid", "n", "sketch", (F.pow(F.lit(1.25), F.col("_p") - 1) >= MINWISE_FROM).alias("minwise"))
    rows = materialize(rows, "jaccard_crowd")
    size = rows.groupBy("node").agg(F.count("*").alias("size")).where("size > 1").withColumn("k", F.ceil(F.col("size") / bucket).cast("int"))
    rows = materialize(rows.join(size, "node"), "jaccard_crowd")
    few, rows = rows.where("k = 1").select("node", "sid"), rows.where("k > 1")
    voters = rows.where(F.pmod(F.xxhash64("sid", "node"), F.greatest(F.lit(1), (F.col("size") / VOTERS).cast("long"))) == 0).select("node", "k", "sketch")
    centres = in_key_order(voters, "node", _centres, "node long, k int, centre binary")
    # as many copies of a centre as its members fill buckets, so that no key is hot
    centres = centres.select("node", "centre", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("c"))
    met = rows.withColumn("c", c(F.col("k"))).join(centres, ["node", "c"], "left").select("node", "sid", "n", "k", "minwise", "sketch", F.coalesce("centre", "sketch").alias("centre"))
    placed = materialize(met.mapInArrow(trimmed(_placed), "node long, sid long, k int, star boolean, rest boolean"), "jaccard_near")
    heads = placed.where("star").groupBy("node").agg(F.min("sid").alias("b"), F.max("k").alias("k"))
    heads = heads.select("node", "b", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("c"))
    star = placed.where("star").select("node", "sid", c(F.col("k")).alias("c")).join(heads, ["node", "c"])
    return star.where("sid <> b").select(F.col("sid").alias("a"), "b").distinct(), placed.where("rest").select("node", "sid").unionByName(few)


def _from_centres(own: DataFrame) -> DataFrame:
    """(sid, root, k, n, q) of the sets of wide groups (sid, root, k, size, n, tokens)."""
    voters = own.where(F.pmod(F.xxhash64("sid"), F.greatest(F.lit(1), (F.col("size") / VOTERS).cast("long"))) == 0).select("root", "k", "tokens")
    centres = in_key_order(voters, "root", _majority, "root long, k int, centre binary")
    centres = centres.select("root", "centre", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("c"))
    met = own.withColumn("c", F.pmod(F.xxhash64("sid"), F.col("k")).cast("int")).join(centres, ["root", "c"], "left")
    return met.select("sid", "root", "k", "n", "tokens", F.coalesce("centre", "tokens").alias("centre")).mapInArrow(trimmed(_distances), "sid long, root long, k int, n int, q int")


def _by_distance(placed: DataFrame, allowed: int) -> tuple[DataFrame, DataFrame]:
    """Links that follow from the distances, as (sid, links, peer), and what is to be compared:
    (task, sid, n, side, q). A group has at most ``UNIT`` different distances.
    """
    cells = materialize(placed.groupBy("root", "q").agg(F.count("*").alias("m"), F.min("sid").alias("low"), F.max("k").alias("k")), "jaccard_cells")
    # for each distance q the sets up to allowed - q: one running sum over cells and questions
    points = cells.select("root", F.col("q").alias("at"), "m", F.lit(0).alias("asks"), "q").unionByName(cells.select("root", (F.lit(allowed) - F.col("q")).alias("at"), F.lit(0).cast("long").alias("m"), F.lit(1).alias("asks"), "q"))
    upto = Window.partitionBy("root").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    links = points.withColumn("links", F.sum("m").over(upto)).where("asks = 1").select("root", "q", (F.col("links") - (2 * F.col("q") <= allowed).cast("int")).alias("links"))
    group = placed.groupBy("root").agg(F.min(F.struct("q", "sid")).alias("near"), F.max("q").alias("far"), F.count("*").alias("all"), F.max("k").alias("k"))
    # participants, in order of distance, in blocks of about all / k sets
    order = Window.partitionBy("root").orderBy("q").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.drop("k").join(group, "root").withColumn("open", F.col("q") + F.col("far") > allowed)
    cells = cells.join(links, ["root", "q"]).withColumn("before", F.coalesce(F.sum(F.when(F.col("open"), F.col("m")).otherwise(0)).over(order), F.lit(0)))
    cells = materialize(cells, "jaccard_cells")
    # one row per cell on this side: a cell with very many sets is split by the adaptive skew join
    spread = placed.select("sid", "root", "q", "n").join(cells, ["root", "q"])
    share = F.greatest(F.lit(1), F.ceil(F.col("all") / F.col("k")))
    rows = spread.select("sid", "root", "q", "n", "links", "near", "open", F.floor((F.col("before") + F.pmod(F.xxhash64("sid", F.lit(1)), F.col("m"))) / share).alias("block"))
    rows = materialize(rows, "jaccard_dealt")
    certain = rows.where("links > 0").select("sid", "links", F.when(F.col("q") + F.col("near.q") <= allowed, F.col("near.sid")).otherwise(F.col("sid")).alias("peer"))
    open_ = rows.where("open").select("sid", "root", "q", "n", "block")
    blocks = open_.groupBy("root", "block").agg(F.min("q").alias("low"), F.max("q").alias("high"))
    x, y = blocks.alias("x"), blocks.alias("y")
    meet = x.join(y, (F.col("x.root") == F.col("y.root")) & (F.col("x.block") <= F.col("y.block"))).where((F.col("x.high") + F.col("y.high") > allowed) & (F.col("y.low") - F.col("x.high") <= allowed + 4))
    meet = meet.select(F.col("x.root").alias("root"), F.col("x.block").alias("a"), F.col("y.block").alias("b"))
    sides = meet.select("root", F.col("a").alias("block"), "a", "b", F.when(F.col("a") == F.col("b"), 0).otherwise(1).alias("side")).unionByName(meet.where("a < b").select("root", F.col("b").alias("block"), "a", "b", F.lit(2).alias("side")))
    return certain, open_.join(sides, ["root", "block"]).select(F.xxhash64("root", "a", "b").alias("task"), "sid", "n", "side", "q")


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, bucket: int = BUCKET, block_sets: int = BLOCK_SETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, h (hash of the text), class_id (smallest doc_id of its class of
    linked documents), class_h (that document's h), n_links (different sets linked to its own),
    n_copies (other documents of an equal set).
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    rows = materialize(slim.mapInArrow(trimmed(_features(runs_for(recall), threshold)), FEATURES), "jaccard_rows")
    sets = rows.where("sid is not null").groupBy("sid").agg(F.min(F.struct("doc_id", "h")).alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("nodes").alias("nodes"), F.count("*").alias("rows"))
    sets = materialize(sets, "jaccard_sets")

    def live(pairs: DataFrame) -> DataFrame:
        """(node, sid, size) of nodes that hold two sets or more."""
        crowd = pairs.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
        return pairs.join(crowd, "node")

    members = materialize(live(sets.select("sid", F.explode("nodes").alias("node"))), "jaccard_members")
    small = members.where(F.col("size") <= bucket).select("node", "sid")
    crowd = members.where(F.col("size") > bucket).select("node", "sid")
    stars: list[DataFrame] = []
    for level in range(DEEPER + 1):
        if not crowd.limit(1).count():
            break
        star, rest = _around_centres(crowd, sets, bucket)
        stars.append(star)
        rest = materialize(live(rest), "jaccard_rest")
        small = small.unionByName(rest.where(F.col("size") <= bucket).select("node", "sid"))
        rest = rest.where(F.col("size") > bucket)
        if level == DEEPER:
            # neither near a centre nor split: block against block
            rest = rest.withColumn("k", F.ceil(F.col("size") / (bucket // 2)).cast("int")).withColumn("c", F.pmod(F.xxhash64("sid"), F.col("k")).cast("int"))
            small = small.unionByName(rest.select(F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("d"), "*").select(F.xxhash64("node", F.least("c", "d"), F.greatest("c", "d")).alias("node"), "sid"))
            break
        if not rest.limit(1).count():
            break
        parents = rest.groupBy("sid").agg(F.collect_set("node").alias("parents"))
        wanted = sets.select("sid", "rep.doc_id", "rep.h").join(parents, "sid")
        deeper = _with_texts(slim, materialize(wanted, "jaccard_parents")).select("sid", "parents", "text").mapInArrow(trimmed(_deeper(threshold, REPEATS)), "sid long, node long").distinct()
        deeper = materialize(live(deeper), "jaccard_members")
        small = small.unionByName(deeper.where(F.col("size") <= bucket).select("node", "sid"))
        crowd = deeper.where(F.col("size") > bucket).select("node", "sid")
    bucketed = small.join(sets.select("sid", "n", "sketch"), "sid")
    edges = in_key_order(bucketed, "node", _propose(threshold), "a long, b long").distinct()
    for star in stars:
        edges = edges.unionByName(star)
    groups = components(edges, "a", "b")
    groups = materialize(groups.select(F.col("node").alias("sid"), "root"), "jaccard_groups")

    sized = groups.join(sets.select("sid", "n", "rep.doc_id", "rep.h"), "sid")
    need = sized.groupBy("root").agg(F.count("*").alias("size"), F.greatest(F.ceil(F.count("*") / block_sets), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int").alias("k"))
    sized = materialize(sized.join(need, "root"), "jaccard_groups")
    fields = "sid long, root long, k int, size long, n int, tokens binary"
    tokens = _with_texts(slim, sized.where("k = 1").select("sid", "root", "k", "size", "doc_id", "h")).mapInArrow(trimmed(_sets_of), fields)
    tokens = tokens.select(F.col("root").alias("task"), "sid", "n", F.lit(0).alias("side"), F.lit(None).cast("int").alias("q"), "tokens")
    wide = sized.where("k > 1").limit(1).count() > 0
    if wide:
        own = materialize(_with_texts(slim, sized.where("k > 1").select("sid", "root", "k", "size", "doc_id", "h")).mapInArrow(trimmed(_sets_of), fields), "jaccard_wide")
        placed = materialize(_from_centres(own), "jaccard_placed")
        certain, uncertain = _by_distance(placed, _certain(threshold))
        tokens = tokens.unionByName(uncertain.join(own.select("sid", "tokens"), "sid").select("task", "sid", "n", "side", "q", "tokens"))
    found = in_key_order(tokens, "task", _verify(threshold), "sid long, links long, peer long")
    found = materialize(found.unionByName(certain) if wide else found, "jaccard_links")
    counted = found.groupBy("sid").agg(F.sum("links").alias("n_links"), F.min("peer").alias("peer")).where("n_links > 0")
    if wide:
        roots = components(found.where("links > 0"), "sid", "peer").withColumnRenamed("node", "sid")
        counted = counted.join(roots, "sid").select("sid", "n_links", "root")
    else:
        counted = counted.select("sid", "n_links", F.col("peer").alias("root"))
    named = counted.join(sets.select("sid", "rep"), "sid")
    named = named.join(named.groupBy("root").agg(F.min("rep").alias("class")), "root").select("sid", "n_links", "class")
    info = sets.select("sid", "rep", "rows").join(named, "sid", "left").select("sid", F.coalesce("class", "rep").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.col("rows") - 1).alias("n_copies"))
    info = materialize(info.where("n_links > 0 or n_copies > 0"), "jaccard_classes")
    out = rows.select("doc_id", "h", "sid").join(info, "sid", "left")
    return out.select("doc_id", "h", F.when(F.col("class").isNotNull(), F.col("class.doc_id")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce(F.col("class.h"), F.col("h")).alias("class_h"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(0)).alias("n_copies"))


def keep_one_of_each(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those of a class whose smallest doc_id is another; one row of repeated ones.

    Rows with a null id stay unless their text is that of an earlier row.
    """
    found = materialize(jaccard_classes(docs, threshold, id_col=id_col, text_col=text_col).select("doc_id", "h", "class_id", "class_h"), "jaccard_result")
    same = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("h") == F.col("class_h"))
    gone = materialize(found.where(~same).select(F.col("doc_id").alias("_i"), F.col("h").alias("_h")).distinct(), "jaccard_gone")
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(id_col).cast("long").alias("_i"), F.xxhash64(text_col).alias("_h"))
    small = _few(gone)
    left = packed.alias("p").join(small.alias("g"), F.col("p._h").eqNullSafe(F.col("g._h")) & F.col("p._i").eqNullSafe(F.col("g._i")), "left_anti")
    if found.where(same).groupBy("doc_id", "h").count().where("count > 1").limit(1).count():
        left = left.dropDuplicates(["_i", "_h"])
    return left.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))
