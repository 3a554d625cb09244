"""Language-model scoring by deleted interpolation.

The probability of a token is a mixture of a uniform, a unigram and a bigram maximum-likelihood
estimate. The mixture weights depend on how often the context was seen (buckets by powers of two; after a
context that was never seen there is no bigram estimate, and its bucket mixes the other two) and come from expectation maximisation on held-out counts: a sixteenth of the training documents
is set aside, its counts are deleted from the estimates, and the weights are those that make it
most likely. Scores then use the counts of all training documents.

Counting runs over blocks of about ``BLOCK_BYTES`` of text. A block's distinct n-grams, as sorted
64-bit hashes with their counts, are dealt out by hash to ``parts``; each part adds up the counts
of its n-grams over all blocks and sends every block the totals of the block's own n-grams, in the
block's order. So an n-gram is shuffled once per block that has it, however often it occurs, no
table of counts is gathered anywhere, and blocks and parts both grow in number, not in size.

Tokens and bigrams are told apart by 64 bits of a hash. Of N different ones about N^2 / 2^65 pairs
collide: none is expected below some billions, and of 10^13 (hundreds of TB) less than one in a million
shares its counts with another.

Texts of any length are read whole; one that exceeds ``BLOCK_BYTES`` has a block of its own. Extra
columns are ignored whatever their names. Ties cannot matter: scores are sums.

Null texts are empty: the end token alone. Documents without an id are training documents.
Repeated rows count as often as they stand. Without training tokens every estimate but the
uniform one is 0. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import get_arrays, in_key_order, materialize, put_arrays, runs_of_key
from .packing import slices

BLOCK_BYTES = 6_000_000
#: N-grams of one part, about.
PART_NGRAMS = 1_000_000
FOLDS = 16
BUCKETS = 48
BLOCKS_PER_TASK = 4
_K = np.uint64(0x9E3779B97F4A7C15)
_END = np.uint64(0x5DEECE66D1234567)
_NO_ID = -(1 << 63)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def tokenize(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each distinct token, token index sequence, tokens per text); each text ends with the end token."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = lists.flatten()
    offsets = (np.asarray(lists.offsets) - lists.offsets[0].as_py()).astype(np.int64)
    coded = words.dictionary_encode()
    names = coded.dictionary.to_pylist()
    vocab = np.concatenate((np.fromiter((xxhash.xxh64_intdigest(w) for w in names), np.uint64, len(names)), [_END]))
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    if "" in names:  # leading and trailing blanks give empty words
        keep = index != names.index("")
        offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
        index = index[keep]
    lens = np.diff(offsets) + 1
    out = np.full(int(lens.sum()), len(vocab) - 1, np.int32)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(lens) - 1] = False
    out[inside] = index
    return vocab, out, lens


class Block:
    """Documents as token indexes, with the sorted distinct unigrams and bigrams of the block."""

    def __init__(self, doc_ids, held, lens, vocab, index) -> None:
        self.doc_ids, self.held, self.lens = doc_ids, held, lens
        order = np.argsort(vocab)
        rank = np.empty(len(vocab), np.int32)
        rank[order] = np.arange(len(vocab), dtype=np.int32)
        self.unigrams, self.uni = vocab[order], rank[index]
        before = np.empty(len(index), np.int32)
        if len(index):
            before[1:] = index[:-1]
            before[np.cumsum(lens) - lens] = len(vocab) - 1  # a text begins after an end
        self.before = rank[before] if len(index) else before
        with np.errstate(over="ignore"):
            keys = _mix(vocab[before] * _K + vocab[index])
        self.bigrams, self.bi = np.unique(keys, return_inverse=True)
        self.train = np.repeat(~held, lens)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        w = self.train.astype(np.float64)
        return tuple(np.bincount(i, w, len(k)).astype(np.int64) for i, k in ((self.uni, self.unigrams), (self.bi, self.bigrams)))


BLOCKS = "block long, ord int, part int, fold boolean, tokens long, data binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Encode slices of the documents as blocks; the set-aside fold has blocks of its own."""
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part in slices(batch, "text", BLOCK_BYTES):
            fold = part.column("fold").to_numpy(zero_copy_only=False)
            for which in (True, False):
                at = np.flatnonzero(fold == which)
                if not len(at):
                    continue
                rows = part.take(pa.array(at))
                vocab, index, lens = tokenize(rows.column("text"))
                ids = pc.fill_null(rows.column("doc_id"), _NO_ID).to_numpy(zero_copy_only=False)
                held = rows.column("held").to_numpy(zero_copy_only=False)
                data = put_arrays(ids, held, lens.astype(np.int32), vocab, index)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([0], pa.int32()), pa.array([0], pa.int32()), pa.array([which]), pa.array([len(index)], pa.int64()), pa.array([data], pa.binary())], names=[c.split()[0] for c in BLOCKS.split(", ")])
                block += 1


def _bounds(keys: np.ndarray, bits: int) -> np.ndarray:
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.empty(0, np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


DEALT = "part int, block long, ord int, fold boolean, keys binary, counts binary"


def _deal(bits: int) -> Callable:
    """A block's distinct n-grams and training counts, by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, fold, data in zip(*(batch.column(c).to_pylist() for c in ("block", "fold", "data")), strict=True):
                b = Block(*get_arrays(data))
                for order, keys, counts in zip((1, 2), (b.unigrams, b.bigrams), b.counts(), strict=True):
                    cut = _bounds(keys, bits)
                    parts = [p for p in range(1 << bits) if cut[p + 1] > cut[p]]
                    cols = [parts, [block] * len(parts), [order] * len(parts), [fold] * len(parts), [keys[cut[p] : cut[p + 1]].tobytes() for p in parts], [put_arrays(counts[cut[p] : cut[p + 1]]) for p in parts]]
                    types = [pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[c.split()[0] for c in DEALT.split(", ")])

    return run


TOTALS = "block long, ord int, part int, fold boolean, tokens long, kinds long, rest long, rest_kinds long, data binary"


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of each part's n-grams, for each block in the order of its own n-grams.

    The row with block -1 has the part's sums: tokens and distinct tokens of all training
    documents, and of those outside the fold.
    """
    names = [c.split()[0] for c in TOTALS.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    for group in runs_of_key(batches, "part"):
        part = group.column("part")[0].as_py()
        orders = group.column("ord").to_numpy()
        sums = [0, 0, 0, 0]
        for order in (1, 2):
            rows = group.filter(pa.array(orders == order)).to_pylist()
            if not rows:
                continue
            keys = [np.frombuffer(r["keys"], np.uint64) for r in rows]
            counts = [get_arrays(r["counts"])[0] for r in rows]
            distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
            size = np.array([len(k) for k in keys])
            n = np.concatenate(counts).astype(np.float64)
            folded = np.repeat([r["fold"] for r in rows], size)
            total = np.bincount(at, n, len(distinct)).astype(np.int64)
            rest = total - np.bincount(at, n * folded, len(distinct)).astype(np.int64)
            if order == 1:
                sums = [int(total.sum()), int((total > 0).sum()), int(rest.sum()), int((rest > 0).sum())]
            ends = np.cumsum(size)
            out = [(r["block"], order, part, r["fold"], None, None, None, None, put_arrays(total[at[e - s : e]], rest[at[e - s : e]] if r["fold"] else None)) for r, s, e in zip(rows, size, ends, strict=True)]
            for lo in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[lo : lo + 64], strict=True), types, strict=True)], names=names)
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((-1, 0, part, False, *sums, None), types, strict=True)], names=names)


def _with_totals(batches: Iterator[pa.RecordBatch], rest: bool) -> Iterator[tuple[Block, np.ndarray, np.ndarray]]:
    """Blocks with the totals of their unigrams and bigrams; rows come in order of block, ord and part."""
    for group in runs_of_key(batches, "block"):
        block = None
        found: dict[int, list[np.ndarray]] = {1: [], 2: []}
        for order, data in zip(group.column("ord").to_pylist(), group.column("data"), strict=True):
            if order == 0:
                block = Block(*get_arrays(data.as_py()))
            else:
                found[order].append(get_arrays(data.as_py())[1 if rest else 0])
        if block is not None and len(block.lens):
            yield block, np.concatenate(found[1]), np.concatenate(found[2])


def bucket_of(counts: np.ndarray) -> np.ndarray:
    """Context-frequency bucket: 0 for unseen, then one per power of two."""
    return np.minimum(np.floor(np.log2(counts + 1)).astype(np.int64), BUCKETS - 1)


def estimates(block: Block, uni: np.ndarray, bi: np.ndarray, tokens: int, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per token: bucket, and the uniform, unigram and bigram estimates."""
    context = uni[block.before].astype(np.float64)
    p0 = np.full(len(block.uni), 1 / (kinds + 1))
    p1 = uni[block.uni] / max(tokens, 1)
    p2 = np.divide(bi[block.bi], context, out=np.zeros(len(context)), where=context > 0)
    return bucket_of(context), p0, p1, np.minimum(p2, 1.0)


HISTOGRAM = "bucket int, q1 int, q2 int, n long, r1 double, r2 double"


def _histogram(tokens: int, kinds: int) -> Callable:
    """The fold's tokens by bucket and by their estimates' ratios to the uniform one, in eighths of
    an octave; with the sums of the ratios, so that cell means are exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, uni, bi in _with_totals(batches, True):
            b, p0, p1, p2 = estimates(block, uni, bi, tokens, kinds)
            r1, r2 = p1 / p0, p2 / p0
            q1, q2 = (np.where(r > 0, np.round(8 * np.log2(np.maximum(r, 1e-12))), -1000).astype(np.int64) for r in (r1, r2))
            cells, at = np.unique((b << 40) + ((q1 + 2000) << 20) + (q2 + 2000), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells >> 40, pa.int32()), pa.array(((cells >> 20) & 0xFFFFF) - 2000, pa.int32()), pa.array((cells & 0xFFFFF) - 2000, pa.int32()), pa.array(np.bincount(at), pa.int64()), pa.array(np.bincount(at, r1)), pa.array(np.bincount(at, r2))], names=[c.split()[0] for c in HISTOGRAM.split(", ")])

    return run


def mixture(cells: list[tuple[int, int, float, float]], rounds: int = 100) -> list[tuple[float, float, float]]:
    """Mixture weights per bucket by EM. ``cells``: (bucket, tokens, sum of r1, sum of r2).

    Every bucket begins with, and one pseudo-token pulls it towards, the weights of all seen contexts
    together; buckets without data keep those. The bucket of unseen contexts has no bigram part.
    """

    def em(rows: list[tuple[int, float, float]], start: np.ndarray) -> np.ndarray:
        w = start
        if not rows:
            return start
        n = np.array([r[0] for r in rows], np.float64)
        ratio = np.stack([np.ones(len(rows)), np.array([r[1] for r in rows]) / n, np.array([r[2] for r in rows]) / n], axis=1)
        for _ in range(rounds):
            part = ratio * w
            share = (part / part.sum(axis=1, keepdims=True) * n[:, None]).sum(axis=0) + start
            w = share / share.sum()
        floor = np.where(start > 0, np.maximum(w, 1e-6), 0)
        return floor / floor.sum()

    together = em([c[1:] for c in cells if c[0]], np.full(3, 1 / 3))
    unseen = np.array([together[0], together[1], 0.0]) / (together[0] + together[1])
    return [tuple(em([c[1:] for c in cells if c[0] == b], together if b else unseen)) for b in range(BUCKETS)]


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(tokens: int, kinds: int, weights: list[tuple[float, float, float]]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.array(weights)
        for block, uni, bi in _with_totals(batches, False):
            b, p0, p1, p2 = estimates(block, uni, bi, tokens, kinds)
            c = uni[block.uni]
            starts = np.cumsum(block.lens) - block.lens
            add = lambda x, s=starts: np.add.reduceat(x, s)
            score = add(np.log10(w[b, 0] * p0 + w[b, 1] * p1 + w[b, 2] * p2))
            base = add(np.log10((c + 1) / (tokens + (kinds + 1))))
            ids = pa.array(block.doc_ids, pa.int64(), mask=block.doc_ids == _NO_ID)
            yield pa.RecordBatch.from_arrays([ids, pa.array(block.held), pa.array(block.lens, pa.int64()), pa.array(add((c > 0).astype(np.int64)), pa.int64()), pa.array(np.full(len(ids), tokens), pa.int64()), pa.array(base), pa.array(score)], names=[c.split()[0] for c in SCORES.split(", ")])

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose crc32 of the id mod 7 is 2 are held out: scored, never learnt from.
    """
    crc = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8"))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    slim = slim.select("doc_id", "text", (crc % 7 == 2).alias("held"), ((crc % 7 != 2) & (F.floor(crc / 7) % FOLDS == 0)).alias("fold"))
    blocks = materialize(slim.mapInArrow(_blocks, BLOCKS), "lm_blocks")
    n, tasks = blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    tasks = max(4, -(-tasks // BLOCKS_PER_TASK))
    bits = max(3, math.ceil(math.log2(max(1, n / PART_NGRAMS))))
    dealt = blocks.select("block", "fold", "data").mapInArrow(_deal(bits), DEALT)
    totals = materialize(in_key_order(dealt, "part", _sum, TOTALS, then=["block", "ord"], parts=1 << bits), "lm_totals")
    s = totals.where("block = -1").agg(F.sum("tokens"), F.sum("kinds"), F.sum("rest"), F.sum("rest_kinds")).first()
    tokens, kinds, rest, rest_kinds = (x or 0 for x in s)
    both = blocks.select("block", "ord", "part", "fold", "data").unionByName(totals.where("block >= 0").select("block", "ord", "part", "fold", "data"))
    fold = in_key_order(both.where("fold").select("block", "ord", "part", "data"), "block", _histogram(rest, rest_kinds), HISTOGRAM, then=["ord", "part"], parts=max(4, tasks // FOLDS))
    cells = fold.groupBy("bucket", "q1", "q2").agg(F.sum("n").alias("n"), F.sum("r1").alias("r1"), F.sum("r2").alias("r2")).collect()
    weights = mixture([(c["bucket"], c["n"], c["r1"], c["r2"]) for c in cells])
    return in_key_order(both.select("block", "ord", "part", "data"), "block", _score(tokens, kinds, weights), SCORES, then=["ord", "part"], parts=tasks)
