"""Removal of repeated byte strings by a hash-compared suffix sort.

A byte goes if a string of ``width`` bytes that covers it also starts earlier: in a document of
smaller id, or earlier in the same document. Strings never cross documents and are judged on the
input.

Every window of ``width`` bytes has an anchor, its least ``gram``-byte substring by hash, so equal
windows have equal anchors at equal places, and the windows of a text fall into runs that share
an anchor (about 30 windows each). Runs are dealt out by hash, once per block of documents:

1. A run whose hash (modulo two primes), length and anchor occur earlier is repeated whole. Every block
   then sends the bytes of such a run once, and they are compared with those of its first occurrence.
2. Among first occurrences, those whose anchor also stands in a different run may be repeated in
   part. Their bytes meet by anchor: the windows' suffixes are sorted by a mergesort whose
   comparisons find the common extension by binary search over prefix polynomial hashes. Equal
   neighbours are confirmed byte by byte; all but the earliest of them are repeated.
   Anchors with very many different runs are split: their windows meet by their own hash, once per
   block, first among a part of the blocks, then the earliest of each part.

Where a comparison of bytes contradicts a hash, nothing of that attempt is used: all is done anew
with another base. So no byte goes, and none stays, because of a hash.

Blocks hold a bounded number of bytes, parts a bounded number of runs on average, and each block
sends a run once; so a text or passage that fills a third of the table costs no more than others. A run
that is in very many blocks is compared in several parts, each with a copy of the first occurrence;
its 24 bytes of hash and place do meet in one part, once per block. Messages between blocks and parts
get smaller as both grow in number; there are never more than runs.

Null texts are empty. Rows of equal id and text stand at the same place and don't repeat each
other; null ids come first. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import get_arrays, in_key_order, materialize, put_arrays, runs_of_key
from .lm_scoring import _bounds
from .packing import slices
from .suffix_hash import PrefixHash, base_of, equal_spans, equal_windows, mix, runs, suffix_sort

WIDTH = 100
GRAM = 32
BLOCK_BYTES = 4_000_000
PART_RUNS = 250_000
BLOCKS_PER_TASK = 4
#: Different runs of one anchor from which its windows are dealt out one by one.
HOT = 2_000
#: Bytes of one row of runs or windows.
CELL_BYTES = 400_000
#: Blocks that share a run per part that compares it; parts of all blocks, for windows of hot anchors.
SHARE = 256
SALTS = 64
ATTEMPTS = 8
#: Bytes that are sorted at a time within a part.
SORT_BYTES = 1_000_000
_NO_ID = -(1 << 63)

ROWS = "block long, kind int, part int, bytes long, data binary"
_NAMES = [c.split()[0] for c in ROWS.split(", ")]
_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
#: Kinds of rows: a block's texts; codes of its runs and anchors; whole runs; windows dealt out; windows
#: found; bytes of whole runs; windows of hot anchors; a hash that was contradicted.
TEXT, RUNS, ANCHORS, WHOLE, DEALT, FOUND, BYTES, HOT_ONES, CLASH = range(9)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, _TYPES, strict=True)], names=_NAMES)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part in slices(batch, "text", BLOCK_BYTES):
            text = pc.fill_null(part.column("text").cast(pa.large_binary()), b"")
            lens = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = pc.fill_null(part.column("doc_id"), _NO_ID).to_numpy(zero_copy_only=False)
            yield _batch([(block, TEXT, 0, int(lens.sum()), put_arrays(ids, lens, b"".join(text.to_pylist()), level=6))])
            block += 1


class Block:
    """A block's bytes, documents and runs of windows."""

    def __init__(self, raw: bytes, width: int, gram: int, with_runs: bool = True, seed: int = 0) -> None:
        self.ids, self.lens, text = get_arrays(raw)
        self.data = np.frombuffer(text, np.uint8)
        self.ends = np.cumsum(self.lens)
        if not with_runs:
            return
        self.first, self.last, self.anchor, self.run, self.place = runs(self.data, self.ends, width, gram, seed)
        doc = np.searchsorted(self.ends, self.first, "right")
        self.doc_id, self.start = self.ids[doc], self.first - (self.ends[doc] - self.lens[doc])
        # distinct runs in order of their hash, with their earliest place; then distinct anchors
        order = np.lexsort((self.start, self.doc_id, self.run))
        ordered = self.run[order]
        new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(order) else np.empty(0, bool)
        self.run_keys, head = ordered[new], order[new]
        self.run_of = np.empty(len(order), np.int64)
        self.run_of[order] = np.cumsum(new) - 1
        self.head = head
        self.run_id, self.run_start = self.doc_id[head], self.start[head]
        self.anchor_keys, self.anchor_of = np.unique(self.anchor[head], return_inverse=True)
        self.anchor_at = np.empty(len(order), np.int64)
        self.anchor_at[:] = self.anchor_of[self.run_of] if len(order) else 0

    def later(self) -> np.ndarray:
        """Occurrences after the block's first one of the same run."""
        i = self.run_of
        return (self.doc_id > self.run_id[i]) | ((self.doc_id == self.run_id[i]) & (self.start > self.run_start[i]))

    def clash(self, width: int) -> bool:
        """Whether two runs of this block have one hash but different bytes."""
        again = np.flatnonzero(self.head[self.run_of] != np.arange(len(self.run)))
        first = self.head[self.run_of[again]]
        size = self.last[again] - self.first[again]
        return bool((size != self.last[first] - self.first[first]).any()) or not equal_spans(self.data, self.first[again], self.first[first], size + width).all()

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per anchor: least and greatest of its runs, and how many different runs."""
        order = np.argsort(self.anchor_of, kind="stable")
        at = np.flatnonzero(np.concatenate(([True], np.diff(self.anchor_of[order]) != 0))) if len(order) else np.empty(0, np.int64)
        bits = self.run_keys[order]
        if not len(order):
            return bits, bits, np.empty(0, np.int64)
        return np.minimum.reduceat(bits, at), np.maximum.reduceat(bits, at), np.diff(np.append(at, len(order)))


def _deal(bits: int, width: int, gram: int, seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("data"), strict=True):
                b = Block(raw.as_py(), width, gram, seed=seed)
                low, high, count = b.anchors()
                rows = []
                for kind, keys, more in ((RUNS, b.run_keys, (b.run_id, b.run_start)), (ANCHORS, b.anchor_keys, (low, high ^ low, count))):
                    cut = _bounds(keys, bits)
                    if kind == ANCHORS:  # 32 more bits tell anchors apart within a part; a mix-up only costs a sort
                        keys = (keys >> np.uint64(8)).astype(np.uint32)
                    rows += [(block, kind, p, 0, put_arrays(*(x[cut[p] : cut[p + 1]] for x in (keys, *more)))) for p in range(1 << bits) if cut[p + 1] > cut[p]]
                yield _batch(rows)

    return run


def _codes(hot: int) -> Callable:
    """For each block's runs: 0 if no other block has it, else 1 if an earlier place has it, 2 if not; plus 4
    for every doubling of the blocks beyond ``SHARE``. For its anchors: 1 if they stand in different
    runs, 2 if in very many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs_of_key(batches, "part"):
            kinds = group.column("kind").to_numpy()
            for kind in (RUNS, ANCHORS):
                rows = group.filter(pa.array(kinds == kind))
                if not rows.num_rows:
                    continue
                got = [get_arrays(x.as_py()) for x in rows.column("data")]
                size = [len(g[0]) for g in got]
                keys, *more = (np.concatenate([g[i] for g in got]) for i in range(len(got[0])))
                if kind == RUNS:
                    order = np.lexsort((more[1], more[0], keys))
                    new = np.concatenate(([True], keys[order][1:] != keys[order][:-1]))
                    n = np.diff(np.append(np.flatnonzero(new), len(order)))
                    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
                    later = (more[0][order] > more[0][head]) | ((more[0][order] == more[0][head]) & (more[1][order] > more[1][head]))
                    code = np.empty(len(keys), np.uint8)
                    code[order] = np.where(np.repeat(n, n) > 1, np.where(later, 1, 2) + 4 * np.repeat(_doublings(n), n), 0)
                else:
                    distinct, at = np.unique(keys, return_inverse=True)
                    low = np.full(len(distinct), ~np.uint64(0))
                    high = np.zeros(len(distinct), np.uint64)
                    np.minimum.at(low, at, more[0])
                    np.maximum.at(high, at, more[0] ^ more[1])
                    many = np.bincount(at, more[2]) >= hot
                    code = ((low != high).astype(np.uint8) * (1 + many))[at].astype(np.uint8)
                ends = np.cumsum(size)
                yield _batch([(block, kind, part, 0, put_arrays(code[e - s : e])) for block, part, s, e in zip(rows.column("block").to_pylist(), rows.column("part").to_pylist(), size, ends, strict=True)])

    return run


def _doublings(n: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(np.maximum(n / SHARE, 1))).astype(np.int64)


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, dict[int, list[tuple]]]]:
    """(block, its texts, the other rows' arrays by kind, in order of part)."""
    for group in runs_of_key(batches, "block"):
        raw, rows = None, {k: [] for k in range(9)}
        for kind, data in zip(group.column("kind").to_pylist(), group.column("data"), strict=True):
            if kind == TEXT:
                raw = data.as_py()
            else:
                rows[kind].append(get_arrays(data.as_py()))
        if raw is not None:
            yield group.column("block")[0].as_py(), raw, rows


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes 0..len-1 each repeated ``count`` times, and the place within each."""
    which = np.repeat(np.arange(len(first)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)


def _apply(bits: int, width: int, gram: int, seed: int) -> Callable:
    """Whole runs that are repeated and their bytes, and the bytes of those that may be repeated in part."""

    def cells(block: int, kind: int, keys: np.ndarray, data: np.ndarray, first: np.ndarray, windows: np.ndarray, *more: np.ndarray) -> Iterator[tuple]:
        """Rows of a part, of bounded size: keys, first, windows, more, bytes."""
        order = np.argsort(keys, kind="stable")
        cut = _bounds(keys[order], bits)
        for p in range(1 << bits):
            mine = order[cut[p] : cut[p + 1]]
            size = np.cumsum(windows[mine] + width - 1)
            lo = 0
            while lo < len(mine):
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + CELL_BYTES, "right")))
                at = mine[lo:hi]
                w, k = _spread(at, windows[at] + width - 1)
                yield block, kind, p, 0, put_arrays(keys[at], first[at], windows[at], *(x[at] for x in more), data[first[at][w] + k].tobytes(), level=3)
                lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, raw, rows in _assemble(batches):
            b = Block(raw, width, gram, seed=seed)
            if not len(b.run):
                continue
            code = np.concatenate([r[0] for r in rows[RUNS]])
            shared = np.concatenate([r[0] for r in rows[ANCHORS]])[b.anchor_at]
            whole = ((code & 3) == 1)[b.run_of] | b.later()
            out = [(block, WHOLE, 0, 0, put_arrays(b.first[whole].astype(np.int32), (b.last[whole] + width).astype(np.int32)))]
            if b.clash(width):
                out.append((block, CLASH, 0, 0, b""))
            # bytes of runs that other blocks have: to one of the parts that compare them, the first occurrence to all
            at = np.flatnonzero(code)
            with np.errstate(over="ignore"):
                salts = np.int64(1) << (code[at] >> 2).astype(np.int64)
                leads = (code[at] & 3) == 2
                i, salt = _spread(at, np.where(leads, salts, 1))
                salt = np.where(leads[i], salt, block % salts[i])
                which = at[i]
                keys = mix(b.run_keys[which] + salt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            head = b.head[which]
            out += cells(block, BYTES, keys, b.data, b.first[head], b.last[head] - b.first[head] + 1, code[which] & 3)
            part = np.flatnonzero(~whole & (shared == 1))
            # windows are matched by their distance from the anchor; single ones have none
            out += cells(block, DEALT, b.anchor[part], b.data, b.first[part], b.last[part] - b.first[part] + 1, b.doc_id[part], b.start[part], b.place[part])
            hot = np.flatnonzero(~whole & (shared == 2))
            if len(hot):
                which, j = _spread(hot, b.last[hot] - b.first[hot] + 1)
                single, ids, start = b.first[hot][which] + j, b.doc_id[hot][which], b.start[hot][which] + j
                own = mix(_window_hash(b.data, single, width, seed))
                order = np.lexsort((start, ids, own))
                single, ids, start, own = single[order], ids[order], start[order], own[order]
                new = np.concatenate(([True], own[1:] != own[:-1]))
                head = np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))
                if not equal_windows(b.data, single[~new], single[head[~new]], width).all():
                    out.append((block, CLASH, 0, 0, b""))
                later = (ids > ids[head]) | ((ids == ids[head]) & (start > start[head]))
                out.append((block, FOUND, 0, 0, put_arrays(np.sort(single[later]).astype(np.int32))))
                # the block's first one of each, with those that stand at the same place
                back = np.flatnonzero(~later)
                with np.errstate(over="ignore"):
                    keys = mix(own[back] + np.uint64(block % SALTS) * np.uint64(0x9E3779B97F4A7C15))
                out += cells(block, HOT_ONES, keys, b.data, single[back], np.ones(len(back), np.int64), ids[back], start[back], np.zeros(len(back), np.int64))
            for lo in range(0, len(out), 64):
                yield _batch(out[lo : lo + 64])

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of kind CLASH where bytes of whole runs differ from those of the first occurrence."""
    for group in runs_of_key(batches, "part"):
        got = [get_arrays(x.as_py()) for x in group.column("data")]
        keys, windows, code = (np.concatenate([g[i] for g in got]) for i in (0, 2, 3))
        data = np.frombuffer(b"".join(g[4] for g in got), np.uint8)
        del got
        spare = (len(data) - windows.sum()) // max(1, len(windows))
        length = windows + spare
        span = np.cumsum(length) - length
        order = np.lexsort((code != 2, keys))
        head = order[np.maximum.accumulate(np.where(np.concatenate(([True], keys[order][1:] != keys[order][:-1])), np.arange(len(order)), 0))]
        if (length[order] != length[head]).any() or (code[head] != 2).any() or not equal_spans(data, span[order], span[head], length[order]).all():
            yield _batch([(0, CLASH, 0, 0, b"")])


def _window_hash(data: np.ndarray, at: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of the windows at ``at``, without powers longer than a window."""
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * np.uint64(base_of(seed)) + data[at + k] + np.uint64(1)
    return out


def _sort_windows(keys, windows, ids, start, place, spans, data, width, seed) -> tuple[np.ndarray, bool]:
    """Marks the windows that have an earlier equal: flags in order of items and windows, and whether a hash was contradicted."""
    which, j = _spread(windows, windows)
    with np.errstate(over="ignore"):
        group = mix(keys[which] + (place[which] - j).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    suffix = spans[which] + j
    order = np.argsort(group)
    again = group[order][1:] == group[order][:-1]
    order = order[np.concatenate((again, [False])) | np.concatenate(([False], again))]
    order = order[np.lexsort(((start[which] + j)[order], ids[which[order]], group[order]))]
    flags = np.zeros(len(which), bool)
    if not len(order):
        return flags, False
    ph = PrefixHash(data, base_of(seed))
    order = order[suffix_sort(data, ph, suffix[order], group[order], width)]
    a, b = suffix[order[:-1]], suffix[order[1:]]
    same = (group[order[:-1]] == group[order[1:]]) & (ph.of(a, a + width) == ph.of(b, b + width))
    confirmed = equal_windows(data, a[same], b[same], width)
    if not confirmed.all():
        return flags, True
    # the sort keeps the order of places, so the head of each class of equal windows is its earliest
    head = np.maximum.accumulate(np.where(np.concatenate(([True], ~same)), np.arange(len(order)), 0))
    x, y = order, order[head]
    place_x, place_y = (start[which] + j)[x], (start[which] + j)[y]
    flags[x] = (ids[which[x]] > ids[which[y]]) | ((ids[which[x]] == ids[which[y]]) & (place_x > place_y))
    return flags, False


def _sorted_parts(width: int, seed: int, bits: int | None = None) -> Callable:
    """Suffix sort of each part's windows; returns every block the windows that are repeated.

    With ``bits``, for single windows: those that aren't are dealt out once more, by their bytes alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs_of_key(batches, "part"):
            got = [get_arrays(x.as_py()) for x in group.column("data")]
            block = np.concatenate([g[7] if len(g) > 7 else np.full(len(g[0]), b, np.int64) for g, b in zip(got, group.column("block").to_pylist(), strict=True)])
            keys, first, windows, ids, start, place = (np.concatenate([g[i] for g in got]) for i in range(6))
            data = np.frombuffer(b"".join(g[6] for g in got), np.uint8)
            del got
            length = windows + width - 1
            span = np.cumsum(length) - length
            order = np.argsort(keys, kind="stable")
            # sub-batches of whole keys
            total = np.cumsum(length[order])
            new = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1])))
            found_block, found_at = [], []
            clash = False
            first_ones = np.zeros(len(keys), bool)
            lo = 0
            while lo < len(order):
                hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + SORT_BYTES, "right"))
                k = int(np.searchsorted(new, max(hi, lo + 1), "left"))
                hi = len(order) if k >= len(new) else int(new[k])
                at = order[lo:hi]
                w, k = _spread(at, length[at])
                local = data[span[at][w] + k]
                flags, mixed = _sort_windows(keys[at], windows[at], ids[at], start[at], place[at], np.cumsum(length[at]) - length[at], local, width, seed)
                clash |= mixed
                if bits is not None:
                    first_ones[at] = ~flags
                which, j = _spread(at, windows[at])
                found_block.append(block[at][which[flags]])
                found_at.append(first[at][which[flags]] + j[flags])
                lo = hi
            blocks, ats = np.concatenate(found_block), np.concatenate(found_at)
            order = np.argsort(blocks, kind="stable")
            blocks, ats = blocks[order], ats[order]
            heads = np.flatnonzero(np.concatenate(([True], blocks[1:] != blocks[:-1]))) if len(blocks) else []
            part = group.column("part")[0].as_py()
            rows = [(int(blocks[h]), FOUND, part, 0, put_arrays(np.sort(ats[h:t]).astype(np.int32))) for h, t in zip(heads, np.append(heads[1:], len(blocks)), strict=True)] if len(blocks) else []
            if clash:
                rows.append((0, CLASH, 0, 0, b""))
            if bits is not None:
                at = np.flatnonzero(first_ones)
                own = mix(_window_hash(data, span[at], width, seed))
                order = np.argsort(own, kind="stable")
                cut = _bounds(own[order], bits)
                for p in range(1 << bits):
                    x = at[order[cut[p] : cut[p + 1]]]
                    if len(x):
                        w, k = _spread(x, length[x])
                        rows.append((part, DEALT, p, 0, put_arrays(own[order[cut[p] : cut[p + 1]]], first[x], windows[x], ids[x], start[x], place[x], data[span[x][w] + k].tobytes(), block[x])))
            for lo in range(0, len(rows), 64):
                yield _batch(rows[lo : lo + 64])

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"


def _finish(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for _, raw, rows in _assemble(batches):
            b = Block(raw, width, 0, with_runs=False)
            change = np.zeros(len(b.data) + 1, np.int32)
            for a, e in rows[WHOLE]:
                np.add.at(change, a, 1)
                np.add.at(change, e, -1)
            for (a,) in rows[FOUND]:
                np.add.at(change, a, 1)
                np.add.at(change, a + width, -1)
            gone = np.cumsum(change[:-1]) > 0
            starts = b.ends - b.lens
            edge = np.diff(np.concatenate(([False], gone)).astype(np.int8)) != 0
            edge[starts[b.lens > 0]] = gone[starts[b.lens > 0]]
            edge &= gone
            heads = np.flatnonzero(edge)
            stop = np.flatnonzero(gone & ~np.concatenate((gone[1:] & ~_at(starts[b.lens > 0], len(gone))[1:], [False]))) + 1 if len(gone) else heads
            doc = np.searchsorted(b.ends, heads, "right")
            per_doc = np.bincount(doc, minlength=len(b.lens)) if len(heads) else np.zeros(len(b.lens), np.int64)
            offsets = np.concatenate(([0], np.cumsum(per_doc)))
            removed = np.concatenate(([0], np.cumsum(gone)))
            values = pa.StructArray.from_arrays([pa.array(heads - starts[doc], pa.int64()), pa.array(stop - starts[doc], pa.int64())], names=["start", "end"])
            spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values).cast(span_type)
            kept = b.data[~gone]
            upto = b.ends - removed[b.ends]
            since = starts - removed[starts]
            texts = [kept[s:e].tobytes() for s, e in zip(since, upto, strict=True)]
            ids = pa.array(b.ids, pa.int64(), mask=b.ids == _NO_ID)
            out = pa.RecordBatch.from_arrays([ids, pa.array(b.lens, pa.int64()), pa.array(removed[b.ends] - removed[starts], pa.int64()), spans, pa.array(texts, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])
            for lo in range(0, out.num_rows, 1000):
                yield out.slice(lo, 1000)

    return run


def _at(places: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    out[places] = True
    return out


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, spans (removed runs, in bytes), kept (bytes)."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = materialize(slim.mapInArrow(_blocks, ROWS), "repeat_blocks")
    n, tasks = blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    bits = max(2, math.ceil(math.log2(max(1, n / (width - gram) * 2 / PART_RUNS))))
    tasks = max(4, -(-tasks // BLOCKS_PER_TASK))
    for seed in range(ATTEMPTS):
        dealt = blocks.select("block", "data").mapInArrow(_deal(bits, width, gram, seed), ROWS)
        codes = in_key_order(dealt, "part", _codes(hot), ROWS, then=["kind", "block"], parts=1 << bits)
        applied = materialize(in_key_order(blocks.unionByName(codes), "block", _apply(bits, width, gram, seed), ROWS, then=["kind", "part"], parts=tasks), "repeat_runs")
        kind = lambda k, rows=applied: rows.where(F.col("kind") == k)
        compared = in_key_order(kind(BYTES), "part", _compare, ROWS, parts=1 << bits)
        once = in_key_order(kind(HOT_ONES), "part", _sorted_parts(width, seed, bits), ROWS, then=["block"], parts=1 << bits)
        once = materialize(once.unionByName(compared), "repeat_compared")
        meet = kind(DEALT).unionByName(kind(DEALT, once))
        found = materialize(in_key_order(meet, "part", _sorted_parts(width, seed), ROWS, then=["block"], parts=1 << bits), "repeat_found")
        marks = applied.where(F.col("kind").isin(WHOLE, FOUND, CLASH)).unionByName(once.where(F.col("kind").isin(FOUND, CLASH))).unionByName(found)
        if not kind(CLASH, marks).limit(1).count():
            break
    else:
        raise RuntimeError(f"{ATTEMPTS} attempts met strings that differ but have one hash")
    return in_key_order(blocks.unionByName(marks), "block", _finish(width), RESULT, then=["kind", "part"], parts=tasks)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``remove_repeats``."""
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
