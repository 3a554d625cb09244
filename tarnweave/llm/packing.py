"""Best-fit packing of token ids, online and in bounded space.

Every task packs its stream of pieces into at most ``OPEN_BINS`` open sequences. A bitset with
one bit per amount of free space finds the fullest open sequence that still has room; when no
sequence has room and all are open, the fullest closes. What is still open when a task's stream
ends is packed once more with the open sequences of other tasks, in tasks of ``REPACK`` pieces.

Documents are encoded whole, word by word: the tokenizer splits at white space and never joins
across it, so each distinct word of a batch is encoded once by ``tokenizers`` and its ids are
gathered. Only documents longer than a sequence are cut; the cuts lose nothing.

Null texts are empty: one piece with the end id alone. Repeated rows are packed each for itself.
An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, trimmed

SEQUENCE = 4096
END_ID = 1
OPEN_BINS = 256
REPACK = 200_000
#: Words that a worker keeps encoded between batches, and bytes of text encoded at a time.
CACHED_WORDS = 300_000
SLICE_BYTES = 12_000_000
#: Closing marks, and the end of a word that keeps them a token of their own: a Latin letter or digit
#: (not U+0130, whose lower case ends in a mark).
MARKS = ".,;:!?"
LETTER_END = r"[A-Za-z0-9\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]$"


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of texts under a tokenizer that never joins across white space."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.kept: dict[str, np.ndarray] = {}

    def _words(self, words: list[str]) -> list[np.ndarray]:
        out: list = [self.kept.get(w) for w in words]
        new = [i for i, x in enumerate(out) if x is None]
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([words[i] for i in part], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, np.uint32)
        for i in new[: max(0, CACHED_WORDS - len(self.kept))]:
            self.kept[words[i]] = out[i]
        return out

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids in a row, where each word's begin, how many) of distinct words.

        ASCII words are lower-cased first, as the tokenizer does. Closing marks after a Latin letter or
        a digit always are a token of their own, so words that differ only there share their stem.
        """
        low = pc.if_else(pc.string_is_ascii(words), pc.ascii_lower(words), words)
        bare = pc.ascii_rtrim(low, characters=MARKS)
        apart = pc.match_substring_regex(bare, LETTER_END)
        stems = pc.if_else(apart, bare, low).dictionary_encode()
        tails = pc.if_else(apart, pc.struct_field(pc.extract_regex(low, f"(?P<tail>[{MARKS}]*)$"), "tail"), "").dictionary_encode()
        parts = []
        for coded in (stems, tails):
            each = self._words(coded.dictionary.to_pylist())
            n = np.fromiter((len(x) for x in each), np.int64, len(each))
            at = coded.indices.to_numpy(zero_copy_only=False)
            parts.append((np.concatenate(each) if each else np.empty(0, np.uint32), np.cumsum(n) - n, n, at))
        size = sum(n[at] for _, _, n, at in parts) if len(words) else np.empty(0, np.int64)
        first = np.cumsum(size) - size
        flat = np.empty(int(size.sum()), np.uint32)
        shift = first
        for ids, begin, n, at in parts:
            count = n[at]
            within = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            flat[np.repeat(shift, count) + within] = ids[np.repeat(begin[at], count) + within]
            shift = shift + count
        return flat, first, size

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, each text followed by ``end_id``; and where each text starts."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = lists.flatten().dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        flat, first, size = self._distinct(coded.dictionary)
        per_word = size[index] if len(index) else np.empty(0, np.int64)
        done = np.concatenate(([0], np.cumsum(per_word)))
        offsets = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        starts = done[offsets] + np.arange(len(offsets))
        out = np.empty(starts[-1], np.uint32)
        is_end = np.zeros(len(out), bool)
        is_end[starts[1:] - 1] = True
        out[is_end] = end_id
        if len(index):
            out[~is_end] = flat[np.repeat(first[index] - done[:-1], per_word) + np.arange(done[-1])]
        return out, starts


class BestFit:
    """Bounded-space best fit: open bins by free space, in a bitset."""

    def __init__(self, capacity: int, open_bins: int, first_id: int) -> None:
        self.capacity, self.most, self.next_id = capacity, open_bins, first_id
        self.bits = 0
        self.by_room: dict[int, list[int]] = {}
        self.bins: dict[int, tuple[int, list]] = {}

    def _take(self, room: int) -> int:
        stack = self.by_room[room]
        bin_id = stack.pop()
        if not stack:
            del self.by_room[room]
            self.bits &= ~(1 << room)
        return bin_id

    def add(self, size: int, item) -> Iterator[tuple[int, list]]:
        """Place an item; yields the bins that close: (id, [(offset, item)])."""
        fits = self.bits >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            bin_id = self._take(room)
        else:
            if len(self.bins) >= self.most:
                tightest = (self.bits & -self.bits).bit_length() - 1
                closed = self._take(tightest)
                yield closed, self.bins.pop(closed)[1]
            bin_id, room = self.next_id, self.capacity
            self.next_id += 1
            self.bins[bin_id] = (0, [])
        used, items = self.bins[bin_id]
        items.append((used, item))
        room -= size
        if room:
            self.bins[bin_id] = (used + size, items)
            self.by_room.setdefault(room, []).append(bin_id)
            self.bits |= 1 << room
        else:
            del self.bins[bin_id]
            yield bin_id, items

    def rest(self) -> Iterator[tuple[int, list]]:
        yield from ((b, items) for b, (_, items) in self.bins.items())


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``most`` bytes of text, or one row."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, upto - at)
        at = upto


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, closed boolean"


def _emit(rows: list[tuple], ids: list[bytes] | None, names: list[str], id_type: pa.DataType) -> pa.RecordBatch:
    types = [id_type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 8, types, strict=True)]
    if ids is not None:
        cols.append(pa.array(ids, pa.binary()))
    return pa.RecordBatch.from_arrays(cols, names=names)


def _first_pass(path: str, capacity: int, end_id: int, open_bins: int, with_ids: bool, names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        fit = BestFit(capacity, open_bins, TaskContext.get().partitionId() << 36)
        id_type: pa.DataType = pa.int64()
        rows: list[tuple] = []
        ids: list[bytes] | None = [] if with_ids else None

        def keep(bins: Iterator[tuple[int, list]], closed: bool) -> None:
            for bin_id, items in bins:
                for offset, (head, raw) in items:
                    rows.append((*head, bin_id, offset, closed))
                    if ids is not None:
                        ids.append(raw)

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for part in slices(batch, "text"):
                flat, starts = code.encode(part.column("text"), end_id)
                flat = flat.astype("<u4")
                for i, doc in enumerate(part.column("doc_id").to_pylist()):
                    lo, hi = int(starts[i]), int(starts[i + 1])
                    for k, at in enumerate(range(lo, hi, capacity)):
                        raw = flat[at : min(hi, at + capacity)].tobytes()
                        size = len(raw) // 4
                        keep(fit.add(size, ((doc, k, at - lo, size, zlib.crc32(raw)), raw if with_ids else None)), True)
                if len(rows) > 5_000:
                    yield _emit(rows, ids, names, id_type)
                    rows, ids = [], [] if with_ids else None
        keep(fit.rest(), False)
        if rows:
            yield _emit(rows, ids, names, id_type)

    return run


def _repack(capacity: int, open_bins: int, names: list[str], with_ids: bool, base: int) -> Callable:
    """Pack the pieces of open sequences again; every sequence that is left closes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = BestFit(capacity, open_bins, base + (TaskContext.get().partitionId() << 36))
        for batch in batches:
            rows, ids = [], [] if with_ids else None
            id_type = batch.schema.field("doc_id").type
            cols = [batch.column(c).to_pylist() for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            raws = batch.column("ids").to_pylist() if with_ids else [None] * batch.num_rows
            closing = [bins for *head, raw in zip(*cols, raws, strict=True) for bins in fit.add(head[3], (tuple(head), raw))]
            for bin_id, items in closing:
                for offset, (head, raw) in items:
                    rows.append((*head, bin_id, offset, True))
                    if ids is not None:
                        ids.append(raw)
            yield _emit(rows, ids, names, id_type)
        rows, ids = [], [] if with_ids else None
        for bin_id, items in fit.rest():
            for offset, (head, raw) in items:
                rows.append((*head, bin_id, offset, True))
                if ids is not None:
                    ids.append(raw)
        if rows:
            yield _emit(rows, ids, names, id_type)

    return run


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = SEQUENCE, end_id: int = END_ID, open_bins: int = OPEN_BINS, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ``ids``).

    ``ids`` are little-endian unsigned 32-bit ids. ``path`` is the tokenizer's file on the executors.
    """
    path = path or vocabulary_path()
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = PIECE + (", ids binary" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]
    placed = materialize(slim.mapInArrow(trimmed(_first_pass(path, capacity, end_id, open_bins, with_ids, names)), schema), "pieces")
    loose = placed.where("not closed")
    n = loose.count()
    parts = max(1, -(-n // REPACK))
    again = loose.repartition(parts, F.xxhash64("doc_id", "piece")).sortWithinPartitions(F.desc("length"), "doc_id", "piece") if parts > 1 else loose.repartition(1).sortWithinPartitions(F.desc("length"), "doc_id", "piece")
    again = again.mapInArrow(_repack(capacity, max(open_bins, 4096), names, with_ids, 1 << 62), schema)
    return placed.where("closed").unionByName(again).drop("closed")
