"""Packed token-id output: best-fit-decreasing packing with a segment tree over capacities.

Every task encodes its documents, each followed by the end-of-text id, cuts those longer than a
row losslessly, and packs groups of at most ``GROUP_TOKENS`` ids: pieces in decreasing length,
each into the row whose free space is the smallest that suffices. A segment tree over the free
spaces 0..``row`` finds that space in a logarithmic descent.

A result row is one row of the id matrix: ``ids`` (fixed width, little-endian, unsigned 16-bit
where the vocabulary allows, else 32-bit; padded with the end id), ``n_tokens``, and per segment
``cu_seqlens`` (cumulative lengths from 0), ``position_resets`` (where position ids return to
0), ``doc_ids`` and ``starts`` (ids of the document before the segment).

Null texts are empty: the end id alone. Repeated rows are packed each for itself. An empty table
gives an empty result. A task holds one group, so memory doesn't follow the table.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import slices

ROW = 4096
GROUP_TOKENS = 4_000_000
LONG_TEXT = 200_000
_SPACE_RUN = re.compile(r"\s{2000}")
SCHEMA = "sequence_id long, n_tokens int, n_segments int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, starts array<long>"


def byte_vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteEncoder:
    """A byte-level encoding from a rank file; ids decode to the exact text."""

    def __init__(self, path: str) -> None:
        import base64

        import public_tokenizers
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.end_id = max(ranks.values()) + 1
        self.encoding = tiktoken.Encoding("packed", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        """Ids of the text and the end id. Long texts are encoded in parts that begin at ``a b``
        boundaries between ASCII letters, where the pattern always splits."""
        parts = []
        at = 0
        while len(text) - at > LONG_TEXT:
            cut = at + LONG_TEXT
            while cut + 1 < len(text) and not (text[cut] == " " and _letter(text[cut - 1]) and _letter(text[cut + 1])):
                cut += 1
            if cut + 1 >= len(text):
                break
            parts.append(self._part(text[at:cut]))
            at = cut
        parts.append(self._part(text[at:]))
        return np.concatenate([np.array(p, np.uint32) for p in parts] + [np.array([self.end_id], np.uint32)])

    def _part(self, text: str) -> list[int]:
        """``encode_ordinary``, whose matcher overflows its stack on long runs of white space."""
        if not _SPACE_RUN.search(text):
            return self.encoding.encode_ordinary(text)
        return [i for piece in self.pattern.findall(text) for i in self.encoding._encode_single_piece(piece)]


def _letter(c: str) -> bool:
    return c.isascii() and c.isalpha()


class CapacityTree:
    """Segment tree over free spaces: how many rows have each; finds the smallest that suffices."""

    def __init__(self, most: int) -> None:
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, space: int, row: int) -> None:
        self.rows[space].append(row)
        self._add(space, 1)

    def _add(self, space: int, by: int) -> None:
        at = self.leaves + space
        while at:
            self.count[at] += by
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(space, row) of a row with the smallest space of at least ``need``; the row leaves the tree."""
        at = self.leaves + need
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        space = at - self.leaves
        self._add(space, -1)
        return space, self.rows[space].pop()


def best_fit_decreasing(sizes: list[int], row: int) -> list[list[int]]:
    """Indexes of the pieces of each row, in order of placement."""
    tree = CapacityTree(row)
    rows: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        got = tree.take(sizes[i])
        if got is None:
            rows.append([])
            got = (row, len(rows) - 1)
        space, at = got
        rows[at].append(i)
        if space > sizes[i]:
            tree.put(space - sizes[i], at)
    return rows


_encoders: dict[str, ByteEncoder] = {}


def _run(path: str, row: int, group: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = ByteEncoder(path)
        code = _encoders[path]
        width = "<u2" if code.end_id < 1 << 16 else "<u4"
        next_id = TaskContext.get().partitionId() << 36
        pieces: list[tuple[int | None, int, np.ndarray]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal next_id
            packed = best_fit_decreasing([len(p[2]) for p in pieces], row)
            for at in range(0, len(packed), 500):
                out = []
                for members in packed[at : at + 500]:
                    ids = np.full(row, code.end_id, width)
                    cu = np.concatenate(([0], np.cumsum([len(pieces[i][2]) for i in members]))).astype(np.int32)
                    for i, lo, hi in zip(members, cu[:-1], cu[1:], strict=True):
                        ids[lo:hi] = pieces[i][2]
                    out.append((next_id, int(cu[-1]), len(members), ids.tobytes(), cu.tolist(), cu[:-1].tolist(), [pieces[i][0] for i in members], [pieces[i][1] for i in members]))
                    next_id += 1
                types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            for part in slices(batch, "text"):
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text"), strict=True):
                    ids = code.encode(text.as_py() or "")
                    for at in range(0, len(ids), row):
                        pieces.append((doc, at, ids[at : at + row]))
                        held += len(pieces[-1][2])
                    if held >= group:
                        yield from flush()
                        pieces, held = [], 0
        if pieces:
            yield from flush()

    return run


def packed_rows(docs: DataFrame, path: str | None = None, row: int = ROW, group: int = GROUP_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed id matrix of all documents, a row per sequence (see the module's text)."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(_run(path or byte_vocabulary_path(), row, group), SCHEMA)


def write_packed(rows: DataFrame, path: str) -> None:
    """Write the matrix as uncompressed Parquet binaries, in order of the sequences within a file."""
    rows.sortWithinPartitions("sequence_id").write.option("compression", "none").parquet(path)


def matrix(rows: list, row: int = ROW) -> np.ndarray:
    """The id matrix of collected result rows."""
    width = "<u2" if not rows or len(rows[0]["ids"]) == 2 * row else "<u4"
    return np.stack([np.frombuffer(r["ids"], width) for r in rows]) if rows else np.empty((0, row), width)


def position_ids(cu_seqlens: list[int], row: int = ROW) -> np.ndarray:
    """Position ids of one row: they restart at every segment, and run on through the padding."""
    starts = np.zeros(row, np.int64)
    for a, b in zip(cu_seqlens, [*cu_seqlens[1:], row], strict=True):
        starts[a:b] = a
    return np.arange(row) - starts
