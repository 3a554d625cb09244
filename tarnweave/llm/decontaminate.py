"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Texts and benchmark items become words (A-Z lower-cased; runs of digits, letters and non-ASCII
characters). The test strings are all windows of ``WINDOW`` consecutive words of the items; an
item of fewer words is one window. Test strings of one length are searched together: a shift
table over blocks of two words skips places where no test string can end, the block at a
possible end selects a bucket of test strings, and direct comparison confirms.

The test strings are sent to every executor in blocks of at most ``PASS_WORDS`` words (an item larger than
that has a block of its own), and a worker holds the tables of one block at a time. Documents are
read and split into words once: up to ``CHUNK_BYTES`` of their text, or one text, are held while all
blocks are searched in turn. There is no shuffle, and one block of items costs one look at its tables.

Texts of any length are read whole. Extra columns stay as they are, whatever their names. Ties cannot
matter: all occurrences count. Null texts have no words; items without words and null items match nothing. Items with a null id
mark words but aren't listed. Repeated rows are judged alike; repeated items count once. Without
items no document is hit. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed
from .packing import slices

WINDOW = 13
PASS_WORDS = 400_000
CHUNK_BYTES = 16_000_000
SLICE_BYTES = 2_000_000
#: Maps bytes: A-Z to a-z, other ASCII that isn't a letter or digit to a space.
_TABLE = bytes((c + 32) if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class Searcher:
    """Wu-Manber tables for test strings of one length."""

    def __init__(self, length: int, strings: dict[tuple[bytes, ...], list]) -> None:
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list]] = {}
        for s, ids in strings.items():
            for end in range(self.block, length + 1):
                block = s[end - self.block : end]
                if length - end < self.shift.get(block, self.far):
                    self.shift[block] = length - end
            self.bucket.setdefault(s[length - self.block :], {})[s] = ids

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list]]:
        """(start, ids of the items) of every occurrence."""
        n, m, b, far, shift, bucket = len(words), self.length, self.block, self.far, self.shift, self.bucket
        end = m
        if b == 1:
            while end <= n:
                if (w := (words[end - 1],)) in bucket:
                    yield end - 1, bucket[w][w]
                end += 1
            return
        while end <= n:
            block = (words[end - 2], words[end - 1])
            skip = shift.get(block, far)
            if skip:
                end += skip
                continue
            ids = bucket[block].get(tuple(words[end - m : end]))
            if ids is not None:
                yield end - m, ids
            end += 1


def searchers(items: list[tuple], window: int = WINDOW) -> list[Searcher]:
    """Tables for (id, text) items, one per length of test string."""
    by: dict[int, dict[tuple[bytes, ...], list]] = {}
    for item, text in items:
        w = words_of(text)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            ids = by.setdefault(m, {}).setdefault(tuple(w[i : i + m]), [])
            if item not in ids:
                ids.append(item)
    return [Searcher(m, s) for m, s in sorted(by.items())]


def hits(words: list[bytes], tables: list[Searcher]) -> tuple[list[tuple[int, int]], set]:
    """Maximal runs of hit words and the ids of the items found."""
    found: list[tuple[int, int]] = []
    items: set = set()
    for t in tables:
        for start, ids in t.search(words):
            found.append((start, start + t.length))
            items.update(ids)
    return merge(found), items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without its runs ``spans`` of words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(_TABLE))]
    for a, b in reversed(spans):
        raw = raw[: words[a][0]] + raw[words[b - 1][1] :]
    return raw.decode("utf-8", "surrogatepass")


_built: dict[str, list[Searcher]] = {}


class Tables:
    """The search tables of several broadcast blocks of items; those of the last block stay."""

    def __init__(self, blocks: list, window: int) -> None:
        self.blocks, self.window, self.name = blocks, window, uuid.uuid4().hex

    def __iter__(self) -> Iterator[list[Searcher]]:
        for k, items in enumerate(self.blocks):
            name = f"{self.name}-{k}"
            if name not in _built:
                _built.clear()
                _built[name] = searchers(items.value, self.window)
                if len(self.blocks) > 1:
                    vars(items).pop("_value", None)  # else the worker would keep the items of all blocks
            yield _built[name]

    def search(self, words: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set]]:
        """Runs of hit words and items of each list of words."""
        spans: list[list[tuple[int, int]]] = [[] for _ in words]
        items: list[set] = [set() for _ in words]
        for tables in self:
            for i, w in enumerate(words):
                s, more = hits(w, tables)
                if s:
                    spans[i] += s
                    items[i] |= more
        return [(merge(s) if len(self.blocks) > 1 else s, x) for s, x in zip(spans, items, strict=True)]


def _chunks(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together, or parted, to about ``most`` bytes of text, or one row."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for part in slices(batch, text, most):
            n = pc.sum(pc.binary_length(part.column(text))).as_py() or 0
            if held and size + n > most:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _searched(tables: Tables, text: str, cut: bool, most: int) -> Callable:
    """An Arrow function that adds hits, items and words; ``cut``: and cuts the passages out of the
    texts that aren't contaminated, with those that the cuts bring about."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches, text, most):
            texts = batch.column(text).to_pylist()
            words = [words_of(t) for t in texts]
            found = tables.search(words)
            todo = [i for i, (s, _) in enumerate(found) if s and 20 * sum(b - a for a, b in s) < len(words[i])] if cut else []
            spans = {i: found[i][0] for i in todo}
            while todo:
                for i in todo:
                    texts[i] = without_spans(texts[i], spans[i])
                again = tables.search([words_of(texts[i]) for i in todo])
                spans = {i: s for i, (s, _) in zip(todo, again, strict=True) if s}
                todo = list(spans)
            fields = batch.schema
            new = {
                "_hits": pa.array([[{"s": a, "e": b} for a, b in s] for s, _ in found], fields.field("_hits").type),
                "_items": pa.array([sorted({str(x) for x in items if x is not None}) for _, items in found], fields.field("_items").type),
                "_words": pa.array([len(w) for w in words], pa.int64()),
            }
            if cut:
                new[text] = pa.array(texts, fields.field(text).type)
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in fields.names], names=fields.names)

    return run


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """Items in blocks of bounded size; only one block is on the driver at a time."""
    rows = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null")
    block: list[tuple] = []
    size = 0
    for r in rows.toLocalIterator():
        n = len(r["t"]) // 4 + 1
        if block and size + n > PASS_WORDS:
            yield block
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += n
    if block:
        yield block


def mark(docs: DataFrame, benchmark: DataFrame, text: str, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text", cut: bool = False) -> DataFrame:
    """Add ``_words`` (long), ``_hits`` (runs of hit words) and ``_items`` (ids as strings) to ``docs``."""
    df = docs.withColumns({"_words": F.lit(0).cast("long"), "_hits": F.array().cast("array<struct<s:int,e:int>>"), "_items": F.array().cast("array<string>")})
    sc = docs.sparkSession.sparkContext
    blocks = [sc.broadcast(b) for b in _blocks(benchmark, id_col, text_col)]
    return df.mapInArrow(trimmed(_searched(Tables(blocks, window), text, cut, CHUNK_BYTES if len(blocks) > 1 else SLICE_BYTES)), df.schema)


def _n_hit():
    return F.aggregate("_hits", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])


def is_contaminated():
    return (_n_hit() > 0) & (_n_hit() * 20 >= F.col("_words"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, hits (runs of hit words), items (ids), contaminated."""
    df = mark(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, "text", window)
    return df.select("doc_id", F.col("_words").alias("n_words"), F.col("_hits").alias("hits"), _n_hit().alias("n_hit"), F.sort_array("_items").alias("items"), is_contaminated().alias("contaminated"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``contamination``."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), "contaminated")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", any_hit: bool = False) -> DataFrame:
    """The documents that aren't contaminated (``any_hit``: that have no hit word at all), with their own columns only."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(f"`{text_col}`").alias("_text"))
    clean = mark(packed, benchmark, "_text", window).where(F.size("_hits") == 0 if any_hit else ~is_contaminated())
    return clean.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))


def cut_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """The documents that aren't contaminated, with the runs of hit words cut out of their texts.

    A cut may join words to another passage; texts are searched again until nothing is hit.
    """
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(f"`{text_col}`").alias("_text"))
    df = mark(packed, benchmark, "_text", window, cut=True).where(~is_contaminated())
    return df.select(*((F.col("_text") if c == text_col else F.col("_row").getField(c)).alias(c) for c in docs.columns))
