"""A tokenizer for HTML as browsers read it, and the extraction of visible text, title and links."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import partial
from html.entities import html5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.snippets import clean
from .text import lower_text
from .urls import parses

#: Elements whose content is text up to their end tag; in the first group entities count.
RCDATA = {"title", "textarea"}
RAW = {"script", "style", "iframe", "noembed", "noframes", "noscript", "xmp"}
HIDDEN = {"script", "noscript", "style"}
MAX_BYTES = 2_000_000
MAX_DEPTH = 40
PART_LIMIT = 500
#: HTML that a worker reads at a time.
SLICE_BYTES = 1_000_000

_SPACE = " \t\n\f\r"
_ATTR = re.compile(rf"[{_SPACE}/]*([^{_SPACE}/>=][^{_SPACE}/>=]*)?(?:[{_SPACE}]*=[{_SPACE}]*(?:\"([^\"]*)\"?|'([^']*)'?|([^{_SPACE}>]*)))?")
_ENTITY = re.compile(r"&(#[xX]?[0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)")


def unescape(text: str, attribute: bool = False, bare: bool = True, only: tuple[str, ...] | None = None) -> str:
    """Decode entities; in attributes a name without ``;`` that runs on into ``=`` or a word stays.

    Without ``bare`` only whole entities of a text count, so that one cut off before its ``;`` stays as it is.
    With ``only`` just these count in a text, named as ``&lt;``.
    """
    if "&" not in text:
        return text
    if not attribute and bare and only is None:
        return html.unescape(text)

    def one(m: re.Match) -> str:
        name = m[1]
        if only is not None and not attribute:
            return html.unescape(m[0]) if m[0] in only else m[0]
        if not bare and not attribute:
            return html.unescape(m[0]) if name.endswith(";") and (name.startswith("#") or name in html5) else m[0]
        if name.startswith("#") or name.endswith(";"):
            return html.unescape(m[0])
        return m[0] if text[m.end() : m.end() + 1] == "=" or name not in html5 else html.unescape(m[0])

    return _ENTITY.sub(one, text)


def _lower(name: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in name)


def _tag(doc: str, at: int) -> tuple[str, dict[str, str], bool, int]:
    """(name, attributes, self-closing, place after) of the tag whose name starts at ``at``."""
    end = at
    while end < len(doc) and doc[end] not in _SPACE + "/>":
        end += 1
    name, attrs = _lower(doc[at:end]), {}
    while end < len(doc) and doc[end] != ">":
        m = _ATTR.match(doc, end)
        if m.end() == end:
            end += 1
            continue
        key = _lower(m[1] or "")
        if key and key not in attrs:
            attrs[key] = unescape(next((g for g in m.groups()[1:] if g is not None), ""), True)
        end = m.end()
    closed = end < len(doc) and doc[end - 1] == "/"
    return name, attrs, closed, min(len(doc), end + 1)


def tokens(doc: str, bare: bool = True, only: tuple[str, ...] | None = None) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(kind, data, attributes); kinds: text, start, end, closed (a self-closing start), other."""
    doc = doc.replace("\r\n", "\n").replace("\r", "\n")
    at, n = 0, len(doc)
    text_from = 0
    raw = ""
    while at < n:
        if raw:
            m = re.compile(rf"</{re.escape(raw)}(?=[{_SPACE}/>])", re.I).search(doc, at)
            stop = m.start() if m else n
            if stop > at:
                yield "text", doc[at:stop] if raw in RAW else unescape(doc[at:stop], bare=bare, only=only), {}
            at = text_from = stop
            raw = ""
            if at >= n:
                return
        lt = doc.find("<", at)
        if lt < 0 or lt + 1 >= n:
            break
        c = doc[lt + 1]
        if not (c.isascii() and c.isalpha()) and c not in "/!?":
            at = lt + 1
            continue
        if c == "/" and not (doc[lt + 2 : lt + 3].isascii() and doc[lt + 2 : lt + 3].isalpha()) and lt + 2 >= n:
            break
        if lt > text_from:
            yield "text", unescape(doc[text_from:lt], bare=bare, only=only), {}
        if c.isascii() and c.isalpha():
            name, attrs, closed, at = _tag(doc, lt + 1)
            yield "closed" if closed else "start", name, attrs
            if name in RAW or name in RCDATA:
                raw = name
            elif name == "plaintext":
                if at < n:
                    yield "text", doc[at:], {}
                return
        elif c == "/" and doc[lt + 2].isascii() and doc[lt + 2].isalpha():
            name, _, _, at = _tag(doc, lt + 2)
            yield "end", name, {}
        elif doc.startswith("<!--", lt):
            m = re.compile(r"--!?>").search(doc, lt + 4) if not doc.startswith((">", "->"), lt + 4) else re.compile(r"-?>").match(doc, lt + 4)
            at = m.end() if m else n
            yield "other", "", {}
        else:
            end = doc.find(">", lt + 2)
            at = n if end < 0 else end + 1
            yield "other", "", {}
        text_from = at
    if text_from < n:
        yield "text", unescape(doc[text_from:], bare=bare, only=only), {}


def clean_href(href: str) -> str | None:
    """The link without blanks at its ends and without fragment; None if empty, malformed or with an overlong part."""
    link = href.strip(_SPACE)
    if not link or not parses(link):
        return None
    link = link.partition("#")[0]
    rest = re.sub(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?]*)?", "", link)
    path, _, query = rest.partition("?")
    if len(_unquote(path)) > PART_LIMIT or len(query.encode()) > PART_LIMIT:
        return None
    return link


def _unquote(path: str) -> bytes:
    return re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), path.encode())


def read(doc: str, links: bool = True, bare: bool = True, only: tuple[str, ...] | None = None) -> tuple[str, str | None, list[str]]:
    """(lower-cased visible text, title, links).

    Every text outside head, script, noscript and style is written after a NUL. The counters of
    open elements may go below zero on stray end tags, which then hides text until they balance.
    """
    head = title = hidden = 0
    out: list[str] = []
    name: str | None = None
    hrefs: list[str] = []
    for kind, data, attrs in tokens(doc, bare, only):
        if kind == "text":
            if not hidden and not head:
                out.append("\0" + lower_text(data))
            if title == 1:
                name = clean(data)
        elif kind in ("start", "end"):
            step = 1 if kind == "start" else -1
            if data == "a" and step == 1:
                if links and "href" in attrs and (link := clean_href(attrs["href"])) is not None:
                    hrefs.append(link)
            elif data == "head":
                head += step
            elif data == "title":
                title += step if head > 0 else 0
            elif data in HIDDEN:
                hidden += step
    return "".join(out), name, hrefs


#: The tags that mark a text as HTML when it begins with one (after blanks).
SIGNATURES = ("!DOCTYPE HTML", "HTML", "HEAD", "SCRIPT", "IFRAME", "H1", "DIV", "FONT", "TABLE", "A", "STYLE", "TITLE", "B", "BODY", "BR", "P")


def is_html(doc):
    """Column: whether the first 512 bytes look like HTML."""
    head = F.decode(F.substring(F.encode(doc, "UTF-8"), 1, 512), "ISO-8859-1")
    tags = "|".join(SIGNATURES)
    return F.coalesce(head.rlike(rf"(?i)^[\t\n\f\r ]*(?:<(?:{tags})[ >]|<!--)"), F.lit(False))


def within_size(doc, most: int = MAX_BYTES):
    """Column: whether the document has at most ``most`` bytes."""
    return F.coalesce(F.octet_length(doc) <= most, F.lit(False))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``SLICE_BYTES`` of HTML, or of one page."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column("_html")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(total):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def _read_slice(batch: pa.RecordBatch, bare: bool, only: tuple[str, ...] | None) -> pa.RecordBatch:
    got = [read(d or "", go, bare, only) for d, go in zip(batch.column("_html").to_pylist(), batch.column("_links").to_pylist(), strict=True)]
    names = [n for n in batch.schema.names if n not in ("_html", "_links")]
    new = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *new], names=[*names, "text", "title", "links"])


def _run(batches: Iterator[pa.RecordBatch], bare: bool, only: tuple[str, ...] | None = None) -> Iterator[pa.RecordBatch]:
    """Pages slice by slice, so that beside a batch only one slice's texts are held."""
    for batch in batches:
        for part in _slices(batch):
            yield _read_slice(part, bare, only)
        batch = part = None  # not beside the next one


def extract(pages: DataFrame, keep: list[str], doc: str = "html", depth: str | None = None, bare: bool = True, only: tuple[str, ...] | None = None, guarded: bool = True) -> DataFrame:
    """The columns ``keep`` with ``text``, ``title`` and ``links`` of every page that passes the guards.

    Pages over ``MAX_BYTES`` and those that don't look like HTML are dropped before any is parsed; without ``guarded``
    every page has its row, a null one that of an empty page. Links of pages at ``MAX_DEPTH`` or deeper aren't
    collected. ``bare`` and ``only``: see ``unescape``.
    """
    go = F.lit(True) if depth is None else F.col(depth) < MAX_DEPTH
    if guarded:
        pages = pages.where(within_size(F.col(doc)) & is_html(F.col(doc)))
    slim = pages.select(*keep, F.col(doc).alias("_html"), go.alias("_links"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.select(*keep).schema)
    return slim.mapInArrow(partial(_run, bare=bare, only=only), f"{schema}, text string, title string, links array<string>")
