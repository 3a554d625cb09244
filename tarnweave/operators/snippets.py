"""Match spans and snippets, on bytes."""

from __future__ import annotations

import re

from ..plans.ast import AnyOf, Expression, Regexp, Text
from ..plans.compile import BOUNDARY, STRICT_BOUNDARY

BUDGET = 160
Span = tuple[int, int]
_WHITE = "\t\n\f\r "


def lookup(text: bytes, needle: bytes, strict: bool = False) -> Span | None:
    """The whole-word occurrence whose suffix of the text is the smallest, byte by byte."""
    edge = STRICT_BOUNDARY if strict else BOUNDARY
    at = text.find(needle) if needle else -1
    found = []
    while at >= 0:
        end = at + len(needle)
        if (at == 0 or text[at - 1] in edge) and (end == len(text) or text[end] in edge):
            found.append(at)
        at = text.find(needle, at + 1)
    depth = len(needle)
    while len(found) > 1:  # narrow down by ever longer pieces of the suffixes
        pieces = {i: text[i + depth : i + depth + 64] for i in found}
        least = min(pieces.values())
        found = [i for i in found if pieces[i] == least]
        depth += 64
    return (found[0], found[0] + len(needle)) if found else None


def spans(text: bytes, root: Expression, regexp_spans: list[Span | None], strict: bool = False) -> list[Span] | None:
    """All spans of a match in the order of the leaves, or None. ``regexp_spans``: of the regexp leaves, consumed from the left."""
    if isinstance(root, Regexp):
        got = regexp_spans.pop(0)
        return [got] if got else None
    if isinstance(root, Text):
        got = lookup(text, root.text.encode(), strict)
        return [got] if got else None
    if isinstance(root, AnyOf):
        return next(([s] for x in root.items if (s := lookup(text, x.encode(), strict))), None)
    first = spans(text, root.first, regexp_spans, strict)
    last = spans(text, root.last, regexp_spans, strict)
    if root.operator == "OR":
        return first if first is not None else last
    return None if first is None or last is None else first + last


def clean(text: str) -> str:
    """Without newlines; white space is stripped at the start and elsewhere each run is cut to its first character."""
    return re.sub(rf"(^|[{_WHITE}])[{_WHITE}]+", r"\1", text.replace("\n", ""))


def _reach(text: bytes, at: int, margin: int, step: int) -> tuple[int | None, bool, bool]:
    """Walk from ``at`` over at most ``margin`` bytes. Returns where the snippet should stop (None: no
    word break was met), whether it ran into the text's edge or a hard stop, and whether a break was met."""
    stop, spaced, met = None, False, False
    for j in range(at, at + step * (margin + 1), step):
        if step < 0 and j <= 0:
            return 0, True, met
        if j >= len(text):
            return (len(text) - 1, False, met) if step < 0 else (len(text), True, met)
        c = text[j]
        if c in b"\n0":
            return (j + 1 if step < 0 else j), True, met
        if c == 0x20:
            if not spaced:
                stop, met = (j + 1 if step < 0 else j), True
            spaced = True
        else:
            spaced = False
    return stop, False, met


def snippet(text: bytes, found: list[Span], budget: int = BUDGET) -> str | None:
    """The pieces of text around the spans, each widened to word breaks within its share of the budget."""
    if not found:
        return None
    share = budget // len(found)
    out: list[bytes] = []
    more = True
    for i, (start, end) in enumerate((min(s), max(s)) for s in found):
        out.append(b"... " if i else b"")
        more = True
        margin = int((share - (end - start)) / 2)
        if margin > 0:
            left, hard, _ = _reach(text, start, margin, -1)
            dots = i == 0 and not hard
            right, ended, _ = _reach(text, end, margin, 1)
            start = start if left is None else left
            end = end if right is None else right
            more = not ended
            out.append(b"..." if dots else b"")
        else:
            end = min(start + share, len(text))
        out.append(text[start : max(start, min(end, start + share))])
    if more:
        out.append(b"... ")
    return clean(b"".join(out).decode("utf-8", "replace"))
