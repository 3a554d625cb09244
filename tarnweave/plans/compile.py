"""Expressions as predicate columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ast import AnyOf, Expression, Operator, Regexp, Text
from .regex import to_java

#: Bytes beside a whole word. White space by single bytes, where 0x85 and 0xA0 count
#: even as the tail of a longer character, and the digit zero.
BOUNDARY = b"\t\n\x0b\x0c\r 0\x85\xa0"
#: With ``strict``: NUL is a boundary, zero and tails of characters aren't.
STRICT_BOUNDARY = b"\t\n\x0b\x0c\r \x00"


def _byte_class(edge: bytes) -> str:
    return "[" + "".join(f"\\x{b:02X}" for b in edge) + "]"


def byte_view(text: Column) -> Column:
    """The text's UTF-8 bytes as one character each, so that patterns and places are those of bytes."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def word_view(text: Column, strict: bool = False) -> Column:
    """The byte view between two blanks, with every boundary byte a blank: whole words stand between blanks there."""
    edge = (STRICT_BOUNDARY if strict else BOUNDARY).decode("latin-1")
    return F.concat(F.lit(" "), F.translate(byte_view(text), edge, " " * len(edge)), F.lit(" "))


def whole_word(text: Column, needle: str, strict: bool = False, words: Column | None = None) -> Column:
    """Whether the literal stands in the text with a boundary on both sides. An empty one never does.

    With ``words``, the text's word view, this is a plain search; literals that have boundary bytes themselves
    need a pattern, and ``contains`` rules most rows out before it runs.
    """
    if not needle:
        return F.lit(False)
    edges = STRICT_BOUNDARY if strict else BOUNDARY
    if words is not None and not set(needle.encode()) & set(edges):
        return words.contains(f" {needle.encode().decode('latin-1')} ")
    edge = _byte_class(edges)
    quoted = "".join(f"\\x{b:02X}" for b in needle.encode())
    return text.contains(needle) & byte_view(text).rlike(f"(?:^|{edge}){quoted}(?:$|{edge})".replace("$", r"\z"))


def predicate(text: Column, root: Expression, strict: bool = False, words: Column | None = None) -> Column:
    """Whether the expression matches the (lower-cased) text; null texts match nothing."""
    if isinstance(root, Text):
        found = whole_word(text, root.text, strict, words)
    elif isinstance(root, AnyOf):
        found = F.lit(False)
        for item in root.items:
            found = found | whole_word(text, item, strict, words)
    elif isinstance(root, Regexp):
        found = text.rlike(to_java(root.pattern))
    else:
        a, b = predicate(text, root.first, strict, words), predicate(text, root.last, strict, words)
        found = a & b if root.operator == "AND" else a | b
    return F.coalesce(found, F.lit(False))


def has_words(root: Expression) -> bool:
    """Whether the expression looks for words at all."""
    return has_words(root.first) or has_words(root.last) if isinstance(root, Operator) else not isinstance(root, Regexp)


def first_of_list(text: Column, root: AnyOf, strict: bool = False) -> Column:
    """The list item that decides, in list order, or null."""
    return F.coalesce(*(F.when(whole_word(text, x, strict), F.lit(x)) for x in root.items), F.lit(None).cast("string"))


def regexps(root: Expression) -> list[Regexp]:
    """The regexp leaves from left to right."""
    if isinstance(root, Operator):
        return regexps(root.first) + regexps(root.last)
    return [root] if isinstance(root, Regexp) else []


def regexp_span(text: Column, leaf: Regexp) -> Column:
    """The left-most match as (start, end) in bytes, or null."""
    pattern = F.lit(to_java(leaf.pattern))
    at = F.regexp_instr(text, pattern)
    start = F.octet_length(F.substring(text, F.lit(1), at - 1))
    return F.when(at > 0, F.struct(start.alias("start"), (start + F.octet_length(F.regexp_substr(text, pattern))).alias("end")))
