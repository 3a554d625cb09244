"""RE2 patterns as Java patterns."""

from __future__ import annotations

import re

#: POSIX classes that RE2 knows by name.
POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~", "lower": "a-z",
    "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
_SPACE = r"\t\n\f\r "
_NEGATED = {"D": "0-9", "W": "0-9A-Za-z_", "S": _SPACE}
_QUANTIFIER = re.compile(r"\{(\d+)(,(\d*))?\}")
_NAME = re.compile(r"\(\?P?<([A-Za-z_]\w*)>")
_FLAGS = re.compile(r"\(\?([a-zA-Z]*)(-[a-zA-Z]+)?([:)])")


class PatternError(ValueError):
    """A pattern that RE2 refuses or that has no Java form."""


def to_java(pattern: str) -> str:
    """The Java pattern that matches as ``(?i)pattern`` does in RE2.

    Case folding is Unicode's, ``.`` excludes the newline alone and ``$`` is the end of the text;
    what RE2 lacks (look-around, back-references, possessive quantifiers) is refused.
    """
    out = ["(?iud)"]
    multi = [False]
    i, n = 0, len(pattern)
    after = False  # whether a quantifier may follow
    while i < n:
        c = pattern[i]
        if c == "\\":
            piece, i = _escape(pattern, i, inside=False)
            out.append(piece)
            after = True
        elif c == "[":
            piece, i = _class(pattern, i)
            out.append(piece)
            after = True
        elif c == "(":
            multi.append(multi[-1])
            if pattern.startswith("(?", i):
                named, flags = _NAME.match(pattern, i), _FLAGS.match(pattern, i)
                if named:
                    out.append("(?<" + named[1].replace("_", "") + ">")
                    i = named.end()
                elif flags:
                    on, off = flags[1], (flags[2] or "")[1:]
                    if set(on + off) - set("ims"):
                        raise PatternError(f"flags {on + off!r} aren't supported")
                    state = ("m" in on) or (multi[-1] and "m" not in off)
                    out.append(pattern[i : flags.end()])
                    i = flags.end()
                    if flags[3] == ")":
                        multi.pop()
                        multi[-1] = state
                    else:
                        multi[-1] = state
                else:
                    raise PatternError("look-around and atomic groups aren't supported")
            else:
                out.append("(")
                i += 1
            after = False
        elif c == ")":
            if len(multi) == 1:
                raise PatternError("unexpected )")
            multi.pop()
            out.append(c)
            i += 1
            after = True
        elif c == "$":
            out.append("$" if multi[-1] else r"\z")
            i += 1
            after = True
        elif c in "*+?" or (c == "{" and _QUANTIFIER.match(pattern, i)):
            if not after:
                raise PatternError("nothing to repeat, or a repeat of a repeat")
            if c == "{":
                m = _QUANTIFIER.match(pattern, i)
                if int(m[1]) > 1000 or int(m[3] or 0) > 1000 or (m[3] and int(m[3]) < int(m[1])):
                    raise PatternError("bad repeat count")
                out.append(m[0])
                i = m.end()
            else:
                out.append(c)
                i += 1
            if i < n and pattern[i] == "?":
                out.append("?")
                i += 1
            after = False
        elif c == "{":
            out.append(r"\{")
            i += 1
            after = True
        else:
            out.append(c)
            i += 1
            after = c not in "|^"
    if len(multi) > 1:
        raise PatternError("missing )")
    return "".join(out)


def _escape(p: str, i: int, inside: bool) -> tuple[str, int]:
    if i + 1 >= len(p):
        raise PatternError("trailing backslash")
    c = p[i + 1]
    if c == "Q" and not inside:
        end = p.find(r"\E", i)
        body = p[i + 2 : end if end >= 0 else len(p)]
        return "".join("\\" + x if x.isascii() and not x.isalnum() and x != "_" else x for x in body), end + 2 if end >= 0 else len(p)
    if c in "pP":
        m = re.compile(r"\\[pP](\{\^?\w+\}|\w)").match(p, i)
        if not m:
            raise PatternError("bad character class")
        name = m[1].strip("{}")
        flip = name.startswith("^") != (c == "P")
        name = name.lstrip("^")
        kind = name if len(name) <= 2 else f"Is{name}"
        return f"\\{'P' if flip else 'p'}{{{kind}}}", m.end()
    if c == "x":
        m = re.compile(r"\\x(\{[0-9a-fA-F]+\}|[0-9a-fA-F]{2})").match(p, i)
        if not m:
            raise PatternError("bad escape")
        return m[0], m.end()
    if c in "sS":
        if inside:
            return (_SPACE if c == "s" else f"[^{_SPACE}]"), i + 2
        return f"[{'^' if c == 'S' else ''}{_SPACE}]", i + 2
    if c == "v":
        return r"\x0B", i + 2
    if c == "a":
        return r"\x07", i + 2
    if c in "dDwWtnfr" or (c in "bBAz" and not inside):
        return "\\" + c, i + 2
    if c in "01234567" and re.match(r"\\[0-7]{3}|\\0[0-7]*", p[i:]):
        m = re.match(r"\\([0-7]{1,3})", p[i:])
        return f"\\x{{{int(m[1], 8):X}}}", i + m.end()
    if not c.isascii() or c.isalnum():
        raise PatternError(f"escape \\{c} isn't supported")
    return "\\" + c, i + 2


def _class(p: str, i: int) -> tuple[str, int]:
    out = ["["]
    i += 1
    if p.startswith("^", i):
        out.append("^")
        i += 1
    first = True
    while True:
        if i >= len(p):
            raise PatternError("missing ]")
        c = p[i]
        if c == "]" and not first:
            return "".join(out) + "]", i + 1
        named = re.compile(r"\[:(\^?)(\w+):\]").match(p, i)
        if named:
            if named[2] not in POSIX:
                raise PatternError("unknown class name")
            out.append(f"[^{POSIX[named[2]]}]" if named[1] else POSIX[named[2]])
            i = named.end()
        elif c == "\\":
            piece, i = _escape(p, i, inside=True)
            out.append(piece)
        else:
            out.append("\\" + c if c in "[]&^~" else c)
            i += 1
        first = False
