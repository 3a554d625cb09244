"""Case mapping rune by rune."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The two capitals that full-text casing maps by context or to two code points, and their own small letters.
ALONE = {"Σ": "σ", "İ": "i"}


def lower_runes(text: Column) -> Column:
    """The text in small letters, each code point mapped by itself."""
    for capital, small in ALONE.items():
        text = F.replace(text, F.lit(capital), F.lit(small))
    return F.lower(text)


def lower_text(text: str) -> str:
    """The same for a Python string."""
    for capital, small in ALONE.items():
        text = text.replace(capital, small)
    return text.lower()
