"""Quality rules as a bitmask ledger. DataFrame functions only.

Every rule is measured once per document and leaves one failure bit; the measurements and the
bits are the ledger. A policy is a named, versioned mask: a document passes where it fails no
rule of the mask. Ablations (what each rule alone decides) come from bitwise aggregation over the
ledger, without going back to the texts.

Null texts have no words. Texts without words fail the word count rule. Rows are judged one by
one: repeated rows get equal verdicts; an empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, word_array

SYMBOLS = "#*$%&|<>"
_LOW = (1 << 31) - 1


@dataclass(frozen=True)
class Rule:
    """A failure condition over the measurements; ``bit`` is its place in the ledger."""

    bit: int
    name: str
    fails: str


#: Ratios are compared in integers, so that every engine agrees.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 4 * n_words"),
    Rule(3, "repeated_lines", "10 * n_dup_lines > 6 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 40 * n_words"),
)
BASE_MASK = 0b11


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    mask: int


POLICIES = {p.version: p for p in (Policy("base", 1, BASE_MASK), Policy("standard", 2, 0b111111))}
CURRENT = POLICIES[2]


def measure(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Add the measurements (n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words).

    Windows of three words are compared by a 33-bit hash packed with their place in one long,
    sorted; equal neighbours are candidates, and those alone are compared as text. So a false
    hash match can't count, and no document costs more than a sort of its own windows.
    """
    p = prefix
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn(f"{p}w", word_array(F.col(text)))
    w = F.col(f"{p}w")
    n = F.size(w)
    packed = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.lit(~_LOW)).bitwiseOR(i.cast("long"))))
    has_word = lambda line: F.btrim(line, F.lit(SPACES)) != ""
    df = df.withColumns({f"{p}s": F.sort_array(packed), f"{p}l": F.filter(F.split(t, "\n"), has_word)})
    s = F.col(f"{p}s")
    same = lambda a, b: F.coalesce(F.shiftright(a, 31) == F.shiftright(b, 31), F.lit(False))
    df = df.withColumn(f"{p}c", F.transform(F.filter(s, lambda x, i: same(x, F.try_element_at(s, i + 2)) | ((i > 0) & same(x, F.get(s, i - 1)))), lambda x: x.bitwiseAND(F.lit(_LOW)).cast("int")))
    c = F.col(f"{p}c")
    df = df.withColumn(f"{p}e", F.when(F.size(c) > 0, F.sort_array(F.transform(c, lambda i: F.struct(F.concat_ws(" ", F.slice(w, i + 1, F.lit(3))).alias("t"), i.alias("i"))))))
    e = F.col(f"{p}e")
    twin = lambda x, y: F.coalesce(x["t"] == y["t"], F.lit(False))
    df = df.withColumn(f"{p}p", F.sort_array(F.transform(F.filter(e, lambda x, k: twin(x, F.try_element_at(e, k + 2)) | ((k > 0) & twin(x, F.get(e, k - 1)))), lambda x: x["i"])))
    at = F.col(f"{p}p")
    covered = F.aggregate(F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.try_element_at(at, k + 2) - x, F.lit(3)))), F.lit(0).cast("long"), lambda acc, x: acc + x)
    lines = F.col(f"{p}l")
    # A filter on the measurements must not be pushed below this projection: it would drag the
    # expressions along and evaluate the splits again for every element. A term that the
    # optimizer may not move holds it above.
    held = F.monotonically_increasing_id() * 0
    return df.withColumns(
        {
            f"{p}n_words": n.cast("long") + held,
            f"{p}word_chars": F.length(F.translate(t, SPACES, "")).cast("long"),
            f"{p}n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
            f"{p}n_lines": F.size(lines).cast("long"),
            f"{p}n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            f"{p}n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        }
    ).drop(*(f"{p}{x}" for x in "wslcep"))


def failure_bits(prefix: str = "") -> Column:
    """The rules' failures as one integer."""
    bits = F.lit(0)
    for rule in RULES:
        cond = rule.fails
        if prefix:
            for name in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"):
                cond = _word_sub(name, f"`{prefix}{name}`", cond)
        bits = bits.bitwiseOR(F.when(F.expr(cond), F.lit(1 << rule.bit)).otherwise(F.lit(0)))
    return bits.cast("int")


def _word_sub(name: str, by: str, cond: str) -> str:
    import re

    return re.sub(rf"(?<![`\w]){name}\b", by, cond)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, the measurements and ``rule_bits``."""
    df = measure(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return df.withColumn("rule_bits", failure_bits()).drop("text")


def apply_policy(rows: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """Add base_failed, kept and the policy's name and version to a ledger."""
    bits = F.col("rule_bits")
    base = bits.bitwiseAND(F.lit(BASE_MASK)) != 0
    return rows.withColumns({"base_failed": base, "kept": ~base & (bits.bitwiseAND(F.lit(policy.mask)) == 0), "policy": F.lit(f"{policy.name}-{policy.version}")})


def ablation(rows: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """Per rule of the policy: documents that fail it, and those that fail no other rule of it.

    One aggregation over the ledger; one column pair per rule, then unpivoted.
    """
    bits = F.col("rule_bits").bitwiseAND(F.lit(policy.mask))
    used = [r for r in RULES if policy.mask >> r.bit & 1]
    sums = rows.agg(F.count("*").alias("n"), F.count_if(bits == 0).alias("kept"), *(F.count_if(bits.bitwiseAND(F.lit(1 << r.bit)) != 0).alias(f"f{r.bit}") for r in used), *(F.count_if(bits == (1 << r.bit)).alias(f"o{r.bit}") for r in used))
    entries = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.col(f"f{r.bit}").alias("n_failed"), F.col(f"o{r.bit}").alias("n_only"), (F.col("kept") + F.col(f"o{r.bit}")).alias("kept_without"), F.col("kept"), F.col("n").alias("n_docs")) for r in used))
    return sums.select(F.inline(entries))


def keep_documents(docs: DataFrame, policy: Policy = CURRENT, text_col: str = "text") -> DataFrame:
    """The documents that pass the policy, with their own columns only, whatever those are called."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    df = measure(packed.withColumn("_text", F.col("_row").getField(text_col)), text="_text", prefix="_m_")
    kept = df.where(failure_bits("_m_").bitwiseAND(F.lit(policy.mask | BASE_MASK)) == 0)
    return kept.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))
