"""Personal data by weak supervision. DataFrame functions only.

Candidates are spans of four kinds: the base patterns (email, ip, card, phone), which always
count, and looser forms of them: addresses with "at" and "dot" as words or in brackets, bracketed or
spaced IP numbers, card numbers with other separators or a wrong check digit, phone numbers without
a plus. Labelers vote on every candidate - its form (regex and checksum), what its parts are known to be
(gazetteer) and the text around it (context: words that announce such a span or another
number, else whether it stands free or is part of a longer token) - or abstain. Expectation
maximisation over the counts of vote patterns, a table of bounded size, estimates how reliable
each labeler is per kind; the posteriors then train a naive Bayes classifier over the span's
features, and that decides on the looser candidates.

Offsets are code points, ends exclusive. Null texts are empty. Rows are judged one by one:
repeated rows get equal spans; an empty table gives an empty result. Loose spans that overlap a
base span of their kind are dropped; of loose spans of one kind that overlap, both stay. Candidates of
equal votes share their verdict, so there are no ties to break. Extra columns are ignored, by ``redact`` kept,
whatever their names. Texts of any length are read whole: offsets are
prefix sums in two levels, so a text with m matches costs m * 64 + (m / 64)^2 steps.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("email", "ip", "card", "phone")
#: Patterns of the contract. Possessive repeats and the look-behind (or \G, the end of the match
#: before) find the same leftmost matches without going back over a run.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Looser forms; the classifier decides on their matches, and on digit runs of card length that fail the checksum.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]++(?:(?: ?(?:\[dot\]|\(dot\)) ?| dot |\.)[A-Za-z0-9-]++)++| at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++)++)",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?: ?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)) ?[0-9]{1,3}+| \. [0-9]{1,3}+){3}(?![0-9.])",
    "card": r"(?<![0-9./_])[0-9]{4}(?:[./_][0-9]{2,7}+){2,4}+(?![0-9./_])",
    "phone": r"(?<![0-9+.-])(?:\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}|00[1-9][0-9]{0,2}[ .-][0-9]{2,4}[ .-][0-9]{3,4}(?:[ .-][0-9]{2,4})?)(?![0-9.-])",
}
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
#: Gazetteers and context words, fixed values.
TLDS = ("com", "de", "edu", "es", "eu", "fr", "gov", "info", "io", "net", "org", "uk")
IIN = r"^(?:4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|35|30[0-5]|3[68]|6011|65|62)"
CUES = {
    "email": r"(?i)(?:e-?mail|contact|write|kontakt|correo|courriel|@)",
    "ip": r"(?i)\b(?:ip|host|server|address|client|from)\b",
    "card": r"(?i)\b(?:card|visa|master|amex|credit|karte|carte|tarjeta|iban|account)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|cell|telefon|rufen|appeler|llam)",
}
#: Words right before a span that announce something else.
OTHERS = {
    "email": r"(?i)\b(?:look|meet|stay|arrive|sold)\b[^A-Za-z]{0,12}$",
    "ip": r"(?i)\b(?:version|release|section|chapter|firmware)\b[^A-Za-z]{0,12}$",
    "card": r"(?i)\b(?:order|invoice|tracking|serial|isbn|ticket|ref)\b[^A-Za-z]{0,12}$",
    "phone": r"(?i)\b(?:order|invoice|part|serial|isbn|ticket|ref)\b[^A-Za-z]{0,12}$",
}
GLUED_BEFORE, GLUED_AFTER = r"[A-Za-z0-9_=/#&?-]$", r"^[A-Za-z0-9_=/#&-]"
LABELERS = ("form", "known", "near")
#: Prior share of true spans among those that no base pattern confirms, and the prior reliability
#: of the labelers; both weigh as much as a quarter of the spans.
SHARE = {"email": 0.5, "ip": 0.1, "card": 0.1, "phone": 0.6}
RELIABLE = {"form": 0.95, "known": 0.75, "near": 0.65}
CONTEXT_CHARS = 40
_CHUNK = 64


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return s.rlike(OCTETS)
    n = F.length(_digits(s))
    return n.between(9, 15) if kind == "phone" else F.when(n.between(13, 19), luhn(_digits(s))).otherwise(F.lit(False))


def _votes(kind: str, s: Column, before: Column, after: Column, base: bool) -> tuple[Column, Column, Column]:
    """form, known, near: 1 for, 0 against, -1 abstains."""
    digits = _digits(s)
    n = F.length(digits)
    near = F.when(before.rlike(OTHERS[kind]), 0).when(before.rlike(CUES[kind]) | after.rlike(CUES[kind]), 1).when(before.rlike(GLUED_BEFORE) | after.rlike(GLUED_AFTER), 0).otherwise(1)
    vote = lambda x: F.when(x, 1).otherwise(0)
    if kind == "email":
        tail = F.lower(F.regexp_extract(s, r"([A-Za-z0-9-]+)$", 1))
        return vote(F.lit(base) | tail.rlike("^[a-z]{2,10}$")), vote(tail.isin(*TLDS)), near
    if kind == "ip":
        parts = s if base else F.regexp_replace(s, "[^0-9]+", ".")
        first = F.regexp_extract(parts, r"^0*([0-9]*)", 1)
        return vote(parts.rlike(OCTETS)), F.when(first.rlike(r"^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])$"), F.when(first == "127", -1).otherwise(1)).otherwise(0), near
    if kind == "card":
        return vote(n.between(13, 19) & luhn(digits)), vote(digits.rlike(IIN)), near
    area = F.regexp_replace(digits, "^(?:00)?1?", "")
    return vote(n.between(9, 15) & (F.lit(base) | ~s.rlike(r"^\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}$") | digits.rlike("^[2-9][0-9]{2}[2-9]"))), vote(area.rlike("^[2-9]")), near


def _total(part: Column) -> Column:
    return F.aggregate(part, F.lit(0), lambda a, x: a + x)


def _lengths(matches: Column, gaps: Column) -> Column:
    return F.transform(matches, lambda m, k: F.length(m) + F.length(F.get(gaps, k)))


def _chunk_sums(lengths: Column) -> Column:
    last = ((F.size(lengths) - 1) / _CHUNK).cast("int")
    return F.when(F.size(lengths) > 0, F.transform(F.sequence(F.lit(0), last), lambda c: _total(F.slice(lengths, c * _CHUNK + 1, F.lit(_CHUNK)))))


def _sums_before(sums: Column) -> Column:
    return F.transform(sums, lambda _, c: _total(F.slice(sums, F.lit(1), c)))


def _spans(kind: str, base: bool, matches: Column, gaps: Column, lengths: Column, chunks: Column) -> Column:
    """Candidates of one pattern, from its matches and the gaps before them."""

    def one(m: Column, k: Column) -> Column:
        c = (k / _CHUNK).cast("int")
        end = F.get(chunks, c) + _total(F.slice(lengths, c * _CHUNK + 1, k - c * _CHUNK + 1))
        form, known, near = _votes(kind, m, F.right(F.get(gaps, k), F.lit(CONTEXT_CHARS)), F.coalesce(F.left(F.get(gaps, k + 1), F.lit(CONTEXT_CHARS)), F.lit("")), base)
        valid = _valid(kind, m) if base else F.lit(False)
        n = F.length(_digits(m))
        joined = F.get(gaps, k).rlike("[A-Za-z0-9]$") | F.get(gaps, k + 1).rlike("^[A-Za-z0-9]")
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), (end - F.length(m)).alias("start"), end.alias("end"), valid.alias("base"), form.cast("int").alias("form"), known.cast("int").alias("known"), near.cast("int").alias("near"), F.least((n / 4).cast("int"), F.lit(5)).alias("size"), F.lit(base).alias("strict"), n.alias("digits"), joined.alias("joined"))

    return F.transform(matches, one)


def candidates(df: DataFrame, text: str, p: str = "_p_") -> DataFrame:
    """Add ``{p}cands``: every candidate span of the text with its votes and features."""
    t = F.coalesce(F.col(text), F.lit(""))
    digit = t.rlike("[0-9]")
    hint = {("email", True): t.contains("@"), ("email", False): t.rlike(r"[\[(]at[\])]| at [A-Za-z0-9-]+ dot "), ("ip", True): t.rlike(r"[0-9]\.[0-9]"), ("ip", False): t.rlike(r"[0-9] ?(?:[\[(](?:\.|dot)[\])]|\. [0-9])| \. [0-9]"), ("card", False): t.rlike("[0-9]{4}[./_][0-9]")}
    sets = [(k, True, BASE[k]) for k in KINDS] + [(k, False, LOOSE[k]) for k in LOOSE]
    empty = F.array().cast("array<string>")
    cols: dict[str, Column] = {}
    for i, (kind, base, pattern) in enumerate(sets):
        cols[f"{p}m{i}"] = F.when(hint.get((kind, base), digit), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(empty)
    df = df.withColumns(cols)
    df = df.withColumns({f"{p}g{i}": F.when(F.size(f"{p}m{i}") > 0, F.split(t, pattern, -1)).otherwise(empty) for i, (_, _, pattern) in enumerate(sets)})
    df = df.withColumns({f"{p}n{i}": _lengths(F.col(f"{p}m{i}"), F.col(f"{p}g{i}")) for i in range(len(sets))})
    df = df.withColumns({f"{p}c{i}": _chunk_sums(F.col(f"{p}n{i}")) for i in range(len(sets))})
    df = df.withColumns({f"{p}o{i}": _sums_before(F.col(f"{p}c{i}")) for i in range(len(sets))})
    spans = [_spans(kind, base, *(F.col(f"{p}{c}{i}") for c in "mgno")) for i, (kind, base, _) in enumerate(sets)]
    # of the base patterns' failing matches only free-standing runs of card length stay
    made = F.filter(F.concat(*spans), lambda x: x["base"] | ~x["strict"] | ((x["kind"] == KINDS.index("card")) & x["digits"].between(13, 19) & ~x["joined"]))
    df = df.withColumn(f"{p}all", made)
    clash = lambda x: F.exists(F.filter(F.col(f"{p}all"), lambda y: y["base"]), lambda y: (y["kind"] == x["kind"]) & (y["start"] < x["end"]) & (x["start"] < y["end"]))
    df = df.withColumn(f"{p}cands", F.when(F.forall(f"{p}all", lambda x: x["base"]), F.col(f"{p}all")).otherwise(F.filter(f"{p}all", lambda x: x["base"] | ~clash(x))))
    return df.drop(*(f"{p}{c}{i}" for c in "mgnco" for i in range(len(sets))), f"{p}all")


@dataclass
class Model:
    """Per kind: log odds of the classifier's prior and of each feature value."""

    prior: dict[int, float]
    odds: dict[tuple[int, str, int], float]
    reliability: dict[tuple[int, str], float]


FEATURES = ("form", "known", "near", "size")


def fit(counts: list[tuple], rounds: int = 50) -> Model:
    """EM over (kind, form, known, near, size, base, n), then naive Bayes on the posteriors.

    A labeler is right with a probability of its own per kind; an abstaining one says nothing.
    Spans that match a base pattern in full are known to be true. The classifier learns what features
    true and false spans have from all spans, and how frequent true ones are from the loose ones,
    which are all that it decides on.
    """
    prior, odds, reliability = {}, {}, {}
    for kind in range(len(KINDS)):
        rows = [r for r in counts if r[0] == kind]
        right = dict(RELIABLE)
        share = SHARE[KINDS[kind]]
        post = [1.0] * len(rows)
        loose = sum(r[6] for r in rows if not r[5])
        for _ in range(rounds if rows else 0):
            for i, r in enumerate(rows):
                yes, no = math.log(share), math.log(1 - share)
                for name, v in zip(LABELERS, r[1:4], strict=True):
                    if v >= 0:
                        yes += math.log(right[name] if v else 1 - right[name])
                        no += math.log(1 - right[name] if v else right[name])
                post[i] = 1.0 if r[5] else 1 / (1 + math.exp(min(700, no - yes)))
            weight = loose / 4 + 4
            share = (sum(p * r[6] for p, r in zip(post, rows, strict=True) if not r[5]) + SHARE[KINDS[kind]] * weight) / (loose + weight)
            share = min(0.99, max(0.01, share))
            for name, at in zip(LABELERS, (1, 2, 3), strict=True):
                voted = [(p, r) for p, r in zip(post, rows, strict=True) if r[at] >= 0]
                good = sum((p if r[at] else 1 - p) * r[6] for p, r in voted)
                n = sum(r[6] for _, r in voted)
                right[name] = min(0.99, max(0.51, (good + RELIABLE[name] * (n / 4 + 4)) / (1.25 * n + 4)))
        for name in LABELERS:
            reliability[kind, name] = right[name]
        yes = sum(p * r[6] for p, r in zip(post, rows, strict=True))
        no = sum((1 - p) * r[6] for p, r in zip(post, rows, strict=True))
        prior[kind] = math.log((sum(p * r[6] for p, r in zip(post, rows, strict=True) if not r[5]) + 1) / (no + 1))
        for at, name in enumerate(FEATURES, 1):
            values = {r[at] for r in rows}
            for v in values:
                a = sum(p * r[6] for p, r in zip(post, rows, strict=True) if r[at] == v)
                b = sum((1 - p) * r[6] for p, r in zip(post, rows, strict=True) if r[at] == v)
                odds[kind, name, v] = math.log((a + 1) / (yes + len(values))) - math.log((b + 1) / (no + len(values)))
    return Model(prior, odds, reliability)


def train(rows: DataFrame, cands: str) -> Model:
    """Fit on all candidates of ``rows``; only the counts of the vote patterns reach the driver."""
    x = rows.select(F.explode(cands).alias("x")).select("x.kind", "x.form", "x.known", "x.near", "x.size", "x.base")
    return fit([tuple(r) for r in x.groupBy("kind", "form", "known", "near", "size", "base").count().collect()])


def accepted(x: Column, model: Model) -> Column:
    """Whether the classifier (or the base pattern) takes candidate ``x``."""
    score = F.lit(0.0)
    for kind, value in model.prior.items():
        part = F.lit(value)
        for name in FEATURES:
            for (k, f, v), w in sorted(model.odds.items()):
                if k == kind and f == name:
                    part = part + F.when(x[name] == v, F.lit(w)).otherwise(F.lit(0.0))
        score = F.when(x["kind"] == kind, part).otherwise(score)
    return x["base"] | (score > 0)


def _label(x: Column) -> Column:
    return F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))


def _key(x: Column) -> Column:
    return F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ``base_spans`` and ``spans``, arrays of (kind, start, end) in order."""
    df = candidates(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text")
    df = materialize(df.select("doc_id", F.col("_p_cands").alias("cands")), "pii")
    model = train(df, "cands")
    return df.select("doc_id", F.sort_array(F.transform(F.filter("cands", lambda x: x["base"]), _key)).alias("base_spans"), F.sort_array(F.transform(F.filter("cands", lambda x: accepted(x, model)), _key)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``find_pii``."""
    count = lambda k: F.size(F.filter("base_spans", lambda x: x["kind"] == k)).cast("long")
    text = lambda c: F.concat_ws(",", F.transform(c, _label))
    return found.select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)), F.sha2(F.encode(text("base_spans"), "UTF-8"), 256).alias("base_sha256"), text("spans").alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with every span of their text replaced by its kind in angle brackets.

    Overlapping spans are merged under the kind of the first, of equal starts the longest. The other columns stay as they are.
    """
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")).withColumn("_text", F.col("_row").getField(text_col))
    df = candidates(packed, "_text").withColumnRenamed("_p_cands", "_cands")
    df = materialize(df, "pii_docs")
    model = train(df, "_cands")
    by_start = lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["end"].alias("end"), x["kind"].alias("kind"))
    df = df.withColumn("_s", F.sort_array(F.transform(F.filter("_cands", lambda x: accepted(x, model)), by_start)))
    s = F.col("_s")
    word = lambda x: F.concat(F.lit("<"), F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), F.lit(">"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(F.col("_text"), acc["pos"] + 1, F.greatest(x["start"] - acc["pos"], F.lit(0)))
        text = F.when(x["start"] >= acc["pos"], F.concat(acc["text"], gap, word(x))).otherwise(acc["text"])
        return F.struct(text.alias("text"), F.greatest(acc["pos"], x["end"]).alias("pos"))

    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("pos"))
    done = F.aggregate(s, start, step, lambda acc: F.concat(acc["text"], F.substring(F.col("_text"), acc["pos"] + 1, F.length("_text"))))
    new = F.when(F.size(s) > 0, done).otherwise(F.col("_text"))
    return df.select(*(new.alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns))
