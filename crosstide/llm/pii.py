"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

DataFrame functions only. A kind is found with one pattern: splitting the text
at its matches gives the pieces between them, so a match begins where the
lengths of all earlier pieces and matches end. Those lengths are summed in
blocks, and no match costs a second walk through the text. The patterns take
each character once: quantifiers are possessive, and a run of characters is
tried from its beginning only (or from the end of the match before, ``\\G``).

Base kinds (email, ip, card, phone) stay whatever their score is. Added kinds
(iban, ssn, secret) stay when their score reaches KEEP.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEAR = 40  # characters before a span in which a word counts as near it
BLOCK = 64
KEEP = 0.6


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    gate: str  # a text without a match of this has no span
    base: float  # score of a confirmed span
    words: str  # context that raises it
    more: float
    added: bool = False


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, r"mail|contact|write", 0.1),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.7, r"\bip\b|host|server|address", 0.2),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9]", 0.8, r"card|visa|credit|pay", 0.2),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.8, r"phone|tel|call|mobile|fax", 0.2),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}", 0.8, r"iban|account|bank", 0.2, True),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]", 0.4, r"ssn|social|security", 0.5, True),
    Kind("secret", r"(?<![A-Za-z0-9])[A-Fa-f0-9]{32,128}+(?![A-Za-z0-9])", r"[A-Fa-f0-9]{32}", 0.4, r"token|key|secret|password", 0.5, True),
)


def before_each(lengths: Column) -> Column:
    """For each number of an array the sum of the numbers before it, in blocks of BLOCK."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))

    def total(a):
        return F.aggregate(a, F.lit(0), lambda s, x: s + x)

    sums = F.transform(blocks, total)
    return F.flatten(
        F.transform(
            F.arrays_zip(blocks.alias("block"), F.transform(sums, lambda _, b: total(F.slice(sums, F.lit(1), b))).alias("before")),
            lambda z: F.transform(z["block"], lambda _, i: z["before"] + total(F.slice(z["block"], F.lit(1), i))),
        )
    )


def _added_lengths(numbers: Column, pieces: Column, *, texts: bool = False) -> Column:
    """To each number the length of the piece of text with its index."""
    return F.transform(numbers, lambda x, i: (F.length(x) if texts else x) + F.length(F.get(pieces, i)))


def luhn(digits: Column) -> Column:
    def weighed(total, i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when((F.length(digits) - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), weighed) % 10 == 0


def mod97(account: Column) -> Column:
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, F.lit(1), F.lit(4)))

    def step(rest, i):
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, rest * 100 + c - 55).otherwise(rest * 10 + c - 48) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        digits = F.regexp_replace(match, r"[\x20-]", "")
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(9, 15)
    if kind == "iban":
        account = F.regexp_replace(match, r"\x20", "")
        return F.when(F.length(account).between(15, 34), mod97(account)).otherwise(False)
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9)|-00-|0000$")
    return F.lit(True)


def _spans(kind: Kind) -> Column:
    """Structs (kind, start, end, score) of the confirmed spans, from the columns of ``find_personal_data``."""
    found, pieces, starts = F.col(f"found_{kind.name}"), F.col(f"pieces_{kind.name}"), F.col(f"starts_{kind.name}")

    def span(match, i):
        near = F.right(F.get(pieces, i), F.lit(NEAR))
        score = F.when(F.lower(near).rlike(kind.words), kind.base + kind.more).otherwise(F.lit(kind.base))
        start = F.get(starts, i)
        return F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.length(match)).alias("end"), score.alias("score"), match.alias("text"))

    spans = F.filter(F.transform(found, span), lambda s: confirmed(kind.name, s["text"]))
    return F.filter(spans, lambda s: s["score"] >= KEEP) if kind.added else spans


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text and the array ``spans``.

    A span is (kind, start, end, score, text); start and end count code points,
    end exclusive; by kind in the order of KINDS, then by start. A null text is
    an empty one and has no spans. Rows that repeat an id and rows without one
    are kept as they are. Other columns are not read.
    """
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    digit = F.col("text").rlike("[0-9]")
    out = out.withColumn("digit", digit)
    for kind in KINDS:
        gate = F.col("text").contains("@") if kind.gate == "@" else F.col("text").rlike(kind.gate)
        gate = gate if kind.name in ("email", "secret") else F.col("digit") & gate
        out = out.withColumn(f"found_{kind.name}", F.when(gate, F.regexp_extract_all("text", F.lit(kind.pattern), F.lit(0))).otherwise(none))
    for kind in KINDS:
        found = F.col(f"found_{kind.name}")
        out = out.withColumn(f"pieces_{kind.name}", F.when(F.size(found) > 0, F.split("text", kind.pattern, -1)))
    for kind in KINDS:
        found, pieces = F.col(f"found_{kind.name}"), F.col(f"pieces_{kind.name}")
        out = out.withColumn(f"gaps_{kind.name}", _added_lengths(found, pieces, texts=True))
    for kind in KINDS:
        found, gaps = F.col(f"found_{kind.name}"), F.col(f"gaps_{kind.name}")
        out = out.withColumn(f"before_{kind.name}", F.when(F.size(found) > 0, before_each(gaps)))
    for kind in KINDS:
        before, pieces = F.col(f"before_{kind.name}"), F.col(f"pieces_{kind.name}")
        out = out.withColumn(f"starts_{kind.name}", _added_lengths(before, pieces))
    return out.select("doc_id", "text", F.concat(*[_spans(kind) for kind in KINDS]).alias("spans"))


def personal_data_digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, the spans as text, counts of the added kinds and n_all, the count of all spans."""
    found = find_personal_data(docs)
    base = [k.name for k in KINDS if not k.added]

    def spelled(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[of(k) for k in base],
        F.sha2(spelled(F.filter("spans", lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"),
        spelled(F.col("spans")).alias("spans"),
        *[of(k.name) for k in KINDS if k.added],
        F.size("spans").cast("long").alias("n_all"),
    )
