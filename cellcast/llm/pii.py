"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

All of it is column expressions over one document, so nothing is shuffled and no Python runs.
Patterns are possessive and start only where a run of their characters starts, which keeps
matching linear on texts of any length; both changes leave the set of matches as it was.

Defined results: null or empty text has no spans; spans count code points, end exclusive; every
row is answered by itself, so repeated rows, equal ids and an empty table need no rule; other columns
pass through, and a column named like the result is replaced by it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellcast.llm.common import full_text, located


def passes_luhn(digits: Column) -> Column:
    """Luhn checksum of a digit string."""
    backwards = F.split(F.reverse(digits), "")

    def term(d: Column, i: Column) -> Column:
        twice = d.cast("int") * 2
        return F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(backwards, term), F.lit(0), lambda a, x: a + x) % 10 == 0


def passes_mod97(account: Column) -> Column:
    """ISO 7064 check of an account number: country and check digits last, letters as 10 to 35."""
    moved = F.concat(F.substring(account, 5, 40), F.substring(account, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.rlike("[0-9]"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + letter) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), add) == 1


def _small_parts(match: Column) -> Column:
    """All four parts at most 255, leading zeros allowed."""
    return ~F.exists(
        F.split(match, r"\."),
        lambda p: ~F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"),
    )


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


@dataclass(frozen=True)
class Kind:
    """One kind of personal data. ``score`` stands before context; a confirmed span starts from it."""

    name: str
    pattern: str
    hint: str
    confirm: Callable[[Column], Column]
    score: float
    words: str


#: In order of rank. The first four are the base kinds: their scores pass the threshold alone.
KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@", lambda m: F.lit(True), 0.8, "mail|contact|write|kontakt|correo|courriel",
    ),
    Kind(
        "ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", _small_parts, 0.7,
        "ip|host|server|address|login",
    ),
    Kind(
        "card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){11}",
        lambda m: F.length(_digits(m)).between(12, 19) & passes_luhn(_digits(m)), 0.8,
        "card|visa|credit|karte|carte|tarjeta",
    ),
    Kind(
        "phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]",
        lambda m: F.length(_digits(m)).between(9, 15), 0.7, "phone|call|tel|mobil|fax|dial",
    ),
    Kind(
        "iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        "[A-Z]{2}[0-9]{2}", lambda m: passes_mod97(F.regexp_replace(m, " ", "")), 0.8, "iban|account|konto|compte|cuenta",
    ),
    Kind(
        "national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]{3}-[0-9]{2}-",
        lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"), 0.3, "ssn|social security|national id|tax id",
    ),
)
BASE = tuple(k.name for k in KINDS[:4])
#: A context word within this many characters of a span raises its score; the result lists spans from the threshold.
NEAR, RAISE, THRESHOLD = 40, 0.3, 0.5


def _spans(text: Column, rank: int, kind: Kind) -> Column:
    near = rf"(?i)\b(?:{kind.words})"

    def span(m: Column) -> Column:
        context = F.right(m["before"], F.lit(NEAR)).rlike(near) | F.left(m["after"], F.lit(NEAR)).rlike(near)
        score = F.least(F.lit(1.0), F.lit(kind.score) + F.when(context, RAISE).otherwise(0.0))
        return F.struct(
            m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind.name).alias("kind"),
            F.round(score, 2).alias("score"), m["match"].alias("match"),
        )

    found = located(text, kind.pattern, text.rlike(kind.hint))
    confirmed = F.filter(found, lambda m: kind.confirm(m["match"]))
    return F.filter(F.transform(confirmed, span), lambda s: s["score"] >= THRESHOLD)


def find(df: DataFrame, text: str = "text", out: str = "personal") -> DataFrame:
    """``df`` with an array of spans (start, rank, end, kind, score, match), by start, then rank."""
    df = df.drop(*[c for c in df.columns if c.lower() == out.lower()])
    body = full_text(text)
    # One column per kind first, so that every pattern stands once in the plan.
    parts = {f"__{out}_{k.name}": _spans(body, i, k) for i, k in enumerate(KINDS)}
    wide = df.withColumns(parts)
    every = F.concat(*[F.col(c) for c in parts])
    return wide.withColumn(out, F.array_sort(every)).drop(*parts)
