"""Personal data: patterns propose spans, checksums (Luhn, mod-97) confirm them, context words adjust the score. Column expressions only.

Spans come from two arrays of one pattern: the matches and the pieces between them (regexp_extract_all, split). Running sums of their
lengths give offsets in code points. Each pattern is written so that the engine never tries again what it has failed on (possessive
repetition; a match starts where its run of characters starts or where the last match ended), which leaves the leftmost matches as they
are and keeps the time linear in the text. Repetitions carry the least length where a
shorter run would be dropped anyway. A cheap test decides per text whether a pattern runs at all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.spans import joined, located


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    maybe: Callable[[Column], Column]  # False only for texts without a match
    valid: Callable[[Column], Column]
    score: float
    words: str  # context, as a pattern over lower-case text
    base: bool = True
    threshold: float = 0.0


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def mod97(m: Column) -> Column:
    """ISO 7064 remainder of an IBAN-like string: the first four characters go last, letters count 10 to 35."""
    s = F.regexp_replace(m, " ", "")
    chars = F.split(F.concat(F.substring(s, 5, 1 << 20), F.substring(s, 1, 4)), "")
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0), lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: Kinds in order, their patterns and context words.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: F.contains(t, F.lit("@")), lambda m: F.lit(True), 0.8, r"mail|contact|write to|kontakt|correo|courriel"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+", lambda t: F.rlike(t, F.lit(r"[0-9]\.[0-9]")), lambda m: F.rlike(m, F.lit(rf"^{_PART}(?:\.{_PART}){{3}}$")), 0.6, r"\bip\b|address|host|server|adresse|direcci"),
    Kind("card", r"[0-9](?:[ -]?[0-9]){15,}+", lambda t: F.rlike(t, F.lit(r"[0-9](?:[ -]?[0-9]){15}")), lambda m: F.length(_digits(m)).between(16, 19) & F.call_function("luhn_check", _digits(m)), 0.7, r"card|visa|credit|debit|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda t: F.rlike(t, F.lit(r"\+[0-9]")), lambda m: F.length(_digits(m)).between(8, 15), 0.7, r"phone|call|tel|mobile|anruf|llam|appel"),
    Kind("iban", r"(?:(?<![A-Za-z0-9])|\G)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", lambda t: F.rlike(t, F.lit(r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]")), lambda m: mod97(m) == 1, 0.6, r"iban|account|bank|konto|cuenta|compte", False, 0.5),
    Kind("ssn", r"(?:(?<![0-9-])|\G)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda t: F.rlike(t, F.lit(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")), lambda m: ~F.rlike(m, F.lit(r"^(?:000|666|9)|-00-|-0000$")), 0.3, r"\bssn\b|social security|tax id|steuer", False, 0.5),
)

#: What a context word within WINDOW code points before a span adds to its score.
WINDOW, BOOST = 40, 0.25

EMPTY = "array<struct<kind:string,start:int,end:int,score:double>>"


def find(text: Column, kind: Kind) -> Column:
    """A kind's confirmed spans with their scores."""

    def scored(s: Column) -> Column:
        score = F.least(F.lit(kind.score) + F.when(F.rlike(F.lower(s["near"]), F.lit(kind.words)), F.lit(BOOST)).otherwise(F.lit(0.0)), F.lit(1.0))
        return F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score.alias("score"))

    spans = F.transform(F.filter(located(text, kind.pattern, WINDOW), lambda s: kind.valid(s["m"])), scored)
    if kind.threshold:
        spans = F.filter(spans, lambda s: s["score"] >= kind.threshold)
    return F.when(kind.maybe(text), spans).otherwise(F.array().cast(EMPTY))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """(id, one array of spans (kind, start, end, score) for each kind, named after it).

    No shuffle, one read; the time is linear in a text and its matches. Null and empty texts have empty arrays; repeated rows and ids give a row each; other columns are left out.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.select(F.col("id").alias(id_col), *[find(F.col("t"), k).alias(f"pii_{k.name}") for k in kinds])


def pii_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Counts and span lists per row; scores are joined in the same order as spans, with two decimals."""
    found = find_pii(docs, id_col, text_col, kinds)
    base = F.concat(*[F.col(f"pii_{k.name}") for k in kinds if k.base])
    every = F.concat(*[F.col(f"pii_{k.name}") for k in kinds])
    counts = [F.size(f"pii_{k.name}").cast("long").alias(f"n_{k.name}") for k in kinds if k.base]
    scores = F.concat_ws(",", F.transform(every, lambda s: F.format_number(s["score"], 2)))
    return found.select(F.col(id_col), *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(every).alias("spans"), scores.alias("scores"))
