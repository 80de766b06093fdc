"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Only built-in functions are used. Positions come from the pieces between the
matches: a match starts where the pieces and matches before it end.

Every pattern is written so that one pass over the text finds all matches:
possessive repeats, and a start only at the head of a run of its characters or
where the last match ended. They find what the plain patterns in PLAIN find.

A null text is an empty text. Texts are never cut. Positions are code points.
A text with k matches of a kind costs k array appends, no join and no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailmill.llm.tables import bound

# The plain patterns of the four base kinds, in the order of kinds.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = PLAIN["phone"]
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_SECRET = r"(?<![A-Za-z0-9])[A-Fa-f0-9]{32,128}(?![A-Za-z0-9])"

WINDOW = 40
"""Code points before a span in which context words count."""


@dataclass(frozen=True)
class Kind:
    """`base` spans always stay; the others need `keep` as score."""

    name: str
    pattern: str
    score: float
    raised: float
    context: str
    base: bool = False


KINDS = (
    Kind("email", _EMAIL, 0.9, 0.1, r"mail|contact|address|correo|adresse", True),
    Kind("ip", _IP, 0.6, 0.3, r"\bip\b|address|host|server|login", True),
    Kind("card", _CARD, 0.8, 0.2, r"card|visa|credit|carte|karte|tarjeta|pay", True),
    Kind("phone", _PHONE, 0.7, 0.2, r"phone|call|tel|mobile|fax|anruf", True),
    Kind("iban", _IBAN, 0.8, 0.2, r"iban|bank|account|konto|compte|cuenta"),
    Kind("ssn", _SSN, 0.3, 0.5, r"ssn|social security|tax id"),
    Kind("secret", _SECRET, 0.2, 0.6, r"token|secret|api.?key|password|passwd|bearer"),
)
KEEP = 0.5

SPAN_TYPE = "array<struct<start:int,end:int,text:string>>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a text of digits only passes the Luhn check."""

    def step(total: Column, at: Column) -> Column:
        d = F.substring(digits, at, F.lit(1)).cast("int")
        twice = d * 2
        odd = (F.length(digits) - at) % 2 == 1
        return total + F.when(odd, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step)
    return (F.length(digits) > 0) & (total % 10 == 0)


def mod97(account: Column) -> Column:
    """Whether an account number in international form leaves 1 when divided by 97."""
    plain = F.replace(account, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def step(rest: Column, char: Column) -> Column:
        code = F.ascii(char)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(step(r, c))) == 1


def _valid(kind: str, text: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(text, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.when(F.length(p) <= 3, p.cast("int")) <= 255))
    if kind == "card":
        return bound(_digits(text), lambda d: F.length(d).between(12, 19) & F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(text)).between(9, 15)
    if kind == "iban":
        return mod97(text)
    if kind == "ssn":
        return ~text.rlike("^(?:000|666|9)") & ~text.rlike("-00-|-0000$")
    return F.lit(True)


def _possible(kind: str, text: Column) -> Column:
    """A cheap test that must hold where the pattern can match."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    return text.rlike("[0-9]")


def matches(text: Column, pattern: str) -> Column:
    """Start, end and text of each match, leftmost first, none overlapping."""

    def placed(found: Column) -> Column:
        pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        pairs = F.zip_with(pieces, found, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN_TYPE).alias("spans"))

        def step(done: Column, pair: Column) -> Column:
            begin = done["at"] + pair["gap"]
            end = begin + F.length(pair["m"])
            span = F.struct(begin.alias("start"), end.alias("end"), pair["m"].alias("text"))
            return F.struct(end.alias("at"), F.concat(done["spans"], F.array(span)).alias("spans"))

        return F.aggregate(pairs, start, step, lambda done: done["spans"])

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return bound(found, lambda f: F.when(F.size(f) > 0, placed(f)).otherwise(F.array().cast(SPAN_TYPE)))


def _kind_spans(text: Column, kind: Kind) -> Column:
    """Confirmed spans of a kind with their scores."""

    def scored(span: Column) -> Column:
        begin = F.greatest(span["start"] - WINDOW, F.lit(0))
        before = F.lower(F.substring(text, begin + 1, span["start"] - begin))
        near = before.rlike(kind.context)
        score = F.lit(kind.score) + F.when(near, F.lit(kind.raised)).otherwise(F.lit(0.0))
        return F.struct(
            F.lit(kind.name).alias("kind"), span["start"].alias("start"), span["end"].alias("end"),
            span["text"].alias("text"), score.alias("score"),
        )

    confirmed = F.filter(matches(text, kind.pattern), lambda s: _valid(kind.name, s["text"]))
    spans = F.transform(confirmed, scored)
    if not kind.base:
        spans = F.filter(spans, lambda s: s["score"] >= KEEP)
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,text:string,score:double>>")
    return F.when(_possible(kind.name, text), spans).otherwise(empty)


def find_pii(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """Adds `into`: an array of (kind, start, end, text, score), kind by kind, each from left to right.

    A column that has that name already is replaced. Null texts have no spans.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(into, bound(body, lambda t: F.concat(*[_kind_spans(t, k) for k in KINDS])))


def _joined(spans: Column) -> Column:
    """Spans as kind:start:end by start, then kind in the order of KINDS."""
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k.name, i)])
    keyed = F.transform(
        spans, lambda s: F.struct(s["start"].alias("a"), rank[s["kind"]].alias("b"), F.concat_ws(":", s["kind"], s["start"], s["end"]).alias("c"))
    )
    return F.concat_ws(",", F.transform(F.array_sort(keyed), lambda s: s["c"]))


def pii_digest(found: DataFrame) -> DataFrame:
    """Counts and digests of `find_pii`, a row per document."""
    base = [k.name for k in KINDS if k.base]
    count = lambda name: F.size(F.filter("pii", lambda s: s["kind"] == name)).cast("long")
    return found.select(
        "doc_id",
        *[count(name).alias(f"n_{name}") for name in base],
        F.sha2(_joined(F.filter("pii", lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("pii")).alias("spans"),
    )
