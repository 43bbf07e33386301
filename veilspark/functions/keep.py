"""Technical parameters that must survive: fragments, spans and audit signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.dialect import CI, matches, replace_by

# Patterns of protected fragments.
OL_REF = CI + r"(?:Комплектация\s+по\s+обосновывающему\s+документу\s+)?[0-9A-Za-zА-Яа-яЁё][0-9A-Za-zА-Яа-яЁё._/\-]{4,}(?:[-.]ОЛК?\d*(?:-\d+)?)"
OL_PHRASE = CI + r"\bКомплектация\s+по\s+обосновывающему\s+документу\b"
FRAGMENTS = (
    CI + r"\bIP\d{2}[A-Z]?\b",
    CI + r"(?<!\w)(?:УХЛ|ХЛ)(?:\d(?:\.\d)?)?(?!\w)",
    CI + r"(?<!\w)(?:[012]?Ex[a-z]*II[ABC][TТ][1-6][A-Za-z0-9]*)(?!\w)",
    CI + r"(?<!\w)II[ABC][TТ][1-6](?!\w)",
    CI + r"(?<!\w)Exd(?!\w)",
    CI + r"\bDN\s*[-=]?\s*\d+(?:[.,]\d+)?\b",
    CI + r"\bPN\s*[-=]?\s*\d+(?:[.,]\d+)?\b",
    CI + r"\bRAL\s*\d{3,4}\b",
)
SDR = CI + r"\bSDR\s*\d+(?:[.,]\d+)?\b"
GOST = CI + r"\bГОСТ(?:\s+Р)?\s*[0-9][0-9.\-–—/]*"
PROTECTED = (
    *FRAGMENTS,
    OL_PHRASE,
    OL_REF,
    SDR,
    GOST,
    CI + r"\b(?:ОЛК?|опросный\s+лист)\b",
    CI + r"\bсталь\s+(?:марки\s+)?[A-Za-zА-Яа-я0-9.-]+\b",
    CI + r"(?<![A-Za-zА-Яа-я0-9])Ст\.?\s*[0-9]{1,3}[A-Za-zА-Яа-я0-9.-]*\b",
)
SIGNATURE = {
    "IP": FRAGMENTS[0],
    "UHL": CI + r"(?<!\w)(?:УХЛ|ХЛ)(?:\d(?:[.]\d)?)?(?!\w)",
    "EX": CI + r"(?<!\w)(?:[012]?Ex[a-z]*II[ABC][TТ][1-6][A-Za-z0-9]*|II[ABC][TТ][1-6]|Exd)(?!\w)",
    "DN": FRAGMENTS[5],
    "PN": FRAGMENTS[6],
    "RAL": FRAGMENTS[7],
    "SDR": SDR,
    "GOST": GOST,
    "OL": OL_REF,
    "INV": CI + r"\bинв[.]?\s*№?\s*[A-Za-zА-Яа-я0-9/._\-]+",
}
#: A cheap test: a text without any of these has no fragment.
_HINT = CI + r"IP\d|ХЛ|II[ABC]|Exd|DN|PN|RAL|ОЛ|обосновывающему"


def fragments(s: Column) -> Column:
    """array<string>: survey-sheet references first, then the other kinds in pattern order, each once."""
    # one expression over an array of patterns: a copy of it for each would make plans ten times as large
    found = lambda patterns: F.flatten(F.transform(F.array(*map(F.lit, patterns)), lambda p: matches(s, p)))
    absolute = found((OL_PHRASE, OL_REF))
    kept = F.filter(found(FRAGMENTS), lambda x: ~F.exists(absolute, lambda o: (o["a"] <= x["a"]) & (x["b"] <= o["b"])))
    values = F.filter(F.transform(F.concat(absolute, kept), lambda x: F.trim(x["m"], F.lit(" -_/.,;"))), lambda v: v != "")
    start = F.struct(F.array().cast("array<string>").alias("keys"), F.array().cast("array<string>").alias("out"))

    def once(acc: Column, v: Column) -> Column:
        key = F.replace(F.lower(v), F.lit(" "), F.lit(""))
        seen = F.array_contains(acc["keys"], key)
        return F.struct(F.when(seen, acc["keys"]).otherwise(F.array_append(acc["keys"], key)).alias("keys"), F.when(seen, acc["out"]).otherwise(F.array_append(acc["out"], v)).alias("out"))

    return F.when(s.rlike(_HINT), F.aggregate(values, start, once, lambda acc: acc["out"])).otherwise(F.array().cast("array<string>"))


def kept_of(m: Column) -> Column:
    """What stays of a removed match: its protected fragments between blanks, or one blank."""
    return F.when(m.rlike(_HINT), F.transform(F.array(fragments(m)), lambda f: F.when(F.size(f) > 0, F.concat(F.lit(" "), F.array_join(f, " "), F.lit(" "))).otherwise(" "))[0]).otherwise(" ")


def replace_keep(s: Column, pattern: str | Column) -> Column:
    """Remove matches but for their protected fragments. A match is looked at alone: its edges are string edges."""
    return F.when(F.rlike(s, F.lit(pattern) if isinstance(pattern, str) else pattern), replace_by(s, pattern, kept_of)).otherwise(s)


def keep_signature(s: Column) -> Column:
    """struct of a sorted token list for each of the ten kinds."""
    text = F.coalesce(s, F.lit(""))

    def tokens(p: str) -> Column:
        return F.array_sort(F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda m: F.regexp_replace(F.lower(F.regexp_replace(m, r"(?U)\s+", "")), r"[.,;:]+$", "")))

    return F.struct(*[tokens(p).alias(k) for k, p in SIGNATURE.items()])
