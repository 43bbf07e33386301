"""Scalar normalizations as column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.dialect import CI, stripped

# Quote characters that names lose, legal forms that names lose.
QUOTES = "\"«»“”„"
LEGAL_WORDS = "ооо|ао|зао|оао|пао|фгуп|нпо|нпп|нпф|нтк|нтц|общество с ограниченной ответственностью|акционерное общество"
INN = CI + r"\bИНН\s*([0-9]{10,12})\b"


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def normalize_name(c: Column) -> Column:
    s = F.translate(F.translate(F.lower(_text(c)), "ё", "е"), QUOTES, "")
    s = F.regexp_replace(s, CI + rf"\b({LEGAL_WORDS})\b", " ")
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "), F.lit(" ,."))


def extract_inn(c: Column) -> Column:
    return F.regexp_extract(_text(c), INN, 1)


def normalize_code(c: Column) -> Column:
    return F.regexp_replace(stripped(_text(c)), r"^(-?\d+)\.0$", "$1")


def code_candidates(c: Column) -> Column:
    """The whole code, then its groups of 4 to 9 digits, longest first, ties in order, without repeats."""
    s = normalize_code(c)
    groups = F.regexp_extract_all(s, F.lit(r"(?<!\d)(\d{4,9})(?!\d)"), F.lit(1))
    ranked = F.array_sort(F.transform(groups, lambda g, i: F.struct((-F.length(g)).alias("n"), i.alias("i"), g.alias("g"))))
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(F.array(s), F.transform(ranked, lambda x: x["g"]))))


def normalize_header(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(stripped(_text(c))), "ё", "е"), r"(?U)\s+", " ")


def title_key(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(stripped(_text(c))), "ё_", "е "), r"(?U)\s+", " ")


def words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?U)\w+"), F.lit(0)))
