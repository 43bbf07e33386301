"""Regular expressions as columns: flags, literals, matches with offsets, replacement that keeps fragments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode case, classes and word boundaries; only \n ends a line for the dot.
CI, CS = "(?iuUd)", "(?uUd)"


def matches(s: Column, pattern: str | Column) -> Column:
    """array<struct<a, b, m>> of all matches, half-open code-point offsets. The pattern must not match the empty string."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    parts = F.zip_with(F.split(s, p, -1), F.regexp_extract_all(s, p, F.lit(0)), lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int,m:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["g"])
        b = a + F.coalesce(F.length(x["m"]), F.lit(0))
        return F.struct(b.alias("at"), F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(a.alias("a"), b.alias("b"), x["m"].alias("m"))))).alias("out"))

    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def replace_by(s: Column, pattern: str | Column, by: Callable[[Column], Column]) -> Column:
    """Replace each match by an expression over the match alone."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.array_join(F.zip_with(F.split(s, p, -1), F.regexp_extract_all(s, p, F.lit(0)), lambda g, m: F.when(m.isNull(), g).otherwise(F.concat(g, by(m)))), "")


def stripped(s: Column, chars: str | None = None) -> Column:
    """Python's strip(): Unicode white space, or the given characters."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "") if chars is None else F.trim(s, F.lit(chars))
