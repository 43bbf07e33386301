"""Who made an item: registry, tax id, alias and marker joins. Ties go to the longest, then alphabetically."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions.dialect import stripped
from veilspark.functions.normalize import code_candidates, extract_inn, normalize_name, words
from veilspark.operators.contain import lookup, met
from veilspark.plans.rulebase import GENERIC_NOUNS, LEAST_ALIAS, MARKER_STARTS, RuleBase, quoted_column


def registry_lookup(df: DataFrame, base: RuleBase, key: str = "row_id") -> DataFrame:
    """(key, factory): what the registry says for the first of a row's code candidates that it has."""
    spread = df.select(key, F.posexplode(code_candidates(F.col("code"))).alias("pos", "candidate"))
    known = base.registry.where("factory <> ''").select(F.col("code").alias("candidate"), F.col("factory").alias("found"))
    return spread.join(known, "candidate").groupBy(key).agg(F.min_by("found", "pos").alias("factory"))


def longest_alias(df: DataFrame, base: RuleBase, text: str, key: str = "row_id", whole_words: bool = False) -> DataFrame:
    """(key, alias_norm, inn): the longest alias inside a normalized text that has the alias's first word as a word.

    With whole_words it must stand between word boundaries and be no common noun.
    """
    index = base.alias_index().where(F.length("alias_norm") >= LEAST_ALIAS).where("first_word <> ''").withColumnRenamed("inn", "alias_inn")
    if whole_words:
        index = index.where(~F.col("alias_norm").isin(*GENERIC_NOUNS))
    # texts meet aliases by hashes
    hit = met(df, key, F.col(text), index, "alias_norm", (LEAST_ALIAS,), base.alias_net()).where(F.col("__t").contains(F.col("alias_norm")))
    if whole_words:
        hit = hit.where(F.rlike("__t", F.concat(F.lit(r"(?iuUd)(?<!\w)"), quoted_column(F.col("alias_norm")), F.lit(r"(?!\w)"))))
    else:
        hit = hit.where(F.array_contains(words(F.col("__t")), F.col("first_word")))
    best = F.min(F.struct((-F.length("alias_norm")).alias("n"), "alias_norm", "alias_inn"))
    return hit.groupBy(key).agg(best.alias("b")).select(key, "b.alias_norm", F.col("b.alias_inn").alias("inn"))


def resolve_factory(df: DataFrame, base: RuleBase, key: str = "row_id") -> DataFrame:
    """(key, factory, inn) of rows (key, code, factory): registry, then tax id, exact alias, alias inside; else inn ''."""
    rows = df.select(key, "code", stripped(F.coalesce("factory", F.lit(""))).alias("given"))
    rows = rows.join(registry_lookup(rows, base, key), key, "left").select(key, F.coalesce("factory", "given").alias("factory"))
    rows = rows.withColumn("own_inn", extract_inn(F.col("factory"))).withColumn("nf", normalize_name(F.col("factory")))
    known = base.known_inns().select(F.col("inn").alias("own_inn"), F.lit(True).alias("known"))
    exact = base.alias_index().select(F.col("alias_norm").alias("nf"), F.col("inn").alias("exact_inn"))
    rows = lookup(lookup(rows, "own_inn", key, known), "nf", key, exact)
    open_rows = rows.where("known is null and exact_inn is null and nf <> ''")
    inside = longest_alias(open_rows, base, "nf", key).select(key, F.col("inn").alias("inside_inn"))
    rows = rows.join(inside, key, "left")
    names = base.maker_names().select(F.col("inn").alias("exact_inn"), F.col("manufacturer").alias("exact_name"))
    rows = lookup(rows, "exact_inn", key, names)
    inn = F.when(F.col("known"), F.col("own_inn")).when(F.col("nf") == "", "").otherwise(F.coalesce("exact_inn", "inside_inn", F.lit("")))
    factory = F.when(F.col("known").isNull() & F.col("exact_inn").isNotNull() & (F.col("factory") == ""), F.coalesce("exact_name", F.lit(""))).otherwise(F.col("factory"))
    return rows.select(key, factory.alias("factory"), inn.alias("inn"))


def identify_in_text(df: DataFrame, base: RuleBase, text: str = "text", key: str = "row_id") -> DataFrame:
    """(key, inn) of the rows whose text names a maker: a known tax id, else the longest whole alias."""
    rows = df.select(key, text).repartition(key).select(key, extract_inn(F.col(text)).alias("own_inn"), normalize_name(F.col(text)).alias("nt"))
    rows = lookup(rows, "own_inn", key, base.known_inns().select(F.col("inn").alias("own_inn"), F.lit(True).alias("known")))
    inside = longest_alias(rows.where("known is null"), base, "nt", key, whole_words=True).select(key, F.col("inn").alias("inside_inn"))
    return rows.join(inside, key, "left").select(key, F.when(F.col("known"), F.col("own_inn")).otherwise(F.col("inside_inn")).alias("inn")).where("inn is not null")


def identify_marker(df: DataFrame, base: RuleBase, text: str = "text", key: str = "row_id") -> DataFrame:
    """(key, inn, factory): the longest verified marker inside a text, as written."""
    solid = lambda c: stripped(F.col(c)).alias(c)
    marks = base.markers.select("ord", stripped(F.col("contains")).alias("marker"), solid("inn"), solid("manufacturer")).where("marker <> '' and inn <> ''")
    names = base.maker_names().select("inn", F.col("manufacturer").alias("named"))
    marks = marks.join(names, "inn", "left").select("ord", "marker", "inn", F.coalesce(F.nullif("manufacturer", F.lit("")), "named", F.lit("")).alias("factory"))
    rows = df.select(key, text).repartition(key)  # a small file may hold many rows
    hit = met(rows, key, F.col(text), marks, "marker", MARKER_STARTS, base.marker_net()).where(F.col("__t").contains(F.col("marker")))
    return hit.groupBy(key).agg(F.min(F.struct((-F.length("marker")).alias("n"), "ord", "inn", "factory")).alias("b")).select(key, "b.inn", "b.factory")
