"""Anonymize item names: global rules, maker rules, aliases and system rules, repeated to a fixpoint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.dialect import replace_by
from veilspark.functions.keep import kept_of
from veilspark.functions.normalize import normalize_name
from veilspark.functions.system_rules import cleanup
from veilspark.operators.contain import lookup
from veilspark.operators.resolve import identify_in_text, resolve_factory
from veilspark.plans.rulebase import RuleBase
from veilspark.plans.scratch import discard, saved

# Status words and the reason of the second.
GREEN, YELLOW = "ЗЕЛЁНЫЙ", "ЖЁЛТЫЙ"
REASON = "Производитель не определён: применены только безопасные системные правила"
MAX_PASSES = 8
_NONE = "array<struct<label:string,pattern:string>>"


def _fold(state: Column, rules: Column, keep: bool = True) -> Column:
    """Apply rules in order to struct<s, applied>; a rule that fires logs its label."""

    def step(acc: Column, r: Column) -> Column:
        fired = F.rlike(acc["s"], r["pattern"])
        new = replace_by(acc["s"], r["pattern"], kept_of) if keep else F.regexp_replace(acc["s"], r["pattern"], F.lit(" "))
        return F.struct(F.when(fired, new).otherwise(acc["s"]).alias("s"), F.when(fired, F.array_append(acc["applied"], r["label"])).otherwise(acc["applied"]).alias("applied"))

    return F.aggregate(rules, state, step)


def _alias_steps(aliases: Column) -> Column:
    """Each alias gives two steps: the alias itself, then its normalized form with a model code beside it."""
    pairs = F.transform(aliases, lambda a: F.array(F.struct(a["label"].alias("label"), a["pattern"].alias("pattern"), F.lit(False).alias("keep")), F.struct(a["norm"].alias("label"), a["model"].alias("pattern"), F.lit(True).alias("keep"))))
    return F.filter(F.flatten(pairs), lambda x: x["pattern"].isNotNull())


def _one_pass(rows: DataFrame, base: RuleBase) -> DataFrame:
    """rows (row_id, s, factory, inn, ...) with `s` rewritten and `fired` the labels of this pass."""
    rules_of = base.patterns_by_inn().withColumnRenamed("rules", "by_inn")
    named = base.patterns_by_name().withColumnRenamed("rules", "by_name")
    everyone = base.global_patterns().agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label", "pattern"))), lambda x: F.struct(x["label"].alias("label"), x["pattern"].alias("pattern"))).alias("for_all"))  # one row
    # rules join last: rows that carry them are wide, and are neither shuffled nor sorted
    ruled = base.patterns_by_inn().select("inn", F.lit(True).alias("ruled"))
    df = lookup(rows, "inn", "row_id", ruled).withColumn("name_key", F.when(F.col("ruled").isNull(), normalize_name(F.col("factory"))))
    df = lookup(lookup(df, "name_key", "row_id", named), "inn", "row_id", rules_of, base.alias_patterns()).crossJoin(F.broadcast(everyone))  # a single row of global rules
    empty = F.array().cast(_NONE)
    state = F.struct(F.col("s"), F.array().cast("array<string>").alias("applied"))
    df = df.withColumn("st", _fold(state, F.col("for_all")))
    df = df.withColumn("st", _fold(F.col("st"), F.coalesce("by_inn", "by_name", empty)))
    steps = F.when(F.col("inn") != "", _alias_steps(F.col("aliases")))

    def step(acc: Column, r: Column) -> Column:
        fired = F.rlike(acc["s"], r["pattern"])
        new = F.when(r["keep"], replace_by(acc["s"], r["pattern"], kept_of)).otherwise(F.regexp_replace(acc["s"], r["pattern"], F.lit(" ")))
        return F.struct(F.when(fired, new).otherwise(acc["s"]).alias("s"), F.when(fired, F.array_append(acc["applied"], r["label"])).otherwise(acc["applied"]).alias("applied"))

    df = df.withColumn("st", F.when(F.size(F.coalesce(steps, F.array().cast("array<struct<label:string,pattern:string,keep:boolean>>"))) > 0, F.aggregate(steps, F.col("st"), step)).otherwise(F.col("st")))
    df = df.withColumn("s", F.col("st.s")).withColumn("fired", F.col("st.applied"))
    return cleanup(df, "s").select(*rows.columns, "fired")


def anonymize(items: DataFrame, base: RuleBase) -> DataFrame:
    """Items (row_id, name, code, factory) -> row_id, text, status, reason, factory, inn, applied, changed.

    Rows that have settled leave the loop; each pass works on the rest, MAX_PASSES at most.
    """
    base = base.indexed()
    rows = items.select("row_id", F.coalesce("name", F.lit("")).alias("original"), F.coalesce("code", F.lit("")).alias("code"), F.coalesce("factory", F.lit("")).alias("factory")).repartition("row_id")  # a small file may hold many rows
    fixed = resolve_factory(rows, base).select("row_id", F.col("factory").alias("fixed_factory"), F.col("inn").alias("fixed_inn"))
    rows = saved(rows.select("row_id", "original").join(fixed, "row_id"), "resolved")
    names = base.maker_names().select("inn", F.col("manufacturer").alias("named"))
    found = identify_in_text(rows.where("fixed_inn = ''"), base, "original")
    rows = rows.join(found.withColumnRenamed("inn", "guess"), "row_id", "left").withColumn("inn", F.coalesce(F.nullif("fixed_inn", F.lit("")), "guess", F.lit("")))
    rows = lookup(rows, "inn", "row_id", names).withColumn("factory", F.when((F.col("fixed_inn") == "") & (F.col("inn") != ""), F.coalesce("named", "fixed_factory")).otherwise(F.col("fixed_factory")))
    rows = rows.withColumn("s", F.col("original")).withColumn("applied", F.array().cast("array<string>")).withColumn("ever", F.col("inn") != "")
    columns = ("row_id", "original", "fixed_factory", "fixed_inn", "inn", "factory", "s", "applied", "ever")
    active, done = saved(rows.select(*columns)), None
    for turn in range(MAX_PASSES):
        # written, as the makers are looked for in it: else the plan would hold, and run, the whole pass for each of its readers
        passed = saved(_one_pass(active.withColumn("before", F.col("s")), base).withColumn("applied", F.concat("applied", "fired")), "passed")
        after = passed
        again = identify_in_text(after.where("fixed_inn = ''"), base, "s").select("row_id", F.col("inn").alias("guess"))
        after = lookup(after.join(again, "row_id", "left"), "guess", "row_id", names.select(F.col("inn").alias("guess"), F.col("named")))
        next_inn = F.when(F.col("fixed_inn") != "", F.col("inn")).otherwise(F.coalesce("guess", F.lit("")))
        next_factory = F.when(F.col("fixed_inn") != "", F.col("factory")).when(F.col("guess").isNotNull(), F.coalesce("named", "factory")).otherwise("")
        after = after.withColumn("settled", (F.col("s") == F.col("before")) & (next_inn == F.col("inn"))).withColumn("ever", F.col("ever") | F.col("guess").isNotNull())
        after = after.withColumn("factory", F.when(F.col("settled"), F.col("factory")).otherwise(next_factory)).withColumn("inn", F.when(F.col("settled"), F.col("inn")).otherwise(next_inn))
        after = saved(after.select(*columns, "settled"))
        discard(passed)
        last = turn == MAX_PASSES - 1
        finished = after.select(*columns) if last else after.where("settled").select(*columns)
        done = finished if done is None else done.unionByName(finished)
        active = after.where("not settled").select(*columns)
        if last or active.isEmpty():
            break
    green = (F.col("fixed_inn") != "") | F.col("ever") | (F.size("applied") > 0)
    return done.select(
        "row_id", F.col("s").alias("text"), F.when(green, GREEN).otherwise(YELLOW).alias("status"), F.when(green, "").otherwise(REASON).alias("reason"),
        F.coalesce(F.nullif("fixed_factory", F.lit("")), "factory").alias("factory"), F.coalesce(F.nullif("fixed_inn", F.lit("")), "inn").alias("inn"), "applied", (F.col("s") != F.col("original")).alias("changed"),
    )
