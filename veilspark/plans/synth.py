"""Item, rule, block and sheet tables derived from the numeric test tables; each expression also runs in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.plans.rulebase import GLOBALS, MARKERS, RuleBase


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: SQL shared by Spark and DuckDB; {s} is the name of the string type.
INN_SQL = "lpad(cast(s_suppkey as {s}), 10, '0')"
ALIAS_SQL = "concat('ООО \"Ромашка-', cast(s_suppkey as {s}), '-Прибор\"')"
NAME_SQL = (
    "concat('Кран шаровый ', p_name, ' DN', cast(p_size as {s}), case cast(p_partkey % 5 as integer) "
    "when 0 then concat(' ТУ 3742-', lpad(cast(p_partkey % 1000 as {s}), 3, '0'), '-', lpad(cast(p_partkey as {s}), 8, '0'), '-2012') "
    "when 1 then concat(' арт. ', cast(p_partkey as {s}), '-7/2') when 2 then concat(', ИНН ', lpad(cast(p_partkey as {s}), 10, '7')) "
    "when 3 then concat('  Заявка № ', cast(p_partkey as {s}), '/а') else ' , www.example.ru IP65' end)"
)


def sql(text: str, kind: str = "string") -> str:
    return text.replace("{s}", kind)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, name, code, factory from `part`."""
    maker = "case cast(p_partkey % 3 as integer) when 0 then concat('ООО \"Ромашка-', cast(p_partkey % 10 + 1 as string), '-Прибор\"') else '' end"
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.expr(sql(NAME_SQL)).alias("name"), F.expr("concat('6410-', cast(100000 + p_partkey % 50 as string), '-3')").alias("code"), F.expr(maker).alias("factory"))


def rule_base(spark: SparkSession, sf_dir: str) -> RuleBase:
    """Two aliases and two rules a supplier; registry codes for a few of them."""
    s = table(spark, sf_dir, "supplier")
    inn, alias = F.expr(sql(INN_SQL)).alias("inn"), F.expr(sql(ALIAS_SQL))
    key = F.col("s_suppkey").cast("int")
    aliases = s.select((key * 2).alias("ord"), inn, F.expr("concat('Ромашка-', cast(s_suppkey as string), '-Прибор')").alias("alias"), alias.alias("manufacturer")).unionByName(
        s.select((key * 2 + 1).alias("ord"), inn, F.expr("concat('Ромашка-', cast(s_suppkey % 7 as string))").alias("alias"), alias.alias("manufacturer"))
    )
    rules = s.select((key * 2).alias("ord"), inn, alias.alias("manufacturer"), F.expr("concat('РПК', cast(s_suppkey as string), '-')").alias("trigger"), F.lit("Начало фирменного обозначения").alias("apply"), F.lit("префикс").alias("type")).unionByName(
        s.select((key * 2 + 1).alias("ord"), inn, alias.alias("manufacturer"), F.expr("concat('ВЕКТА', cast(s_suppkey % 9 as string))").alias("trigger"), F.lit("Бренд + соседний индекс").alias("apply"), F.lit("бренд").alias("type"))
    )
    registry = s.where("s_suppkey <= 20").select(F.expr("cast(100000 + s_suppkey as string)").alias("code"), F.expr(sql("concat('АО Прибор ИНН ', " + INN_SQL + ")")).alias("factory"))
    markers = spark.createDataFrame([(0, "ТУ 0000-001-00000001", "0000000002", "")], MARKERS)
    everyone = spark.createDataFrame([(0, "ZETTA-", None, "Начало фирменного обозначения", "")], GLOBALS)
    return RuleBase(rules, aliases, registry, markers, everyone)


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page blocks from `lineitem`: a page is an order, a block a line."""
    text = (
        "case cast((l_orderkey + l_linenumber) % 4 as integer) when 0 then 'Поставщик ИНН' when 1 then lpad(cast(l_partkey as string), 10, '5') "
        "when 2 then 'Труба ТУ 2531-' else '002-53597015-12' end"
    )
    top = "cast(l_linenumber * 100 + l_partkey % 50 as double)"
    return table(spark, sf_dir, "lineitem").selectExpr("'f' as file", "cast(l_orderkey as int) as page", "800.0D as page_h", "cast(l_linenumber as int) as block", f"{text} as text", "cast(l_suppkey % 60 as double) as x0", f"{top} as y0", "cast(l_suppkey % 60 + 200 as double) as x1", f"{top} + 12 as y1")
