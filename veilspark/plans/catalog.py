"""The queries of the redaction engine and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspark.functions import normalize as N
from veilspark.functions.keep import fragments, keep_signature, replace_keep
from veilspark.functions.system_rules import ARTICLE, CONTACT, TU_CODE, cleanup
from veilspark.operators import audit, intervals, layout, pages, resolve, spans
from veilspark.operators.anonymize import anonymize
from veilspark.plans import rule_rows, synth
from veilspark.plans.synth import INN_SQL, NAME_SQL, table
from veilspark.sources import sheets

QUERIES: dict = {**rule_rows.QUERIES}
ORACLE_SQL: dict[str, str] = {**rule_rows.ORACLE_SQL}
_NAME = NAME_SQL.replace("{s}", "varchar")
_INN = INN_SQL.replace("{s}", "varchar")
_ITEMS = f"items AS (SELECT p_partkey AS row_id, {_NAME} AS name FROM part)"
_SUPPLIER = f"s AS (SELECT s_suppkey, {_INN} AS inn, 'ООО \"Ромашка-' || s_suppkey || '-Прибор\"' AS maker FROM supplier)"
# aliases as the first of equal normalized ones has them
_ALIASES = f"""{_SUPPLIER}, a AS (SELECT s_suppkey * 2 AS ord, inn, 'Ромашка-' || s_suppkey || '-Прибор' AS alias FROM s UNION ALL SELECT s_suppkey * 2 + 1, inn, 'Ромашка-' || (s_suppkey % 7) FROM s),
 idx AS (SELECT lower(alias) AS alias_norm, arg_min(inn, ord) AS inn FROM a GROUP BY 1)"""

# the maker of each item: the registry's, else the one given, and its inn by tax id, exact alias or alias inside
_MADE = """f AS (SELECT p_partkey AS row_id, p_partkey % 50 AS k, CASE WHEN p_partkey % 3 = 0 THEN 'ООО "Ромашка-' || (p_partkey % 10 + 1) || '-Прибор"' ELSE '' END AS given FROM part),
made AS (SELECT row_id, CASE WHEN k BETWEEN 0 AND least(20, (SELECT max(s_suppkey) FROM s)) THEN 'АО Прибор ИНН ' || lpad(CAST(k AS VARCHAR), 10, '0') ELSE given END AS factory,
 CASE WHEN k BETWEEN 0 AND least(20, (SELECT max(s_suppkey) FROM s)) THEN lpad(CAST(k AS VARCHAR), 10, '0') WHEN given = '' THEN ''
 ELSE coalesce(idx.inn, (SELECT arg_max(i.inn, length(i.alias_norm)) FROM idx i WHERE length(i.alias_norm) >= 7 AND contains(lower(given), i.alias_norm)), '') END AS inn
FROM f LEFT JOIN idx ON alias_norm = replace(replace(lower(given), 'ооо "', ''), '"', ''))"""
_CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace(
 regexp_replace(name, 'ТУ [0-9][0-9-]+|арт\. [0-9/-]+|ИНН [0-9]+|Заявка № [0-9]+/а|www\.\S+', ' ', 'g'), '\s+', ' ', 'g'), '\s+([,;:.])', '\1', 'g'), '([,;])\s*([,;])+', '\1', 'g'), ' ,;.-')"""
# an item's own tax id is a maker's where the rule base knows it
_RESULTS = f"""{_ALIASES}, {_ITEMS}, {_MADE}, known AS (SELECT row_id, name, factory, made.inn AS fixed, coalesce(nullif(made.inn, ''), s.inn, '') AS inn
 FROM items JOIN made USING (row_id) LEFT JOIN s ON s.inn = regexp_extract(name, 'ИНН ([0-9]{{10,12}})', 1)),
results AS (SELECT row_id, {_CLEAN} AS text, inn, CASE WHEN inn <> '' THEN 'ЗЕЛЁНЫЙ' ELSE 'ЖЁЛТЫЙ' END AS status, {_CLEAN} <> name AS changed,
 CASE WHEN inn <> '' THEN '' ELSE 'Производитель не определён: применены только безопасные системные правила' END AS reason, factory, '' AS applied FROM known)"""


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return register


@query(f"WITH {_RESULTS} SELECT row_id, text, status, reason, factory, inn, applied, changed FROM results")
def anonymize_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole item path: resolve, fold rules to a fixpoint, clean up, report a status."""
    out = anonymize(synth.items(spark, sf_dir), synth.rule_base(spark, sf_dir))
    return out.withColumn("applied", F.array_join("applied", "|"))


@query(f"""WITH {_RESULTS} SELECT count(*) AS rows, count(*) FILTER (changed) AS changed, count(*) FILTER (status = 'ЗЕЛЁНЫЙ') AS green, count(*) FILTER (status = 'ЖЁЛТЫЙ') AS yellow FROM results""")
def status_report(spark, sf_dir):
    return audit.report(anonymize(synth.items(spark, sf_dir), synth.rule_base(spark, sf_dir)))


@query("SELECT CAST(0 AS BIGINT) AS keep_losses, CAST(0 AS BIGINT) AS idempotence_failures, CAST(0 AS BIGINT) AS residual_confirmed")
def audits(spark, sf_dir):
    rows, base = synth.items(spark, sf_dir), synth.rule_base(spark, sf_dir)
    return audit.audits(rows, anonymize(rows, base), base)


@query(rf"""WITH {_ITEMS}, m AS (SELECT row_id, name, unnest([('standalone_tu;tu', 'ТУ [0-9][0-9-]+'), ('article', 'арт\. [0-9/-]+'), ('contact', 'ИНН [0-9]+|www\.\S+'), ('request', 'Заявка № [0-9]+/а')]) AS t FROM items)
SELECT row_id, instr(name, regexp_extract(name, t[2])) - 1 AS a, instr(name, regexp_extract(name, t[2])) - 1 + length(regexp_extract(name, t[2])) AS b, t[1] AS label FROM m WHERE regexp_matches(name, t[2])""")
def redaction_spans(spark, sf_dir):
    rows = synth.items(spark, sf_dir).withColumnRenamed("name", "text")
    return spans.redaction_spans(rows, synth.rule_base(spark, sf_dir)).select("row_id", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "label")


@query(f"WITH {_SUPPLIER} SELECT s_suppkey AS row_id, 'ромашка-' || s_suppkey || '-прибор' AS name_key FROM s")
def normalize_name(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row_id"), N.normalize_name(F.expr(synth.sql(synth.ALIAS_SQL))).alias("name_key"))


@query(f"WITH {_ITEMS} SELECT row_id, regexp_extract(name, 'ИНН ([0-9]{{10,12}})', 1) AS inn FROM items")
def extract_inn(spark, sf_dir):
    return synth.items(spark, sf_dir).select("row_id", N.extract_inn(F.col("name")).alias("inn"))


@query(r"SELECT s_suppkey AS row_id, regexp_replace(trim(' ' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '.0 ' ELSE '.05' END), '^(-?[0-9]+)\.0$', '\1') AS code FROM supplier")
def normalize_code(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row_id"), N.normalize_code(F.expr("concat(' ', cast(s_suppkey as string), case when s_suppkey % 2 = 0 then '.0 ' else '.05' end)")).alias("code"))


@query("SELECT p_partkey AS row_id, '6410-' || (100000 + p_partkey % 50) || '-3|' || (100000 + p_partkey % 50) || '|6410' AS candidates FROM part")
def code_candidates(spark, sf_dir):
    return synth.items(spark, sf_dir).select("row_id", F.array_join(N.code_candidates(F.col("code")), "|").alias("candidates"))


@query(f"WITH {_SUPPLIER} SELECT p_partkey AS row_id, 'АО Прибор ИНН ' || inn AS factory FROM part JOIN s ON s_suppkey = p_partkey % 50 WHERE s_suppkey <= 20")
def registry_lookup(spark, sf_dir):
    return resolve.registry_lookup(synth.items(spark, sf_dir), synth.rule_base(spark, sf_dir))


@query(f"WITH {_ALIASES} SELECT alias_norm, inn FROM idx")
def alias_first_wins(spark, sf_dir):
    return synth.rule_base(spark, sf_dir).alias_index().select("alias_norm", "inn")


@query(f"WITH {_SUPPLIER} SELECT inn, maker AS manufacturer FROM s")
def maker_names(spark, sf_dir):
    return synth.rule_base(spark, sf_dir).maker_names()


@query(f"WITH {_SUPPLIER} SELECT inn FROM s")
def known_inns(spark, sf_dir):
    return synth.rule_base(spark, sf_dir).known_inns()


@query(f"""WITH {_SUPPLIER}, t AS (SELECT inn, 'РПК' || s_suppkey || '-' AS trigger, 0 AS brand FROM s UNION ALL SELECT inn, 'ВЕКТА' || (s_suppkey % 9), 1 FROM s)
SELECT inn, trigger, CAST(row_number() OVER (PARTITION BY inn ORDER BY brand DESC, length(trigger) DESC) AS INTEGER) AS rank_inn FROM t""")
def rules_ranked(spark, sf_dir):
    return synth.rule_base(spark, sf_dir).rules_ranked().select("inn", "trigger", "rank_inn")


@query(f"""WITH {_SUPPLIER}, t AS (SELECT inn, 'РПК' || s_suppkey || '-' AS trigger FROM s UNION ALL SELECT inn, 'ВЕКТА' || (s_suppkey % 9) FROM s)
SELECT min(inn) AS inn, trigger FROM t GROUP BY trigger HAVING count(DISTINCT inn) = 1 AND length(replace(trigger, '-', '')) >= 5""")
def unique_triggers(spark, sf_dir):
    return synth.rule_base(spark, sf_dir).unique_triggers().select("inn", "trigger")


@query(f"WITH {_ALIASES}, {_MADE} SELECT row_id, factory, inn FROM made")
def resolve_factory(spark, sf_dir):
    return resolve.resolve_factory(synth.items(spark, sf_dir), synth.rule_base(spark, sf_dir))


@query(f"""WITH {_ALIASES}, t AS (SELECT s_suppkey AS row_id, 'насос ромашка-' || s_suppkey || '-прибор dn50' AS x FROM supplier)
SELECT row_id, arg_max(inn, length(alias_norm)) AS inn FROM t JOIN idx ON contains(' ' || replace(x, '-', ' ') || ' ', ' ' || replace(alias_norm, '-', ' ') || ' ') AND contains(x, alias_norm) GROUP BY row_id""")
def identify_in_text(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as row_id", "concat('Насос Ромашка-', cast(s_suppkey as string), '-Прибор DN50') as text")
    return resolve.identify_in_text(rows, synth.rule_base(spark, sf_dir))


@query("SELECT p_partkey AS row_id, '0000000002' AS inn FROM part WHERE p_partkey % 4 = 1")
def pdf_marker(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey as row_id", "concat('Труба ТУ 0000-00', cast(p_partkey % 4 as string), '-00000001 лист') as text")
    return resolve.identify_marker(rows, synth.rule_base(spark, sf_dir)).select("row_id", "inn")


@query(r"SELECT doc_id, regexp_replace(text, '\b[0-9A-Za-z_.+-]+@[0-9A-Za-z_.-]+\.[A-Za-z]{2,}\b|https?://\S+|www\.\S+', ' ', 'g') AS redacted FROM documents")
def redact_contacts_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", CONTACT, " ").alias("redacted"))


@query(r"SELECT page_id, regexp_replace(url, 'https?://\S+|www\.\S+', ' ', 'g') AS redacted FROM pages")
def redact_urls_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", CONTACT, " ").alias("redacted"))


@query(rf"WITH {_ITEMS} SELECT row_id, regexp_replace(name, 'ТУ [0-9][0-9-]+', ' ', 'g') AS redacted FROM items")
def redact_tu(spark, sf_dir):
    return synth.items(spark, sf_dir).select("row_id", replace_keep(F.col("name"), TU_CODE).alias("redacted"))


@query(rf"WITH {_ITEMS} SELECT row_id, regexp_replace(name, 'арт\. [0-9/-]+', ' ', 'g') AS redacted FROM items")
def redact_articles(spark, sf_dir):
    return synth.items(spark, sf_dir).select("row_id", F.regexp_replace("name", ARTICLE, " ").alias("redacted"))


def _parts(spark, sf_dir, text):
    return table(spark, sf_dir, "part").selectExpr("p_partkey as row_id", f"{text} as text")


@query("SELECT p_partkey AS row_id, 'Болт, лист М' || p_size AS redacted FROM part")
def tidy_punct(spark, sf_dir):
    rows = _parts(spark, sf_dir, "concat(' Болт  ,, лист ( ) М', cast(p_size as string), ' ;')")
    return cleanup(rows, "text", {"tidy"}).withColumnRenamed("text", "redacted")


@query("SELECT p_partkey AS row_id, 'Изделие ' || p_size || '  IP65  лист' AS redacted FROM part")
def replace_kept(spark, sf_dir):
    rows = _parts(spark, sf_dir, "concat('Изделие ', cast(p_size as string), ' ТУ ', cast(p_partkey as string), '-IP65 лист')")
    return rows.select("row_id", replace_keep(F.col("text"), TU_CODE).alias("redacted"))


@query(f"WITH {_SUPPLIER} SELECT s_suppkey AS row_id, 'ромашка-' || s_suppkey || '-прибор' AS alias_norm, inn FROM s")
def alias_longest(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as row_id", "concat('склад ромашка-', cast(s_suppkey as string), '-прибор юг') as text")
    return resolve.longest_alias(rows, synth.rule_base(spark, sf_dir), "text")


@query(f"WITH {_ITEMS} SELECT row_id, {_CLEAN} AS text FROM items")
def system_rules(spark, sf_dir):
    return cleanup(synth.items(spark, sf_dir).select("row_id", F.col("name").alias("text")), "text")


@query(f"WITH {_ITEMS} SELECT row_id, 'DN' || regexp_extract(name, 'DN([0-9]+)', 1) AS dn, CASE WHEN contains(name, 'IP65') THEN 'ip65' ELSE '' END AS ip FROM items")
def keep_tokens(spark, sf_dir):
    return synth.items(spark, sf_dir).select("row_id", keep_signature(F.col("name")).alias("k")).select("row_id", F.upper(F.array_join("k.DN", "|")).alias("dn"), F.array_join("k.IP", "|").alias("ip"))


@query(f"WITH {_ITEMS} SELECT row_id, CASE WHEN contains(name, 'IP65') THEN 'IP65|' ELSE '' END || 'DN' || regexp_extract(name, 'DN([0-9]+)', 1) AS kept FROM items")
def protected_fragments(spark, sf_dir):
    return synth.items(spark, sf_dir).select("row_id", F.array_join(fragments(F.col("name")), "|").alias("kept"))


_SPANS = "c AS (SELECT l_orderkey AS id, l_orderkey * 8 + l_linenumber AS k, l_partkey % 40 AS a, l_partkey % 40 + 1 + l_suppkey % 9 AS b FROM lineitem), p AS (SELECT l_orderkey AS id, l_suppkey % 45 AS a, l_suppkey % 45 + 1 + l_partkey % 3 AS b FROM lineitem)"
_ISLANDS = "SELECT id AS row_id, min(a) AS a, max(b) AS b FROM (SELECT *, sum(CASE WHEN m IS NULL OR a > m THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY a, b, k ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, max(b) OVER (PARTITION BY id ORDER BY a, b, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM {t})) GROUP BY id, g"


def _span_tables(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    found = line.selectExpr("l_orderkey as row_id", "monotonically_increasing_id() as k", "l_partkey % 40 as a", "l_partkey % 40 + 1 + l_suppkey % 9 as b")
    return found, line.selectExpr("l_orderkey as row_id", "l_suppkey % 45 as a", "l_suppkey % 45 + 1 + l_partkey % 3 as b")


@query(f"WITH {_SPANS} {_ISLANDS.format(t='c')}")
def spans_coalesced(spark, sf_dir):
    return intervals.coalesce_spans(_span_tables(spark, sf_dir)[0])


@query(f"""WITH {_SPANS}, ch AS (SELECT c.id, x FROM c, unnest(range(a, b)) AS t(x) EXCEPT SELECT p.id, x FROM p, unnest(range(a, b)) AS t(x))
SELECT id AS row_id, min(x) AS a, max(x) + 1 AS b FROM (SELECT id, x, x - row_number() OVER (PARTITION BY id ORDER BY x) AS g FROM ch) GROUP BY id, g""")
def spans_subtracted(spark, sf_dir):
    found, kept = _span_tables(spark, sf_dir)
    return intervals.coalesce_spans(intervals.subtract_spans(found, kept))


_BLOCKS = """blk AS (SELECT CAST(l_orderkey AS INTEGER) AS page, CAST(l_linenumber AS INTEGER) AS block, (l_orderkey + l_linenumber) % 4 AS kind, l_partkey, CAST(l_suppkey % 60 AS DOUBLE) AS x0,
 CAST(l_linenumber * 100 + l_partkey % 50 AS DOUBLE) AS y0, length(CASE (l_orderkey + l_linenumber) % 4 WHEN 0 THEN 'Поставщик ИНН' WHEN 1 THEN lpad(CAST(l_partkey AS VARCHAR), 10, '5') WHEN 2 THEN 'Труба ТУ 2531-' ELSE '002-53597015-12' END) AS n FROM lineitem)"""


@query(f"""WITH {_BLOCKS} SELECT page, block, CAST(0 AS BIGINT) AS a, CAST(n AS BIGINT) AS b, 'inn_continuation' AS label FROM
 (SELECT *, lag(kind) OVER (PARTITION BY page ORDER BY block) AS prev FROM blk) WHERE kind = 1 AND prev = 0""")
def inn_continuation(spark, sf_dir):
    return layout.continuation_spans(synth.blocks(spark, sf_dir)).select("page", "block", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "label")


# an order may repeat a line number: what these two derive from lines is the same for such rows
@query("""SELECT DISTINCT CAST(l_orderkey AS INTEGER) AS page, CAST(l_linenumber AS INTEGER) AS block, CAST(100000 + (l_orderkey + l_linenumber * 7) % 40 AS VARCHAR) AS code
FROM lineitem WHERE (l_orderkey + l_linenumber * 7) % 40 IN (SELECT s_suppkey FROM supplier WHERE s_suppkey <= 20)""")
def block_codes(spark, sf_dir):
    labelled = "case cast(l_linenumber % 2 as integer) when 0 then 'Кран, код № ' else '' end"
    df = table(spark, sf_dir, "lineitem").selectExpr("'f' as file", "cast(l_orderkey as int) as page", "cast(l_linenumber as int) as block", f"concat({labelled}, cast(100000 + (l_orderkey + l_linenumber * 7) % 40 as string), ' DN50') as text")
    return layout.block_codes(df, synth.rule_base(spark, sf_dir)).select("page", "block", "code")


@query("""WITH t AS (SELECT l_orderkey AS page, l_linenumber AS block, l_linenumber % 2 = 1 AS org, l_linenumber * (80 + l_orderkey % 30) AS y FROM lineitem),
 n AS (SELECT *, lag(org) OVER w AS p_org, lag(y) OVER w AS p_y, lead(org) OVER w AS n_org, lead(y) OVER w AS n_y FROM t WINDOW w AS (PARTITION BY page ORDER BY block))
SELECT CAST(page AS INTEGER) AS page, CAST(block AS INTEGER) AS block, CAST(0 AS BIGINT) AS a, CAST(length('завод, ИНН 5904184047') AS BIGINT) AS b, 'supplier_org_continuation' AS label FROM n WHERE NOT org AND p_org AND abs(y - p_y - 60) <= 35
UNION ALL SELECT CAST(page AS INTEGER), CAST(block AS INTEGER), length('Поставщик '), length('Поставщик ООО Калужский'), 'supplier_org_wrapped' FROM n WHERE org AND NOT n_org AND abs(n_y - y - 60) <= 35""")
def org_wrapped(spark, sf_dir):
    text = "case cast(l_linenumber % 2 as integer) when 1 then 'Поставщик ООО Калужский' else 'завод, ИНН 5904184047, DN50' end"
    top = "cast(l_linenumber * (80 + l_orderkey % 30) as double)"
    df = table(spark, sf_dir, "lineitem").selectExpr("'f' as file", "cast(l_orderkey as int) as page", "cast(l_linenumber as int) as block", f"{text} as text", "0.0D as x0", f"{top} as y0", "200.0D as x1", f"{top} + 60 as y1")
    return layout.continuation_spans(df).select("page", "block", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "label")


@query()
def page_spans(spark, sf_dir):
    """All spans of all blocks, those that only the layout proves included."""
    order = Window.partitionBy("page").orderBy("block", "x0", "y0", "text")
    df = synth.blocks(spark, sf_dir).withColumn("block", F.row_number().over(order))  # an order may repeat a line number
    return pages.page_spans(df, synth.rule_base(spark, sf_dir))[0].select("page", "block", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "label")


@query(f"""WITH {_BLOCKS}, broken AS (SELECT DISTINCT page + 1 AS page FROM blk WHERE y0 >= 480 AND kind = 2)
SELECT blk.page, min(block) AS block, CAST(15 AS BIGINT) AS b FROM blk JOIN broken USING (page) WHERE kind = 3 AND y0 < 170 GROUP BY blk.page""")
def tu_cross_page(spark, sf_dir):
    return layout.tu_over_pages(synth.blocks(spark, sf_dir)).select("page", "block", F.col("b").cast("long").alias("b"))


@query(f"""WITH {_BLOCKS}, m AS (SELECT * FROM blk WHERE block % 2 = 1),
 j AS (SELECT k.page, k.block, m.block AS mb, abs(k.y0 - m.y0) + 0.001 * abs(k.x0 - m.x0) AS d FROM blk k JOIN m USING (page)
  WHERE greatest(0.0, least(k.y0 + 12, m.y0 + 12) - greatest(k.y0, m.y0)) / 12 >= 0.45 OR abs(k.y0 - m.y0) <= 7)
SELECT page, block, 'c' || mb AS code FROM (SELECT *, row_number() OVER (PARTITION BY page, block ORDER BY d, mb) AS r FROM j) WHERE r = 1""")
def same_row_code(spark, sf_dir):
    df = synth.blocks(spark, sf_dir)
    marked = df.where("block % 2 = 1").withColumn("code", F.expr("concat('c', cast(block as string))"))
    return layout.same_row(df, marked, "code").select("page", "block", "code")


_CHARS = "SELECT l_orderkey AS page, l_linenumber AS line, min(l_partkey % 100) AS x0, min(l_suppkey % 30) AS t, max(l_partkey % 100 + 5) AS x1, max(l_suppkey % 30 + 12) AS u FROM lineitem GROUP BY 1, 2"


def _chars(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr("'f' as file", "l_orderkey as page", "0 as block", "0 as span", "l_linenumber as line", "'x' as ch", "cast(l_partkey % 100 as double) as x0", "cast(l_suppkey % 30 as double) as y0", "cast(l_partkey % 100 + 5 as double) as x1", "cast(l_suppkey % 30 + 12 as double) as y1")


def _rounded(df):
    return df.select("page", "line", *[F.round(c, 3).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query(f"SELECT page, line, CAST(x0 AS DOUBLE) AS x0, round(t + (u - t) * 0.55::DOUBLE, 3) AS y0, CAST(x1 AS DOUBLE) AS x1, round(t + (u - t) * 0.62::DOUBLE, 3) AS y1 FROM ({_CHARS})")
def strip_rects(spark, sf_dir):
    return _rounded(layout.strips(_chars(spark, sf_dir)))


@query(f"SELECT page, line, round(x0 - 0.8::DOUBLE, 3) AS x0, round(t - 0.8::DOUBLE, 3) AS y0, round(x1 + 0.8::DOUBLE, 3) AS x1, round(u + 0.8::DOUBLE, 3) AS y1 FROM ({_CHARS})")
def ocr_rects(spark, sf_dir):
    return _rounded(layout.strips(_chars(spark, sf_dir), ocr=True))


@query()
def rect_dedupe(spark, sf_dir):
    rects = _chars(spark, sf_dir).select("file", F.col("page") % 97, F.col("line").alias("ord"), "x0", "y0", "x1", "y1").toDF("file", "page", "ord", "x0", "y0", "x1", "y1")
    return layout.dedupe_rects(rects).select("page", "ord", "x0", "y0")


def _cells(spark, sf_dir):
    return table(spark, sf_dir, "supplier").selectExpr(
        "concat('f', cast(s_suppkey % 5 as string)) as file", "case cast(s_suppkey % 3 as integer) when 0 then ' Готово ' when 1 then 'Выборка_оборудования' else 'Лист' end as sheet", "cast(s_suppkey % 2 + 1 as int) as r", "cast(s_suppkey % 4 + 1 as int) as c",
        "case cast(s_suppkey % 4 as integer) when 0 then ' Наименование  МТР' when 1 then 'Код' when 2 then 'Завод' else 'x' end as value", "'s' as data_type",
    )


_CELLS = """cells AS (SELECT 'f' || (s_suppkey % 5) AS file, CASE s_suppkey % 3 WHEN 0 THEN ' Готово ' WHEN 1 THEN 'Выборка_оборудования' ELSE 'Лист' END AS sheet, s_suppkey % 3 AS rank, CAST(s_suppkey % 2 + 1 AS INTEGER) AS r, CAST(s_suppkey % 4 + 1 AS INTEGER) AS c, s_suppkey % 4 AS role FROM supplier)"""


@query(f"""WITH {_CELLS}, h AS (SELECT file, sheet, r, min(c) FILTER (role = 0) AS name, min(c) FILTER (role = 1) AS code, min(c) FILTER (role = 2) AS factory FROM cells GROUP BY ALL HAVING name IS NOT NULL AND (code IS NOT NULL OR factory IS NOT NULL))
SELECT file, sheet, r, name, code, factory FROM (SELECT *, row_number() OVER (PARTITION BY file, sheet ORDER BY r) AS n FROM h) WHERE n = 1""")
def header_discovery(spark, sf_dir):
    return sheets.find_headers(_cells(spark, sf_dir)).select("file", "sheet", "r", "name", "code", "factory")


@query(f"WITH {_CELLS}, d AS (SELECT DISTINCT file, sheet, rank FROM cells) SELECT file, sheet FROM d WHERE rank = (SELECT min(rank) FROM d e WHERE e.file = d.file)")
def sheet_select(spark, sf_dir):
    return sheets.select_sheets(_cells(spark, sf_dir))


@query("""SELECT count(*) FILTER (s_suppkey % 3 = 0) AS ok, count(*) FILTER (s_suppkey % 3 = 1) AS review, count(*) FILTER (s_suppkey % 3 = 2) AS errors, count(*) AS total
FROM supplier WHERE s_suppkey % 5 IN (0, 1, 2, 3)""")
def batch_summary(spark, sf_dir):
    path = "concat('/in/', cast(s_suppkey as string), case cast(s_suppkey % 5 as integer) when 0 then '.xlsx' when 1 then '.CSV' when 2 then '.pdf' when 3 then '.xlsm' else '_обезличено.csv' end)"
    files = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as ord", f"{path} as path")
    outcome = F.expr("case cast(ord % 3 as integer) when 0 then 'ok' when 1 then 'review' else 'error' end")
    return audit.batch_summary(audit.supported_files(files.unionByName(files)).withColumn("outcome", outcome))
