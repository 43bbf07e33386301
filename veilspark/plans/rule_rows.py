"""One query a system rule and a trigger mode, over derived rows that hit, miss, touch a boundary or are null.

Texts are made of `part` by expressions that also run in DuckDB; the SQL counterparts find and replace in those texts with
expressions of their own dialect, which knows neither look-around nor Unicode word boundaries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.dialect import matches
from veilspark.functions.system_rules import cleanup
from veilspark.plans.rulebase import trigger_pattern
from veilspark.plans.synth import table

_FORMS = "(?:ООО|АО|ЗАО|ОАО|ПАО|НПО|НПП|ФГУП)"
_ROLES = "(?:производитель|изготовитель|поставщик|разработчик)"
_ORG = r'["«][^,\n"»]{1,140}["»]'
_EDGE, _LETTER = r"(^|[^A-Za-zА-Яа-яЁё0-9_])", r"([^A-Za-zА-Яа-яЁё0-9_]|$)"

#: rule -> (texts, where # stands for the row's number; pattern and replacement of the SQL).
RULES: dict[str, tuple[tuple[str, ...], str, str]] = {
    "gost_tu": (("Труба ГОСТ/ТУ #", "труба гост / ту, #", "ГОСТ/ТУБ #", "ГОСТ #/ТУ", "ГОСТ/ТУ"), r"(?i)ГОСТ\s*/\s*ТУ" + _LETTER, r"ГОСТ\1"),
    "reverse_tu": (("Муфта (АБВ #-5 ТУ) лист", "(аб # ту)", "(# ТУ)", "(АБ # ТУ", "()"), r"(?i)\(\s*[A-Za-zА-Яа-я0-9][A-Za-zА-Яа-я0-9._/\- ]{2,}\s+ТУ\s*\)", " "),
    "vo_tu": (("Кран ВО ТУ #", "ВО  ТУ", "ЛВО ТУ #", "во ТУ #", "ВО ТУР #"), _EDGE + r"ВО\s+(ТУ" + _LETTER + ")", r"\1 \2"),
    "attached_tu": (("Болт АБВ.#-ТУ, лист", "x#/ТУ", "ТУ #", "аб#ту", "#ТУР"), r"(^|[ ,;(])[A-Za-zА-Яа-я0-9_.\-/]+ТУ([ ,;)]|$)", r"\1 \2"),
    "standalone_tu": (("Болт ТУ, #", "ту", "ТУР #", "аТУ #", "(ТУ) #"), r"(?i)" + _EDGE + "ТУ" + _LETTER, r"\1 \2"),
    "role_bare_org": (("Насос изготовитель: Acme Valves, #", "ПОСТАВЩИК Acme#", "изготовитель Завод, #", "изготовитель: Acme (#)", "поставщик"), rf"(?i){_ROLES}\s*[:=–—-]?\s*[A-Z][A-Za-z0-9&.+-]*(?:\s+[A-Z][A-Za-z0-9&.+-]*){{0,4}}(\s*[,;.]|$)", r" \1"),
    "production_org": (("Насос производства ООО \"Завод #\", лист", "произв. АО «Кран #»", "производства Завод \"#\", x", "производства ООО Завод #", "производства"), rf"(?i)(?:производства|произв\.?)\s+{_FORMS}\s+{_ORG}([,;.]|$)", r" \1"),
    "po_org": (("Кран по АО «Завод #», DN5", "по ООО \"А#\"", "по «Завод #», x", "почта ООО #", "по"), rf"(?i)по\s+{_FORMS}\s+{_ORG}([,;.]|$)", r" \1"),
    "bracket_org": (("Кран [ООО \"Завод #\"] DN5", "[ АО «К#» ]", "[ООО Завод #]", "(ООО \"#\")", "[]"), rf"(?i)\[\s*{_FORMS}\s+{_ORG}\s*\]", " "),
    "end_org": (("Кран # ООО \"Завод\"", "Кран АО «К #»;", "ООО \"Завод\" кран #", "Кран ООО Завод #", "ООО"), rf"(?i){_FORMS}\s+{_ORG}[).;\s]*$", " "),
    "commercial_reference": (("Прайс лист ООО Завод #, поз. Лист", "Коммерческое предложение АО К # от 5. Кран", "Прайс лист Завод #", "прайслист ЗАО #.5 а. Кран", "Прайс"), rf"(?i)(?:Коммерческое\s+предложение|Прайс\s*лист)\s+{_FORMS}\s+(?:[^.]|\.[^ \s])+(?:\.( )|\.?$)", r" \1"),
    "commercial_org": (("Прайс лист ООО \"Завод #\", лист", "Коммерческое предложение АО «К#»; x", "Прайс лист \"Завод #\"", "Прайс лист ООО 5#", "лист ООО \"#\""), rf"(?i)((?:Коммерческое\s+предложение|Прайс\s*лист))\s+{_FORMS}\s+{_ORG}([,;])", r"\1 \2"),
    "kp_org": (("КП ООО \"Завод #\", лист", "кп АО «К#»", "КП \"Завод #\"", "КПП ООО \"#\"", "КП"), rf"(?i)КП\s+{_FORMS}\s+{_ORG}([,;]|$)", r"КП \1"),
    "dangling": (("Кран # по типу, лист", "Кран # по; x", "Насос поставщик: № #", "по типу #", "топо #"), rf"(?i)(?:по\s+типу\s*|по\s*|{_ROLES}\s*[:=–—-]?\s*)([,;]|№)", r" \1"),
    "role_org": (("Насос изготовитель: ООО \"Завод #\", DN5", "поставщик «К#»", "изготовитель ООО Завод #", "изготовительница \"К#\"", "разработчик \"\""), rf"(?i){_ROLES}\s*[:=–—-]?\s*(?:{_FORMS}\s+)?{_ORG}([,;.]|$)", r" \1"),
    "letter_tail": (("Болт № #/12-А от 12.03.2019, лист", "№ #-А от 5 марта 2019 г.", "№ #-А от лист", "#-А от 12.03.2019", "№ А от 1.1.19"), r"(?i)№\s*[A-Za-zА-Яа-яЁё0-9][A-Za-zА-Яа-яЁё0-9._/\-–—]{2,50}\s+от\s+(?:\d{1,2}\s+[а-я]{3,8}\s+\d{4}|\d{1,2}[.]\d{1,2}[.]\d{2,4})\s*г?[.]?", " "),
    "request": (("Болт Заявка № #/а, x", "заявка №#", "Заявка #", "Подзаявка № #", "Заявка № "), r"(?i)" + _EDGE + r"Заявка\s*№\s*[A-Za-zА-Яа-я0-9._/\-]+", r"\1 "),
    "contact": (("Кран ИНН 5904184047, #", "почта a.b@c#.ru x", "https://x.ru/# y, КПП 123456789", "ИНН 123 #", "a@b #"), r"(?i)ИНН\s*[0-9]{10,12}|КПП\s*[0-9]{9}|[\w.+-]+@[\w.-]+\.[A-Za-zА-Яа-я]{2,}|https?://\S+|www\.\S+", " "),
    "commercial_dangling": (("Кран. Прайс лист № # от 12.03.2019 поз. 3; лист", "Коммерческое предложение", "Прайс лист лист #", "Прайслист №#. x", "лист № #."), r"(?i)(?:Коммерческое\s+предложение|Прайс\s*лист)\s*(?:№\s*[^,;.\s]+\s*)?(?:от\s+\d{1,2}\.\d{1,2}\.\d{2,4})?(?:\s*,?\s*поз\.?\s*\d+)?\s*([.;]|$)", r" \1"),
}

#: mode -> (trigger, apply, texts, pattern of the SQL whose whole first match is found).
TRIGGERS: dict[str, tuple[str, str, tuple[str, ...], str]] = {
    "exact": ("АБВ", "Точное совпадение", ("Болт АБВ #", "абв, #", "АБВГ #", "#АБВ", "-АБВ-"), r"(?i)(?:^|[ ,\-])(АБВ)(?:[ ,\-]|$)"),
    "prefix": ("РП-", "Начало фирменного обозначения", ("Насос РП-#,5;x, лист", "рп-#", "ЖРП-#", "РП #", "РП-"), r"(?i)(?:^|[ ])(РП-(?:[^\s,;]|[,;][^\s,;])*)"),
    "prefix_dot": ("ЖНКЮ.", "Полный код КД", ("Реле ЖНКЮ.#.01, x", "жнкю # 5", "ЖНКЮ, #", "АЖНКЮ.#", "ЖНКЮ."), r"(?i)(?:^|[ ])(ЖНКЮ(?:\.\s*|\s+)[A-Za-zА-Яа-я0-9][A-Za-zА-Яа-я0-9._/\-]*)"),
    "prefix_ai": ("AI-", "Слитное/дефисное обозначение", ("Блок АИ-#/2 x", "ai-#", "AI #", "НАИ-#", "AI-"), r"(?i)(?:^|[ ])((?:AI|АИ)-[A-Za-zА-Яа-я0-9][A-Za-zА-Яа-я0-9._/+*\-,]*)"),
    "brand": ("ВЕКТА", "Бренд + соседний индекс", ("Кран ВЕКТА #-2 DN5", "векта--#", "ВЕКТА, #", "ЗАВЕКТА #", "ВЕКТА"), r"(?i)(?:^|[ ])(ВЕКТА(?:[\s\-]+[A-Za-zА-Яа-я0-9](?:[^\s,;]|[,;][^\s,;])*)?)"),
    "brand_named": ("Метран-100", "Бренд + соседний индекс", ("Датчик Метран #-ДИ, x", "метран-#", "Метран", "АМетран #", "Метран, #"), r"(?i)(?:^|[ ])(Метран(?:\s*-\s*|\s+)?[A-Za-zА-Яа-я0-9](?:[^\s,;]|[,;][^\s,;])*)"),
    "quoted": ("(К.1)", "Точное совпадение", ("Болт (К.1) #", "а(к.1)б", "(Кх1) #", "К.1 #", "((К.1))"), r"(?i)(\(К\.1\))"),
}


def _sql_text(texts: tuple[str, ...]) -> str:
    """SQL, for both engines, of a row's text: one of the texts, with the number of the row, or null."""
    number = "cast(p_partkey as {s})"
    return "case cast(p_partkey % 6 as integer) " + " ".join(f"when {i} then replace('{t}', '#', {number})" for i, t in enumerate(texts)) + " else null end"


def _rows(spark: SparkSession, sf_dir: str, texts: tuple[str, ...]) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey as row_id", f"{_sql_text(texts).replace('{s}', 'string')} as text")


def _rule_query(rule: str, texts: tuple[str, ...]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return cleanup(_rows(spark, sf_dir, texts), "text", {rule}).withColumnRenamed("text", "redacted")

    return run


def _trigger_query(trigger: str, mode: str, texts: tuple[str, ...]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = matches(F.col("text"), trigger_pattern(F.lit(trigger), F.lit(mode)))
        return _rows(spark, sf_dir, texts).select("row_id", F.get(found, F.lit(0))["m"].alias("found"))

    return run


QUERIES = {
    **{f"rule_{r}": _rule_query(r, texts) for r, (texts, _, _) in RULES.items()},
    **{f"trigger_{m}": _trigger_query(t, mode, texts) for m, (t, mode, texts, _) in TRIGGERS.items()},
}


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _texts(texts: tuple[str, ...]) -> str:
    return f"SELECT p_partkey AS row_id, {_sql_text(texts).replace('{s}', 'varchar')} AS text FROM part"


_TRIMMED = r"regexp_replace(trim({}, ' ,;.-'), '^\s+|\s+$', '', 'g')"
ORACLE_SQL = {
    **{f"rule_{r}": f"SELECT row_id, {_TRIMMED.format(f'regexp_replace(text, {_quoted(p)}, {_quoted(by)}, {_quoted("g")})')} AS redacted FROM ({_texts(texts)})" for r, (texts, p, by) in RULES.items()},
    **{f"trigger_{m}": f"SELECT row_id, CASE WHEN regexp_matches(text, {_quoted(p)}) THEN regexp_extract(text, {_quoted(p)}, 1) END AS found FROM ({_texts(texts)})" for m, (_, _, texts, p) in TRIGGERS.items()},
}
