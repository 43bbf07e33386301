"""Rules that hold for every text, whoever made the item: specification numbers, articles, organizations, contacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions.dialect import CI, CS
from veilspark.functions.keep import replace_keep

# Patterns of the system rules.
MONTHS = r"(?:января|февраля|марта|апреля|мая|июня|июля|августа|сентября|октября|ноября|декабря)"
LEGAL_FORM = r"(?:ООО|АО|ЗАО|ОАО|ПАО|НПО|НПП|ФГУП)"
PDF_LEGAL_FORM = r"(?:ООО|АО|ЗАО|ОАО|ПАО|НПО|НПП|ФГУП|[ОO]{3}|[ОO][АA][ОO]|З[АA][ОO]|П[АA][ОO]|[АA][ОO]|FGUP)"
QUOTED_ORG = r"[\"«][^,\n]{1,140}?[\"»](?=\s*(?:г\.?\s*|Россия\b|№|от\b|[,;.\]]|\(|по\b|$))"
ROLE = r"(?:производитель|изготовитель|поставщик|разработчик)"
OFFER = r"(?:Коммерческое\s+предложение|Прайс\s*лист)"
GOST_TU = CI + r"\bГОСТ\s*/\s*ТУ\b"
REVERSE_TU = CI + r"\(\s*[A-Za-zА-Яа-я0-9][A-Za-zА-Яа-я0-9._/\- ]{2,}\s+ТУ\s*\)"
ARTICLE = CI + r"(?<!\w)(?:артикул|арт\.?|кат\.?\s*№|каталожный\s+номер)\s*[:№,\-]?\s*[A-Za-zА-Яа-я0-9_./*\"'\-]+"
VO_TU = CS + r"(?<!\w)ВО\s+(?=ТУ\b)"
ATTACHED_TU = CS + r"(?<!\w)[A-Za-zА-Яа-я0-9_.\-/]*[A-Za-zА-Яа-я0-9_.\-/]ТУ\b"
_TU_HEAD = r"(?<!\w)ТУ\s*[-–—]?\s*(?:(?!(?:DN|PN|IP|ГОСТ|SDR)\b)(?:[A-ZА-Я]{1,4}|\d{1,3})\s+)?(?=[A-Za-zА-Яа-я0-9_.\-/]*\d)"
TU_WRAP = CI + _TU_HEAD + r"[A-Za-zА-Яа-я0-9_.\-/–—]*[-–—][ \t]*\n[ \t]*(?=[A-Za-zА-Яа-я0-9_.\-/–—]*\d)[A-Za-zА-Яа-я0-9_.\-/–—]+"
TU_CODE = CI + _TU_HEAD + r"[A-Za-zА-Яа-я0-9_.\-/–—]+"
STANDALONE_TU = CI + r"(?<!\w)ТУ(?!\w)"
ROLE_ORG = CI + rf"\b{ROLE}\s*[:=–—-]?\s*(?:{LEGAL_FORM}\s+)?{QUOTED_ORG}(?:\s+[^,;.\n]{{1,50}}\s+филиал)?"
ROLE_BARE_ORG = CI + rf"\b{ROLE}\s*[:=–—-]?\s*([A-Z][A-Za-z0-9&.+-]*(?:\s+[A-Z][A-Za-z0-9&.+-]*){{0,4}})(?=\s*[,;.]|$)"
PRODUCTION_ORG = CI + rf"\b(?:производства|произв\.?)\s+{LEGAL_FORM}\s+{QUOTED_ORG}(?:\s+(?:Россия,?\s*)?г\.?\s*[А-ЯЁA-Z][А-Яа-яЁёA-Za-z .-]{{1,45}})?"
PO_ORG = CI + rf"\bпо\s+{LEGAL_FORM}\s+{QUOTED_ORG}(?:\s+г\.?\s*[А-ЯЁA-Z][А-Яа-яЁёA-Za-z .-]{{1,45}})?"
BRACKET_ORG = CI + rf"\[\s*{LEGAL_FORM}\s+{QUOTED_ORG}\s*\]"
END_ORG = CI + rf"{LEGAL_FORM}\s+{QUOTED_ORG}(?=\s*[).;]*$)"
COMMERCIAL_REFERENCE = CI + rf"\b{OFFER}\s+{LEGAL_FORM}\s+(?:(?!\.\s|$).){{1,240}}(?:\.(?=\s|$)|$)"
COMMERCIAL_ORG = CI + rf"\b({OFFER})\s+{LEGAL_FORM}\s+(?:{QUOTED_ORG}|[А-ЯЁA-Z][А-Яа-яЁёA-Za-z0-9&.+-]*(?:\s+[А-ЯЁA-Z][А-Яа-яЁёA-Za-z0-9&.+-]*){{0,4}})"
COMMERCIAL_DANGLING = CI + rf"\b{OFFER}\s*[\"«»]?\s*(?:№\s*[^,;.\s]+\s*)?(?:от\s+\d{{1,2}}\.\d{{1,2}}\.\d{{2,4}})?(?:\s*,?\s*поз\.?\s*\d+)?\s*[\"«»]?(?=[.;]|$)"
LETTER_TAIL = CI + (
    rf"(?<!\w)№\s*[A-Za-zА-Яа-яЁё0-9][A-Za-zА-Яа-яЁё0-9._/\-–—]{{2,50}}\s+от\s+(?:\d{{1,2}}\s+{MONTHS}\s+\d{{4}}|\d{{1,2}}[.]\d{{1,2}}[.]\d{{2,4}})\s*г?[.]?"
    r"(?:\s*,?\s*(?:п|поз)[.]?\s*\d+(?:[.]\d+)*)?"
)
REQUEST = CI + r"\bЗаявка\s*№\s*[A-Za-zА-Яа-я0-9._/\-]+"
KP_ORG = CI + rf"\bКП\s+{LEGAL_FORM}\s+{QUOTED_ORG}"
CONTACT = CI + r"(?:\bИНН\s*\d{10,12}\b|\bКПП\s*\d{9}\b|\b[\w.+-]+@[\w.-]+\.[A-Za-zА-Яа-я]{2,}\b|https?://\S+|www\.\S+)"
ORG_WITH_INN = CI + rf"\b{PDF_LEGAL_FORM}\b(?:(?!\bИНН\b)[\s\S]){{1,180}}\bИНН\b"
DANGLING_LIKE = CI + r"\bпо\s+типу\s*(?=(?:комплектация|№|Масса\b|[,;.]|$))"
DANGLING_BY = CI + r"\bпо\s*(?=(?:комплектация|[,;.]|$))"
DANGLING_ROLE = CI + rf"\b{ROLE}\s*[:=–—-]?\s*(?=(?:№|[,;.]|$))"

#: (name, pattern, replacement) in the order they run; None keeps protected fragments. A name may run several times.
STEPS: tuple[tuple[str, str, str | None], ...] = (
    ("gost_tu", GOST_TU, "ГОСТ"),
    ("reverse_tu", REVERSE_TU, None),
    ("article", ARTICLE, " "), ("article", ARTICLE, " "), ("article", ARTICLE, " "),
    ("vo_tu", VO_TU, " "),
    ("attached_tu", ATTACHED_TU, None),
    ("tu", TU_CODE, None),
    ("standalone_tu", STANDALONE_TU, " "),
    ("role_org", ROLE_ORG, " "), ("role_bare_org", ROLE_BARE_ORG, " "), ("production_org", PRODUCTION_ORG, " "),
    ("po_org", PO_ORG, " "), ("bracket_org", BRACKET_ORG, " "), ("end_org", END_ORG, " "),
    ("commercial_reference", COMMERCIAL_REFERENCE, " "), ("commercial_org", COMMERCIAL_ORG, "$1 "), ("commercial_dangling", COMMERCIAL_DANGLING, " "),
    ("letter_tail", LETTER_TAIL, " "), ("request", REQUEST, " "), ("kp_org", KP_ORG, "КП "), ("contact", CONTACT, " "),
    ("dangling", DANGLING_LIKE, " "), ("dangling", DANGLING_BY, " "), ("dangling", DANGLING_ROLE, " "),
    ("tidy", r"(?U)\s+", " "), ("tidy", r"(?U)\s+([,;:.])", "$1"), ("tidy", r"(?U)([,;])\s*([,;])+", "$1"),
    ("tidy", r"(?U)\(\s*\)", " "), ("tidy", r"(?U)\[\s*\]", " "), ("tidy", r"(?U)[\"«»]\s*[\"«»]", " "), ("tidy", r"(?U)\s+", " "),
)
#: Labelled patterns of the span path.
SPAN_RULES = (
    ("reverse_tu", REVERSE_TU), ("article", ARTICLE), ("vo_tu", VO_TU), ("attached_tu", ATTACHED_TU), ("tu_wrap", TU_WRAP), ("tu", TU_CODE),
    ("standalone_tu", STANDALONE_TU), ("contact", CONTACT), ("supplier_org_inn", ORG_WITH_INN), ("letter_tail", LETTER_TAIL), ("request", REQUEST),
)


def cleanup(df: DataFrame, text: str, only: set[str] | None = None) -> DataFrame:
    """All system rules (or those named) over one column, then the edges are trimmed.

    Runs of plain replacements nest in one projection; a step that reads its input several times gets one of its own.
    """
    c = plain = F.col(text)
    for name, pattern, by in STEPS:
        if only is not None and name not in only:
            continue
        if by is not None:
            plain = F.regexp_replace(plain, pattern, by)
            continue
        # quadratic in token length, and pointless without the letters it ends in
        new = F.when(c.contains("ТУ"), replace_keep(c, pattern)).otherwise(c) if name == "attached_tu" else replace_keep(c, pattern)
        df, plain = df.withColumn(text, plain).withColumn(text, new), c
    return df.withColumn(text, F.regexp_replace(F.trim(plain, F.lit(" ,;.-")), r"(?U)^\s+|\s+$", ""))
