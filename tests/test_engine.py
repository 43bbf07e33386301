"""Unit cases of the redaction engine, hand-derived, and the catalog against DuckDB on the smallest tables."""

import gzip
import json
import random
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilspark.functions import keep, normalize
from veilspark.functions.dialect import matches
from veilspark.functions.system_rules import SPAN_RULES, TU_CODE, cleanup
from veilspark.operators import audit, intervals, layout, pages, resolve, spans
from veilspark.operators.anonymize import GREEN, REASON, YELLOW, anonymize
from veilspark.plans import catalog, rule_rows, rulebase
from veilspark.plans.rulebase import ALIASES, GLOBALS, MARKERS, REGISTRY, RULES, RuleBase
from veilspark.sources import files, sheets, workbooks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def base(spark):
    make = spark.createDataFrame
    return RuleBase(
        make([(0, "7700000001", "Ромашка-Прибор", "РП-", "Начало фирменного обозначения", ""), (1, "7700000002", "Вектор-Арматура", "ВЕКТА", "Бренд + соседний индекс", "бренд")], RULES),
        make([(0, "7700000001", "Ромашка-Прибор", 'ООО "Ромашка-Прибор"'), (1, "7700000002", "Вектор-Арматура", 'АО "Вектор-Арматура"'), (2, "7700000002", "мониторинг", "")], ALIASES),
        make([("456101", 'ООО "Ромашка-Прибор" ИНН 7700000001')], REGISTRY),
        make([(0, "ТУ 0000-001-00000001", "7700000002", "")], MARKERS),
        make([(0, "ZETTA-", None, "Начало фирменного обозначения", "")], GLOBALS),
    )


def one(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_normalizations(spark):
    assert one(spark, [' ООО  "Ёлка" ', None, "ао Вектор."], normalize.normalize_name) == ["елка", "", "вектор"]
    assert one(spark, ["6410-456101-3", "12.0", None, "1-100-10"], normalize.code_candidates) == [["6410-456101-3", "456101", "6410"], ["12"], [], ["1-100-10"]]
    assert one(spark, ["x ИНН 5904184047 y", "инн123"], normalize.extract_inn) == ["5904184047", ""]


@pytest.mark.parametrize(("trigger", "mode", "text", "found"), [
    ("РП-", "Начало фирменного обозначения", "Насос РП-12,5;x, лист", "РП-12,5;x"),
    ("ЖНКЮ.", "Полный код КД", "ЖНКЮ 464429.018 (шт)", "ЖНКЮ 464429.018"),
    ("ВЕКТА", "Бренд + соседний индекс", "кран векта 15-2 DN5", "векта 15-2"),
    ("АБВ", "Точное совпадение", "АБВГ АБВ", "АБВ"),
    ("AI-", "Слитное/дефисное обозначение", "блок АИ-77/2 x", "АИ-77/2"),
    ("ДТ.", "Слитное/дефисное обозначение", "реле ДТ. 12а/3, МДТ. 5", "ДТ. 12а/3"),
    ("Метран-150", "Бренд + соседний индекс", "датчик метран 55-ДИ IP65", "метран 55-ДИ"),
    ("ВЕКТА", "Бренд + соседний индекс", "кран ВЕКТА", "ВЕКТА"),
    ("(К)", "Точное совпадение", "а(К)б", "(К)"),
    ("АБВ", "", "АБВ1, абв", "абв"),
])
def test_trigger_patterns(spark, trigger, mode, text, found):
    df = spark.createDataFrame([(trigger, mode, text)], "t string, m string, v string")
    row = df.select(rulebase.trigger_pattern(F.col("t"), F.col("m")).alias("p"), "v").select(matches(F.col("v"), F.col("p")).alias("x"), "p").first()
    assert [x["m"] for x in row["x"]] == [found]


CASES = [
    ("Кран шаровый DN50 ТУ 3742-001-12345678-2012, УХЛ1", "Кран шаровый DN50, УХЛ1"),
    ("Задвижка ГОСТ/ТУ 12-34", "Задвижка ГОСТ 12-34"),
    ("Насос арт. 12-34/7 DN 40", "Насос DN 40"),
    ("Изделие ТУ 123-АБВ.456-ОЛ2", "Изделие 123-АБВ.456-ОЛ2"),
    ("Датчик ИНН 5904184047, IP65", "Датчик, IP65"),
    ("Болт М12 Заявка № 12/а-3", "Болт М12"),
    ("Фланец  DN80 ", "Фланец DN80"),
]


def test_system_rules(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CASES)], "row_id int, text string")
    assert [r["text"] for r in cleanup(df, "text").orderBy("row_id").collect()] == [b for _, b in CASES]


def test_long_tokens_do_not_break_the_engine(spark):
    assert one(spark, ["x РП-" + "a" * 50_000], lambda c: F.length(F.regexp_replace(c, rulebase.trigger_pattern(F.lit("РП-"), F.lit(rulebase.PREFIX_MODES[0])), ""))) == [2]


def test_keep(spark):
    assert one(spark, ["УХЛ1 IP65 dn 50 DN50", ""], keep.fragments) == [["IP65", "УХЛ1", "dn 50"], []]
    assert one(spark, ["a ТУ 12-IP65 b"], lambda c: keep.replace_keep(c, TU_CODE)) == ["a  IP65  b"]


def test_anonymize(spark, base):
    rows = [(0, "Насос РП-12 DN50", "6410-456101-3", ""), (1, "Кран Вектор-Арматура ВЕКТА 15 DN5", "", ""), (2, "Болт М12", "", ""), (3, "Блок ZETTA-7 IP65", "", ""), (4, None, None, None), (5, "система мониторинг", "", "")]
    out = {r["row_id"]: r for r in anonymize(spark.createDataFrame(rows, "row_id int, name string, code string, factory string"), base).collect()}
    assert out[0]["text"] == "Насос DN50" and out[0]["inn"] == "7700000001" and out[0]["status"] == GREEN
    assert out[1]["status"] == GREEN and "ектор" not in out[1]["text"] and out[1]["inn"] == ""
    assert (out[2]["text"], out[2]["status"], out[2]["reason"], out[2]["changed"]) == ("Болт М12", YELLOW, REASON, False)
    assert out[3]["text"] == "Блок IP65" and out[3]["applied"] == ["ZETTA-"]
    assert out[4]["text"] == "" and out[5]["status"] == YELLOW


def test_resolution(spark, base):
    rows = spark.createDataFrame([(0, "насос ромашка-прибор x"), (1, "система мониторинга"), (2, "ИНН 7700000002"), (3, "Труба ТУ 0000-001-00000001 x")], "row_id int, text string")
    assert {r["row_id"]: r["inn"] for r in resolve.identify_in_text(rows, base).collect()} == {0: "7700000001", 2: "7700000002"}
    assert {r["row_id"]: r["inn"] for r in resolve.identify_marker(rows, base).collect()} == {3: "7700000002"}


def test_spans(spark, base):
    rows = spark.createDataFrame([(0, "Насос ZETTA-7 ТУ 12-34 IP65 и ИНН 5904184047", "", ""), (1, "чисто", "", "")], "row_id int, text string, code string, factory string")
    got = [(r["row_id"], r["piece"].strip()) for r in spans.redaction_matches(rows, base).orderBy("row_id", "a").collect()]
    assert got == [(0, "ZETTA-7"), (0, "ТУ 12-34"), (0, "ИНН 5904184047")]
    found = spark.createDataFrame([(0, 0, 0, 3), (0, 1, 2, 4), (0, 2, 3, 5), (0, 3, 7, 9)], "row_id int, k int, a int, b int")
    assert sorted(tuple(r) for r in intervals.coalesce_spans(found).select("a", "b").collect()) == [(0, 5), (7, 9)]
    cut = intervals.subtract_spans(spark.createDataFrame([(0, 0, 0, 10)], "row_id int, k int, a int, b int"), spark.createDataFrame([(0, 3, 5), (0, 5, 6)], "row_id int, a int, b int"))
    assert sorted(tuple(r) for r in cut.select("a", "b").collect()) == [(0, 3), (6, 10)]


def test_rules_by_name(spark, base):
    """Rules without an inn go by the maker's name, however the maker was found, unless its inn has rules of its own."""
    make = spark.createDataFrame
    named = RuleBase(
        base.rules.unionByName(make([(2, "", "ООО Заря-Кран", "ЗР-", "Начало фирменного обозначения", ""), (3, None, "Вектор-Арматура", "ВА-", "Начало фирменного обозначения", "")], RULES)),
        base.aliases.unionByName(make([(3, "7700000003", "Заря-Кран", 'АО "Заря-Кран"')], ALIASES)),
        base.registry.unionByName(make([("456103", "Заря-Кран")], REGISTRY)),
        base.markers.unionByName(make([(1, "ТУ 0000-003-00000003", "7700000003", "")], MARKERS)),
        base.globals,
    )
    rows = [(0, "Кран ЗР-15 ИНН 7700000003", "", ""), (1, "Кран ЗР-16", "456103", ""), (2, "Кран ЗР-17 ТУ 0000-003-00000003", "", ""), (3, "Кран ЗР-18", "", ""), (4, "Кран ВА-19 ВЕКТА 15 ИНН 7700000002", "", "")]
    rows = make(rows, "row_id int, text string, code string, factory string")
    got = [(r["row_id"], r["label"]) for r in spans.redaction_spans(rows, named).where("label like '%rule:%'").orderBy("row_id", "a").collect()]
    assert got == [(0, "rule:ЗР-"), (1, "rule:ЗР-"), (2, "rule:ЗР-"), (4, "rule:ВЕКТА")]


def python_pattern(p):
    """A pattern of the engine for Python: \\w, \\b and case are Unicode there without flags."""
    for flags in ("(?iuUd)", "(?uUd)"):
        if p.startswith(flags):
            return re.compile(p[len(flags):], re.I if "i" in flags else 0)
    return re.compile(p)


def painted(text, candidates, kept):
    """Spans by painting characters: candidates in order, minus kept characters, blank pieces dropped, touching ones as one."""
    safe = {i for p in kept for m in p.finditer(text) for i in range(*m.span())}
    pieces = []
    for n, (a, b, label) in enumerate(sorted(candidates, key=lambda c: (c[0], c[0] - c[1]))):
        run = []
        for i in [*range(a, b), None]:
            if i is not None and i not in safe:
                run.append(i)
            elif run:
                if text[run[0] : run[-1] + 1].strip():
                    pieces.append((run[0], run[-1] + 1, n, label))
                run = []
    out = []
    for a, b, _, label in sorted(pieces):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b), [*out[-1][2], label])
        else:
            out.append((a, b, [label]))
    return [(a, b, ";".join(dict.fromkeys(labels))) for a, b, labels in out]


def test_spans_against_painting(spark, base):
    """System, maker, alias, global and unique rules over a few hundred mixed texts, offsets and labels."""
    rng = random.Random(8)
    parts = ["Кран", "ТУ 12-34-56", "ТУ", "арт. 7/2", "DN50", "ИНН 5904184047", "ИНН 7700000002", "www.a.ru", "ZETTA-7", "zetta-9x", "Заявка № 1/а", "№ 12-А/3 от 12.03.2019", "Ромашка-Прибор", "Вектор-Арматура", "РП-5", "ВЕКТА 15-2",
             "ГОСТ 12-3", "(АБВ 12 ТУ)", "ВО ТУ 5-6", "IP65", "абвТУ", "ТУ 3742-\n001", ",", "ООО \"Завод\" ИНН 5904184047", "", " ", "мониторинг", "Метран 150-А"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(7))) for _ in range(300)]
    metran = spark.createDataFrame([(2, "7700000004", "Прочие", "Метран-100", "Бренд + соседний индекс", "бренд")], RULES)
    base = RuleBase(base.rules.unionByName(metran), base.aliases, base.registry, base.markers, base.globals)
    rows = spark.createDataFrame([(i, t, None, None) for i, t in enumerate([*texts, None])], "row_id int, text string, code string, factory string")
    got = {}
    for r in spans.redaction_spans(rows, base).orderBy("row_id", "a").collect():
        got.setdefault(r["row_id"], []).append((r["a"], r["b"], r["label"]))
    triggers = {t: python_pattern(spark.range(1).select(rulebase.trigger_pattern(F.lit(t), F.lit(m))).first()[0] + (rulebase.BRAND_SUFFIX if t != "ZETTA-" and m == rulebase.BRAND else "")) for t, m in (("РП-", "Начало фирменного обозначения"), ("ZETTA-", "Начало фирменного обозначения"), ("ВЕКТА", "Бренд + соседний индекс"), ("Метран-100", "Бренд + соседний индекс"))}
    bare = python_pattern(spark.range(1).select(rulebase.trigger_pattern(F.lit("ВЕКТА"), F.lit(rulebase.BRAND))).first()[0])
    aliases = {"7700000001": ["Ромашка-Прибор"], "7700000002": ["Вектор-Арматура", "мониторинг"]}
    for i, t in enumerate(texts):
        first = re.search(r"ИНН (\d{10})", t)
        named = [k for k, a in aliases.items() if a[0].lower() in t.lower()]
        inn = first[1] if first and first[1] == "7700000002" else max(named, key=lambda k: len(aliases[k][0])) if named else ""
        found = [(*m.span(), "global:ZETTA-") for m in triggers["ZETTA-"].finditer(t)]
        own = {"7700000001": [("rule:РП-", triggers["РП-"])], "7700000002": [("rule:ВЕКТА", bare)], "": [("unique:Метран-100", triggers["Метран-100"]), ("unique:ВЕКТА", triggers["ВЕКТА"])]}[inn]
        found += [(*m.span(), label) for label, p in own for m in p.finditer(t)]
        found += [(*m.span(), f"alias:{a}") for a in aliases.get(inn, []) for m in re.finditer(rf"(?<!\w){re.escape(a)}(?!\w)", t, re.I)]
        found += [(*m.span(), name) for name, p in SPAN_RULES for m in python_pattern(p).finditer(t)]
        assert got.get(i, []) == painted(t, found, [python_pattern(p) for p in keep.PROTECTED]), t
    assert len(texts) not in got


def test_unfinished_numbers(spark):
    """What follows the last hyphen of a number decides, not what follows an earlier one."""
    texts = {"Труба ТУ 2531-": True, "ТУ 25--31": False, "ТУ 12-.5-34": False, "ТУ 12-34- шт": True, "ТУ 12-34- 5": False, "ТУ 12": False}
    df = spark.createDataFrame(list(texts.items()), "t string, want boolean")
    assert not df.where(F.col("t").rlike(layout.UNFINISHED_TU) != F.col("want")).count()


def test_blank_blocks_are_no_neighbours(spark, base):
    rows = [("f", 1, 800.0, 0, "Поставщик ИНН", 0.0, 100.0, 9.0, 110.0), ("f", 1, 800.0, 1, " \u00a0\n", 0.0, 105.0, 9.0, 115.0), ("f", 1, 800.0, 2, "5904184047", 0.0, 112.0, 9.0, 122.0), ("f", 1, 800.0, 3, None, 0.0, 112.0, 9.0, 122.0)]
    blocks = spark.createDataFrame(rows, "file string, page int, page_h double, block int, text string, x0 double, y0 double, x1 double, y1 double")
    found = pages.page_spans(blocks, base)[0]
    assert ("inn_continuation", 2) in [(r["label"], r["block"]) for r in found.collect()]


def test_markers_of_any_length(spark, base):
    markers = spark.createDataFrame([(0, "Q7", "1", "a"), (1, "ТУ-5", "2", "b"), (2, " ТУ-55-77 ", "3", "c"), (3, "z", "4", "d"), (4, "\u00a0", "5", "e")], MARKERS)
    rows = spark.createDataFrame([(0, "x ТУ-55-77 Q7"), (1, "ТУ-5 Q7"), (2, "Q7"), (3, "no"), (4, "z"), (5, None)], "row_id int, text string")
    got = {r["row_id"]: (r["inn"], r["factory"]) for r in resolve.identify_marker(rows, RuleBase(base.rules, base.aliases, base.registry, markers, base.globals)).collect()}
    assert got == {0: ("3", "c"), 1: ("2", "b"), 2: ("1", "a"), 4: ("4", "d")}


def test_rule_base_file(spark, tmp_path):
    """One JSON document, gzip or not; numbers follow the order of the lists; broken patterns are refused."""
    data = {"version": "7", "rules": [{"inn": "1", "manufacturer": "М", "trigger": "РП-", "apply": "Точное совпадение", "type": ""}, {"inn": "2", "trigger": "АБ"}], "aliases": [{"inn": "1", "alias": "Мотор-Завод", "manufacturer": "М"}],
            "registry": {"456": "М"}, "pdf_markers": [{"contains": "ТУ 1", "inn": "1"}], "global_unique_rules": [{"trigger": "Z-", "regex": "Z-[0-9]+"}]}
    (tmp_path / "base.json.gz").write_bytes(gzip.compress(json.dumps(data).encode()))
    loaded = RuleBase.load(spark, f"{tmp_path}/base.json.gz")
    assert loaded.version == "7" and [(r["ord"], r["trigger"], r["apply"]) for r in loaded.rules.orderBy("ord").collect()] == [(0, "РП-", "Точное совпадение"), (1, "АБ", None)]
    assert loaded.registry.first()["factory"] == "М" and loaded.alias_index().first()["alias_norm"] == "мотор-завод"
    assert {r["row_id"]: r["text"] for r in anonymize(spark.createDataFrame([(0, "Кран Z-77 x", "456", "")], "row_id int, name string, code string, factory string"), loaded).collect()} == {0: "Кран x"}
    data["global_unique_rules"][0]["regex"] = "("
    (tmp_path / "bad.json").write_text(json.dumps(data))
    with pytest.raises(ValueError, match="invalid patterns"):
        RuleBase.load(spark, f"{tmp_path}/bad.json")


def test_layout(spark):
    rects = spark.createDataFrame([("f", 1, 0, 0.0, 0.0, 9.0, 9.0), ("f", 1, 1, 0.4, 0.4, 9.4, 9.4), ("f", 1, 2, 0.6, 0.0, 9.0, 9.0)], "file string, page int, ord int, x0 double, y0 double, x1 double, y1 double")
    assert [r["ord"] for r in layout.dedupe_rects(rects).orderBy("ord").collect()] == [0, 2]


def test_pages(spark, base):
    texts = [
        (1, 0, "Поставщик ИНН", 100.0), (1, 1, "5904184047", 120.0), (1, 2, "Датчик IP65", 300.0), (1, 3, "узел ИНН 7700000001", 400.0), (1, 4, "м 2 7700000001 шт", 500.0), (1, 5, "Труба ТУ 2531-", 700.0),
        (2, 0, "002-53597015-12", 100.0), (2, 1, "002-53597015-13", 130.0), (2, 2, "КШГ 71.100.050.А.16\nDN50", 300.0), (3, 0, "456101 Кран РП-7", 100.0), (3, 1, "РП-8 насос", 101.0), (3, 2, "РП-9 насос", 300.0),
    ]
    chars = []
    for page, block, text, y in texts:
        for line, row in enumerate(text.split("\n")):
            chars += [("f", page, block, line, 0, i, c, 10.0 * i, y + 12 * line, 10.0 * i + 9, y + 12 * line + 10) for i, c in enumerate(row)]
    chars = spark.createDataFrame(chars, "file string, page int, block int, line int, span int, idx int, ch string, x0 double, y0 double, x1 double, y1 double")
    found, placed = pages.block_texts(chars)
    assert {(r["page"], r["block"], r["text"]) for r in found.collect()} == {t[:3] for t in texts}
    blocks = found.withColumn("page_h", F.lit(800.0))
    merged, context = pages.page_spans(blocks, base)
    got = {(r["page"], r["block"], r["a"], r["b"]): r["label"] for r in merged.collect()}
    assert got[1, 1, 0, 10] == "inn_continuation" and got[1, 3, 5, 19] == "contact;known_inn" and got[1, 4, 4, 14] == "inn_cross_block"
    assert got[2, 0, 0, 15] == "tu_continuation" and got[2, 2, 0, 3] == "context:КШГ" and got[2, 2, 4, 19] == "context:КШГ-model"
    assert got[3, 0, 12, 16] == "rule:РП-" == got[3, 1, 0, 4]  # by its own code, by the code on its row
    assert not [k for k in got if k[:2] in ((1, 2), (2, 1), (3, 2))]
    rects = pages.page_rects(merged, placed)
    box = rects.where("page = 2 and ord.block = 0").first()
    assert (box["x0"], box["x1"], round(box["y0"], 3), round(box["y1"], 3)) == (0.0, 149.0, 105.5, 106.2)
    whole = pages.page_rects(merged, placed, spark.createDataFrame([("f", 2)], "file string, page int")).where("page = 2 and ord.block = 0").first()
    assert (round(whole["x0"], 3), round(whole["y1"], 3)) == (-0.8, 110.8)
    listed = spark.createDataFrame([("f", 1, False, False), ("f", 2, False, False), ("g", 1, True, False), ("h", 1, False, False)], "file string, page int, recognized boolean, failed boolean")
    report = {r["file"]: r for r in pages.page_report(blocks, merged, context, rects, listed).collect()}
    assert [report[f]["outcome"] for f in "fgh"] == ["ok", "review", "error"]
    assert (report["f"]["pages"], report["f"]["blocks"], report["f"]["tu_continuations"], report["f"]["context_models"]) == (2, 12, 1, 1)
    assert one(spark, ["   12345678901 ", "123456789012", None], pages.needs_recognition) == [True, False, True]


def test_file_report(spark):
    rows = spark.createDataFrame([(0, "f", "a"), (1, "f", "b"), (2, "g", "a")], "row_id int, file string, sheet string")
    out = audit.with_fill(spark.createDataFrame([(0, True, GREEN), (1, False, YELLOW), (2, True, YELLOW)], "row_id int, changed boolean, status string"))
    assert [r["fill"] for r in out.orderBy("row_id").collect()] == ["D9EAD3", "FFF2CC", "FFF2CC"]
    assert sorted(tuple(r) for r in audit.file_report(rows, out).collect()) == [("f", 2, 1, 1, 1, 2), ("g", 1, 1, 0, 1, 1)]


def test_sheets(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Код;Наименование;Завод\n456101;Насос РП-1;x\n;;\n".encode("cp1251"))
    (tmp_path / "bad.csv").write_bytes(b"x")
    cells = sheets.read_delimited(spark, str(tmp_path))
    heads = sheets.find_headers(cells.where("data_type <> 'failed'"), sheets.CODE_CSV)
    assert [(r["name"], r["code"], r["factory"]) for r in sheets.item_rows(cells, heads, False).collect()] == [("Насос РП-1", "456101", "x")]
    assert cells.where("data_type = 'failed'").count() == 1


def test_workbooks(spark, tmp_path):
    rows = [("готово", 2, 1, "Код", "s"), ("готово", 2, 2, "Наименование", "s"), ("готово", 2, 3, "Завод", "s"), ("готово", 2, 4, "Статус", "s"), ("готово", 3, 1, "456101", "n"), ("готово", 3, 2, "Насос <РП-1> & \x01", "s"),
            ("готово", 3, 3, "x", "s"), ("готово", 4, 1, "7", "n"), ("готово", 4, 2, "Болт", "s"), ("a", 30, 28, " b ", "s")]
    cells = spark.createDataFrame([("/in/m.xlsx", *r) for r in rows], sheets.CELLS)
    results = spark.createDataFrame([("/in/m.xlsx", "готово", 3, "Насос", GREEN), ("/in/m.xlsx", "готово", 4, "Болт", YELLOW)], "file string, sheet string, r int, text string, status string")
    placed = workbooks.place_results(cells, sheets.find_headers(cells), results)
    fills = {(r["r"], r["c"]): r["fill"] for r in placed.where("fill is not null").collect()}
    assert fills == {(2, 5): "D9EAF7", (2, 4): "D9EAF7", (3, 4): "D9EAD3", (3, 1): "D9EAD3", (4, 4): "FFF2CC", (4, 1): "FFF2CC"}
    workbooks.save_workbooks(workbooks.workbooks(placed), str(tmp_path))
    assert [p.name for p in tmp_path.iterdir()] == ["m_обезличено.xlsx"]
    read = {(r["sheet"], r["r"], r["c"]): r["value"] for r in sheets.read_workbooks(spark, str(tmp_path)).collect()}
    want = {(s, r, c): v for s, r, c, v, _ in rows} | {("готово", 3, 2): "Насос <РП-1> & ", ("готово", 2, 5): workbooks.RESULT, ("готово", 3, 5): "Насос", ("готово", 3, 4): GREEN, ("готово", 4, 5): "Болт", ("готово", 4, 4): YELLOW}
    del want["готово", 3, 3]  # the factory is blank
    assert read == want


def test_batch(spark):
    files = spark.createDataFrame([(0, "a.csv"), (1, "a.csv"), (2, "b_обезличено.csv"), (3, "c.txt"), (4, "d.XLSX")], "ord int, path string")
    assert sorted(r["path"] for r in audit.supported_files(files).collect()) == ["a.csv", "d.XLSX"]


def test_files_end_to_end(spark, base, tmp_path):
    """From bytes to bytes: a workbook, two delimited files, and four that fail without stopping the others."""
    given, out = tmp_path / "in", tmp_path / "out"
    given.mkdir()
    out.mkdir()
    lines = ["отчёт;;", "Код;Наименование;Завод;Примечание", "456101;Насос РП-1 DN50;x;a", "; \u00a0;завод;b", ";Болт М12", "1;3;z;", ';"Кран; шар";y;c']
    (given / "a.CSV").write_bytes("\r\n".join(lines).encode("cp1251", "replace").replace(b"? ", b"\xa0"))
    (given / "tabs.csv").write_bytes("\ufeffКод МТР\tОписание\n456101\tДатчик ТУ 12-34 IP65\n".encode())
    for name, data in {"empty.csv": b"", "no.csv": "x;y\n1;2\n".encode(), "bad.xlsx": b"no zip", "scan.doc": b"?", "a_обезличено.csv": b"old"}.items():
        (given / name).write_bytes(data)
    rows = [("Готово", 2, 1, "Код", "s"), ("Готово", 2, 2, "Наименование", "s"), ("Готово", 2, 3, "Завод", "s"), ("Готово", 3, 1, "1", "s"), ("Готово", 3, 2, "3", "s"), ("Готово", 4, 1, "456101", "s"), ("Готово", 4, 2, "Насос РП-5 DN40", "s"), ("Готово", 4, 3, "x", "s"),
            ("Готово", 5, 2, "#DIV/0!", "e"), ("Готово", 6, 2, " \u00a0\t", "s"), ("Готово", 7, 2, "Болт", "s"), ("Лист", 1, 2, "Наименование", "s"), ("Лист", 1, 1, "Код", "s"), ("Лист", 2, 2, "Кран РП-9", "s")]
    (given / "book.xlsx").write_bytes(workbooks.workbook_bytes(pd.DataFrame([(*r, None) for r in rows], columns=["sheet", "r", "c", "value", "data_type", "fill"])))
    (given / "other.xlsm").write_bytes(workbooks.workbook_bytes(pd.DataFrame([("a", 1, 1, "x", "s", None)], columns=["sheet", "r", "c", "value", "data_type", "fill"])))
    report = files.process_files(spark, str(given), str(out), base)
    got = {r["file"].rsplit("/", 1)[1]: (r["outcome"], r["rows"], r["changed"], r["green"], r["yellow"], r["sheets"]) for r in report.collect()}
    assert got == {"a.CSV": ("ok", 4, 1, 1, 3, 1), "tabs.csv": ("ok", 1, 1, 1, 0, 1), "book.xlsx": ("ok", 2, 1, 1, 1, 1), **dict.fromkeys(["empty.csv", "no.csv", "bad.xlsx", "other.xlsm", "scan.doc"], ("error", 0, 0, 0, 0, 0))}
    assert tuple(audit.batch_summary(report).first()) == (3, 0, 5, 8)
    assert sorted(p.name for p in out.iterdir()) == ["a_обезличено.CSV", "book_обезличено.xlsx", "tabs_обезличено.csv"]
    assert (out / "a_обезличено.CSV").read_bytes().decode("utf-8-sig").split("\r\n") == [
        "отчёт;;", f"Код;Наименование;Завод;Примечание;{workbooks.RESULT};{workbooks.STATUS}", f"456101;Насос РП-1 DN50;;a;Насос DN50;{GREEN}", "; \u00a0;завод;b;;", f";Болт М12;;;Болт М12;{YELLOW}", f"1;3;;;3;{YELLOW}", f';"Кран; шар";;c;"Кран; шар";{YELLOW}', "",
    ]
    assert (out / "tabs_обезличено.csv").read_bytes().startswith(b"\xef\xbb\xbf") and "\tДатчик IP65\t" in (out / "tabs_обезличено.csv").read_text("utf-8-sig")
    read = {(r["sheet"], r["r"], r["c"]): r["value"] for r in sheets.read_workbooks(spark, str(out).replace("out", "in")).where("sheet = 'Готово'").collect()}
    assert read["Готово", 4, 3] == "x"
    audited = {r["file"].rsplit("/", 1)[1]: r for r in files.process_workbooks(spark, str(given), str(out), base).collect()}
    assert [audited["book.xlsx"][c] for c in files.AUDITS] == [0, 0, 0]


SLOW = {"anonymize_items", "status_report", "audits", "redaction_spans"}


@pytest.mark.parametrize("name", sorted(set(catalog.ORACLE_SQL) - SLOW))
def test_catalog_matches_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("part", "supplier", "lineitem", "documents", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    want = con.sql(catalog.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    assert sorted(tuple(map(str, (r[c] for c in columns))) for r in df.collect()) == sorted(tuple(str(r[i]) for i in order) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(rule_rows.QUERIES))
def test_rule_rows_hit_and_miss(spark, name):
    """Each rule's rows hold hits, misses and nulls, so that agreement with DuckDB says something."""
    kind, of = name.split("_", 1)
    texts = rule_rows.RULES[of][0] if kind == "rule" else rule_rows.TRIGGERS[of][2]
    given = {r["row_id"]: r["text"] for r in rule_rows._rows(spark, SF, texts).collect()}
    got = {r[0]: r[1] for r in rule_rows.QUERIES[name](spark, SF).collect()}
    bare = lambda t: re.sub(r"\s+", "", t or "").strip(",;.-")
    hit = {i % 6: bare(got[i]) != bare(t) if kind == "rule" else got[i] is not None for i, t in given.items() if t is not None}
    assert len(hit) == 5 and 1 <= sum(hit.values()) <= 4 and all(got[i] is None for i, t in given.items() if t is None)
