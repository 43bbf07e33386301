"""Steps whose work must grow no faster than their input, and their results on odd cases."""

import itertools
import random
import re

from pyspark.sql import functions as F

from veilspark.operators import contain, intervals, layout, resolve
from veilspark.plans import catalog, synth

SF = "/root/testdata/sf0.001"
BOX = "file string, page int, ord int, x0 double, y0 double, x1 double, y1 double"


def text_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_aliases_that_share_a_first_word(spark):
    """Texts meet the aliases that they contain, not all of the same first word; odd starts, short texts and nulls."""
    needles = spark.createDataFrame([(f"завод-{i:05}-юг",) for i in range(3000)] + [("завод-1",)], "v string")
    texts = spark.createDataFrame([(i, f"склад завод-{i:05}-юг 7") for i in range(3000)] + [(3000, None), (3001, "завод"), (3002, "xзавод-1")], "id int, t string")
    known = contain.net(needles, "v", (7,))
    got = {(r["id"], r["v"]) for r in contain.met(texts, "id", F.col("t"), needles, "v", (7,), known).collect()}
    assert got == {(i, f"завод-{i:05}-юг") for i in range(3000)} | {(3002, "завод-1")}


def test_alias_inside_needs_its_first_word(spark):
    base = synth.rule_base(spark, SF)
    rows = spark.createDataFrame([(0, "склад ромашка-3-прибор2"), (1, "суперромашка-3-прибор"), (2, "суперромашка-3-прибор ромашка")], "row_id int, text string")
    assert {r["row_id"]: r["alias_norm"] for r in resolve.longest_alias(rows, base, "text").collect()} == {0: "ромашка-3-прибор", 2: "ромашка-3-прибор"}


def test_rows_without_a_key_are_dealt_out(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, F.lit("")).alias("k"))
    table = spark.createDataFrame([(f"a{i}", i) for i in range(9)], "k string, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = contain.lookup(rows, "k", "id", table)
        most = max(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert most < 1000 and out.where("v is not null").count() == 0


def test_redaction_spans_plan_is_small(spark):
    """The sources of candidates are not part of the plan that cuts them."""
    assert len(re.findall("Generate", text_of(catalog.QUERIES["redaction_spans"](spark, SF)))) < 6


def greedy(rects):
    kept = []
    for r in sorted(rects, key=lambda r: r[2:]):
        if not any(r[:2] == k[:2] and all(abs(a - b) < layout.SAME_RECT for a, b in zip(r[3:], k[3:], strict=True)) for k in kept):
            kept.append(r)
    return sorted(kept)


def test_rects_of_one_page(spark):
    """Chains of near boxes, equal boxes and gaps of just the tolerance; boxes with a null are all kept."""
    rng = random.Random(3)
    side = lambda: rng.choice([0.0, 0.25, 0.49, 0.5, 0.75, 1.0, 3.0, 3.4, 7.5])
    rects = [("f", p, n, side(), side(), 9.0 + side() / 4, 9.0) for p in (1, 2) for n in range(250)]
    got = sorted(tuple(r[c] for c in ("file", "page", "ord", "x0", "y0", "x1", "y1")) for r in layout.dedupe_rects(spark.createDataFrame(rects, BOX)).collect())
    assert got == greedy(rects)
    odd = spark.createDataFrame([("f", 1, 0, None, 0.0, 1.0, 1.0), ("f", 1, 1, None, 0.0, 1.0, 1.0), ("f", 1, 2, float("nan"), 0.0, 1.0, 1.0)], BOX)
    assert sorted(r["ord"] for r in layout.dedupe_rects(odd).collect()) == [0, 1, 2]
    same = layout.dedupe_rects(spark.createDataFrame(rects, BOX))
    assert "min(ord" in text_of(same)  # equal boxes are dropped before boxes are compared pair by pair


def test_subtraction_against_painting(spark):
    rng = random.Random(5)
    cut = lambda: (a := rng.randrange(20), a + rng.randrange(1, 6))
    found = [(i % 40, i, *cut()) for i in range(200)]
    kept = [(i % 40, *cut()) for i in range(70)]
    out = intervals.subtract_spans(spark.createDataFrame(found, "row_id int, k int, a int, b int"), spark.createDataFrame(kept, "row_id int, a int, b int"))
    want = []
    for row, k, a, b in found:
        free = [x for x in range(a, b) if not any(r == row and p <= x < q for r, p, q in kept)]
        for _, run in itertools.groupby(enumerate(free), lambda e: e[1] - e[0]):
            run = [x for _, x in run]
            want.append((row, k, run[0], run[-1] + 1))
    assert sorted(tuple(r[c] for c in ("row_id", "k", "a", "b")) for r in out.collect()) == sorted(want)
    assert "Window" not in text_of(out) and out.dtypes == [("row_id", "int"), ("k", "int"), ("a", "int"), ("b", "int")]
