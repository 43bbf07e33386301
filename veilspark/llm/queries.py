"""The queries of this subpackage, each over its whole tables, with digests of the operators' outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import chat, decontaminate, knn, neardup, packing, pii, quality, repeats, secrets, toxicity
from veilspark.llm import pipeline as stages
from veilspark.llm.kit import table
from veilspark.llm.training import fold, labelled_sample


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect_pii(table(spark, sf_dir, "documents"))
    spans = F.col("pii_spans")
    return found.select("doc_id", *_counts(spans, pii.BASE), F.sha2(pii.span_digest(spans, pii.BASE), 256).alias("base_sha256"), pii.span_digest(spans).alias("spans"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.detect_secrets(table(spark, sf_dir, "documents"))
    spans = F.col("secret_spans")
    return found.select("doc_id", *_counts(spans, secrets.BASE), F.sha2(pii.span_digest(spans, secrets.BASE), 256).alias("base_sha256"), pii.span_digest(spans).alias("spans"))


def _counts(spans, kinds):
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return [count(k).alias(f"n_{k}") for k in kinds]


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(labelled_sample(docs, labels, "toxic", fold("doc_id", 5) != 0))
    return toxicity.score(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    # one conversation more, whose texts are control strings
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(more).alias("text"))
    out = chat.formatted(chat.rows_to_turns(rows.unionByName(added)))
    read = F.transform(chat.read_turns(), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    out = out.select("conv_id", "formatted", F.size(chat.read_turns()).cast("long").alias("n_turns"), F.sha2(F.array_join(read, ""), 256).alias("turns_sha256"), chat.masked_text().alias("under_mask"))
    return out.select("conv_id", "n_turns", "turns_sha256", F.length("under_mask").cast("long").alias("loss_chars"), F.sha2("under_mask", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(labelled_sample(docs, labels, "quality", fold("doc_id", 3) != 1))
    return quality.score(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_pii, op2_decontaminate, op3_near_duplicates, op4_packing, op5_top_k, op6_secrets, op7_toxicity, op8_chat, op9_repeats, op10_quality, pipeline)
}

# words as in kit.WordScanner: A-Z lower-cased only
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
# the template's escapes, as in chat.escaped
_ESCAPED = r"replace(replace(replace(replace(replace({}, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')"

ORACLE_SQL = {
    "op2_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
 b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
 bw AS (SELECT DISTINCT item_id, least(8, len(w)) AS n, array_to_string(w[i : i + least(8, len(w)) - 1], ' ') AS phrase
        FROM b, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
 sizes AS (SELECT DISTINCT n FROM bw),
 dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS phrase FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)),
 hits AS (SELECT DISTINCT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.phrase = bw.phrase),
 spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
 items AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
 sha256(coalesce(s, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op5_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
       FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
""",
    "op8_chat": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
 g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
  sum(length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) + {len("<s>[INST][/INST]</s>")}) AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
 CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
""",
}
