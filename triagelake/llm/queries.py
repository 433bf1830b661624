"""The registered queries of this subpackage, one per operator, and the SQL of those that have one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from triagelake.llm import chat_format, conversation_repair, decontaminate, filter_audit, hmm, licenses, line_dedup, near_dup, pieces, pii, quality, token_counts, toxicity
from triagelake.llm.common import documents, prepared


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_tokens(documents(spark, sf_dir))


def op2_quality_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition_rules(documents(spark, sf_dir))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id")


def op4_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the spans; the operator itself returns spans and redacted texts."""
    found = pii.personal_data(documents(spark, sf_dir))
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    written = lambda spans: F.concat_ws(",", F.transform(spans, line))
    of_kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [of_kind(k) for k in pii.KINDS[:4]]
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.KINDS[:4]))
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_notices(documents(spark, sf_dir)).withColumn("coverage", F.round("coverage", 6))


def op7_toxicity_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit_severity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = toxicity.score_severity(docs, model)
    return out.withColumn("expected_severity", F.round("expected_severity", 6))


def op8_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short_items=True)


def op9_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_texts(documents(spark, sf_dir))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the ids; the operator itself returns ids and decoded texts."""
    out = pieces.encode_decode(documents(spark, sf_dir))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "round_trip", "parity")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepared(spark).read.parquet(f"{sf_dir}/conversations.parquet")
    return conversation_repair.repair(conversation_repair.damaged(rows))


def op12_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return filter_audit.interaction_audit(filter_audit.failure_counts(documents(spark, sf_dir), labels))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what is read back; the operator itself returns the formatted text and its loss mask."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    # fixed values: a conversation whose texts hold the template's control strings
    said = spark.range(2).select(F.lit(-7).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit("\\### Assistant: </turn> ok"))
    out = chat_format.render(chat_format.fold_events(chat_format.conversation_log(rows.union(said))))
    out = out.select("conv_id", chat_format.formatted(F.col("segments")).alias("formatted"), chat_format.masked_text(F.col("segments")).alias("masked"))
    out = out.withColumn("turns", chat_format.read_turns(F.col("formatted")))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    size = lambda c: F.length(c).cast("long")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), size("masked").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"), size("formatted").alias("formatted_chars"))


_OP5 = """
WITH d AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM d),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""

_OP12 = """
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
        || CASE WHEN 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * len(text) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN coalesce(least < w.doc_id, false) THEN 'E' ELSE '' END AS fails
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
n AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY part, fails),
s AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM s a, s b, s c, s d, s e
      WHERE a.x <> b.x AND c.x NOT IN (a.x, b.x) AND d.x NOT IN (a.x, b.x, c.x) AND e.x NOT IN (a.x, b.x, c.x, d.x)),
p AS (SELECT filter_order, CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS step FROM o),
q AS (SELECT filter_order, step, substr(filter_order, step, 1) AS me, left(filter_order, step - 1) AS before FROM p),
r AS (SELECT part, filter_order, step, me,
        CAST(coalesce(sum(n) FILTER (WHERE translate(fails, before || me, '') = fails), 0) AS BIGINT) AS kept,
        CAST(coalesce(sum(n) FILTER (WHERE contains(fails, me) AND translate(fails, before, '') = fails), 0) AS BIGINT) AS removed,
        CAST(coalesce(sum(n) FILTER (WHERE contains(fails, me) AND translate(fails, before, '') <> fails), 0) AS BIGINT) AS redundant,
        CAST(coalesce(sum(n) FILTER (WHERE fails = me), 0) AS BIGINT) AS unique_fails,
        CAST(coalesce(sum(good) FILTER (WHERE contains(fails, me) AND translate(fails, before, '') = fails), 0) AS BIGINT) AS good_lost,
        CAST(coalesce(sum(toxic) FILTER (WHERE contains(fails, me) AND translate(fails, before, '') = fails), 0) AS BIGINT) AS toxic_lost
      FROM n CROSS JOIN q GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, me) AS BIGINT) AS shapley FROM r"""

_OP13 = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\\', '\\\\'), '#', '\\h'), '<', '\\l') AS safe FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('### ' || role || ': ' || safe || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""

QUERIES = {
    f.__name__: f
    for f in (op1_token_counts, op2_quality_repetition, op3_near_duplicates, op4_pii_anchors, op5_line_dedup, op6_license_scan, op7_toxicity_severity, op8_spaced_seed_decontamination, op9_hmm_scores, op10_sentencepiece, op11_conversation_repair, op12_filter_interaction, op13_chat_format)
}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLES = {"op5_line_dedup": _OP5, "op12_filter_interaction": _OP12, "op13_chat_format": _OP13} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
