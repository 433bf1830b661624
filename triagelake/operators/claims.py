"""Checking written explanations against the assessment and its citations.

An explanation is one row of JSON. Its claims stay an array of that row and every check is a
column expression over it, so the whole check needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions.scale import ratio
from triagelake.functions.text import sha, strip

SCHEMA = (
    "incident_decision STRING, severity STRING, summary STRING, explanation STRING, "
    "claims ARRAY<STRUCT<text STRING, claim_type STRING, citation_ids STRING>>, uncertainties ARRAY<STRING>, recommended_action STRING"
)

# fixed values: claim types, and those that must be backed by citations
CLAIM_TYPES = ("OBSERVATION", "EVIDENCE", "CORRELATION", "INTERPRETATION", "UNCERTAINTY", "RECOMMENDATION")
FACTUAL_TYPES = ("OBSERVATION", "EVIDENCE", "CORRELATION")

# fixed values: phrases that assert a cause
CAUSAL_PATTERNS = (
    r"\bcaused by\b",
    r"\bcrashed because\b",
    r"\bunderlying root cause is\b",
    r"\bdefinitively caused\b",
    r"\bfailure is due to\b",
)

# fixed values: words that carry no content
STOPWORDS = (
    "a", "an", "the", "in", "on", "at", "for", "to", "of", "and", "or", "is", "are", "was", "were", "this", "that", "it", "with", "as",
    "by", "from", "be", "has", "have", "had", "not", "but", "observed", "evidence", "log", "window", "system", "event", "events", "chunk", "chunks",
)

# fixed values: words that tie a claim to the signals
SIGNAL_WORDS = ("anomaly", "score", "escalation", "repeated", "window", "connection")

# fixed values: faults outside the logs, and words of the assessment itself
EXTERNAL_FAULT_WORDS = ("crash", "crashed", "power", "supply", "disk", "hardware", "reboot", "rebooted", "cable", "killed", "leak", "corrupted")
ASSESSMENT_WORDS = (
    "rule", "rules", "classified", "decision", "severity", "confidence", "signal", "signals", "anomaly", "score", "escalation", "evidence", "sufficiency",
    "insufficient", "retrieval", "relevance", "alignment", "agreement", "conflict", "conflicts", "system", "deterministic",
)

# fixed values: phrases of free text that need a supported claim
RISKY_PHRASES = (
    "power supply", "catastrophically failed", "server crashed", "hardware reboot", "disk corrupted", "memory leak", "network split", "switch failed",
    "kernel panic", "data corrupted",
)
CONFIRMED_PATTERN = r"(?i)\b(confirmed incident|definite attack|verified failure|incident confirmed)\b"

MIN_OVERLAP, COVERAGE_VERIFIED, MIN_COVERAGE = 0.05, 0.70, 0.50


def _lits(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def content_tokens(text: Column) -> Column:
    """Distinct lower-case words of three and more characters without stopwords."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b[a-zA-Z0-9_-]{3,}\b"), F.lit(0))), _lits(STOPWORDS))


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?U)\b[0-9]+(?:\.[0-9]+)?\b"), F.lit(0)), lambda n: n.cast("double"))


def parse_claims(explanations: DataFrame) -> DataFrame:
    """Add ``parsed`` (NULL if no JSON object) and ``claims``; claims without text are dropped.

    Unknown types become INTERPRETATION; citation ids may come as a list or as one string.
    """
    out = explanations.withColumn("parsed", F.from_json(strip(F.col("raw_json")), SCHEMA))
    ok = F.rlike(strip(F.col("raw_json")), F.lit(r"(?s)^\{.*\}$")) & F.get_json_object("raw_json", "$").isNotNull()
    out = out.withColumn("parsed", F.when(ok, F.col("parsed")))

    def ids(c: Column) -> Column:
        raw = c["citation_ids"]
        many = F.transform(F.from_json(raw, "ARRAY<STRING>"), lambda x: strip(x))
        one = F.array(strip(raw))
        return F.filter(F.coalesce(F.when(F.startswith(F.ltrim(raw), F.lit("[")), many).when(raw.isNotNull(), one), F.array().cast("array<string>")), lambda x: x != "")

    def claim(c: Column, i: Column) -> Column:
        kind = F.upper(strip(F.coalesce(c["claim_type"], F.lit("OBSERVATION"))))
        kind = F.when(kind.isin(*CLAIM_TYPES), kind).otherwise("INTERPRETATION")
        text = strip(F.coalesce(c["text"], F.lit("")))
        notes = F.array_compact(F.array(*[F.when(F.rlike(text, F.lit("(?i)" + p)), F.lit(f"causal: {p}")) for p in CAUSAL_PATTERNS]))
        cid = F.concat(F.lit("CLM-"), F.col("window_id"), F.lit("-"), F.lpad((i + 1).cast("string"), 3, "0"))
        return F.struct(cid.alias("claim_id"), text.alias("text"), kind.alias("claim_type"), ids(c).alias("citation_ids"), kind.isin(*FACTUAL_TYPES).alias("is_factual"), notes.alias("notes"))

    claims = F.filter(F.transform(F.col("parsed.claims"), claim), lambda c: c["text"] != "")
    none = F.array().cast("array<struct<claim_id:string,text:string,claim_type:string,citation_ids:array<string>,is_factual:boolean,notes:array<string>>>")
    return out.withColumn("claims", F.coalesce(claims, none))


def check_citations(parsed: DataFrame) -> DataFrame:
    """Cited ids against the window's own verified bundle: status, precision, unknown ids."""
    refs = F.flatten(F.col("claims.citation_ids"))
    known = F.coalesce(F.col("citations.citation_id"), F.array().cast("array<string>"))
    good = F.filter("cited_ids", lambda c: F.array_contains("bundle_ids", c) & F.coalesce("all_verified", F.lit(False)))
    out = parsed.withColumn("cited_ids", refs).withColumn("bundle_ids", known).withColumn("valid_refs", F.size(good)).withColumn("total_refs", F.size("cited_ids"))
    return out.withColumn("citation_precision", F.round(ratio(F.col("valid_refs"), F.col("total_refs"), 1.0), 4)).withColumn(
        "citation_status", F.when(F.col("valid_refs") == F.col("total_refs"), "VALID").otherwise("INVALID")
    ).withColumn("unknown_ids", F.array_except("cited_ids", "bundle_ids"))


def trusted_numbers(confidence: Column, signal_values: Column, citations: Column) -> Column:
    """Numbers a claim may use: 0 to 10, 100, and the recorded values at 2 and 4 places."""

    def both(v: Column) -> Column:
        return F.array(F.round(v, 2), F.round(v, 4))

    base = F.array(*[F.lit(float(i)) for i in (*range(11), 100)])

    def of(c: Column) -> Column:
        loc = c["source_location"]
        exact = F.array(c["selected_rank"].cast("double"), loc["line_start"].cast("double"), loc["line_end"].cast("double"), loc["record_count"].cast("double"))
        return F.concat(exact, both(c["retrieval_score"]), both(c["selection_score"]))

    cited = F.flatten(F.transform(F.coalesce(citations, F.slice(citations, 1, 0)), of))
    none = F.array().cast("array<double>")
    return F.array_distinct(F.concat(base, both(confidence), F.flatten(F.transform(signal_values, both)), F.coalesce(cited, none)))


def check_faithfulness(checked: DataFrame) -> DataFrame:
    """Per claim: numbers, contradiction, citations and word overlap; per window: the verdict.

    Needs ``final_decision``, ``trusted``, ``citations``, ``all_verified`` and, per citation,
    its text; ``excerpts`` (map citation id to text) is optional.
    """

    def cited_text(c: Column) -> Column:
        text = c["citation_text"]
        if "excerpts" in checked.columns:
            text = F.concat_ws(" ", F.coalesce(F.element_at("excerpts", c["citation_id"]), F.lit("")), text)
        return F.struct(c["citation_id"].alias("id"), content_tokens(text).alias("words"))

    out = checked.withColumn("_src", F.transform("citations", cited_text))

    def check(c: Column) -> Column:
        words = content_tokens(c["text"])
        bad_numbers = F.filter(numbers(c["text"]), lambda n: ~F.array_contains("trusted", F.round(n, 2)) & ~F.array_contains("trusted", F.round(n, 4)))
        valid = F.filter(c["citation_ids"], lambda i: F.array_contains("bundle_ids", i))
        source = F.flatten(F.transform(F.filter("_src", lambda s: F.array_contains(c["citation_ids"], s["id"])), lambda s: s["words"]))
        overlap = F.when(F.size(words) == 0, 1.0).otherwise(F.size(F.array_intersect(words, source)) / F.size(words))
        cited = F.when(F.size(c["citation_ids"]) == 0, "no_citation").when(F.size(valid) != F.size(c["citation_ids"]), "unknown_citation").when(
            ~F.coalesce("all_verified", F.lit(False)), "unverified_bundle")
        aligned = (overlap >= MIN_OVERLAP) | F.arrays_overlap(words, _lits(SIGNAL_WORDS))
        outside = F.arrays_overlap(words, _lits(EXTERNAL_FAULT_WORDS)) & ~F.arrays_overlap(words, _lits(ASSESSMENT_WORDS))
        problem = F.when(c["is_factual"], F.coalesce(cited, F.when(~aligned, "low_overlap"))).when(
            (c["claim_type"] == "INTERPRETATION") & (F.size(c["citation_ids"]) == 0) & outside, "external_event")
        score = F.when(c["is_factual"] & cited.isNotNull(), 0.0).when(c["is_factual"], F.round(overlap, 4)).when(problem.isNotNull(), 0.0).otherwise(1.0)
        contradiction = (F.col("final_decision") == "INSUFFICIENT_EVIDENCE") & F.rlike(c["text"], F.lit(CONFIRMED_PATTERN))
        return F.struct(
            c["claim_id"].alias("claim_id"), c["text"].alias("text"), c["claim_type"].alias("claim_type"), c["citation_ids"].alias("citation_ids"), c["is_factual"].alias("is_factual"),
            c["notes"].alias("notes"), problem.isNull().alias("supported"), score.alias("support_score"), problem.alias("problem"), bad_numbers.alias("bad_numbers"), contradiction.alias("contradiction"),
        )

    out = out.withColumn("claims", F.transform("claims", check)).drop("_src")
    factual = F.filter("claims", lambda c: c["is_factual"])
    out = out.withColumn("factual_claims", F.size(factual)).withColumn("supported_factual", F.size(F.filter(factual, lambda c: c["supported"])))
    out = out.withColumn("numeric_ok", ~F.exists("claims", lambda c: F.size(c["bad_numbers"]) > 0)).withColumn("contradicted", F.exists("claims", lambda c: c["contradiction"]))
    out = out.withColumn("citation_coverage", F.round(ratio(F.col("supported_factual"), F.col("factual_claims"), 1.0), 4))
    cov, num = F.col("citation_coverage"), F.col("numeric_ok")
    status = (
        F.when(F.col("contradicted"), "INVALID").when(F.col("factual_claims") == 0, "VERIFIED").when((cov >= COVERAGE_VERIFIED) & num, "VERIFIED")
        .when(cov > 0, "PARTIALLY_SUPPORTED").otherwise("UNSUPPORTED")
    )
    return out.withColumn("faithfulness_status", status).withColumn("grounding_score", F.round((cov + F.when(num, 1.0).otherwise(0.0)) / 2, 4))


def validate(checked: DataFrame) -> DataFrame:
    """Ordered checks as ``trace`` (step, passed), with ``reasons`` and ``is_valid``.

    A row whose JSON cannot be read fails at the first step and has no further ones.
    """
    readable = F.col("parsed").isNotNull()
    said = F.concat_ws(" ", F.lower(F.coalesce("parsed.summary", F.lit(""))), F.lower(F.coalesce("parsed.explanation", F.lit(""))))
    backed = F.lower(F.array_join(F.transform(F.filter("claims", lambda c: c["supported"]), lambda c: c["text"]), " "))
    loose = F.array_compact(F.array(*[F.when(F.rlike(F.col("_said"), F.lit(rf"\b{p}\b")) & ~F.contains(F.col("_backed"), F.lit(p)), F.lit(p)) for p in RISKY_PHRASES]))
    out = checked.withColumn("_said", said).withColumn("_backed", backed).withColumn("unbacked_phrases", loose).drop("_said", "_backed")

    def same(field: str, expected: str) -> Column:
        return F.coalesce(F.upper(strip(F.coalesce(F.col(field), F.lit("")))) == F.upper(strip(F.col(expected))), F.lit(False))

    covered = (F.col("citation_coverage") >= MIN_COVERAGE) | (F.col("factual_claims") == 0)
    steps = {
        "decision_immutability": same("parsed.incident_decision", "final_decision"),
        "severity_immutability": same("parsed.severity", "severity"),
        "citation_validation": F.col("citation_status") == "VALID",
        "numeric_check": F.col("numeric_ok"),
        "contradiction_check": ~F.col("contradicted"),
        "coverage_check": covered,
        "freeform_text_inspection": F.size("unbacked_phrases") == 0,
    }
    entry = [F.struct(F.lit(s).alias("step"), c.alias("passed")) for s, c in steps.items()]
    first = F.struct(F.lit("json_parse").alias("step"), readable.alias("passed"))
    out = out.withColumn("trace", F.when(readable, F.array(first, *entry)).otherwise(F.array(first)))
    out = out.withColumn("reasons", F.transform(F.filter("trace", lambda t: ~t["passed"]), lambda t: t["step"]))
    out = out.withColumn("is_valid", F.size("reasons") == 0)
    return out.withColumn("faithfulness_status", F.when(readable, F.col("faithfulness_status")).otherwise("INVALID"))


def build_context(assessed: DataFrame, max_lines: int, max_chars: int) -> DataFrame:
    """Bounded context per window: summary fields and excerpts of so many lines and characters."""

    def item(c: Column) -> Column:
        text = c["citation_text"]
        if "excerpts" in assessed.columns:
            text = F.coalesce(F.nullif(F.element_at("excerpts", c["citation_id"]), F.lit("")), text)
        short = F.substring(F.array_join(F.slice(F.split(text, r"\r?\n"), 1, max_lines), "\n"), 1, max_chars)
        return F.struct(
            c["citation_id"].alias("citation_id"), c["citation_text"].alias("citation_text"), c["selected_rank"].alias("selected_rank"),
            F.round(c["retrieval_score"], 4).alias("retrieval_score"), F.round(c["selection_score"], 4).alias("selection_score"), c["source_location"].alias("source_location"), short.alias("excerpt"),
        )

    return assessed.select(
        "dataset", "split", "window_id", F.col("final_decision").alias("decision"), "severity", F.round("confidence", 4).alias("confidence"), F.col("sufficiency").alias("evidence_sufficiency"),
        F.array("rule_fired").alias("rules_fired"), F.round("anomaly_score", 4).alias("anomaly_score"), "evidence_count", F.col("conflicts.conflict_id").alias("conflict_ids"), F.transform("citations", item).alias("citations"),
    )


def prompt_text(context: DataFrame) -> DataFrame:
    """Deterministic text of each context, for export to whoever writes the explanation."""

    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"{label}: "), F.coalesce(value.cast("string"), F.lit("n/a")))

    def evidence(c: Column) -> Column:
        return F.concat_ws("\n", line("citation", c["citation_id"]), line("source", c["citation_text"]), line("rank", c["selected_rank"]),
                           line("retrieval score", F.format_string("%.4f", c["retrieval_score"])), F.lit("excerpt (untrusted data):"), c["excerpt"])

    body = F.concat_ws(
        "\n",
        F.lit("# assessment"), line("dataset", F.col("dataset")), line("window", F.col("window_id")), line("decision", F.col("decision")), line("severity", F.col("severity")),
        line("confidence", F.format_string("%.2f", F.col("confidence"))), line("evidence sufficiency", F.col("evidence_sufficiency")), line("rules fired", F.array_join("rules_fired", ", ")),
        F.lit("# evidence"), F.when(F.size("citations") == 0, F.lit("none")).otherwise(F.array_join(F.transform("citations", evidence), "\n")),
        F.lit("# signals"), line("anomaly score", F.col("anomaly_score")), line("conflicts", F.array_join("conflict_ids", ", ")),
        F.lit("# answer: one JSON object with incident_decision, severity, summary, claims (text, citation_ids, claim_type), uncertainties, recommended_action"),
    )
    return context.select("dataset", "split", "window_id", body.alias("prompt"))


def assemble(validated: DataFrame, model: str = "none", version: str = "1") -> DataFrame:
    """Final explanation rows. Decision and severity always come from the assessment.

    Unverified provenance abstains before anything is read; a failed validation abstains with its reasons.
    """
    abstain = F.when(~F.col("provenance_ok"), F.concat(F.lit("provenance: "), "provenance_reason")).when(~F.col("is_valid"), F.concat(F.lit("validation: "), F.array_join("reasons", "; ")))
    status = F.when(~F.col("provenance_ok"), "ABSTAINED").when(~F.col("is_valid"), "VALIDATION_FAILED").otherwise("GENERATED")
    shown = F.transform("claims", lambda c: F.concat(F.lit("- ["), c["claim_type"], F.lit("] "), c["text"], F.array_join(F.transform(c["citation_ids"], lambda i: F.concat(F.lit(" ["), F.substring(i, 1, 8), F.lit("...]"))), "")))
    story = F.concat_ws("\n", F.col("parsed.summary"), F.lit("Key claims:"), F.array_join(shown, "\n"),
                        F.when(F.size(F.coalesce(F.col("parsed.uncertainties"), F.array().cast("array<string>"))) > 0, F.concat(F.lit("Uncertainties:\n"), F.array_join("parsed.uncertainties", "\n"))),
                        F.concat(F.lit("Recommended action:\n"), F.col("parsed.recommended_action")))
    fallback = F.concat(F.lit("No narrative: "), F.col("abstention_reason"), F.lit(". Decision "), F.col("final_decision"), F.lit(", severity "), F.col("severity"), F.lit("."))
    out = validated.withColumn("abstention_reason", abstain).withColumn("explanation_status", status).withColumn("abstained", F.col("abstention_reason").isNotNull())
    out = out.withColumn("explanation", F.when(F.col("abstained"), fallback).otherwise(story))
    ident = F.concat(F.lit("EXP-"), F.substring(sha(F.col("window_id"), F.col("dataset"), F.col("split"), F.lit(model), F.lit(version)), 1, 16))
    out = out.withColumn("explanation_id", F.when(F.col("abstained"), F.concat(F.lit("EXP-"), F.col("window_id"), F.lit("-ABSTAINED"))).otherwise(ident))
    content = F.struct("explanation_id", "window_id", "final_decision", "severity", "explanation", "explanation_status")
    return out.withColumn("content_hash", F.sha2(F.to_json(content), 256))


def explanation_metrics(final: DataFrame) -> DataFrame:
    """One row of totals; citations are judged inside their own window."""

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))

    used = ~F.col("abstained")
    m = final.agg(
        F.count(F.lit(1)).alias("total_attempted"),
        F.count_if(F.col("explanation_status") == "GENERATED").alias("successful"),
        F.count_if("abstained").alias("abstentions"),
        F.count_if(F.col("explanation_status") == "VALIDATION_FAILED").alias("validation_failures"),
        F.count_if(F.exists("trace", lambda t: (t["step"] == "decision_immutability") & ~t["passed"])).alias("decision_failures"),
        total(F.when(used, F.size("claims"))).alias("total_claims"),
        total(F.when(used, F.col("factual_claims"))).alias("factual_claims"),
        total(F.when(used, F.col("supported_factual"))).alias("supported_factual_claims"),
        total(F.when(used, F.col("valid_refs"))).alias("valid_refs"),
        total(F.when(used, F.col("total_refs"))).alias("total_refs"),
    )
    return m.withColumn("citation_coverage", F.round(ratio(F.col("supported_factual_claims"), F.col("factual_claims"), 1.0), 4)).withColumn(
        "citation_precision", F.round(ratio(F.col("valid_refs"), F.col("total_refs"), 1.0), 4))


#: what a generator may report of each call, and how it is added up
USAGE = ("latency_ms", "input_tokens", "output_tokens", "retry_count")


def explanation_outcomes(final: DataFrame) -> DataFrame:
    """Long table (measure, key, n): explanations by status and by faithfulness, in one pass."""
    pairs = [F.struct(F.lit(m).alias("measure"), F.col(c).alias("key")) for m, c in (("status", "explanation_status"), ("faithfulness", "faithfulness_status"))]
    return final.select(F.inline(F.array(*pairs))).groupBy("measure", "key").agg(F.count(F.lit(1)).alias("n"))


def usage_totals(calls: DataFrame) -> DataFrame:
    """One row of what calls of a generator cost: mean latency at two places, tokens, retries.

    ``calls`` holds the columns of ``USAGE``; a call that reports nothing is in no mean, and a null adds nothing.
    """
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return calls.agg(
        F.count("latency_ms").alias("measured_calls"), F.round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 2).alias("mean_latency_ms"),
        total("input_tokens").alias("total_input_tokens"), total("output_tokens").alias("total_output_tokens"), total("retry_count").alias("total_retries"),
    ).withColumn("total_tokens", F.col("total_input_tokens") + F.col("total_output_tokens"))


def explode_claims(checked: DataFrame) -> DataFrame:
    return checked.select("window_id", F.inline("claims"))
