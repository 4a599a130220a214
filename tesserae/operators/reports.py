"""Query sets and evaluation reports.

A query set is a JSON file whose slots may be strings or arrays of strings; it is read as VARIANT and
brought to one type.  Reports are aggregations of scored rows: by document for parsing, by case for
summaries and chat, over several runs of each case for experts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.numbers import numbers_in
from tesserae.functions.text import metric_text
from tesserae.operators import evals

#: Least share of concepts and most hedges of a useful answer, runs of a gated case.
CONCEPTS, HEDGES, GATED_RUNS = 0.5, 0.15, 5
#: What an honest decline of a detail says.
DECLINES = (
    "don't state", "does not state", "do not state", "not stated", "won't invent", "will not invent", "cannot determine", "can't determine",
    "not specified", "no specific", "i don't have", "do not cover", "don't cover", "not in your", "not found in", "does not contain", "do not contain",
    "cannot be extracted", "cannot be determined", "no information", "not break down", "do not break down", "not broken down",
)
#: A sentence that speaks for the documents, a date, a section.
DOCUMENT_SAYS = (
    r"(?i)\b(?:your|the)\s+(?:document|documents|vault|guide|guides|notes|report|reports|deployment guide|material|materials)\b[^.?!]*?\b"
    r"(?:cover|covers|state|states|say|says|recommend|recommends|show|shows|list|lists|report|reports|describe|describes|mention|mentions|note|notes|specif)"
)
DATED = r"(?i)\b(?:19|20)\d{2}\b|\b\d{1,2}/\d{1,2}/\d{2,4}\b|\b(?:january|february|march|april|may|june|july|august|september|october|november|december)\b"
SECTION = r"(?i)\bsection\s+\d|\b\d+\.\d+\b"


# --- query sets -----------------------------------------------------------------------------------
def slots(value: Column) -> Column:
    """A VARIANT array of strings and arrays of strings as arrays of alternatives; null and other values have none."""
    one = lambda v: F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<string>")).otherwise(F.array(F.try_variant_get(v, "$", "string")))
    listed = F.try_variant_get(value, "$", "array<variant>")
    return F.coalesce(F.transform(F.filter(listed, lambda v: v.isNotNull() & ~F.is_variant_null(v)), one), F.array().cast("array<array<string>>"))


def field(record: Column, name: str, kind: str, default: object = None) -> Column:
    """A field of a VARIANT record; the default where it is missing, null or of another kind."""
    found = F.try_variant_get(record, f"$.{name}", kind)
    if default is None:
        return found.alias(name)
    empty = F.array().cast(kind) if default == [] else F.lit(default)
    return F.coalesce(found, empty).alias(name)


def records(text: Column, key: str) -> Column:
    """The records under ``key`` of a JSON text; none where it is no JSON."""
    return F.try_variant_get(F.try_parse_json(text), f"$.{key}", "array<variant>")


def load_records(spark: SparkSession, path: str, key: str) -> DataFrame:
    """``file, record`` of the query sets at ``path``; other keys of a file, such as comments that begin with ``_``, are passed over."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.explode(records(F.col("value"), key)).alias("record"))


def answer_queries(rows: DataFrame) -> DataFrame:
    """``qid, question, relevant_chunk_ids, should_refuse, answer_must_mention`` of records under ``queries``."""
    r = F.col("record")
    return rows.select(field(r, "qid", "string"), field(r, "question", "string"), field(r, "relevant_chunk_ids", "array<string>", []), field(r, "should_refuse", "boolean", False), slots(F.try_variant_get(r, "$.answer_must_mention", "variant")).alias("answer_must_mention"))


def summary_cases(rows: DataFrame) -> DataFrame:
    r = F.col("record")
    return rows.select(field(r, "doc_id", "string"), field(r, "detail", "string", "standard"), field(r, "token_budget", "int", 40_000), slots(F.try_variant_get(r, "$.must_mention", "variant")).alias("must_mention"), field(r, "must_not_assert", "array<string>", []), field(r, "should_summarize", "boolean", True))


def chat_cases(rows: DataFrame) -> DataFrame:
    r = F.col("record")
    return rows.select(field(r, "name", "string"), field(r, "history", "array<struct<user_text: string, answer_summary: string>>", []), field(r, "follow_up", "string"), field(r, "relevant_chunk_ids", "array<string>", []), field(r, "k", "int", 50))


def expert_cases(rows: DataFrame) -> DataFrame:
    r, many = F.col("record"), ("scope_doc_ids", "must_not_assert", "blocked_quotes", "must_not_recommend")
    return rows.select(
        field(r, "name", "string"),
        field(r, "question", "string"),
        field(r, "case_type", "string", "in_domain_analytical"),
        *[field(r, n, "array<string>", []) for n in many],
        *[slots(F.try_variant_get(r, f"$.{n}", "variant")).alias(n) for n in ("must_mention", "acknowledgment_phrases")],
        field(r, "blocked_figures", "array<double>", []),
        field(r, "is_ood", "boolean", False),
        field(r, "is_gated", "boolean", False),
        field(r, "case_expects_engagement", "boolean", True),
    )


# --- reports --------------------------------------------------------------------------------------
def passes(scores: DataFrame) -> DataFrame:
    """``scores`` with ``passed``: error rates at most, F1 values at least what is demanded; a missing demand demands nothing."""
    bad = F.lit(False)
    for name in ("cer", "wer"):
        bad = bad | F.coalesce(F.col(name) > F.col(f"{name}_threshold"), F.lit(False))
    for name, demand in (("f1_headings", "f1_threshold"), ("f1_tables", "f1_tables_threshold"), ("f1_equations", "f1_equations_threshold")):
        bad = bad | F.coalesce(F.col(name) < F.col(demand), F.lit(False))
    return scores.withColumn("passed", ~bad)


def parse_report(scores: DataFrame) -> DataFrame:
    """One row of counts and means; rows with an ``error`` (no text was predicted) are counted apart."""
    ok = F.col("error").isNull()
    means = [F.avg(F.when(ok, F.col(c))).alias(f"mean_{c}") for c in ("cer", "wer", "f1_headings", "f1_tables", "f1_equations")]
    return passes(scores).agg(F.count(F.when(ok, 1)).alias("doc_count"), F.count(F.when(ok & F.col("passed"), 1)).alias("passed_count"), F.count(F.when(~ok, 1)).alias("errors"), *means)


def summary_results(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """Scores of each case; ``answers``: doc_id, answered, text."""
    j = cases.join(answers, "doc_id", "left").withColumn("answered", F.coalesce("answered", F.lit(False))).withColumn("text", F.coalesce("text", F.lit("")))
    return j.select("doc_id", F.col("answered").alias("summarized"), (F.col("should_summarize") == F.col("answered")).alias("summarize_correct"), F.when(F.col("answered"), evals.mention_recall(F.col("text"), F.col("must_mention"))).otherwise(0.0).alias("mention_recall"), evals.asserted(F.col("text"), F.col("must_not_assert")).alias("violations"))


def summary_report(results: DataFrame) -> DataFrame:
    """One row; the mean recall is over cases that were summarized, null if none was."""
    return results.agg(
        F.count(F.lit(1)).alias("case_count"),
        F.count(F.when(F.col("summarized"), 1)).alias("summarized_count"),
        F.count(F.when(F.col("summarize_correct"), 1)).alias("summarize_correct_count"),
        F.coalesce(F.sum(F.size("violations")), F.lit(0)).alias("hallucination_count"),
        F.avg(F.when(F.col("summarized"), F.col("mention_recall"))).alias("mean_mention_recall"),
    )


def chat_results(cases: DataFrame, retrieved: DataFrame) -> DataFrame:
    """``name, recall, retrieved``: the share of a case's gold chunks among its first ``k`` retrieved ones (name, rank, chunk_id)."""
    gold = cases.select("name", "k", F.array_distinct("relevant_chunk_ids").alias("gold"))
    hits = retrieved.join(gold, "name").groupBy("name").agg(F.count_distinct(F.when((F.col("rank") <= F.col("k")) & F.array_contains("gold", F.col("chunk_id")), F.col("chunk_id"))).alias("hits"), F.count(F.lit(1)).alias("retrieved"))
    n = F.size("gold")
    return gold.join(hits, "name", "left").select("name", F.when(n == 0, 1.0).otherwise(F.coalesce("hits", F.lit(0)) / n).alias("recall"), F.coalesce("retrieved", F.lit(0)).alias("retrieved"))


def chat_report(results: DataFrame) -> DataFrame:
    return results.agg(F.count(F.lit(1)).alias("case_count"), F.coalesce(F.avg("recall"), F.lit(0.0)).alias("mean_recall"))


def speaks_for_documents(answer: Column, is_ood: Column, evidence_empty: Column) -> Column:
    """Sentences that ascribe a date, a section or a figure to the documents, of an answer out of their domain that no evidence backs."""
    sentences = F.filter(F.split(F.trim(answer), r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")
    told = lambda s: F.rlike(s, F.lit(DOCUMENT_SAYS)) & (F.rlike(s, F.lit(DATED)) | F.rlike(s, F.lit(SECTION)) | F.exists(numbers_in(s), lambda x: F.abs(x) >= 1))
    return F.when(is_ood & evidence_empty, F.transform(F.filter(sentences, told), F.trim)).otherwise(F.array().cast("array<string>"))


def structural_faults(answer: Column, question: Column, note: Column, expected_note: str, evidence_ids: Column, known_ids: Column) -> Column:
    """What is wrong with an answer's form: its note of provenance is gone, it says nothing or echoes the question, it cites chunks that do not exist."""
    empty = ~F.rlike(answer, F.lit(r"[\p{L}\p{N}]")) | (metric_text(answer) == metric_text(question))
    made = F.transform(F.array_except(evidence_ids, known_ids), lambda e: F.concat(F.lit("fabricated_evidence_id:"), e))
    return F.concat(F.array_compact(F.array(F.when(~note.eqNullSafe(F.lit(expected_note)), "provenance_stripped"), F.when(empty, "degenerate_decode"))), made)


def declined(answer: Column) -> Column:
    text = metric_text(answer)
    return F.exists(F.array(*map(F.lit, DECLINES)), lambda p: F.contains(text, p))


GATES = ("vault_contradiction", "fabricated_specific", "structural", "ood_doc_attribution", "advisory_safety")


def expert_results(runs: DataFrame, order: str | None = None) -> DataFrame:
    """One row a case over its runs (name, case_type, run, is_gated, expects_engagement, the gates' counts, coverage, acknowledged, hedges, refused, declined).

    A gate counts what its worst run found; for a gated case it counts once if it fired in more than half of the
    runs, rounded down.  An answer is useful if no run refused, its mean coverage is 0.5 or more and the first
    run hedges little; a case that expects no engagement needs no use.  With ``order``, a column, coverage is added up in
    its order, so that a mean next to the limit does not depend on how rows were dealt.
    """
    mean = F.avg("coverage")
    if order:
        known = F.array_sort(F.collect_list(F.when(F.col("coverage").isNotNull(), F.struct(order, "coverage"))))  # the runs of a case
        mean = F.aggregate(known, F.lit(0.0), lambda s, x: s + x["coverage"]) / F.nullif(F.size(known), F.lit(0))
    n, fired = F.count(F.lit(1)), sum((F.col(g) for g in GATES), F.lit(0)) > 0
    worst = lambda g: F.when(F.bool_or("is_gated"), (F.count(F.when(F.col(g) > 0, 1)) > F.floor(n / 2)).cast("long")).otherwise(F.max(g)).cast("long")
    by = runs.groupBy("name", "case_type").agg(
        n.alias("runs"),
        *[worst(g).alias(g) for g in GATES],
        (F.bool_and(fired) | ~F.bool_or(fired)).alias("gate_run_stable"),
        mean.alias("concept_coverage"),
        F.avg("acknowledged").alias("acknowledgment_recall"),
        F.bool_or("refused").alias("unexpected_refused"),
        F.bool_or(F.col("declined") & ~F.col("expects_engagement")).alias("declined_specific"),
        F.min_by("hedges", "run").alias("_hedges"),
        F.bool_and("expects_engagement").alias("_expects"),
    )
    hard = sum((F.col(g) for g in GATES), F.lit(0)) == 0
    useful = ~F.col("_expects") | (~F.col("unexpected_refused") & (F.col("concept_coverage") >= CONCEPTS) & (F.col("_hedges") <= HEDGES))
    return by.withColumn("hard_gates_pass", hard).withColumn("usefulness_floor_pass", useful).drop("_hedges", "_expects")


def expert_report(results: DataFrame) -> DataFrame:
    """One row over all cases; acknowledgment is averaged over probes out of domain alone."""
    return results.agg(
        F.count(F.lit(1)).alias("case_count"),
        F.coalesce(F.bool_and("hard_gates_pass"), F.lit(True)).alias("hard_gates_pass"),
        *[F.coalesce(F.sum(g), F.lit(0)).alias(f"{g}_count") for g in GATES],
        F.coalesce(F.bool_and("usefulness_floor_pass"), F.lit(True)).alias("usefulness_floor_pass"),
        F.coalesce(F.avg("concept_coverage"), F.lit(0.0)).alias("mean_concept_coverage"),
        F.count(F.when(F.col("unexpected_refused"), 1)).alias("unexpected_refusal_count"),
        F.count(F.when(F.col("declined_specific"), 1)).alias("declined_specific_count"),
        F.avg(F.when(F.col("case_type") == "out_of_domain_probe", F.col("acknowledgment_recall"))).alias("mean_acknowledgment_recall_ood"),
    )
