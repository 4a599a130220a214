"""Structured answers of a model for tables of prompts, and grounding claim by claim.

A prompt's answer is looked up by the hash of prompt and schema in a stored cache first.  What is left is
called in the tasks, once for each distinct prompt, behind a breaker; an answer that does not parse as
the schema, or lacks a required field, is asked for once more in the compact schema.  Answers are
kept in the cache; a failure is a row with its reason and stops nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.numbers import numbers_in
from tesserae.functions.text import content_tokens
from tesserae.sources.snapshots import Store, append
from tesserae.storage import cut
from tesserae.streaming.breaker import Breaker, Open

CACHE = "answers"
#: Failures in a row after which a task stops calling, and seconds until it tries again.
FAILURES, REST_S = 3, 60.0


def called(prompts: DataFrame, model: Callable[[str, str], str], schema: str) -> DataFrame:
    """``key, answer, error`` of ``prompts`` (key, prompt): ``model(prompt, schema)`` in each task."""
    out = pa.schema([("key", pa.string()), ("answer", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        breaker = Breaker(FAILURES, REST_S)
        for batch in batches:
            rows = []
            for key, prompt in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows.append((key, breaker.call(model, prompt, schema), None))
                except Open:
                    rows.append((key, None, "breaker is open"))
                except Exception as e:  # a failed call is a row, not the end of the job
                    rows.append((key, None, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], schema=out)

    return prompts.select("key", "prompt").mapInArrow(run, "key string, answer string, error string")


def checked(answers: DataFrame, schema: str, required: list[str]) -> DataFrame:
    """Adds ``value`` (null if the answer is not of the schema) and says so in ``error``."""
    parsed = F.from_json("answer", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    whole = F.col("_p._corrupt").isNull() & F.col("_p").isNotNull()
    for r in required:
        whole = whole & F.col(f"_p.{r}").isNotNull()
    t = answers.withColumn("_p", parsed)
    names = [c.name for c in t.schema["_p"].dataType if c.name != "_corrupt"]
    sound = F.coalesce(whole, F.lit(False))
    value = F.when(sound, F.struct(*[F.col(f"_p.{n}").alias(n) for n in names]))
    return t.withColumn("value", value).withColumn("error", F.coalesce("error", F.when(~sound, F.lit("the answer is not of the schema")))).drop("_p")


def complete(prompts: DataFrame, model: Callable[[str, str], str], schema: str, required: list[str], store: Store, compact: str | None = None, tag: str = "") -> DataFrame:
    """``prompt_id, value, error, cached`` for each row of ``prompts`` (prompt_id, prompt); ``tag`` names the version of the prompt's template.

    ``schema`` and ``compact`` are DDL; the compact one holds the same fields or fewer.
    """
    keyed = prompts.withColumn("key", F.sha2(F.concat_ws("\0", F.lit(tag), F.lit(schema), "prompt"), 256))
    kept = store.read(CACHE)
    kept = store.spark.createDataFrame([], "key string, answer string") if kept is None else kept.groupBy("key").agg(F.min_by("answer", "written").alias("answer"))  # the first writer wins
    distinct = keyed.select("key", "prompt").dropDuplicates(["key"])
    first = cut(checked(called(distinct.join(kept, "key", "left_anti"), model, schema), schema, required))
    again = first.filter("answer IS NOT NULL AND value IS NULL").select("key").join(distinct, "key")
    second = cut(checked(called(again, model, compact or schema), schema, required))
    fresh = first.join(second.select("key"), "key", "left_anti").unionByName(second)
    good = cut(fresh.filter("value IS NOT NULL").select("key", "answer"))
    if not good.isEmpty():
        append(store, CACHE, good)
    old = checked(kept.withColumn("error", F.lit(None).cast("string")), schema, required).withColumn("cached", F.lit(True))
    every = old.unionByName(fresh.withColumn("cached", F.lit(False)))
    return keyed.select("prompt_id", "key").join(every, "key").select("prompt_id", "value", "error", "cached")


# --- grounding ------------------------------------------------------------------------------------
def lexical_support(claim: Column, evidence: Column, least: float = 0.6) -> Column:
    """Default judge of one claim: its figures stand in the evidence and so do at least ``least`` of its content words."""
    words = F.array_distinct(content_tokens(claim))
    share = F.size(F.array_intersect(words, content_tokens(evidence))) / F.greatest(F.size(words), F.lit(1))
    figures = F.size(F.array_except(numbers_in(claim), numbers_in(evidence))) == 0
    return figures & (F.size(words) > 0) & (share >= least)


def reason_then_ground(drafts: DataFrame, evidence: DataFrame, judge: Callable[[Column, Column], Column] = lexical_support) -> DataFrame:
    """``question_id, claim_no, claim, chunk_ids``: the sentences of free drafts (question_id, draft) that a piece of the question's evidence supports.

    Each claim is judged alone against each piece (question_id, chunk_id, text: the few that were retrieved);
    one that nothing supports is dropped, and so is a claim whose judge fails.
    """
    claims = drafts.select("question_id", F.posexplode(F.split(F.trim("draft"), r"(?<=[.!?])\s+")).alias("claim_no", "claim")).filter(F.trim("claim") != "")
    met = claims.join(evidence.select("question_id", "chunk_id", "text"), "question_id").filter(F.coalesce(judge(F.col("claim"), F.col("text")), F.lit(False)))
    return met.groupBy("question_id", "claim_no", "claim").agg(F.sort_array(F.collect_set("chunk_id")).alias("chunk_ids"))


def expert_answers(questions: DataFrame, drafts: DataFrame, evidence: DataFrame, note: str) -> DataFrame:
    """``question_id, answer, evidence_ids, note, grounded_claims, n_claims``: ungrounded answers that say so, with what they saw and how many claims hold.

    An empty draft is refused: ``answer`` is null.
    """
    grounded = reason_then_ground(drafts, evidence).groupBy("question_id").agg(F.count(F.lit(1)).alias("grounded_claims"))
    seen = evidence.groupBy("question_id").agg(F.sort_array(F.collect_set("chunk_id")).alias("evidence_ids"))
    told = drafts.select("question_id", F.nullif(F.trim("draft"), F.lit("")).alias("answer"))
    n = F.when(F.col("answer").isNull(), 0).otherwise(F.size(F.split("answer", r"(?<=[.!?])\s+")))
    j = questions.select("question_id").join(told, "question_id", "left").join(seen, "question_id", "left").join(grounded, "question_id", "left")
    return j.select("question_id", "answer", F.coalesce("evidence_ids", F.array().cast("array<string>")).alias("evidence_ids"), F.when(F.col("answer").isNotNull(), note).alias("note"), F.coalesce("grounded_claims", F.lit(0)).alias("grounded_claims"), n.alias("n_claims"))
