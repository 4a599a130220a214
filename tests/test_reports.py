"""Query sets, evaluation reports, detached headers, structured answers."""

from __future__ import annotations

import json
import math

from pyspark.sql import functions as F

from tesserae.operators import headers, reports
from tesserae.plans import structured
from tesserae.sources.snapshots import Store


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_query_sets(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        json.dumps({"_comment": "x", "queries": [{"qid": "1", "question": "q?", "_note": 1, "answer_must_mention": ["a", ["b", "c"], None, 5]}, {"qid": "2", "should_refuse": True, "relevant_chunk_ids": ["x", "y"], "answer_must_mention": "no array"}]}, indent=1)
    )
    (tmp_path / "b.json").write_text("no json")
    got = reports.answer_queries(reports.load_records(spark, str(tmp_path), "queries"))
    assert rows(got, *got.columns) == [("1", "q?", [], False, [["a"], ["b", "c"], ["5"]]), ("2", None, ["x", "y"], True, [])]
    cases = {"cases": [{"name": "n", "doc_id": "d", "history": [{"user_text": "u", "answer_summary": "s"}], "follow_up": "f", "must_mention": ["m"], "blocked_figures": [1, 2.5], "is_ood": True}]}
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "c.json").write_text(json.dumps(cases))
    r = reports.load_records(spark, f"{tmp_path}/c", "cases")
    assert rows(reports.chat_cases(r), "name", "follow_up", "k", F.col("history")[0]["user_text"]) == [("n", "f", 50, "u")]
    assert rows(reports.summary_cases(r), "doc_id", "detail", "token_budget", "must_mention", "should_summarize") == [("d", "standard", 40_000, [["m"]], True)]
    assert rows(reports.expert_cases(r), "case_type", "blocked_figures", "is_ood", "is_gated", "case_expects_engagement", "blocked_quotes") == [("in_domain_analytical", [1.0, 2.5], True, False, True, [])]


def test_parse_and_summary_reports(spark):
    cols = "doc_id string, cer double, wer double, f1_headings double, f1_tables double, f1_equations double, cer_threshold double, wer_threshold double, f1_threshold double, f1_tables_threshold double, f1_equations_threshold double, error string"
    data = [("a", 0.1, 0.2, 1.0, 1.0, 1.0, 0.1, 0.2, 1.0, 1.0, 1.0, None), ("b", 0.1, 0.2, 0.9, 1.0, 1.0, 0.05, None, None, None, None, None), ("c", 0.3, 0.4, 0.5, 0.5, 0.2, None, None, None, 0.6, None, None), ("d", 0.9, 0.9, 0.0, 0.0, 0.0, None, None, None, None, None, None), ("e", None, None, None, None, None, None, None, None, None, None, "missing")]
    scores = spark.createDataFrame(data, cols)
    assert rows(reports.passes(scores).filter("error IS NULL"), "doc_id", "passed") == [("a", True), ("b", False), ("c", False), ("d", True)]
    r = reports.parse_report(scores).first()
    assert (r["doc_count"], r["passed_count"], r["errors"]) == (4, 2, 1)
    assert math.isclose(r["mean_cer"], 0.35)
    cases = spark.createDataFrame([("a", [["cat"], ["dog", "hound"]], ["secret"], True), ("b", [["x"]], [], False), ("c", [["x"]], [], True)], "doc_id string, must_mention array<array<string>>, must_not_assert array<string>, should_summarize boolean")
    answers = spark.createDataFrame([("a", True, "A Hound keeps a Secret"), ("b", True, "x")], "doc_id string, answered boolean, text string")
    got = reports.summary_results(cases, answers)
    assert rows(got, "doc_id", "summarized", "summarize_correct", "mention_recall", "violations") == [("a", True, True, 0.5, ["secret"]), ("b", True, False, 1.0, []), ("c", False, False, 0.0, [])]
    assert tuple(reports.summary_report(got).first()) == (3, 2, 1, 1, 0.75)
    assert reports.summary_report(got.limit(0)).first()["mean_mention_recall"] is None


def test_chat_report(spark):
    cases = spark.createDataFrame([("a", ["1", "2", "2"], 2), ("b", ["1"], 2), ("c", [], 2)], "name string, relevant_chunk_ids array<string>, k int")
    found = spark.createDataFrame([("a", 1, "1"), ("a", 2, "9"), ("a", 3, "2")], "name string, rank int, chunk_id string")
    got = reports.chat_results(cases, found)
    assert rows(got, "name", "recall", "retrieved") == [("a", 0.5, 3), ("b", 0.0, 0), ("c", 1.0, 0)]
    assert tuple(reports.chat_report(got).first()) == (3, 0.5)


def test_expert_report(spark):
    schema = "name string, case_type string, run int, is_gated boolean, expects_engagement boolean, vault_contradiction int, fabricated_specific int, structural int, ood_doc_attribution int, advisory_safety int, coverage double, acknowledged double, hedges double, refused boolean, declined boolean"
    run = lambda name, i, gated=False, expects=True, gates=(0, 0, 0, 0, 0), cov=1.0, ack=0.0, hedge=0.0, ref=False, dec=False, kind="x": (name, kind, i, gated, expects, *gates, cov, ack, hedge, ref, dec)
    data = (
        [run("fine", i) for i in range(3)]
        + [run("worst", 0, gates=(2, 0, 0, 0, 0)), run("worst", 1, gates=(3, 1, 0, 0, 0)), run("worst", 2)]
        + [run("minority", i, True, gates=(int(i < 2), 0, 0, 0, 0)) for i in range(5)]
        + [run("majority", i, True, gates=(0, 5 * int(i < 3), 0, 0, 0)) for i in range(5)]
        + [run("vague", 0, hedge=0.2), run("vague", 1)]
        + [run("thin", 0, cov=0.9), run("thin", 1, cov=0.0)]
        + [run("refused", 0), run("refused", 1, ref=True)]
        + [run("bait", 0, expects=False, cov=0.0, dec=True, ack=0.5, kind="out_of_domain_probe")]
    )
    got = reports.expert_results(spark.createDataFrame(data, schema))
    assert {r["name"]: (r["vault_contradiction"], r["fabricated_specific"], r["hard_gates_pass"], r["gate_run_stable"], r["usefulness_floor_pass"]) for r in got.collect()} == {
        "fine": (0, 0, True, True, True),
        "worst": (3, 1, False, False, True),
        "minority": (0, 0, True, False, True),
        "majority": (0, 1, False, False, True),
        "vague": (0, 0, True, True, False),
        "thin": (0, 0, True, True, False),
        "refused": (0, 0, True, True, False),
        "bait": (0, 0, True, True, True),
    }
    r = reports.expert_report(got).first()
    assert (r["case_count"], r["hard_gates_pass"], r["vault_contradiction_count"], r["fabricated_specific_count"], r["unexpected_refusal_count"], r["declined_specific_count"], r["mean_acknowledgment_recall_ood"]) == (8, False, 3, 2, 1, 1, 0.5)


def test_answers_out_of_domain(spark):
    text = "Your documents recommend section 3. The guide states nothing. The report shows 12 cases! In 2020 it rained. The notes say so since May"
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(reports.speaks_for_documents(F.col("t"), F.lit(True), F.lit(True)), reports.speaks_for_documents(F.col("t"), F.lit(True), F.lit(False)), reports.declined(F.lit("It is NOT stated.")), reports.declined(F.lit("yes"))).first()
    assert list(got) == [["Your documents recommend section 3.", "The report shows 12 cases!", "The notes say so since May"], [], True, False]
    faults = lambda a, n, ids: df.select(reports.structural_faults(F.lit(a), F.lit("Why so?"), F.lit(n), "note", F.array(*map(F.lit, ids)), F.array(F.lit("k")))).first()[0]
    assert faults("Because.", "note", ["k"]) == []
    assert faults(" why  SO? ", None, ["k", "z"]) == ["provenance_stripped", "degenerate_decode", "fabricated_evidence_id:z"]
    assert faults("...", "note", ["k"]) == ["degenerate_decode"]


# --- headers --------------------------------------------------------------------------------------
def test_detached_headers(spark):
    def table(name, grid, before, flagged=()):
        return name, [[(c, (i, j) in flagged) for j, c in enumerate(r)] for i, r in enumerate(grid)], [(k, t) for k, t in before]

    plain = [["Revenue", "10", "20"], ["Income", "1", "2"]]
    text = lambda *t: [("text", x) for x in t]
    cases = [
        table("wide", plain, text("Compute & Networking  Graphics")),
        table("single", plain, text("Graphics Total")),
        table("run", plain, [("text", "old"), ("picture", None), ("heading", "2023"), ("text", "2024")]),
        table("blank", plain, text("a", "", "b")),
        table("count", plain, text("one two three")),
        table("none", plain, []),
        table("no labels", [["1", "2"], ["3", "4"]], text("a  b")),
        table("flagged value row", plain, text("a  b"), {(0, 1), (0, 2)}),
        table("real header", [["", "2023", "2024"], *plain], text("a  b"), {(0, 1), (0, 2)}),
        table("text header", [["Name", "first", "second"], *plain], text("a  b"), {(0, 1), (0, 2)}),
        table("flagged corner", plain, text("a  b"), {(0, 0), (0, 1)}),
        table("two headers", plain, text("a  b"), {(0, 1), (1, 1)}),
    ]
    df = spark.createDataFrame(cases, "table_id string, grid array<array<struct<text: string, header: boolean>>>, before array<struct<kind: string, text: string>>")
    assert dict(rows(headers.reattach(df), "table_id", "header")) == {
        "wide": ["", "Compute & Networking", "Graphics"], "single": ["", "Graphics", "Total"], "run": ["", "2023", "2024"], "blank": None, "count": None, "none": None,
        "no labels": ["a", "b"], "flagged value row": ["", "a", "b"], "real header": None, "text header": None, "flagged corner": None, "two headers": None,
    }


# --- structured answers ---------------------------------------------------------------------------
def fake(prompt, schema):
    """Fails for some prompts; for one the full schema is too long."""
    if "down" in prompt:
        raise ConnectionError("down")
    if "broken" in prompt or ("dense" in prompt and "spare" in schema):
        return '{"name": "cut off'
    return json.dumps({"name": None if "lacking" in prompt else prompt.upper(), "n": len(prompt)})


def test_structured_answers(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    asked = [(1, "good"), (2, "good"), (3, "dense"), (4, "broken"), (5, "lacking"), (6, "down")]
    df = spark.createDataFrame(asked, "prompt_id int, prompt string").coalesce(1)
    how = {"schema": "name string, n int, spare string", "required": ["name"], "store": store, "compact": "name string, n int"}
    value = lambda r: r["value"] and (r["value"]["name"], r["value"]["n"])
    for cached in (False, True):
        got = {r["prompt_id"]: (value(r), r["error"], r["cached"]) for r in structured.complete(df, fake, **how).collect()}
        bad = "the answer is not of the schema"
        assert got == {1: (("GOOD", 4), None, cached), 2: (("GOOD", 4), None, cached), 3: (("DENSE", 5), None, cached), 4: (None, bad, False), 5: (None, bad, False), 6: (None, "ConnectionError: down", False)}
    other = structured.complete(df.filter("prompt_id = 1"), fake, **how, tag="v2").first()
    assert not other["cached"]


def test_breaker_in_a_task(spark):
    df = spark.createDataFrame([(str(i), "down") for i in range(6)], "key string, prompt string").coalesce(1)
    errors = [r["error"] for r in structured.called(df, fake, "x int").orderBy("key").collect()]
    assert errors == ["ConnectionError: down"] * 3 + ["breaker is open"] * 3


def test_claims_are_grounded_one_by_one(spark):
    drafts = spark.createDataFrame([("q", "The service uses TCP for transport. Revenue was 216 billion dollars. Loops never happen!"), ("r", "  ")], "question_id string, draft string")
    evidence = spark.createDataFrame([("q", "c1", "The service uses TCP for all transport connections."), ("q", "c2", "Revenue was 130 billion dollars."), ("q", "c3", "transport: the service uses TCP")], "question_id string, chunk_id string, text string")
    assert rows(structured.reason_then_ground(drafts, evidence), "claim_no", "chunk_ids") == [(0, ["c1", "c3"])]
    got = structured.expert_answers(drafts, drafts, evidence, "not grounded")
    assert rows(got, "question_id", "evidence_ids", "note", "grounded_claims", "n_claims") == [("q", ["c1", "c2", "c3"], "not grounded", 1, 3), ("r", [], None, 0, 0)]
