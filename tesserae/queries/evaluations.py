"""Query sets and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import headers, reports
from tesserae.queries.base import query


@query("""
SELECT conv_id, turn, 'c' || conv_id || '-' || turn AS qid, role <> 'user' AS should_refuse, CASE WHEN turn % 3 = 2 THEN 0 ELSE 2 END::INT AS n_slots,
  CASE turn % 3 WHEN 0 THEN upper(role) || ';' || role || '|' || lang WHEN 1 THEN role || '|' || lang || ';' || upper(role) ELSE '' END AS slots
FROM (SELECT *, CASE WHEN length(text) % 2 = 0 THEN 'even' ELSE 'odd' END AS lang FROM conversations)""")
def query_set_slots(t):
    """Records written as JSON, whose slots mix strings and arrays in either order, or are missing, read back."""
    c = t.conversations.withColumn("lang", F.when(F.length("text") % 2 == 0, "even").otherwise("odd"))
    one, many = F.concat(F.lit('"'), F.upper("role"), F.lit('"')), F.concat(F.lit('["'), "role", F.lit('","'), "lang", F.lit('"]'))
    slots = F.when(F.col("turn") % 3 == 0, F.concat(F.lit('['), one, F.lit(","), many, F.lit("]"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("["), many, F.lit(", null, "), one, F.lit("]"))).otherwise(F.lit("null"))
    text = F.concat(F.lit('{"_comment": "x", "queries": [{"_note": 1, "qid": "c'), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit('", "should_refuse": '), (F.col("role") != "user").cast("string"), F.lit(', "answer_must_mention": '), slots, F.lit("}]}"))
    rows = c.select("conv_id", "turn", F.explode(reports.records(text, "queries")).alias("record"))
    r = F.col("record")
    found = rows.select("conv_id", "turn", reports.field(r, "qid", "string"), reports.field(r, "should_refuse", "boolean", False), reports.slots(F.try_variant_get(r, "$.answer_must_mention", "variant")).alias("s"))
    return found.select("conv_id", "turn", "qid", "should_refuse", F.size("s").alias("n_slots"), F.array_join(F.transform("s", lambda x: F.array_join(x, "|")), ";").alias("slots"))


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_discount AS cer, l_tax AS wer, l_quantity / 50 AS f1, CASE WHEN l_linenumber % 2 = 0 THEN 0.05 END AS c, CASE WHEN l_linenumber % 3 = 0 THEN 0.04 END AS w, CASE WHEN l_linenumber % 5 = 0 THEN 0.5 END AS f, l_returnflag = 'R' AS bad FROM lineitem)
SELECT count(*) FILTER (WHERE NOT bad) AS doc_count, count(*) FILTER (WHERE NOT bad AND NOT coalesce(cer > c, false) AND NOT coalesce(wer > w, false) AND NOT coalesce(f1 < f, false)) AS passed_count, count(*) FILTER (WHERE bad) AS errors,
  round(avg(cer) FILTER (WHERE NOT bad), 6) AS mean_cer, round(avg(f1) FILTER (WHERE NOT bad), 6) AS mean_f1_tables FROM s""")
def parse_report(t):
    """Line items as scored documents, some of which demand something and some of which failed."""
    k, none = F.col("l_linenumber"), F.lit(None).cast("double")
    s = t.lineitem.select(
        F.col("l_discount").alias("cer"), F.col("l_tax").alias("wer"), *[(F.col("l_quantity") / 50).alias(f"f1_{x}") for x in ("headings", "tables", "equations")],
        F.when(k % 2 == 0, 0.05).alias("cer_threshold"), F.when(k % 3 == 0, 0.04).alias("wer_threshold"), none.alias("f1_threshold"), F.when(k % 5 == 0, 0.5).alias("f1_tables_threshold"), none.alias("f1_equations_threshold"), F.when(F.col("l_returnflag") == "R", "missing").alias("error"),
    )
    return reports.parse_report(s).select("doc_count", "passed_count", "errors", F.round("mean_cer", 6).alias("mean_cer"), F.round("mean_f1_tables", 6).alias("mean_f1_tables"))


@query(r"""
WITH d AS (SELECT doc_id, n_chars > 800 AS answered, lang <> 'de' AS due, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS x FROM documents),
r AS (SELECT *, (regexp_matches(x, '(^|\W)(the|le)(\W|$)')::INT + regexp_matches(x, '(^|\W)und(\W|$)')::INT + regexp_matches(x, '(^|\W)this work(\W|$)')::INT) / 3.0::DOUBLE AS recall, contains(x, 'license')::INT + contains(x, 'worthless')::INT AS leaks FROM d)
SELECT count(*) AS case_count, count(*) FILTER (WHERE answered) AS summarized_count, count(*) FILTER (WHERE answered = due) AS summarize_correct_count, sum(leaks)::BIGINT AS hallucination_count, round(avg(recall) FILTER (WHERE answered), 6) AS mean_mention_recall FROM r""")
def summary_report(t):
    """Documents as summaries of themselves: long ones are answers, German ones should not be."""
    slots = F.array(F.array(F.lit("the"), F.lit("le")), F.array(F.lit("und")), F.array(F.lit("this work")))
    cases = t.documents.select("doc_id", slots.alias("must_mention"), F.array(F.lit("license"), F.lit("worthless")).alias("must_not_assert"), (F.col("lang") != "de").alias("should_summarize"))
    answers = t.documents.select("doc_id", (F.col("n_chars") > 800).alias("answered"), "text")
    return reports.summary_report(reports.summary_results(cases, answers)).withColumn("mean_mention_recall", F.round("mean_mention_recall", 6))


@query("""
WITH g AS (SELECT vec_id AS name, list_distinct([vec_id % 10, vec_id % 7, vec_id % 3]) AS gold FROM embeddings),
f AS (SELECT vec_id AS name, unnest(range(0, 10)) AS rank FROM embeddings),
h AS (SELECT g.name, any_value(len(gold)) AS n, count(DISTINCT rank) FILTER (WHERE rank + 1 <= 5 AND list_contains(gold, rank)) AS hits FROM g JOIN f USING (name) GROUP BY g.name)
SELECT count(*) AS case_count, round(avg(hits / n::DOUBLE), 6) AS mean_recall FROM h""")
def chat_report(t):
    """A case for each vector, with up to three gold chunks; ten chunks are found in order, five count."""
    e = t.embeddings.select(F.col("vec_id").cast("string").alias("name"), "vec_id")
    cases = e.select("name", F.array(*[(F.col("vec_id") % k).cast("string") for k in (10, 7, 3)]).alias("relevant_chunk_ids"), F.lit(5).alias("k"))
    found = e.select("name", F.posexplode(F.sequence(F.lit(0), F.lit(9))).alias("p", "c")).select("name", (F.col("p") + 1).alias("rank"), F.col("c").cast("string").alias("chunk_id"))
    return reports.chat_report(reports.chat_results(cases, found)).withColumn("mean_recall", F.round("mean_recall", 6))


@query("""
WITH r AS (SELECT l_orderkey AS k, l_linenumber AS i, l_orderkey % 3 = 0 AS gated, l_orderkey % 5 <> 0 AS expects, (l_partkey % 11 = 0)::INT * 2 AS a, (l_suppkey % 13 = 0)::INT AS b, (l_partkey % 17 = 0)::INT AS c, l_quantity / 50 AS cov, l_discount AS hedges, l_returnflag = 'R' AND l_linestatus = 'O' AS refused, l_returnflag = 'A' AS declined FROM lineitem),
x AS (SELECT k, bool_and(expects) AS expects, bool_or(refused) AS refused, bool_or(declined AND NOT expects) AS declined, avg(cov) AS cov, arg_min(hedges, i) AS hedges, bool_or(gated) AS gated, count(*) AS n, count(DISTINCT a + b + c > 0) = 1 AS stable,
  max(a) AS ma, max(b) AS mb, max(c) AS mc, count(*) FILTER (WHERE a > 0) AS ca, count(*) FILTER (WHERE b > 0) AS cb, count(*) FILTER (WHERE c > 0) AS cc FROM r GROUP BY k),
y AS (SELECT *, CASE WHEN gated THEN (ca > n // 2)::INT ELSE ma END AS ga, CASE WHEN gated THEN (cb > n // 2)::INT ELSE mb END AS gb, CASE WHEN gated THEN (cc > n // 2)::INT ELSE mc END AS gc FROM x)
SELECT k, n AS runs, ga::BIGINT AS vault_contradiction, gb::BIGINT AS fabricated_specific, gc::BIGINT AS structural, stable AS gate_run_stable, refused AS unexpected_refused, declined AS declined_specific,
  ga + gb + gc = 0 AS hard_gates_pass, NOT expects OR (NOT refused AND cov >= 0.5 AND hedges <= 0.15) AS usefulness_floor_pass FROM y""")
def expert_results(t):
    """Orders as cases, their line items as runs; every third case is gated."""
    k, zero = F.col("l_orderkey"), F.lit(0)
    row = F.struct("_metadata.file_path", "_metadata.row_index")  # line numbers may be repeated: of equal ones the first row counts, and means are summed as rows come
    runs = t.lineitem.select(
        k.alias("name"), F.lit("x").alias("case_type"), F.struct("l_linenumber", row).alias("run"), row.alias("row"), (k % 3 == 0).alias("is_gated"), (k % 5 != 0).alias("expects_engagement"),
        ((F.col("l_partkey") % 11 == 0).cast("int") * 2).alias("vault_contradiction"), (F.col("l_suppkey") % 13 == 0).cast("int").alias("fabricated_specific"), (F.col("l_partkey") % 17 == 0).cast("int").alias("structural"), zero.alias("ood_doc_attribution"), zero.alias("advisory_safety"),
        (F.col("l_quantity") / 50).alias("coverage"), F.lit(0.0).alias("acknowledged"), F.col("l_discount").alias("hedges"), ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")).alias("refused"), (F.col("l_returnflag") == "A").alias("declined"),
    )
    return reports.expert_results(runs, "row").select(F.col("name").alias("k"), "runs", "vault_contradiction", "fabricated_specific", "structural", "gate_run_stable", "unexpected_refused", "declined_specific", "hard_gates_pass", "usefulness_floor_pass")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN NULL WHEN len(string_split(p_name, ' ')) = 2 THEN '|' || replace(p_name, ' ', '|') END AS header FROM part""")
def detached_headers(t):
    """Tables made of parts: a row label and two figures, with the name's words in front; every fourth has a header of its own."""
    cell = lambda text, flag: F.struct(text.alias("text"), flag.alias("header"))
    own = F.col("p_partkey") % 4 == 3
    first = F.array(cell(F.when(own, "").otherwise(F.col("p_brand").substr(1, 5)), F.lit(False)), cell(F.when(own, "2023").otherwise(F.col("p_size").cast("string")), own), cell(F.when(own, "2024").otherwise(F.col("p_retailprice").cast("string")), own))
    rest = F.array(cell(F.lit("Total"), F.lit(False)), cell(F.lit("1"), F.lit(False)), cell(F.lit("2"), F.lit(False)))
    item = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    before = F.array(item("text", F.lit("before")), item("picture", F.lit(None).cast("string")), item("text", F.col("p_name")))
    tables = t.part.select(F.lit("d").alias("doc_id"), F.col("p_partkey").alias("table_id"), F.array(first, rest).alias("grid"), before.alias("before"))
    return headers.reattach(tables).select(F.col("table_id").alias("p_partkey"), F.array_join("header", "|").alias("header"))
