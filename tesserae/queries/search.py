"""Full text, vectors, fusion, retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.operators import evals, fulltext, vectors
from tesserae.queries.base import query

TOKENS = r"regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')"


def _bm25_sql(phrases: list[list[str]], k: int) -> str:
    def count(p: list[str]) -> str:
        needle = "".join(f" {x} " for x in p)
        padded = "(' ' || array_to_string(t, '  ') || ' ')"
        return f"len(list_filter(t, lambda x: x = '{p[0]}'))" if len(p) == 1 else f"(length({padded}) - length(replace({padded}, '{needle}', ''))) // {len(needle)}"

    cols = ", ".join(f"{count(p)} AS f{i}" for i, p in enumerate(phrases))
    stats = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS n{i}" for i in range(len(phrases)))
    idf = lambda i: f"CASE WHEN ln((N - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((N - n{i} + 0.5) / (n{i} + 0.5)) ELSE 1e-6 END"
    total = " + ".join(f"CASE WHEN f{i} > 0 THEN ({idf(i)}) * f{i} * 2.2::DOUBLE / (f{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * d / a)) ELSE 0 END" for i in range(len(phrases)))
    some = " OR ".join(f"f{i} > 0" for i in range(len(phrases)))
    return f"""
WITH x AS (SELECT doc_id, {TOKENS} AS t FROM documents), c AS (SELECT doc_id, len(t) AS d, {cols} FROM x),
s AS (SELECT CAST(count(*) AS DOUBLE) AS N, avg(d) AS a, {stats} FROM c)
SELECT doc_id, round({total}, 6) AS score FROM c, s WHERE {some} ORDER BY {total} DESC, doc_id LIMIT {k}"""


def _bm25(t, phrases: list[str], k: int):
    return fulltext.search(t.documents, phrases, k, "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query(_bm25_sql([["the"]], 10))
def bm25_frequent_term_topk(t):
    return _bm25(t, ["the"], 10)


@query(_bm25_sql([["license"], ["worthless"], ["release"]], 10))
def bm25_or_topk(t):
    return _bm25(t, ["license", "Worthless", "release"], 10)


@query(_bm25_sql([["this", "work", "is", "licensed"]], 20))
def bm25_phrase_topk(t):
    return _bm25(t, ["This work is licensed"], 20)


@query(f"""
WITH x AS (SELECT doc_id, {TOKENS} AS t FROM documents)
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_terms FROM x""")
def doc_token_stats(t):
    return t.documents.select("doc_id", T.tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"))


@query(f"""
WITH x AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents), d AS (SELECT term, count(DISTINCT doc_id) AS df FROM x GROUP BY term), n AS (SELECT count(*) AS n FROM documents)
SELECT term, df, round(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END, 6) AS idf FROM d, n""")
def term_df_idf(t):
    docs = t.documents
    df = fulltext.document_frequency(fulltext.postings(docs, "doc_id"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.round(F.when(idf > 0, idf).otherwise(1e-6), 6).alias("idf"))


@query(f"""
WITH x AS (SELECT doc_id, {TOKENS} AS t FROM documents), p AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM x),
i AS (SELECT doc_id, term, dl, count(*) AS tf FROM p GROUP BY ALL), s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(t)) AS a FROM x),
q AS (SELECT DISTINCT conv_id, turn, unnest({TOKENS}) AS term FROM conversations WHERE role = 'user'),
df AS (SELECT term, count(*) AS df FROM i GROUP BY term),
r AS (SELECT conv_id, turn, doc_id, sum((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / a))) AS score
      FROM q JOIN i USING (term) JOIN df USING (term), s GROUP BY conv_id, turn, doc_id)
SELECT conv_id, turn, doc_id, round(score, 6) AS score FROM r QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY round(score, 6) DESC, doc_id) <= 3""")
def bm25_batch_topk(t):
    """Three documents for each turn of a user, by joining all postings of its terms."""
    docs = t.documents
    turns = t.conversations.filter("role = 'user'").select(F.struct("conv_id", "turn").alias("query_id"), "text")
    found = fulltext.search_batch(fulltext.postings(docs, "doc_id"), fulltext.corpus_stats(docs), turns, 3, "doc_id")
    return found.select("query_id.conv_id", "query_id.turn", "doc_id", "score")



ZERO = "(SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"
L2 = "sqrt(list_sum(list_transform(list_zip(embedding, q), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))))"


def _seed(t, vec_id: int = 0) -> list[float]:
    return list(t.embeddings.filter(F.col("vec_id") == vec_id).select("embedding").first()[0])


@query(f"""
WITH d AS (SELECT vec_id, {L2} AS distance FROM embeddings, {ZERO}), r AS (SELECT *, row_number() OVER (ORDER BY distance, vec_id) AS rank FROM d)
SELECT vec_id, round(distance, 6) AS distance, rank, (10 - rank + 1) / 10.0::DOUBLE AS score FROM r WHERE rank <= 10""")
def dense_l2_topk(t):
    out = vectors.dense_topk(t.embeddings, _seed(t), 10)
    return out.select("vec_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"), "score")


@query(f"""
WITH d AS (SELECT vec_id, {L2} AS distance FROM embeddings, {ZERO} WHERE label IN (1, 2))
SELECT vec_id, round(distance, 6) AS distance FROM d ORDER BY d.distance, vec_id LIMIT 10""")
def dense_filtered_topk(t):
    return vectors.dense_topk(t.embeddings, _seed(t), 10, only=F.col("label").isin(1, 2)).select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"""
SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, q), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))
  / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS cosine FROM embeddings, {ZERO}""")
def cosine_scores(t):
    return t.embeddings.select("vec_id", F.round(vectors.cosine(F.col("embedding"), vectors.literal(_seed(t))), 6).alias("cosine"))


FIRSTS = "(SELECT label AS qlabel, arg_min(embedding, vec_id) AS q, min(vec_id) AS query_id FROM embeddings GROUP BY label)"
KNN = f"SELECT query_id, qlabel, vec_id, label, {L2} AS distance, row_number() OVER (PARTITION BY query_id ORDER BY {L2}, vec_id) AS rank FROM embeddings, {FIRSTS}"


def _knn(t, k: int):
    e = t.embeddings
    q = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector"), F.min("vec_id").alias("query_id"))
    near = vectors.knn_join(q.select("query_id", "vector"), e, k).join(e.select("vec_id", "label"), "vec_id")
    return near.join(q.select("query_id", F.col("label").alias("qlabel")), "query_id")


@query(f"WITH r AS ({KNN}) SELECT query_id, vec_id, round(distance, 6) AS distance, rank FROM r WHERE rank <= 10")
def knn_join_topk(t):
    return _knn(t, 10).select("query_id", "vec_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(f"""
WITH r AS ({KNN}), l AS (SELECT query_id, list(CASE WHEN label = qlabel THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ORDER BY rank) AS g FROM r WHERE rank <= 50 GROUP BY query_id),
n AS (SELECT min(vec_id) AS query_id, count(*) AS n FROM embeddings GROUP BY label)
SELECT query_id,
  round(coalesce(list_sum(list_transform(range(1, 11), lambda i: g[i] / log2(i + 1)))
    / nullif(list_sum(list_transform(range(1, 11), lambda i: list_reverse_sort(g)[i] / log2(i + 1))), 0), 0), 6) AS ndcg,
  round(coalesce(list_sum(list_transform(range(1, 11), lambda i: g[i] / log2(i + 1))) / nullif(list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1.0 / log2(i + 1))), 0), 0), 6) AS ndcg_standard,
  round(coalesce(1.0::DOUBLE / nullif(list_position(g[1:10], 1.0::DOUBLE), 0), 0), 6) AS mrr,
  round(list_sum(list_transform(range(1, len(g) + 1), lambda i: CASE WHEN g[i] > 0 THEN list_sum(g[1:i]) / i ELSE 0 END)) / n, 6) AS ap
FROM l JOIN n USING (query_id)""")
def ranking_metrics(t):
    near = _knn(t, 50).withColumn("g", (F.col("label") == F.col("qlabel")).cast("double"))
    l = near.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "g"))), lambda x: x["g"]).alias("g"))  # noqa: E741
    n = t.embeddings.groupBy("label").agg(F.min("vec_id").alias("query_id"), F.count(F.lit(1)).alias("n"))
    j = l.join(n, "query_id")
    g = F.col("g")
    return j.select("query_id", F.round(evals.ndcg_at_k(g, 10), 6).alias("ndcg"), F.round(evals.ndcg_at_k(g, 10, F.col("n")), 6).alias("ndcg_standard"), F.round(evals.mrr_at_k(g, 10), 6).alias("mrr"), F.round(evals.average_precision(g, F.col("n")), 6).alias("ap"))


@query(f"""
WITH r AS ({KNN}), l AS (SELECT query_id, qlabel, list(vec_id ORDER BY rank) AS ids FROM r WHERE rank <= 20 GROUP BY ALL), g AS (SELECT label AS qlabel, list(vec_id) AS gold FROM embeddings GROUP BY label)
SELECT query_id, round(len(list_intersect(ids, gold)) / len(gold)::DOUBLE, 6) AS recall, round(len(list_intersect(ids, gold)) / 20.0::DOUBLE, 6) AS precision FROM l JOIN g USING (qlabel)""")
def recall_precision_at_k(t):
    l = _knn(t, 20).groupBy("query_id", "qlabel").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "vec_id"))), lambda x: x["vec_id"]).alias("ids"))  # noqa: E741
    g = t.embeddings.groupBy(F.col("label").alias("qlabel")).agg(F.collect_list("vec_id").alias("gold"))
    return l.join(g, "qlabel").select("query_id", F.round(evals.recall_at_k(F.col("ids"), F.col("gold"), 20), 6).alias("recall"), F.round(evals.citation_precision(F.col("ids"), F.col("gold")), 6).alias("precision"))


RANKS = f"""
a AS (SELECT vec_id, row_number() OVER (ORDER BY {L2}, vec_id) AS rank FROM embeddings, {ZERO} QUALIFY rank <= 50),
b AS (SELECT vec_id, row_number() OVER (ORDER BY label, vec_id DESC) AS rank FROM embeddings QUALIFY rank <= 50),
u AS (SELECT *, 0 AS l FROM a UNION ALL SELECT *, 1 AS l FROM b),
f AS (SELECT vec_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(l * 1000 + rank) AS first FROM u GROUP BY vec_id)"""


@query(f"WITH {RANKS} SELECT vec_id, round(score, 8) AS score, row_number() OVER (ORDER BY round(score, 10) DESC, first) AS rank FROM f")
def rrf_fusion(t):
    a = vectors.dense_topk(t.embeddings, _seed(t), 50).select("vec_id", "rank")
    b = t.embeddings.orderBy("label", F.desc("vec_id")).limit(50).select("vec_id", F.row_number().over(Window.orderBy("label", F.desc("vec_id"))).alias("rank"))
    fused = vectors.rrf([a, b], "vec_id")
    return fused.select("vec_id", F.round("score", 8).alias("score"), F.row_number().over(Window.orderBy(F.desc(F.round("score", 10)), "_first")).cast("long").alias("rank"))


@query("""
SELECT conv_id, turn, round(coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0)::DOUBLE, 0), 6) AS jaccard
FROM (SELECT conv_id, turn, string_split(lower(text), ' ') AS a, lag(string_split(lower(text), ' ')) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE b IS NOT NULL""")
def turn_jaccard(t):
    words = F.split(F.lower("text"), " ")
    prev = F.lag("a").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = t.conversations.select("conv_id", "turn", words.alias("a")).withColumn("b", prev).filter("b IS NOT NULL")
    return rows.select("conv_id", "turn", F.round(T.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query("""
SELECT p_partkey, round(levenshtein(lower(p_name), lower(p_type)) / length(p_name)::DOUBLE, 6) AS cer FROM part""")
def cer_pairs(t):
    return t.part.select("p_partkey", F.round(evals.cer(F.col("p_name"), F.col("p_type")), 6).alias("cer"))


@query(None)
def wer_turns(t):
    prev = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.conversations.withColumn("_p", prev).filter("_p IS NOT NULL").select("conv_id", "turn", F.round(evals.wer(F.col("_p"), F.col("text")), 6).alias("wer"))


@query("""
WITH r AS (SELECT o_orderkey, o_orderstatus = 'P' AS should_refuse, o_orderpriority LIKE '1%' AS refused, CASE WHEN o_orderkey % 97 = 0 THEN 'x' END AS error, o_totalprice / 1e6 AS recall, o_custkey / 1e6 AS precision FROM orders)
SELECT count(*) AS n, count(*) FILTER (WHERE error IS NOT NULL) AS errors,
  round(avg(recall) FILTER (WHERE error IS NULL AND NOT refused AND NOT should_refuse), 6) AS mean_recall, round(avg(precision) FILTER (WHERE error IS NULL AND NOT refused AND NOT should_refuse), 6) AS mean_precision,
  round(coalesce(avg(refused::INT) FILTER (WHERE error IS NULL AND should_refuse), 1), 6) AS refusal_rate FROM r""")
def eval_report(t):
    r = t.orders.select((F.col("o_orderstatus") == "P").alias("should_refuse"), F.col("o_orderpriority").like("1%").alias("refused"), F.when(F.col("o_orderkey") % 97 == 0, "x").alias("error"), (F.col("o_totalprice") / 1e6).alias("recall"), (F.col("o_custkey") / 1e6).alias("precision"))
    out = evals.report(r)
    return out.select("n", "errors", *[F.round(c, 6).alias(c) for c in ("mean_recall", "mean_precision", "refusal_rate")])


@query("""
WITH a AS (SELECT year(o_orderdate) AS y, o_orderpriority AS metric, avg(o_totalprice) AS value FROM orders GROUP BY 1, 2), p AS (SELECT y FROM a WHERE y > (SELECT min(y) FROM a) GROUP BY y)
SELECT p.y::INT AS y, b.metric, CASE WHEN c.value IS NULL OR (c.value - b.value) / b.value > 0.01 THEN 'fail' WHEN (c.value - b.value) / b.value > 0.001 THEN 'warn' ELSE 'ok' END AS verdict
FROM p JOIN a b ON b.y = p.y - 1 LEFT JOIN a c ON c.y = p.y AND c.metric = b.metric""")
def regression_gate(t):
    """The mean order of each priority and year against that of the year before."""
    a = t.orders.groupBy(F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("p")).agg(F.avg("o_totalprice").alias("value"))
    before = a.withColumn("y", F.col("y") + 1).join(a.select("y").distinct(), "y", "left_semi")
    keyed = lambda df: df.select(F.struct("y", "p").alias("metric"), "value")
    return evals.regression_gate(keyed(before), keyed(a), 0.01, 0.001).select("metric.y", F.col("metric.p").alias("metric"), "verdict")


