"""Exact dense search, rank fusion, reordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.topk import numbered

#: Queries of a block, and queries whose vectors are sent to every task.
QUERY_BLOCK, BROADCAST_QUERIES = 64, 20_000
RRF_K = 60


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance, summed in double precision."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; null for a zero vector."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def dense_topk(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding", only: Column | None = None) -> DataFrame:
    """``id, distance, rank, score``: the ``k`` nearest by L2, ties to the smaller id; ``score`` is ``(k - rank + 1) / k``.

    A filter is applied before the search.  Spark keeps ``k`` rows per task and merges those.
    """
    rows = vectors if only is None else vectors.filter(only)
    best = rows.select(id_col, l2(F.col(vector_col), literal(query)).alias("distance")).orderBy("distance", id_col).limit(k)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy("distance", id_col)))  # at most k rows
    return ranked.withColumn("score", (F.lit(k) - F.col("rank") + 1) / F.lit(k))


def knn_join(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, id, distance, rank`` for a stated set of queries (query_id, vector) against all rows.

    The queries are counted; blocks of ``QUERY_BLOCK`` of them meet all rows, one block after the other in a task, and
    are broadcast only up to ``BROADCAST_QUERIES``.
    """
    n = queries.count()
    asked = queries.select("query_id", F.col("vector").alias("_q"), F.pmod(F.xxhash64("query_id"), F.lit(n // QUERY_BLOCK + 1)).alias("_b"))
    blocks = asked.groupBy("_b").agg(F.collect_list(F.struct("query_id", "_q")).alias("_block")).drop("_b")
    pairs = vectors.select(id_col, vector_col).join(F.broadcast(blocks) if n <= BROADCAST_QUERIES else blocks, F.lit(True)).select(id_col, vector_col, F.explode("_block").alias("x"))
    scored = pairs.select("x.query_id", id_col, l2(F.col(vector_col), F.col("x._q")).alias("distance"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", id_col))).filter(F.col("rank") <= k)


def rrf(rankings: list[DataFrame], id_col: str = "chunk_id", k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of rankings (id, rank): ``id, score``, best first.

    Ties keep the order in which the ids first appear: earlier ranking first, then its rank.
    """
    parts = [r.select(id_col, F.col("rank").cast("long").alias("rank"), F.lit(i).alias("_list")) for i, r in enumerate(rankings)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    fused = every.groupBy(id_col).agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"), F.min(F.struct("_list", "rank")).alias("_first"))
    return fused.orderBy(F.desc("score"), "_first").select(id_col, "score", "_first")


def hybrid(dense: DataFrame, lexical: DataFrame, k: int, id_col: str = "chunk_id") -> DataFrame:
    """The ``k`` best of both rankings by fusion, with their rank."""
    best = rrf([dense, lexical], id_col).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "_first"))).drop("_first")


def demote(ranked: DataFrame, low: Column) -> DataFrame:
    """Rows where ``low`` holds move behind all others, the order is kept otherwise."""
    return numbered(ranked.withColumn("_low", low.cast("int")).withColumnRenamed("rank", "_was"), ["_low", "_was"], "rank").drop("_low", "_was")


def carry(ranked: DataFrame, prior: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Appends prior ids that are not there yet, in their order, behind the ranking."""
    last = ranked.agg(F.coalesce(F.max("rank"), F.lit(0)).alias("_last"))
    more = numbered(prior.join(ranked.select(id_col), id_col, "left_anti").select(id_col, F.col("rank").alias("_was")), ["_was", id_col], "_at")
    more = more.crossJoin(F.broadcast(last)).select(id_col, (F.col("_last") + F.col("_at")).alias("rank"))
    return ranked.select(id_col, "rank").unionByName(more)


def rerank(ranked: DataFrame, score: Column, top_k: int, id_col: str = "chunk_id") -> DataFrame:
    """Orders by any score column (a model's or :func:`lexical_overlap`), ties in the old order."""
    best = ranked.withColumn("rerank_score", score).orderBy(F.desc("rerank_score"), "rank").limit(max(1, top_k))
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("rerank_score"), "rank")))


def ordered_union(parts: list[DataFrame], id_col: str, pos_col: str = "pos") -> DataFrame:
    """Distinct ids of all parts in order of first appearance: ``id, pos``."""
    every = None
    for i, p in enumerate(parts):
        one = p.select(id_col, F.struct(F.lit(i).alias("part"), F.col(pos_col).cast("long").alias("pos")).alias("_at"))
        every = one if every is None else every.unionByName(one)
    first = every.groupBy(id_col).agg(F.min("_at").alias("_at"))
    return numbered(first, ["_at"], pos_col, 0).select(id_col, pos_col)


def round_robin(rows: DataFrame, group_col: str, order_col: str, last: Column, limit: int) -> DataFrame:
    """First of each group, then second of each, ...; groups where ``last`` holds come after all others in each turn."""
    turn = F.row_number().over(Window.partitionBy(group_col).orderBy(order_col))
    pos = F.min(order_col).over(Window.partitionBy(group_col))
    return rows.withColumn("_turn", turn).withColumn("_pos", pos).orderBy(last.cast("int"), "_turn", "_pos").limit(limit).drop("_turn", "_pos")


def counterparts(alignments: DataFrame, chunk_ids: DataFrame, left: str = "transcript_chunk_id", right: str = "deck_chunk_id") -> DataFrame:
    """Aligned partners of chunks, both ways: ``chunk_id, counterpart``."""
    ways = alignments.select(F.col(left).alias("chunk_id"), F.col(right).alias("counterpart")).unionByName(alignments.select(F.col(right).alias("chunk_id"), F.col(left).alias("counterpart")))
    return ways.join(chunk_ids.select("chunk_id").distinct(), "chunk_id").filter("counterpart IS NOT NULL").distinct()


def neighbours(chunks: DataFrame, hits: DataFrame, n: int) -> DataFrame:
    """Chunks up to ``n`` places before or after a hit in reading order, hits included."""
    placed = chunks.withColumn("_at", F.row_number().over(Window.partitionBy("document_id").orderBy("char_start", "chunk_id")))
    at = placed.join(hits.select("chunk_id").distinct(), "chunk_id").select("document_id", F.explode(F.sequence(F.col("_at") - n, F.col("_at") + n)).alias("_at")).distinct()
    return placed.join(at, ["document_id", "_at"]).drop("_at")
