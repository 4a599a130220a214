"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Main path: DataFrame functions only; the driver plans on counts of sources, never on documents.

* Targets.  Sources in code-point order (null last) take the weights in turn.  The mix wants
  ``epochs`` times all words; source *s* gets ``min(max_repeat * size_s, level * weight_s)`` where the
  water level is the one that spends exactly the wanted words.
* Blocks.  A document is cut into blocks of ``block_words`` words.  A source's blocks stand in an
  order drawn by md5 of (seed, doc_id, block), or with the row's number for its id where rows share
  one or have none; whole passes take every block once, and a prefix of
  the order supplies the rest of the target, to the nearest block.  That fixes each source's exact
  block quota.
* Splitting tree.  The root holds the quotas of all sources.  A node with capacity for k output
  shards splits into halves; how many of each source's blocks go left is one multivariate
  hypergeometric draw, so every leaf has its exact size and every block is equally likely anywhere.
  The tree's leaves are written as a table of the places that each shard takes.
* Leaves.  A shard takes its count of each source as the next disjoint run of the permuted blocks,
  and orders what it got by a hash: a local shuffle.  These draws are written down, one row for each
  time a block is drawn; what a document gave is summed from them.

The running sums over one source, which may hold a third of all rows, are done in two levels
(hash-range buckets, then inside a bucket), so no task sees a whole source.

Defined results: null text has size 0 and takes nothing; null sources form one source; repeated
rows and repeated ids count as documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm.common import BROADCAST_ROWS, materialise, remove_later, shared_dir, table

WEIGHTS, EPOCHS, MAX_REPEAT, BLOCK_WORDS, SEED, SHARDS = (3, 1, 2), 1.5, 2, 1024, 17, 64
#: Running sums are taken inside at most this many rows at once on average.
BUCKET_ROWS = 20_000
#: Blocks in an output shard, above ``SHARDS`` of them: a shard is sorted in one task.
SHARD_BLOCKS = 250_000
#: Things up to which a hypergeometric draw is exact, and cells of shards that the driver writes at once.
EXACT_DRAWS, CELLS_AT_ONCE = 1_000_000_000, 100_000
WORD = r"[^\x20\x09-\x0D]"
#: The drawn order of a source's blocks; keys differ, the rest only parts keys that clash.
ORDER = ("_key", "doc_id", "block", "size", "_row")


def size_of(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text."""
    words = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.length(F.regexp_replace(words, r"[\x20\x09-\x0D]+", "")).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, epochs: float = EPOCHS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``(source, source_size)`` to ``source, no, weight, source_size, target``; one row a source."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    out = sizes.withColumn("no", F.row_number().over(by_name) - 1)
    out = out.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("no") % len(weights) + 1).cast("int")).cast("double"))
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), "no")
    everyone, before, onward = Window.partitionBy(), by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(everyone) * F.lit(float(epochs)) - max_repeat * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    out = out.withColumn("_level", left / F.sum("weight").over(onward)).withColumn("_level", F.max("_level").over(everyone))
    target = F.least(F.col("source_size") * F.lit(float(max_repeat)), F.col("_level") * F.col("weight"))
    return out.select("source", "no", "weight", "source_size", target.alias("target"))


def _ranked(rows: DataFrame, n_rows: int, add: str) -> DataFrame:
    """Adds ``_before``, the sum of ``add``, and ``_rank``, the count, over the rows of the same source that stand earlier by ``ORDER``."""
    digits = max(1, min(6, len(f"{max(1, n_rows // BUCKET_ROWS):x}")))
    rows = rows.withColumn("_bucket", F.substring("_key", 1, digits))
    sums = rows.groupBy("no", "_bucket").agg(F.sum(add).alias("_s"), F.count(F.lit(1)).alias("_c"))
    ahead = Window.partitionBy("no").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("no", "_bucket", F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_s0"), F.coalesce(F.sum("_c").over(ahead), F.lit(0)).alias("_c0"))
    inside = Window.partitionBy("no", "_bucket").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum(add).over(inside), F.lit(0))).withColumn("_at", F.row_number().over(Window.partitionBy("no", "_bucket").orderBy(*ORDER)) - 1)
    return rows.join(sums, ["no", "_bucket"]).withColumn("_before", F.col("_in") + F.col("_s0")).withColumn("_rank", F.col("_at") + F.col("_c0")).drop("_in", "_at", "_s0", "_c0", "_bucket")


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` are good; exact up to ``EXACT_DRAWS`` things, beyond that a normal draw of the same mean and variance, to the nearest count that can be."""
    total = good + bad
    if not good or not draws:
        return 0
    if total < EXACT_DRAWS:
        return int(rng.hypergeometric(good, bad, draws))
    share = good / total
    spread = (draws * share * (1 - share) * ((total - draws) / max(1, total - 1))) ** 0.5
    mean = draws * good // total  # whole numbers of any size; the fraction is far below the spread
    return min(good, draws, max(0, draws - bad, mean + round(float(rng.standard_normal()) * spread)))


def splitting_tree(quotas: list[int], shards: int, seed: int = SEED) -> Iterator[list[int]]:
    """Blocks of each source for each shard, shard by shard; rows are shards of (almost) equal size, column sums are the quotas.

    The tree is walked depth first, so no more than a path of it is held.
    """
    rng = np.random.default_rng(seed)

    def split(counts: list[int], n: int) -> Iterator[list[int]]:
        if n == 1:
            yield counts
            return
        rest, half = sum(counts), n // 2
        draws, left = rest * half // n, []
        for c in counts:  # a multivariate draw, source by source
            rest -= c
            left.append(hypergeometric(rng, c, rest, draws))
            draws -= left[-1]
        yield from split(left, half)
        yield from split([c - x for c, x in zip(counts, left, strict=True)], n - half)

    return split([int(q) for q in quotas], max(1, shards))


def shard_cells(spark: SparkSession, quotas: dict[int, int], shards: int, seed: int) -> DataFrame:
    """``no, cell, first, last, shard``: which places of a source's draws a shard takes, as a written table.

    A cell is a run of places about as long as a shard's share, so a place meets few rows of its cell.  The driver
    holds ``CELLS_AT_ONCE`` of them, however many sources and shards there are.
    """
    path, held = f"{shared_dir(spark).rstrip('/')}/tesserae/{uuid.uuid4().hex}", []

    def write() -> None:
        rows = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(held)), "array<struct<no:int,cell:long,first:long,last:long,shard:int>>")).alias("c"))
        rows.select("c.*").write.mode("append").parquet(path)
        held.clear()

    done = dict.fromkeys(quotas, 0)
    for shard, leaf in enumerate(splitting_tree(list(quotas.values()), shards, seed)):
        for (no, quota), n in zip(quotas.items(), leaf, strict=True):
            if n:
                size, first, last = max(1, -(-quota // shards)), done[no], done[no] + n - 1
                held.extend({"no": no, "cell": c, "first": first, "last": last, "shard": shard} for c in range(first // size, last // size + 1))
                done[no] = last + 1
        if len(held) >= CELLS_AT_ONCE:
            write()
    write()
    remove_later(spark, path)
    return spark.read.parquet(path)


def plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, block_words: int, seed: int, row_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents with ``_row``, size and target, and the blocks with ``takes``, how often the mix draws each, and ``_rank`` in its source.

    ``row_col`` names a written column that tells rows apart; without one, numbers are given here.
    """
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    sized = materialise(docs.select(row.alias("_row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size")))
    sources = materialise(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))))
    sized = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    again = materialise(sized.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("_id"), F.lit(True).alias("_again")))
    n_again = again.count()
    if n_again:  # ids that several rows share, or none: such rows are told apart by their number
        named = sized.join(F.broadcast(again) if n_again <= BROADCAST_ROWS else again, F.col("doc_id").eqNullSafe(F.col("_id")), "left").withColumn("_again", F.col("_again").isNotNull())
    else:
        named = sized.withColumn("_again", F.lit(False))
    blocks = named.filter("size > 0").select("_row", "_again", "doc_id", "no", "source_size", "target", "size", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / block_words).cast("int") - 1)).alias("block"))
    blocks = blocks.withColumn("words", F.least(F.lit(block_words).cast("long"), F.col("size") - F.col("block").cast("long") * block_words))
    name = F.when(F.col("_again"), F.concat(F.lit("row "), F.col("_row").cast("string"))).otherwise(F.col("doc_id").cast("string"))  # no two blocks share a name
    blocks = blocks.withColumn("_key", F.md5(F.concat_ws(":", F.lit(str(seed)), name, F.col("block").cast("string"))))
    passes = F.floor(F.col("target") / F.col("source_size"))
    blocks = _ranked(blocks, blocks.count(), "words").withColumn("_passes", passes)
    rest = F.col("target") - F.col("_passes") * F.col("source_size")
    blocks = blocks.withColumn("takes", (F.col("_passes") + (F.col("_before") * 2 + F.col("words") <= rest * 2).cast("int")).cast("int"))
    return sized, blocks.select("_row", "doc_id", "no", "block", "words", "_key", "_rank", "takes")


def draw(blocks: DataFrame, seed: int = SEED, shards: int = SHARDS) -> DataFrame:
    """The draws of the blocks of :func:`plan`, written down: ``_row, doc_id, block, copy, words, shard, slot``."""
    blocks = materialise(blocks)
    per = blocks.groupBy("no").agg(F.sum("takes").alias("quota"), F.count(F.lit(1)).alias("n")).orderBy("no")
    per = materialise(per.filter("quota > 0"))
    quotas = {r["no"]: r["quota"] for r in per.collect()}  # one row a source
    shards = max(shards, sum(quotas.values()) // SHARD_BLOCKS + 1)
    cells = shard_cells(blocks.sparkSession, quotas, shards, seed)
    few = cells.count() <= BROADCAST_ROWS // 4
    places = per.select("no", "n", F.ceil(F.col("quota") / shards).alias("_size"))
    drawn = blocks.filter("takes > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("takes") - 1))).join(F.broadcast(places) if len(quotas) <= BROADCAST_ROWS else places, "no")
    drawn = drawn.withColumn("_at", F.col("_rank") + F.col("copy") * F.col("n")).withColumn("cell", F.floor(F.col("_at") / F.greatest(F.col("_size"), F.lit(1))))
    drawn = drawn.join(F.broadcast(cells) if few else cells, ["no", "cell"]).filter(F.col("_at").between(F.col("first"), F.col("last")))
    drawn = drawn.select("_row", "doc_id", "block", "copy", "words", "shard", F.md5(F.concat_ws(":", F.lit(f"{seed}/shuffle"), "_key", F.col("copy").cast("string"))).alias("_draw"))
    return materialise(drawn.withColumn("slot", F.row_number().over(Window.partitionBy("shard").orderBy("_draw", "doc_id", "block", "copy", "_row")) - 1).drop("_draw"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, seed: int = SEED, shards: int = SHARDS) -> DataFrame:
    """The mix itself: ``doc_id, block, copy, words, shard, slot``; a document's block may be drawn more than once, in different passes."""
    return draw(plan(docs, id_col, text_col, source_col, block_words, seed)[1], seed, shards).drop("_row")


def taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, seed: int = SEED, shards: int = SHARDS) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken``, the words of its draws in all shards."""
    sized, blocks = plan(docs, id_col, text_col, source_col, block_words, seed)
    sums = draw(blocks, seed, shards).groupBy("_row").agg(F.sum("words").alias("_t"))
    return sized.join(sums, "_row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("_t", F.lit(0)).cast("long").alias("taken"))


def block_texts(text: Column, block_words: int) -> Column:
    """The text cut after every ``block_words`` words; a text without words stays one piece.

    The quantifiers are possessive, so Java takes one word after the other without recursion.
    """
    cut = rf"[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+){{1,{block_words}}}+"
    return F.when(text.rlike(WORD), F.regexp_extract_all(text, F.lit(cut), F.lit(0))).otherwise(F.array(text))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, seed: int = SEED, shards: int = SHARDS) -> DataFrame:
    """The mix as rows of ``docs``: one for each draw, with the drawn block as its text; documents without words stay once.

    ``shards`` is the least number of shards.  A shard's rows lie in one partition, in the order of their slots.  The texts are shuffled by shard,
    and before that by row where the draws were counted as too many to broadcast.
    """
    keyed = materialise(docs.withColumn("__row", F.monotonically_increasing_id()))
    drawn = draw(plan(keyed, id_col, text_col, source_col, block_words, seed, "__row")[1], seed, shards)
    n_drawn = drawn.count()
    drawn = materialise(drawn.groupBy(F.col("_row").alias("__row")).agg(F.collect_list(F.struct("block", "shard", "slot")).alias("__draws")))  # bounded by the document
    if drawn.count() <= BROADCAST_ROWS // 4:
        drawn = F.broadcast(drawn)
    keyed = keyed.join(drawn, "__row", "left").filter(F.col("__draws").isNotNull() | ~F.coalesce(F.col(text_col).rlike(WORD), F.lit(False)))
    cut = keyed.select(*[c for c in docs.columns if c != text_col], "__row", "__draws", F.posexplode(block_texts(F.col(text_col), block_words)).alias("__block", text_col))
    mine = F.filter("__draws", lambda d: d["block"] == F.col("__block"))
    mine = F.when(F.col("__draws").isNull(), F.array(F.lit(None).cast("struct<block:int,shard:int,slot:int>"))).otherwise(mine)
    out = cut.withColumn("__draw", F.explode(mine)).withColumn("__shard", F.col("__draw.shard")).withColumn("__slot", F.col("__draw.slot"))
    out = out.withColumn("__shard", F.coalesce("__shard", F.pmod("__row", F.lit(shards)).cast("int")))
    shards = max(shards, n_drawn // SHARD_BLOCKS + 1)
    return out.repartition(shards, "__shard").sortWithinPartitions("__shard", "__slot").select(*docs.columns)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(table(spark, sf_dir, "documents"))


ORACLE_OP4 = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS no FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][CAST(no % 3 + 1 AS INT)] AS DOUBLE) AS weight FROM s),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE
        - 2 * coalesce(CAST(sum(source_size) OVER (ORDER BY source_size / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0::DOUBLE))
        / sum(weight) OVER (ORDER BY source_size / weight, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, no, source_size, least(source_size * 2::DOUBLE, max(level) OVER () * weight) AS target FROM l),
b AS (SELECT doc_id, no, source_size, target, size, block, least(1024, size - block * 1024) AS words, md5('17:' || doc_id || ':' || block) AS k
      FROM (SELECT d.doc_id, d.size, t.no, t.source_size, t.target, unnest(range(CAST(ceil(d.size / 1024.0) AS BIGINT))) AS block
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source WHERE d.size > 0)),
c AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY no ORDER BY k, doc_id, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, floor(target / source_size) AS passes FROM b),
x AS (SELECT doc_id, sum(words * (passes + CASE WHEN before * 2 + words <= (target - passes * source_size) * 2 THEN 1 ELSE 0 END)) AS taken FROM c GROUP BY doc_id)
SELECT d.doc_id, d.size, t.source_size, t.target, CAST(coalesce(x.taken, 0) AS BIGINT) AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN x ON x.doc_id = d.doc_id
"""
