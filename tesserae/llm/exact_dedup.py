"""Exact dedup by deterministic block naming (DataFrame functions only).

Texts are equal when they are identical after each run of ``[\\x20\\x09-\\x0D]`` became one space.
Every text is cut into blocks of ``block_chars`` characters.  The distinct blocks are sorted and
numbered, so equal blocks - and no others - get one integer.  Then adjacent pairs of integers are
numbered in the same way, level by level, until one integer per document is left.

Blocks are dealt and sorted by a 128-bit hash with the block itself behind it; the distinct blocks,
by content, travel once.  Documents find their blocks' names under the hash alone, after it was
proved that no two distinct blocks share one; if two ever did, another seed would be taken.  So two
different texts cannot share an identity, and only numbers are shuffled but for the distinct blocks.

Defined results: a null text counts as empty; a null ``doc_id`` sorts after all others; repeated
rows (same id, same text) form a group of which one row stays; an empty table gives no rows; other
columns are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import BROADCAST_ROWS, materialise, table, without_copies

BLOCK_CHARS = 4096


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _named(values: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct ``keys`` with an integer ``name`` each, ascending in sort order, written once."""
    return materialise(values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).drop("_n").orderBy(*keys).withColumn("name", F.monotonically_increasing_id()))


def _blocks(norm: Column, block_chars: int) -> Column:
    cut = F.regexp_extract_all(norm, F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    return F.when(norm == "", F.array(F.lit(""))).otherwise(cut)


def _hash(block: Column, seed: int) -> Column:
    return F.struct(F.xxhash64(F.lit(seed), block).alias("h"), F.xxhash64(F.lit(seed + 1), block).alias("g"))


def block_names(texts: DataFrame, block_chars: int, seed: int) -> DataFrame:
    """``norm`` to ``h, g, name`` of every distinct block, numbered in the order of hash and content."""
    blocks = texts.select(F.explode(_blocks(F.col("norm"), block_chars)).alias("block"))
    blocks = blocks.select(_hash(F.col("block"), seed).alias("k"), "block").select("k.h", "k.g", "block")
    distinct = blocks.groupBy("h", "g", "block").agg(F.count(F.lit(1)).alias("_n"))  # equal blocks are combined before they travel
    return materialise(distinct.sortWithinPartitions("h", "g", "block").select("h", "g", F.monotonically_increasing_id().alias("name")))


def identities(texts: DataFrame, block_chars: int = BLOCK_CHARS, seed: int = 0) -> DataFrame:
    """``(doc_id, norm)`` to ``_row, doc_id, text_sha256, n_blocks, name``; equal texts share ``(n_blocks, name)`` and no others do."""
    names = block_names(texts, block_chars, seed)
    while not names.groupBy("h", "g").count().filter("count > 1").isEmpty():
        seed += 2
        names = block_names(texts, block_chars, seed)
    keys = F.transform(_blocks(F.col("norm"), block_chars), lambda b: _hash(b, seed))
    rows = materialise(texts.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.sha2("norm", 256).alias("text_sha256"), keys.alias("_k")))
    level = rows.select("_row", F.size("_k").alias("n_blocks"), F.posexplode("_k").alias("pos", "k")).select("_row", "n_blocks", F.col("n_blocks").alias("left"), "pos", "k.h", "k.g")
    level = materialise(level.join(names, ["h", "g"]).drop("h", "g"))
    done = level.filter("left = 1").select("_row", "n_blocks", "name")
    most = level.agg(F.max("left")).first()[0] or 0
    while most > 1:
        pairs = (
            level.filter("left > 1")
            .groupBy("_row", "n_blocks", F.ceil(F.col("left") / 2).cast("int").alias("left"), (F.col("pos") / 2).cast("int").alias("pos"))
            .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"))
        )
        names = _named(pairs, ["a", "b"])
        level = materialise(pairs.join(names, ["a", "b"]).select("_row", "n_blocks", "left", "pos", "name"))
        done = done.unionByName(level.filter("left = 1").select("_row", "n_blocks", "name"))
        most = (most + 1) // 2
    return materialise(rows.drop("_k").join(done, "_row"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    named = identities(docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm")), block_chars)
    groups = named.groupBy("n_blocks", "name").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("_k"), F.count(F.lit(1)).alias("n"))
    groups = materialise(groups.filter("n > 1"))  # a document without equals needs no partner
    few = groups.count() <= BROADCAST_ROWS // 4  # wider than a key
    out = named.join(F.broadcast(groups) if few else groups, ["n_blocks", "name"], "left")
    alone = F.col("n").isNull()
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("_k.doc_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), (alone | (F.col("_row") == F.col("_k._row"))).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each text, all columns kept; ids may be repeated or null."""
    judged = exact_dedup(docs, id_col, text_col).filter("group_size > 1").select(F.struct(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha")), "kept")
    return without_copies(docs, F.struct(F.col(id_col).alias("id"), F.sha2(normalised(F.col(text_col)), 256).alias("sha")), judged)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE_OP6 = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
