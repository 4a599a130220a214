"""Filter interaction audit by Walsh-Hadamard sums.

Five filters give a document a mask of failures, one of 32.  For each part of the corpus and each
class of documents (all, good, toxic) 32 signed parity sums are aggregated, ``sum((-1)**|mask & w|)``;
they add up over tasks, so a part of any size travels as 96 numbers a task.  The transform is its own
inverse up to a factor of 32, so the counts of all masks follow exactly, and from them every order
of the filters.  A document that fails *k* filters is removed by each of them in ``120 / k`` of the
120 orders, which gives the Shapley value in closed form.

Filters: A fewer than 100 words; B ``100 * distinct < 80 * words``; C more than a tenth of the code
points are A-Z; D holds any of ``#$%&*|``; E equals the text of a smaller ``doc_id``.  Texts are found
equal by their SHA-256.

Defined results: a null text counts as empty, a null or empty ``lang`` is the part ``''``; a null
``doc_id`` is neither smaller nor larger than any other, so it never fails E and makes none fail, and
has no label; rows that repeat an id and a text do not fail E through each other; a document is good
or toxic if any of its labels says so; an empty table gives no rows; other columns are ignored
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import BROADCAST_ROWS, byte_windows, frugal, materialise, table

FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
ORDERS = ["".join(x) for x in permutations(FILTERS)]
MIN_WORDS = 100
#: Limits in hundredths.
MIN_DISTINCT, MAX_CAPITALS = 80, 10
#: Characters of filter D.
SYMBOLS = b"#$%&*|"
CLASSES = ("all", "good", "toxic")

_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_CONTINUED = bytes(range(0x80, 0xC0))


def text_mask(text: bytes | None) -> int:
    """The failures of A to D, A in the lowest bit; a very long text is split into words in windows."""
    data, words, distinct = text or b"", 0, set()
    for window in byte_windows(data):
        found = window.split()
        words += len(found)
        distinct.update(found)
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    points = len(data.translate(None, _CONTINUED))
    fails = (words < MIN_WORDS, 100 * len(distinct) < MIN_DISTINCT * words, 100 * capitals > MAX_CAPITALS * points, len(data.translate(None, SYMBOLS)) < len(data))
    return sum(x << i for i, x in enumerate(fails))


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``part, mask, good, toxic`` of every row of ``docs``; texts do not travel, only their digests."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() for x in batch.column(2)]
            mask, sha = [text_mask(x) for x in texts], [hashlib.sha256(x or b"").digest() for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(mask, pa.int32()), pa.array(sha, pa.binary())], ["doc_id", "part", "mask", "sha"])

    read = materialise(rows.mapInArrow(frugal(run), f"doc_id {kind}, part string, mask int, sha binary"))
    copied = materialise(read.groupBy("sha").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    small = copied.count() <= BROADCAST_ROWS // 4  # wider than a key
    failing = read.join(F.broadcast(copied) if small else copied, "sha", "left").withColumn("mask", F.col("mask") + F.when(F.col("doc_id") > F.col("least"), 16).otherwise(0))
    known = labels.select(F.col("doc_id").alias("id"), (F.col("quality") == 1).cast("int").alias("q"), (F.col("toxic") == 1).cast("int").alias("t")).groupBy("id").agg(F.max("q").alias("q"), F.max("t").alias("t"))
    return failing.join(known, failing["doc_id"] == known["id"], "left").select("part", "mask", F.coalesce("q", F.lit(0)).alias("good"), F.coalesce("t", F.lit(0)).alias("toxic"))


def _sign(mask: Column, w: Column) -> Column:
    return 1 - 2 * F.bit_count(mask.bitwiseAND(w)).bitwiseAND(F.lit(1))


def parity_sums(marked: DataFrame) -> DataFrame:
    """``part`` and, for each class, the array of its 32 signed parity sums."""
    weight = {"all": F.lit(1), "good": F.col("good"), "toxic": F.col("toxic")}
    sums = [F.sum((_sign(F.col("mask"), F.lit(w)) * weight[c]).cast("long")).alias(f"{c}_{w}") for c in CLASSES for w in range(CELLS)]
    return marked.groupBy("part").agg(*sums).select("part", *[F.array(*[f"{c}_{w}" for w in range(CELLS)]).alias(c) for c in CLASSES])


def invert(sums: Column) -> Column:
    """The counts of the 32 masks, exactly."""
    every = F.sequence(F.lit(0), F.lit(CELLS - 1))
    total = lambda m: F.aggregate(every, F.lit(0).cast("long"), lambda s, w: s + F.get(sums, w) * _sign(m, w))
    return F.transform(every, lambda m: F.shiftright(total(m), 5))


def _summed(cells: Column, held: Column | None = None, none: Column | None = None, some: Column | None = None) -> Column:
    """The sum of the cells whose mask holds ``held``, holds nothing of ``none`` and something of ``some``."""

    def counts(m: Column) -> Column:
        tests = [m.bitwiseAND(held) != 0] if held is not None else []
        tests += [m.bitwiseAND(none) == 0] if none is not None else []
        tests += [m.bitwiseAND(some) != 0] if some is not None else []
        met = tests[0]
        for t in tests[1:]:
            met = met & t
        return met

    return F.aggregate(F.filter(F.sequence(F.lit(0), F.lit(CELLS - 1)), counts), F.lit(0).cast("long"), lambda s, m: s + F.get(cells, m))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step; see the module for the columns' rules."""
    sums = materialise(parity_sums(masks(docs, labels, id_col, text_col, part_col)))
    cells = materialise(sums.select("part", *[invert(F.col(c)).alias(c) for c in CLASSES]))
    steps = cells.select("*", F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = lambda letter: F.lit(1 << FILTERS.index(letter))
    here = F.substring("filter_order", F.col("step"), F.lit(1))
    own = F.coalesce(*[F.when(here == x, bit(x)) for x in FILTERS])
    before = sum((F.when(F.instr(F.col("filter_order"), x) < F.col("step"), bit(x)).otherwise(0) for x in FILTERS), F.lit(0))
    steps = steps.withColumn("own", own).withColumn("before", before)
    own, before = F.col("own"), F.col("before")
    share = F.aggregate(
        F.filter(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda m: m.bitwiseAND(own) != 0),
        F.lit(0).cast("long"),
        lambda s, m: s + F.get(F.col("all"), m) * F.get(F.array(*[F.lit(len(ORDERS) // max(1, k)) for k in range(len(FILTERS) + 1)]), F.bit_count(m)),
    )
    return steps.select(
        "part",
        "filter_order",
        "step",
        _summed(F.col("all"), none=before.bitwiseOR(own)).alias("kept"),
        _summed(F.col("all"), held=own, none=before).alias("removed"),
        _summed(F.col("all"), held=own, some=before).alias("redundant"),
        F.get(F.col("all"), own).alias("unique_fails"),
        _summed(F.col("good"), held=own, none=before).alias("good_lost"),
        _summed(F.col("toxic"), held=own, none=before).alias("toxic_lost"),
        share.alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        len(ws) < 100 AS fa, 100 * len(list_distinct(ws)) < 80 * len(ws) AS fb,
        100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS fc,
        regexp_matches(t, '[#$%&*|]') AS fd, coalesce(w.doc_id > least, false) AS fe
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
x AS (SELECT part, good, toxic, map {'A': fa, 'B': fb, 'C': fc, 'D': fd, 'E': fe} AS fails, fa::INT + fb::INT + fc::INT + fd::INT + fe::INT AS k,
        count(*) AS n FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM f a, f b, f c, f d, f e
      WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o),
e AS (SELECT part, filter_order, step, n, k, good, toxic, fails[substr(filter_order, step, 1)] AS own,
        len(list_filter(range(1, step), lambda i: fails[substr(filter_order, i, 1)])) > 0 AS gone
      FROM x, s)
SELECT part, filter_order, step::INT AS step,
  coalesce(sum(n) FILTER (NOT own AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (own AND NOT gone), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (own AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (own AND k = 1), 0)::BIGINT AS unique_fails,
  coalesce(sum(n * good) FILTER (own AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(n * toxic) FILTER (own AND NOT gone), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * 120 // greatest(k, 1)) FILTER (own), 0)::BIGINT AS shapley
FROM e GROUP BY ALL
"""
