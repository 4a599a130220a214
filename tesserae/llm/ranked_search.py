"""Ranked lexical search: document-at-a-time over compressed postings, shard by shard.

* Index.  Every task cuts its documents into shards of a bounded number of postings; texts do not
  travel.  Within a shard documents are numbered in the order of their ids.  A term's postings are
  its documents (differences) and its occurrences in each as variable-length integers; one more row
  of the shard holds the ids and lengths of its documents.  The index is written as a table.
* Search.  Postings of the queries' terms are joined with the queries that hold the term, so a shard
  gets only what is asked for.  Queries come in blocks of a bounded number, and a task answers
  a block on a shard: a heap merges the postings of a query's terms in document order, each
  document's score is complete when its number leaves the heap, and a bounded heap keeps the best
  by score, then by id.  The shards' answers are merged by rank.

A document of ``n`` terms scores ``sum(w * (1000000000 * tf // (1000 * tf + 20 * m)))`` over the query's
distinct terms, with ``m = 50 + 50 * n * N // L`` and ``w = floor(1000 * ln((2 * N + 2) / (2 * df + 1)))``.

Terms are maximal runs of ASCII letters, digits and all characters beyond ASCII; only A-Z are
lower-cased.  Defined results: a null text has no term; a document without terms counts nowhere;
query rows that share an id (null is one) are one query; a query without terms gives no rows; rows
that repeat a ``doc_id`` are documents of their own and a null ``doc_id`` sorts after all others; empty
tables give no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heappushpop, heapreplace
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm.common import BROADCAST_ROWS, byte_windows, frugal, materialise, semi_join, table

#: Documents that a query gets.
TOP = 50
#: Postings of a shard; more only where one document holds more.
SHARD_POSTINGS = 1 << 21
#: Queries that are answered together on a shard.
BLOCK_QUERIES = 256
#: Pairs of a shard and a block of queries that a task answers.
TASK_SHARDS = 2
#: Bits of a contribution in a merged number; the rest is the document's number in its shard.
SCORE_BITS = 36

_KEPT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_counts(text: bytes | None) -> Counter:
    """Each term of a UTF-8 text with its occurrences; a very long text is split in windows."""
    found: Counter = Counter()
    for window in byte_windows((text or b"").translate(_KEPT)):
        found.update(window.split())
    return found


def packed(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Non-negative integers in groups of seven bits, lowest first, the last one with its high bit set; and where each ends."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    for k in range(1, 9):
        sizes += values >> np.uint64(7 * k) > 0
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(sizes.max(initial=0))):
        at = sizes > k
        byte = (values[at] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8)
        out[ends[at] - sizes[at] + k] = byte | (sizes[at] == k + 1).astype(np.uint8) << 7
    return out.tobytes(), ends


def unpacked(data: bytes) -> np.ndarray:
    """What :func:`packed` made."""
    x = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(x & 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    place = (np.arange(len(x)) - np.repeat(starts, ends - starts + 1)) * 7
    return np.add.reduceat((x & 127).astype(np.int64) << place, starts) if len(ends) else np.zeros(0, np.int64)


class Shard:
    """Documents of a shard while they are read."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.ids: list = []
        self.lengths: list[int] = []
        self.codes: list[np.ndarray] = []
        self.tfs: list[np.ndarray] = []
        self.postings = 0

    def add(self, doc_id: int | None, counts: Counter) -> None:
        number = self.numbers
        self.codes.append(np.fromiter((number.setdefault(t, len(number)) for t in counts), np.int32, len(counts)))
        self.tfs.append(np.fromiter(counts.values(), np.int64, len(counts)))
        self.ids.append(doc_id)
        self.lengths.append(int(self.tfs[-1].sum()))
        self.postings += len(counts)

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        """``shard, term, df, total, data``: first the documents (no term), then each term's postings."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        lengths = np.array(self.lengths, np.int64)[order]
        known = [self.ids[i] for i in order if self.ids[i] is not None]
        data = np.array([len(known)], "<i8").tobytes() + np.array(known, "<i8").tobytes() + packed(lengths)[0]
        yield self._batch(shard, [None], [len(order)], [int(lengths.sum())], [data])
        document = np.repeat(place, [len(c) for c in self.codes])
        code, tf = np.concatenate(self.codes), np.concatenate(self.tfs)
        at = np.lexsort((document, code))
        code, document, tf = code[at], document[at], tf[at]
        first = np.concatenate([[True], code[1:] != code[:-1]])
        gap = np.where(first, document, np.diff(document, prepend=0))
        both, ends = packed(np.stack([gap, tf], 1).ravel())
        starts = np.flatnonzero(first)
        stops = np.append(starts[1:], len(code))
        cut = np.concatenate([[0], ends[2 * stops - 1]]).tolist()
        terms, df = list(self.numbers), stops - starts
        for x in range(0, len(starts), 4096):
            own = range(x, min(len(starts), x + 4096))
            yield self._batch(shard, [terms[code[starts[i]]] for i in own], df[x : x + 4096].tolist(), [None] * len(own), [both[cut[i] : cut[i + 1]] for i in own])

    @staticmethod
    def _batch(shard: int, terms: list, df: list, total: list, data: list) -> pa.RecordBatch:
        columns = [pa.array([shard] * len(terms), pa.int64()), pa.array(terms, pa.binary()), pa.array(df, pa.int64()), pa.array(total, pa.int64()), pa.array(data, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["shard", "term", "df", "total", "data"])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", postings: int = SHARD_POSTINGS) -> DataFrame:
    """``shard, term, df, total, data`` of all documents, as a written table; a row without a term describes a shard's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, n = Shard(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if counts := term_counts(text.as_py()):
                    shard.add(doc_id, counts)
                if shard.postings >= postings:
                    yield from shard.rows(n)
                    shard, n = Shard(), n + 1
        if shard.postings:
            yield from shard.rows(n)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return materialise(rows.mapInArrow(frugal(run), "shard long, term binary, df long, total long, data binary"))


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item_id, term``: the distinct terms of each query."""
    rows = queries.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(term_counts(x.as_py())) for x in batch.column(1)]
            own = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), pa.array([t for x in found for t in x], pa.binary())], ["item_id", "term"])

    return rows.mapInArrow(run, f"item_id {kind}, term binary").distinct()


def best(lists: list[np.ndarray], ids: list[int | None], top: int) -> list[tuple[int, int]]:
    """``(score, document)`` of the ``top`` documents, by a heap over lists of ``document << SCORE_BITS | contribution``.

    Documents are numbered in the order of their ids, so of equal scores the earlier number wins.
    """
    cursors = [iter(x.tolist()) for x in lists if len(x)]
    heap = [(next(c), i) for i, c in enumerate(cursors)]
    heapify(heap)
    steps = [c.__next__ for c in cursors]
    low, kept, now, score = (1 << SCORE_BITS) - 1, [], -1, 0
    while heap:
        x, i = heap[0]
        document = x >> SCORE_BITS
        if document != now:
            if score and (len(kept) < top or (score, -now) > kept[0]):
                (heappush if len(kept) < top else heappushpop)(kept, (score, -now))
            now, score = document, 0
        score += x & low
        try:
            heapreplace(heap, (steps[i](), i))
        except StopIteration:
            heappop(heap)
    if score and (len(kept) < top or (score, -now) > kept[0]):
        (heappush if len(kept) < top else heappushpop)(kept, (score, -now))
    return [(s, -d) for s, d in kept]


def contributions(data: bytes, w: int, m: np.ndarray) -> np.ndarray:
    """A term's postings as ``document << SCORE_BITS | contribution``; ``m`` by document."""
    both = unpacked(data)
    document, tf = np.cumsum(both[::2]), both[1::2]
    part = w * (1_000_000_000 * tf // (1000 * tf + 20 * m[document]))
    kept = part > 0
    return document[kept] << SCORE_BITS | part[kept]


def search(index: DataFrame, queries: DataFrame, id_col: str = "item_id", text_col: str = "text", top: int = TOP, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of each query, all with a score above 0 where there are fewer."""
    shards = index.filter("term IS NULL")
    n_docs, n_terms = shards.agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    asked = materialise(query_terms(queries, id_col, text_col))
    kind = asked.schema["item_id"].dataType.simpleString()
    blocks = max(1, ceil(asked.select("item_id").distinct().count() / block_queries))
    terms = asked.select("term").distinct()
    postings = semi_join(index.filter("term IS NOT NULL"), terms, ["term"])
    weights = postings.groupBy("term").agg(F.sum("df").alias("df")).select("term", F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).alias("w")).filter("w > 0")
    holders = asked.join(weights, "term").withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
    holders = materialise(holders.groupBy("term", "block", "w").agg(F.collect_list(F.struct("item_id")).alias("items")))  # no more than a block holds
    few = holders.count() <= BROADCAST_ROWS // 16 and blocks == 1
    hits = index.join(F.broadcast(holders) if few else holders, "term").select("shard", "block", "w", F.transform("items", lambda x: x["item_id"]).alias("items"), "data")
    sizes = shards.select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(-1).cast("long").alias("w"), F.lit(None).cast(f"array<{kind}>").alias("items"), "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer() -> pa.RecordBatch:
            rows = [(item, *((ids[d] if d < len(ids) else None), s)) for item, lists in held.items() for s, d in best(lists, ids, top)]
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], item_kind), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["item_id", "doc_id", "score"])

        now, held, ids, m, item_kind = None, {}, [], None, pa.int64()
        for batch in batches:
            item_kind = batch.schema.field("items").type.value_type
            for shard, block, w, items, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (shard, block) != now:
                    if held:
                        yield answer()
                    now, held = (shard, block), {}
                    n = int.from_bytes(data[:8], "little")  # the shard's documents come first
                    ids = np.frombuffer(data, "<i8", n, 8).tolist()
                    m = 50 + 50 * unpacked(data[8 + 8 * n :]) * n_docs // n_terms
                    continue
                found = contributions(data, w, m)
                for item in items:
                    held.setdefault(item, []).append(found)
        if held:
            yield answer()

    tasks = max(1, shards.count() * blocks // TASK_SHARDS)  # searching costs more than its bytes tell
    together = hits.unionByName(sizes).repartition(tasks, "shard", "block").sortWithinPartitions("shard", "block", "w")
    found = together.mapInArrow(frugal(run), f"item_id {kind}, doc_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())))
    return ranked.filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


ORACLE_OP13 = r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM n),
m AS (SELECT doc_id, 50 + (50 * n * docs) // terms AS m FROM n, c),
t AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM t GROUP BY 1), c),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
      FROM q JOIN t USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY 1, 2)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 50
"""
