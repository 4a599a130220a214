"""SimHash near-dedup: an inverted index over byte positions with count filtering.

A text's fingerprint has bit *b* set when more than half of its three-word shingles, repeats
included, have it set in their XXH64.  Fingerprints are linked when they differ in at most three of
64 bits; then at most three of their eight bytes differ, so linked ones share at least five bytes in
place.  Equal fingerprints are one node.

* Index.  A list holds the fingerprints that share the bytes at given positions.  Of a pair that
  shares five positions, the first ``m`` shared ones lie among the first ``3 + m``, so it meets in
  one of the ``C(3 + m, m)`` lists that each of the two is in.  ``m`` follows from the counted
  fingerprints, such that a fingerprint meets a bounded number of others by chance.
* Tally.  Within a list the shared bytes of each pair are counted, pairs with at least five are
  kept, and their differing bits are counted.  A list is one run of a sorted partition; what leaves
  the task is a spanning forest of its links, never its pairs.
* A list of more than ``most`` fingerprints is dealt again by one more shared position.  Lists that
  are too long even at five positions are answered by probing instead: two fingerprints differ in at
  most three bits exactly if some value is at most one bit from one of them and at most two from the
  other.  That takes 2,081 rows a fingerprint, however long the list is.
* Components are found over links, and named by their smallest ``doc_id``.

Defined results: a null, empty or blank text has fingerprint zero, which is linked like any other;
fewer than three words are one shingle; rows with a null ``doc_id`` are returned and take part in
links, but name no component (one of such rows alone has a null ``component_id``); repeated rows are
returned each; an empty table gives no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tesserae.llm.common import BROADCAST_ROWS, byte_windows, frugal, materialise, semi_join, table
from tesserae.llm.minhash_join import components

WORDS = 3
SEED = 42
MAX_BITS = 3
#: Bytes that fingerprints of at most ``MAX_BITS`` differing bits share at least.
LEAST_SHARED = 8 - MAX_BITS
#: Fingerprints of a list that one task compares.
LIST_MOST = 32_768
#: Fingerprints that another one meets by chance, at most, in all its lists.
MET_BY_CHANCE = 64
#: Rows compared at once, beyond the list that is being read.
TASK_ROWS = 100_000


def shingle_hashes(words: list[bytes]) -> list[int]:
    """XXH64 of each run of three words joined by a space."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[: 1 - WORDS].tolist(), ends[WORDS - 1 :].tolist(), strict=True)]


def fingerprint(text: bytes | None) -> int:
    """The 64-bit SimHash of a UTF-8 text, read in windows."""
    ones, n, held = np.zeros(64, np.int64), 0, []
    for window in byte_windows((text or b"").lower()):  # of bytes, only A-Z have a lower case
        held += window.split()
        if len(held) >= WORDS:
            hashes = np.array(shingle_hashes(held), "<u8")
            ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            n += len(hashes)
            held = held[1 - WORDS :]
    if not n:
        return xxh64_intdigest(b" ".join(held), SEED) if held else 0
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` of every row; the 64 bits are held in a long.  Nothing is shuffled."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return rows.mapInArrow(frugal(run), f"doc_id {kind}, fp long")


def positions(n: int, chance: int = MET_BY_CHANCE) -> int:
    """How many shared positions make a list, for ``n`` different fingerprints."""
    return next((m for m in range(2, LEAST_SHARED) if comb(MAX_BITS + m, m) * n <= 2 * chance * 256**m), LEAST_SHARED)


def deeper(lists: DataFrame, level: int) -> DataFrame:
    """``key, fp`` of lists of ``level`` positions to those of one more; a key holds positions (8 bits) and their bytes (40 bits).

    The next shared position comes after the last one, and before the ``LEAST_SHARED - 1 - level`` that must follow.
    """
    mask = F.shiftrightunsigned("key", 40)

    def child(p: Column) -> Column:
        byte = F.call_function("shiftrightunsigned", F.col("fp"), 8 * p).bitwiseAND(F.lit(255))
        return F.col("key") + F.call_function("shiftleft", F.lit(1).cast("long"), 40 + p) + F.shiftleft(byte, 8 * level)

    later = F.filter(F.sequence(F.lit(0), F.lit(MAX_BITS + level)), lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), p) > mask)
    return lists.select(F.explode(F.transform(later, child)).alias("key"), "fp")


def _unite(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Gives rows that hang together the smallest of their labels; labels are roots before and after."""
    while len(i):
        a, b = labels[i], labels[j]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels[:] = up
        apart = labels[i] != labels[j]
        i, j = i[apart], j[apart]


def forest(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges over the links within each run of equal ``keys`` (sorted).  ``fps`` are unsigned."""
    labels, n, low = np.arange(len(keys)), len(keys), np.uint64(0x0101010101010101)
    at, step = np.arange(n), 0
    while True:
        step += 1
        at = at[at + step < n]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            break
        x = fps[at] ^ fps[at + step]
        y = x | x >> np.uint64(4)
        y |= y >> np.uint64(2)
        y |= y >> np.uint64(1)
        shared = 8 - np.bitwise_count(y & low)  # the tally of the pair: a byte that differs has a bit left at its lowest place
        kept = shared >= LEAST_SHARED
        i = at[kept][np.bitwise_count(x[kept]) <= MAX_BITS]
        i = i[labels[i] != labels[i + step]]
        _unite(labels, i, i + step)
    hung = np.flatnonzero(labels != np.arange(n))
    return fps[hung], fps[labels[hung]]


def compare(lists: DataFrame) -> DataFrame:
    """``u, v``: a spanning forest of the links within each list; no list is longer than a task may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            u, v = forest(k, f)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        keys, fps, held, n = [], [], None, 0
        for batch in batches:
            keys.append(batch.column(0).to_numpy())
            fps.append(batch.column(1).to_numpy().view(np.uint64))
            n += batch.num_rows
            if n < TASK_ROWS:
                continue
            k, f = np.concatenate(keys), np.concatenate(fps)
            held = int(np.searchsorted(k, k[-1]))  # the last list may go on
            if held:
                yield answer(k[:held], f[:held])
            keys, fps, n = [k[held:]], [f[held:]], len(k) - held
        if n:
            yield answer(np.concatenate(keys), np.concatenate(fps))

    return lists.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(frugal(run), "u long, v long")


def probe(fps: DataFrame) -> DataFrame:
    """``u, v`` that connect what is linked among ``fps``, by the values at most two bits away from each."""
    flips = [0] + [1 << i for i in range(64)] + [1 << i | 1 << j for i, j in combinations(range(64), 2)]
    signed = ", ".join(f"{x - (x >> 63 << 64)}L" if x != 1 << 63 else "-9223372036854775807L - 1L" for x in flips)
    near = fps.select("fp", F.explode(F.expr(f"array({signed})")).alias("x")).select(F.col("fp").bitwiseXOR(F.col("x")).alias("near"), F.bit_count("x").alias("bits"), "fp")
    met = near.groupBy("near").agg(F.min(F.struct("bits", "fp")).alias("c"), F.collect_list("fp").alias("fps")).filter("c.bits <= 1 AND size(fps) > 1")  # at most 2,081 fingerprints are so near to a value
    return met.select(F.explode("fps").alias("u"), F.col("c.fp").alias("v")).filter("u <> v").distinct()


def links(nodes: DataFrame, most: int = LIST_MOST, chance: int = MET_BY_CHANCE) -> DataFrame:
    """``u, v`` over which the distinct ``fp`` of ``nodes`` hang together."""
    level, lists, found = positions(nodes.count(), chance), nodes.select(F.lit(0).cast("long").alias("key"), "fp"), []
    for depth in range(level):
        lists = deeper(lists, depth)
    while True:
        long = materialise(lists.groupBy("key").count().filter(F.col("count") > most).select("key"))
        n = long.count()
        short = lists.join(F.broadcast(long) if n <= BROADCAST_ROWS else long, "key", "left_anti") if n else lists
        found.append(materialise(compare(short)))
        if not n:
            break
        lists = materialise(semi_join(lists, long, ["key"], n))
        if level == LEAST_SHARED:
            found.append(probe(lists.select("fp").distinct()))
            break
        lists, level = deeper(lists, level), level + 1
    return reduce(DataFrame.unionByName, found).distinct()


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = LIST_MOST, chance: int = MET_BY_CHANCE) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``."""
    rows = materialise(fingerprints(docs, id_col, text_col))
    nodes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    hung = materialise(nodes.join(components(links(nodes.select("fp"), most, chance)).withColumnRenamed("u", "fp"), "fp", "left").filter("n > 1 OR root IS NOT NULL").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    named = materialise(hung.join(hung.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id", F.lit(True).alias("hung")))
    out = rows.join(F.broadcast(named) if named.count() <= BROADCAST_ROWS else named, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("hung"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))
