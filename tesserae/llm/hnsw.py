"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard.

Distinct vectors are dealt by hash into shards of about ``shard_rows`` vectors.  A task builds a
shard's graph in numpy: levels drawn from a seeded hash, neighbours chosen by the diversity rule,
and for every level one flat int32 array (row = node, -1 = no neighbour).  The graphs are written
as rows of a table in the shared folder, so a lost executor costs no rebuild.  The stated queries,
in blocks, meet every shard's graph; each shard gives its best, and the best of all are kept.

Copies of a vector are one node.  Of its ids only the smallest ``k + 1`` can ever be reported, so
they alone are kept with it: ties go to smaller ids exactly, however many copies there are.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part,
neither as query nor as candidate; vectors of different lengths never meet; repeated rows (same id,
same vector) count once; a query never finds rows with its own id; an empty table gives no rows;
other columns are ignored whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm.common import BROADCAST_ROWS, frugal, materialise, table

K, M, EF_BUILD, EF_SEARCH, SHARD_ROWS, QUERY_BLOCK, EVERY = 5, 16, 64, 128, 8192, 1024, 50


class Graph:
    """HNSW over unit vectors by inner product.  ``flat[level]`` is an int32 array (nodes, width)."""

    def __init__(self, unit: np.ndarray, m: int = M, ef: int = EF_BUILD, seed: int = 1):
        self.unit, self.m, n = unit, m, len(unit)
        draws = np.random.default_rng(seed).random(n)
        self.level = np.minimum((-np.log(np.maximum(draws, 1e-12)) / np.log(m)).astype(np.int32), 12)
        self.flat = [np.full((n, m * (2 if lv == 0 else 1)), -1, np.int32) for lv in range(int(self.level.max(initial=0)) + 1)]
        self.degree = [np.zeros(n, np.int32) for _ in self.flat]
        self.seen, self.stamp, self.entry = np.zeros(n, np.int64), 0, -1
        for i in range(n):
            self._insert(i, ef)

    def _search(self, q: np.ndarray, starts: list[int], ef: int, lv: int) -> list[tuple[float, int]]:
        """The ``ef`` best nodes found from ``starts`` as (similarity, node), best first."""
        self.stamp += 1
        seen, stamp, flat, degree, unit = self.seen, self.stamp, self.flat[lv], self.degree[lv], self.unit
        seen[starts] = stamp
        sims = unit[starts] @ q
        todo = [(-float(s), x) for s, x in zip(sims, starts, strict=True)]
        heapq.heapify(todo)
        best = [(-s, x) for s, x in todo]
        heapq.heapify(best)
        while len(best) > ef:
            heapq.heappop(best)
        while todo:
            s, x = heapq.heappop(todo)
            if len(best) >= ef and -s < best[0][0]:
                break
            near = flat[x, : degree[x]]
            near = near[seen[near] != stamp]
            if not len(near):
                continue
            seen[near] = stamp
            sims = unit[near] @ q
            if len(best) >= ef:
                good = sims > best[0][0]
                near, sims = near[good], sims[good]
            for v, y in zip(sims.tolist(), near.tolist(), strict=True):
                if len(best) < ef:
                    heapq.heappush(best, (v, y))
                elif v > best[0][0]:
                    heapq.heapreplace(best, (v, y))
                else:
                    continue
                heapq.heappush(todo, (-v, y))
        return sorted(best, key=lambda p: (-p[0], p[1]))

    def _diverse(self, sims: np.ndarray, nodes: np.ndarray, most: int) -> np.ndarray:
        """Nodes, best first, that are nearer to the centre than to any kept one; filled up with the best others."""
        if len(nodes) <= most:
            return nodes
        between = self.unit[nodes] @ self.unit[nodes].T
        kept: list[int] = []
        hidden = np.zeros(len(nodes), bool)
        for i in range(len(nodes)):
            if not hidden[i]:
                kept.append(i)
                if len(kept) == most:
                    break
                hidden |= between[i] > sims
        if len(kept) < most:
            chosen = set(kept)
            kept += [i for i in range(len(nodes)) if i not in chosen][: most - len(kept)]
        return nodes[kept]

    def _insert(self, i: int, ef: int) -> None:
        top = int(self.level[i])
        if self.entry < 0:
            self.entry = i
            return
        q, starts, highest = self.unit[i], [self.entry], int(self.level[self.entry])
        for lv in range(highest, top, -1):
            starts = [self._search(q, starts, 1, lv)[0][1]]
        for lv in range(min(top, highest), -1, -1):
            found = self._search(q, starts, ef, lv)
            starts = [x for _, x in found]
            sims, nodes = np.array([s for s, _ in found], np.float32), np.array(starts, np.int32)
            flat, degree, width = self.flat[lv], self.degree[lv], self.flat[lv].shape[1]
            mine = self._diverse(sims, nodes, self.m)
            flat[i, : len(mine)] = mine
            degree[i] = len(mine)
            for x in mine.tolist():
                d = degree[x]
                if d < width:
                    flat[x, d] = i
                    degree[x] = d + 1
                else:
                    around = np.append(flat[x], np.int32(i))
                    s = self.unit[around] @ self.unit[x]
                    order = np.argsort(-s, kind="stable")
                    kept = self._diverse(s[order], around[order], width)
                    flat[x, : len(kept)] = kept
                    flat[x, len(kept) :] = -1
                    degree[x] = len(kept)
        if top > highest:
            self.entry = i

    def search(self, q: np.ndarray, k: int, ef: int = EF_SEARCH) -> list[int]:
        if self.entry < 0:
            return []
        starts = [self.entry]
        for lv in range(len(self.flat) - 1, 0, -1):
            starts = [self._search(q, starts, 1, lv)[0][1]]
        return [x for _, x in self._search(q, starts, max(ef, k), 0)][:k]

    def dump(self) -> dict:
        return {"n": len(self.unit), "entry": self.entry, "widths": [f.shape[1] for f in self.flat], "flat": np.concatenate([f.ravel() for f in self.flat]).tobytes()}

    @classmethod
    def load(cls, unit: np.ndarray, row: dict) -> Graph:
        self = cls.__new__(cls)
        self.unit, self.entry, n = unit, row["entry"], row["n"]
        data, at, self.flat = np.frombuffer(row["flat"], np.int32), 0, []
        for w in row["widths"]:
            self.flat.append(data[at : at + n * w].reshape(n, w))
            at += n * w
        self.degree = [(f >= 0).sum(1).astype(np.int32) for f in self.flat]
        self.seen, self.stamp = np.zeros(n, np.int64), 0
        return self


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def _units(vectors: np.ndarray) -> np.ndarray:
    """Float32 unit vectors, scaled first so that squares neither overflow nor vanish."""
    v = vectors / np.abs(vectors).max(1, keepdims=True)
    return (v / np.sqrt((v * v).sum(1, keepdims=True))).astype(np.float32)


def cosine(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosines of ``q`` and the rows of ``v`` in double precision."""
    return (v * q).sum(1) / (np.sqrt((q * q).sum()) * np.sqrt((v * v).sum(1)))


def build_index(rows: DataFrame, k: int = K, m: int = M, ef: int = EF_BUILD, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(id, v, dim)`` to one written row per shard: ``dim, shard, n, entry, widths, flat, vectors, ids`` (ids: ``k + 1`` a vector)."""
    # The smallest ids of each distinct vector: Spark applies such a rank limit before it shuffles.
    first = rows.distinct().withColumn("_r", F.row_number().over(Window.partitionBy("dim", "v").orderBy("id"))).filter(F.col("_r") <= k + 1)
    nodes = materialise(first.groupBy("dim", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    dims = nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("_n")).withColumn("_shards", F.ceil(F.col("_n") / shard_rows))
    nodes = nodes.join(dims, "dim").withColumn("shard", F.pmod(F.xxhash64("v"), F.col("_shards")).cast("int")).select("dim", "shard", "v", "ids")

    def build(t: pa.Table) -> pa.Table:
        dim = t.column("dim")[0].as_py()
        order = sorted(range(t.num_rows), key=lambda i, ids=t.column("ids").to_pylist(): ids[i])
        t = t.take(pa.array(order, pa.int64()))
        v = np.array(t.column("v").combine_chunks().flatten(), dtype=np.float64).reshape(-1, dim)
        g = Graph(_units(v), m, ef)
        ids = np.full((len(v), k + 1), np.iinfo(np.int64).min, np.int64)
        for i, x in enumerate(t.column("ids").to_pylist()):
            ids[i, : len(x)] = x
        row = {"dim": dim, "shard": t.column("shard")[0].as_py(), **g.dump(), "vectors": v.tobytes(), "ids": ids.tobytes()}
        return pa.Table.from_pylist([row], schema=pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("n", pa.int32()), ("entry", pa.int32()), ("widths", pa.list_(pa.int32())), ("flat", pa.binary()), ("vectors", pa.binary()), ("ids", pa.binary())]))

    n = nodes.select("dim", "shard").distinct().count()
    built = nodes.repartition(max(1, 2 * n), "dim", "shard").groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, n int, entry int, widths array<int>, flat binary, vectors binary, ids binary")
    return materialise(built)


def search_index(index: DataFrame, queries: DataFrame, k: int = K, ef: int = EF_SEARCH, block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` for ``queries`` (id, v, dim); every block of queries meets every shard of its dimension.

    A shard's graph is shipped once; the blocks of queries that stream past it follow in its partition.
    """
    shards = index.select("dim", "shard")
    n = queries.count()
    blocks = queries.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(max(1, n // block)))).groupBy("dim", "_b").agg(F.collect_list(F.struct("id", "v")).alias("q"))
    n_shards = shards.count()
    asked = blocks.join(F.broadcast(shards) if n_shards <= BROADCAST_ROWS else shards, "dim").select("dim", "shard", "q")
    work = index.unionByName(asked, allowMissingColumns=True).repartition(max(1, n_shards), "dim", "shard").sortWithinPartitions("dim", "shard", F.col("flat").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = None
        for b in batches:
            for row in b.to_pylist():
                if row["flat"] is not None:
                    vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
                    ids = np.frombuffer(row["ids"], np.int64).reshape(len(vectors), -1)
                    graph = Graph.load(_units(vectors), row)
                    continue
                out: list[tuple[int, int, float]] = []
                for q in row["q"]:
                    v = np.array(q["v"], np.float64)
                    nodes = graph.search(_units(v[None])[0], ef, ef)
                    scores = cosine(v, vectors[nodes])
                    found: list[tuple[float, int]] = []
                    for i in np.argsort(-scores, kind="stable").tolist():
                        if len(found) >= k and scores[i] < sorted(found)[k - 1][0] * -1:
                            break
                        found += [(-float(scores[i]), int(x)) for x in ids[nodes[i]] if x != np.iinfo(np.int64).min and x != q["id"]]
                    out += [(q["id"], x, -s) for s, x in sorted(found)[:k]]
                cols = list(zip(*out, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["query_id", "vec_id", "score"])

    found = work.select("dim", "shard", "n", "entry", "widths", "flat", "vectors", "ids", "q").mapInArrow(frugal(run), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, **options) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows by cosine for each row where ``is_query``."""
    rows = vectors.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.size(vector_col).alias("dim"), is_query.alias("_q"))
    queries = rows.filter("_q").select("id", "v", "dim").distinct()
    return search_index(build_index(rows.select("id", "v", "dim"), k, **options), queries, k)


def op5_hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
