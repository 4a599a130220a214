"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

A document is the set of its five-word shingles (words: runs of non-white space, lower-cased; a text
of fewer words is one shingle).  Documents with equal sets are one *node* with a count.

* Forest.  A node has a label of ``max_depth`` MinHash values in each of ``trees`` prefix tries.  A trie
  node at depth *d* is the group of labels that share their first *d* values.  Labels are shuffled once,
  by the shortest prefix that can be needed, and sorted below it: there the groups of all depths are
  runs.  All prefixes begin at
  their full length and are shortened by one value at a time.  At each length the groups propose
  pairs, which are verified; from the exact similarities *s* of the links found, each of which this
  length finds with the known probability ``1 - (1 - s**d)**trees``, follows how many links were
  missed.  Shortening ends when the estimated recall reaches ``recall``; where no link was found, when
  links of just the threshold would be found with that probability.  A threshold for which one value
  is still too long is refused.
* Candidates.  A node is tied to the smallest one of its longest group in which it is not that itself
  (never all pairs): at most one tie a label, which holds for all shorter prefixes too.  The
  connected parts of these ties hold every proposed pair; a node's shingles are shipped for its
  part, not once for each tree, and only for parts that grew since the last length.
* Verification.  Parts are cut into blocks of at most about ``block`` shingles and ``most`` nodes; pairs of
  blocks are compared in numpy by exact intersection counts.  A task holds two blocks and returns,
  per node, how many links it has and the smallest node it hangs together with: no pair is ever
  emitted, and a part that holds a third of all documents is spread over many tasks.
* Classes are the connected components over verified links.

Defined results: texts without words (or null) have no shingles, are in a class of their own and
have no links; rows with a null id are returned with null class; repeated ids with different texts
are different nodes; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm.common import BROADCAST_ROWS, frugal, materialise, read_words, semi_join, table, without_copies

WORDS, THRESHOLD, TREES, MAX_DEPTH, RECALL, SEED = 5, (4, 5), 20, 6, 0.9995, 11
#: Shingles and nodes in a block; a task compares two blocks.
BLOCK_SHINGLES, BLOCK_NODES = 1_500_000, 4096
#: Similarities of links are counted in so many equal steps up to 1.
STEPS = 20


def estimated_recall(bins: list[int], depth: int, threshold: float, trees: int = TREES) -> float:
    """Share of the links that prefixes of ``depth`` find, judged by the similarities of those found (each link stands for 1 / its probability); where none was found, the least that it can be."""
    s = threshold + (1 - threshold) * np.arange(len(bins)) / len(bins)  # the lower edge of each step
    all_links = float((np.array(bins) / (1 - (1 - s**depth) ** trees)).sum())
    return sum(bins) / all_links if all_links else least_recall(threshold, depth, trees)


def least_recall(threshold: float, depth: int, trees: int = TREES) -> float:
    """The probability with which prefixes of ``depth`` find a link of just the threshold's similarity."""
    return 1 - (1 - threshold**depth) ** trees


def shortest_prefix(threshold: float, max_depth: int, recall: float, trees: int = TREES) -> int:
    """The longest prefix that finds links of just the threshold with ``recall``, so that none shorter is needed (an estimate is never lower)."""
    return max([d for d in range(1, max_depth + 1) if least_recall(threshold, d, trees) >= recall], default=1)


_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return text.lower().split()


def shingles(w: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams, from the hashes of the words."""
    if not len(w):
        return w
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = h * _PRIME + w[i : len(w) - k + 1 + i]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.unique(h)


def _multipliers(n: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def signature(sh: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = np.full(len(a), 2**32 - 1, np.uint32)
    x = (sh ^ (sh >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(low, (x[at : at + 512, None] * a + b).min(0), out=low)
    return low


def nodes_of(docs: DataFrame, id_col: str, text_col: str, n: int, trees: int, depth: int) -> DataFrame:
    """``doc_id, node (16 bytes naming the shingle set), n, labels``; nothing is shuffled."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _multipliers(trees * depth)
        for batch in batches:
            node, size, labels = [], [], []
            for _, w in read_words(batch.column(1).to_pylist(), words_of):
                sh = shingles(w, n)
                size.append(len(sh))
                node.append(blake2b(sh.tobytes(), digest_size=16).digest())
                sig = signature(sh, a, b).astype(">u4").tobytes() if len(sh) else b""
                labels.append([sig[i : i + 4 * depth] for i in range(0, len(sig), 4 * depth)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node, pa.binary()), pa.array(size, pa.int64()), pa.array(labels, pa.list_(pa.binary()))], ["doc_id", "node", "n", "labels"])

    return rows.mapInArrow(frugal(run), f"doc_id {kind}, node binary, n long, labels array<binary>")


def forest(nodes: DataFrame, shortest: int, longest: int) -> DataFrame:
    """``u, labels`` to ``u, v, depth``: the ties of the prefix tries, by the longest prefix at which a node ``u`` has a smaller ``v`` beside it.

    The ties of ``depth`` *d* and more connect all groups of labels that share *d* values, for each *d*
    from ``shortest`` to ``longest``.  A hash stands for a prefix: where two meet, nodes are compared that need not be.
    """
    depths = range(shortest, longest + 1)
    value = {d: F.hash(F.substring("label", 4 * d - 3, 4)) for d in depths}
    value[shortest] = F.xxhash64("tree", F.substring("label", 1, 4 * shortest))
    twigs = nodes.select("u", F.posexplode("labels").alias("tree", "label")).select("u", *[value[d].alias(f"k{d}") for d in depths])
    twigs = twigs.repartition(f"k{shortest}")
    for d in reversed(depths):  # the longest first: its order serves the others
        twigs = twigs.withColumn(f"v{d}", F.min("u").over(Window.partitionBy(*[f"k{x}" for x in range(shortest, d + 1)])))
    ties = F.coalesce(*[F.when(F.col(f"v{d}") != F.col("u"), F.struct(F.col(f"v{d}").alias("v"), F.lit(d).alias("depth"))) for d in reversed(depths)])
    return twigs.select("u", ties.alias("tie")).filter("tie IS NOT NULL").select("u", "tie.v", "tie.depth")


def components(edges: DataFrame) -> DataFrame:
    """``(u, v)`` to ``(u, root)``: smallest node of each connected component, for nodes that have an edge.

    A node hangs on its smallest neighbour, and its other ones are tied to that: edges that many nodes have
    alike, as a group's members in every tree, become one, and rounds are made over what is left.
    """
    down = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    down = materialise(down.withColumn("hub", F.min("v").over(Window.partitionBy("u"))))
    hung = down.filter("v = hub").select("u", "hub")
    lower = down.select(F.col("v").alias("u")).distinct()
    ties = down.filter("v <> hub").select("v", F.col("hub").alias("u")).distinct()
    ties = ties.select("u", "v").unionByName(hung.join(lower, "u", "left_semi").select("u", F.col("hub").alias("v")))
    lowest = lower.join(hung, "u", "left_anti").withColumn("hub", F.col("u"))
    roots = _rounds(ties).withColumnRenamed("u", "hub")
    return hung.unionByName(lowest).join(roots, "hub", "left").select("u", F.coalesce("root", "hub").alias("root"))


def _rounds(edges: DataFrame) -> DataFrame:
    """``u, root`` of the nodes of ``edges``.

    Smallest labels are handed over edges, then labels take their own label's label (pointer
    jumping), until nothing changes; each round is written down.
    """
    both = materialise(edges.filter("u <> v").select("u", "v").unionByName(edges.filter("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = materialise(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root")))
    while True:
        heard = both.join(labels.select(F.col("u").alias("v"), F.col("root").alias("r")), "v").groupBy("u").agg(F.min("r").alias("r"))
        told = labels.join(heard, "u").select("u", F.least("root", "r").alias("root"), F.col("root").alias("was"))
        told = materialise(told)
        up = told.select(F.col("u").alias("root"), F.col("root").alias("up"))
        new = materialise(told.join(up, "root").select("u", F.least("root", "up").alias("root"), "was"))
        if new.filter("root <> was").isEmpty():
            return new.select("u", "root")
        labels = new.select("u", "root")


def join_parts(parts: DataFrame | None, edges: DataFrame) -> DataFrame:
    """``u, part``: the connected parts after more ``edges``; what hangs together already is handled as its parts, not edge by edge."""
    if parts is None:
        return materialise(components(edges).select("u", F.col("root").alias("part")))
    ends = edges.join(parts.withColumnRenamed("part", "pu"), "u", "left").join(parts.select(F.col("u").alias("v"), F.col("part").alias("pv")), "v", "left")
    ends = ends.select(F.coalesce("pu", "u").alias("u"), F.coalesce("pv", "v").alias("v")).filter("u <> v").distinct()
    merged = components(ends).select(F.col("u").alias("part"), "root")
    fresh = edges.select("u").unionByName(edges.select(F.col("v").alias("u"))).distinct().join(parts, "u", "left_anti").withColumn("part", F.col("u"))
    return materialise(parts.unionByName(fresh).join(merged, "part", "left").select("u", F.coalesce("root", "part").alias("part")))


def compare(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of ``left`` and ``right`` (None: left itself) are linked, as a boolean matrix, by exact Jaccard; and the links by similarity.

    A shingle that many rows hold is counted by a matrix product, another by its few pairs.
    """
    p, q = threshold
    both = left + (right or [])
    sizes = np.array([len(x) for x in both], np.int64)
    _, column, counts = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(both)), sizes)
    order = np.lexsort((owner, column))
    owner, column = owner[order], column[order]
    nl, lo = len(left), len(left) if right is not None else 0
    nr = len(both) - lo
    inter = np.zeros((nl, nr), np.float32)  # counts are exact below 2**24 shingles a text
    starts = np.cumsum(counts) - counts
    sparse = (counts > 1) & (counts.astype(np.int64) ** 2 * 250 < nl * nr)
    flat = inter.reshape(-1)
    for k in np.unique(counts[sparse]).tolist():
        at = starts[sparse & (counts == k)]
        step = max(1, 1_000_000 // (k * k))
        for x in range(0, len(at), step):
            own = owner[at[x : x + step, None] + np.arange(k)]
            i, j = np.broadcast_arrays(own[:, :, None], own[:, None, :])
            i, j = i.ravel(), j.ravel()
            if right is not None:
                keep = (i < nl) & (j >= lo)
                i, j = i[keep], j[keep] - lo
            np.add.at(flat, i * nr + j, np.float32(1))
    dense = (counts > 1) & ~sparse
    number = np.cumsum(dense) - 1
    held = dense[column]
    owner, column = owner[held], number[column[held]]
    step = max(64, (8 << 20) // len(both))
    for at in range(0, int(dense.sum()), step):
        i, j = np.searchsorted(column, [at, at + step])
        x = np.zeros((len(both), min(step, int(dense.sum()) - at)), np.float32)
        x[owner[i:j], column[i:j] - at] = 1
        inter += x[:nl] @ x[lo:].T
    link, bins = np.zeros((nl, nr), bool), np.zeros(STEPS, np.int64)
    for x in range(0, nl, 256):  # J >= p/q  <=>  (p + q) * inter >= p * (|a| + |b|)
        total = (sizes[x : min(nl, x + 256), None] + sizes[None, lo:]).astype(np.float64)
        part = inter[x : x + 256].astype(np.float64)
        link[x : x + 256] = (p + q) * part >= p * total
        if right is None:
            link[np.arange(x, min(nl, x + 256)), np.arange(x, min(nl, x + 256))] = False
        at = link[x : x + 256]
        j = part[at] / (total[at] - part[at])
        bins += np.bincount(np.clip(((j - p / q) / (1 - p / q) * STEPS).astype(np.int64), 0, STEPS - 1), minlength=STEPS)
    return link, bins // (2 if right is None else 1)


def _local_roots(link: np.ndarray, same: bool) -> np.ndarray:
    """Smallest index (left rows first, then right rows) each row hangs together with inside this pair of blocks."""
    nl, nr = link.shape
    labels = np.arange(nl if same else nl + nr)
    while True:
        new = labels.copy()
        far = labels if same else labels[nl:]
        for i in np.flatnonzero(link.any(1)):
            new[i] = min(new[i], far[link[i]].min())
        if not same:
            for j in np.flatnonzero(link.any(0)):
                new[nl + j] = min(new[nl + j], new[:nl][link[:, j]].min())
        new = np.minimum(new, new[new])
        if (new == labels).all():
            return labels
        labels = new


def verify(members: DataFrame, sets: DataFrame, threshold: tuple[int, int], block: int, most: int = BLOCK_NODES) -> DataFrame:
    """``(part, u, node, n, copies)`` and ``(node, shingles)``, which may be repeated, to ``part, u, root, links, linked_docs, bins``, a few rows per node: one for each pair of blocks it is in.

    The blocks follow from the sizes, so sets are made once; where the members were counted as few, sets are shuffled only by their blocks.
    """
    parts = members.groupBy("part").agg(F.greatest(F.ceil(F.sum("n") / block), F.ceil(F.count(F.lit(1)) / most)).cast("int").alias("blocks"))
    placed = members.join(parts, "part").select("node", "part", "u", "copies", "blocks", F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int").alias("mine"))
    few = members.count() <= BROADCAST_ROWS // 4  # wider than a key
    rows = sets.join(F.broadcast(placed) if few else placed, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("part", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "u", "copies", "shingles")
    rows = rows.repartition("part", "i", "j").sortWithinPartitions("part", "i", "j", "mine", "u")

    def answer(held: list[tuple]) -> pa.RecordBatch:
        i, j = held[0][1:3]
        left, right = [r for r in held if r[3] == i], [r for r in held if r[3] != i]
        same = i == j
        rows, links, docs = left + right, np.zeros(len(held), np.int64), np.zeros(len(held), np.int64)
        roots, bins = np.arange(len(held)), np.zeros(STEPS, np.int64)
        if len(left) > 0 and (same or right):
            link, bins = compare([r[6] for r in left], None if same else [r[6] for r in right], threshold)
            copies = np.array([r[5] for r in rows], np.int64)
            links[: len(left)], docs[: len(left)] = link.sum(1), link @ copies[0 if same else len(left) :]
            if not same:
                links[len(left) :], docs[len(left) :] = link.sum(0), copies[: len(left)] @ link
            roots = _local_roots(link, same)
        u = [r[4] for r in rows]
        told = [bins.tolist(), *[None] * (len(u) - 1)]  # once for the two blocks
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(u, pa.int64()), pa.array([u[k] for k in roots.tolist()], pa.int64()), pa.array(links), pa.array(docs), pa.array(told, pa.list_(pa.int64()))], ["part", "u", "root", "links", "linked_docs", "bins"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for r in zip(*(b.column(k).to_pylist() for k in range(7)), strict=True):
                if held and held[0][:3] != r[:3]:
                    yield answer(held)
                    held = []
                if held and held[-1][4] == r[4]:
                    continue  # rows of equal id and text, read by two tasks
                held.append((*r[:6], np.frombuffer(r[6], np.uint64)))
        if held:
            yield answer(held)

    return rows.mapInArrow(frugal(run), "part long, u long, root long, links long, linked_docs long, bins array<long>")


def shingle_sets(docs: DataFrame, text_col: str, n: int) -> DataFrame:
    """``node, shingles`` of the rows; a task tells each node once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[bytes] = set()
        for batch in batches:
            fresh = {}
            for _, w in read_words(batch.column(0).to_pylist(), words_of):
                sh = shingles(w, n).tobytes()
                node = blake2b(sh, digest_size=16).digest()
                if node not in told:
                    told.add(node)
                    fresh[node] = sh
            yield pa.RecordBatch.from_arrays([pa.array(list(fresh), pa.binary()), pa.array(list(fresh.values()), pa.binary())], ["node", "shingles"])

    return docs.select(F.col(text_col)).mapInArrow(frugal(run), "node binary, shingles binary")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: tuple[int, int] = THRESHOLD, trees: int = TREES, max_depth: int = MAX_DEPTH, recall: float = RECALL, block: int = BLOCK_SHINGLES, most: int = BLOCK_NODES) -> DataFrame:
    """One row per document: ``doc_id, class_id, n_links, n_linked_texts, copy_id, kept``.

    ``class_id`` is the smallest id of the documents that hang together by links, ``copy_id`` that of
    the documents with the same shingles; ``n_links`` counts the other documents of similarity
    ``threshold`` or more, copies included, ``n_linked_texts`` the other shingle sets.
    """
    if least_recall(threshold[0] / threshold[1], 1, trees) < recall:
        raise ValueError("even prefixes of one value miss too many links: take more trees")
    base = materialise(nodes_of(docs, id_col, text_col, words, trees, max_depth).withColumn("u", F.monotonically_increasing_id()))
    base, bare = base.filter("n > 0 AND doc_id IS NOT NULL"), base.filter("n = 0 OR doc_id IS NULL")
    nodes = materialise(base.groupBy("node").agg(F.min("u").alias("u"), F.min("doc_id").alias("copy_id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n")))
    copied = nodes.filter("copies > 1").select("node", F.col("u").alias("first"))
    again = materialise(base.select("u", "node").join(copied, "node").filter("u <> first").select("u"))
    alone = base.join(F.broadcast(again) if again.count() <= BROADCAST_ROWS else again, "u", "left_anti")  # labels stay where they are
    shortest = shortest_prefix(threshold[0] / threshold[1], max_depth, recall, trees)
    ties = materialise(forest(alone, shortest, max_depth))
    texts = docs.select(F.col(id_col).alias("copy_id"), F.col(text_col).alias("text"))
    found = old = parts = None
    for depth in range(max_depth, shortest - 1, -1):
        parts = join_parts(parts, ties.filter(F.col("depth") == depth).select("u", "v").distinct())
        sizes = materialise(parts.groupBy("part").agg(F.count(F.lit(1)).alias("members")))
        grown = parts if old is None else parts.join(sizes.join(old, ["part", "members"], "left_anti"), "part", "left_semi")
        inside = materialise(grown.join(nodes.select("u", "node", "copy_id", "copies", "n"), "u"))
        sets = shingle_sets(semi_join(texts, inside.select("copy_id"), ["copy_id"]), "text", words)
        new = materialise(verify(inside.drop("copy_id"), sets, threshold, block, most))
        found = new if old is None else new.unionByName(found.join(sizes.join(old, ["part", "members"]), "part", "left_semi"))  # parts only grow: one of the same size is the same
        bins = {r["i"]: r["n"] for r in found.select(F.posexplode("bins").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect()}  # STEPS rows
        if estimated_recall([bins.get(i, 0) for i in range(STEPS)], depth, threshold[0] / threshold[1], trees) >= recall:
            break
        old = sizes
    links = found.groupBy("u").agg(F.sum("links").alias("links"), F.sum("linked_docs").alias("linked_docs"))
    classes = components(found.select("u", F.col("root").alias("v")))
    nodes = nodes.select("u", "node", "copy_id", "copies").join(links, "u", "left").join(classes, "u", "left")
    nodes = materialise(nodes.withColumn("root", F.coalesce("root", "u")))
    first = nodes.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    nodes = nodes.join(first, "root").select("node", "class_id", "copy_id", (F.coalesce("linked_docs", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("links", F.lit(0)).alias("n_linked_texts"))
    out = base.select("doc_id", "node").join(nodes, "node").select("doc_id", "class_id", "n_links", "n_linked_texts", "copy_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
    zero = F.lit(0).cast("long")
    return out.unionByName(bare.select("doc_id", F.col("doc_id").alias("class_id"), zero.alias("n_links"), zero.alias("n_linked_texts"), F.col("doc_id").alias("copy_id"), F.lit(True).alias("kept")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class, all columns kept: that of the smallest id, null after all others.

    Rows are joined under their id and text, so ids may be repeated or null.
    """
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("sha"))
    judged = jaccard_join(docs.select(key.alias("key"), F.col(text_col).alias("text")), "key", "text").filter("n_links > 0")
    return without_copies(docs, key, judged.select("doc_id", "kept"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
