"""Inputs on which a query once differed from its SQL, or made far more rows than its input."""

from __future__ import annotations

import math
import random
import re
import tracemalloc
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tesserae.functions.text import upper_by_character
from tesserae.llm import minhash_join
from tesserae.operators import align, citations, evals, fulltext, graph, patterns, textindex, topk
from tesserae.queries import relations
from tesserae.queries.base import Tables
from tesserae.registry import ORACLES, QUERIES
from tesserae.sources import snapshots
from tests.oracle import assert_same, connect


def _same(spark, folder, name: str, **tables: pa.Table) -> None:
    for t, rows in tables.items():
        pq.write_table(rows, f"{folder}/{t}.parquet")
    assert_same(QUERIES[name](spark, str(folder)).toPandas(), connect(str(folder)).sql(ORACLES[name]).df())


def test_capitals_by_character(spark):
    letters = [chr(c) for c in range(1, 0x11000) if not 0xD800 <= c < 0xE000]
    wanted = dict(duckdb.sql("SELECT c, upper(c) FROM (SELECT unnest(?) AS c)", params=[letters]).fetchall())
    got = dict(spark.createDataFrame([(c,) for c in letters], "c string").select("c", upper_by_character("c")).collect())
    assert {c: got[c] for c in letters if got[c] != wanted[c]} == {}


def test_document_versions_with_sharp_s(spark, tmp_path):
    docs = pa.table({"doc_id": pa.array(range(5), pa.int64()), "text": ["la Straße à ﬁn", "", None, "Straße", "ok"], "lang": ["fr", "fr", "fr", "de", None]})
    _same(spark, tmp_path, "document_versions", documents=docs)


def test_expert_results_with_repeated_runs(spark, tmp_path):
    n = 400
    li = pa.table({
        "l_orderkey": pa.array([i % 90 for i in range(n)], pa.int64()), "l_partkey": pa.array([i * 7 % 101 for i in range(n)], pa.int64()), "l_suppkey": pa.array([i % 57 for i in range(n)], pa.int64()),
        "l_linenumber": pa.array([1] * n, pa.int32()), "l_quantity": [50.0] * n, "l_discount": [[0.2, 0.1, 0.0, 0.3][(i // 90 * 3 + i) % 4] for i in range(n)], "l_returnflag": ["N"] * n, "l_linestatus": ["O"] * n,
    })
    _same(spark, tmp_path, "expert_results", lineitem=li)


def test_expert_results_with_means_at_the_limit(spark, tmp_path):
    runs = [(k, i, q) for k, qs in {1: [19.0, 48.0, 11.0, 22.0], 2: [12.0, 31.0, 49.0, 13.0, 13.0, 8.0, 49.0], 4: [8.0, 31.0, 36.0], 7: [15.0, 23.0, 8.0, 19.0, 43.0, 42.0]}.items() for i, q in enumerate(qs)]
    runs.sort(key=lambda r: (r[1], r[0]))  # the runs of a case lie apart, in many row groups
    n = len(runs)
    li = pa.table({
        "l_orderkey": pa.array([r[0] for r in runs], pa.int64()), "l_partkey": pa.array([1] * n, pa.int64()), "l_suppkey": pa.array([1] * n, pa.int64()), "l_linenumber": pa.array([7 - r[1] for r in runs], pa.int32()),
        "l_quantity": [r[2] for r in runs], "l_discount": [0.0] * n, "l_returnflag": ["N"] * n, "l_linestatus": ["O"] * n,
    })
    _same(spark, tmp_path, "expert_results", lineitem=li)


def _shuffled(df) -> int:
    """Rows that all exchanges of a collected query wrote."""

    def walk(node) -> int:
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        own = node.metrics().get("shuffleRecordsWritten")
        below = node.children()
        return (own.get().value() if own.isDefined() else 0) + sum(walk(below.apply(i)) for i in range(below.size()))

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.fixture(scope="module")
def mentions(spark):
    """80 entities of 100 of 200 documents, some of which share a name, or have several."""
    rows = [(d, e, f"Name {e % 70}" if e < 75 else f"name {e}{'x' * (d % 2)}", "person" if e % 3 else "tool") for e in range(80) for d in range(200) if (d * 7 + e * 3) % 2 or d % 10 == e % 10 and d > 180]
    return spark.createDataFrame(rows, "doc_id long, entity_id long, name string, kind string").cache(), rows


def _ties(rows):
    docs = {}
    for d, e, n, k in rows:
        docs.setdefault(e, []).append((d, n, k))
    n_docs = len({r[0] for r in rows})
    for e, own in docs.items():
        for seed, _, _ in own:
            for d, n, k in own:
                if d != seed:
                    yield seed, d, e, n, k, math.log(n_docs / len(own)) * graph.KIND_WEIGHT[k] if len(own) <= 0.6 * n_docs else None


def test_pairs_are_summed_where_a_seed_is(spark, mentions):
    m, rows = mentions
    seeds = m.select("doc_id").distinct()
    counts, pairs, made = defaultdict(set), defaultdict(float), 0
    for seed, d, _, n, _, c in _ties(rows):
        made += 1
        counts[seed, d].add(n)
        pairs[seed, d] += c or 0
    hops = graph.one_hop_counts(m, seeds)
    assert {(r["seed"], r["doc_id"]): r["shared"] for r in hops.collect()} == {k: len(v) for k, v in counts.items()}
    related = graph.related(m, seeds, 3)
    best = defaultdict(list)
    for (seed, d), s in pairs.items():
        best[seed].append((-round(s, 4), d))
    assert {(r["seed"], r["rank"]): (r["doc_id"], r["score"]) for r in related.collect()} == {(s, i + 1): (d, pytest.approx(-x, abs=2e-4)) for s, v in best.items() for i, (x, d) in enumerate(sorted(v)[:3])}
    assert made > 500_000 and _shuffled(hops) < made / 4 and _shuffled(related) < made / 4


def test_bridges_are_counted(spark, mentions):
    m, rows = mentions
    seeds = m.select("doc_id").distinct()
    sums, made = defaultdict(lambda: [0.0, set()]), 0
    for seed, d, _, n, _, c in _ties(rows):
        made += 1
        if c:
            sums[seed, n.lower()][0] += c
            sums[seed, n.lower()][1].add(d)
    found = graph.bridges(m, seeds, 1000)
    assert {(r["seed"], r["entity"].lower()): r["strength"] for r in found.collect()} == {k: pytest.approx(t / len(d) * math.log1p(len(d)), abs=2e-4) for k, (t, d) in sums.items()}
    assert _shuffled(found) < made / 4


def test_cooccurring_tells_rows_apart_by_ids(spark, mentions):
    m, _ = mentions
    found = graph.cooccurring(m, m.filter("entity_id = 0").select("entity_id"))
    keys = re.findall(r"Aggregate\(keys=\[([^\]]*)\]", found._jdf.queryExecution().executedPlan().toString())
    assert found.count() == 10 and keys and not any("name" in k for k in keys)


def test_mentions_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(relations, "PART_ROWS", 100)
    t = Tables(spark, "/root/testdata/sf0.001")
    assert relations._mentions(t).rdd.getNumPartitions() == -(-t.lineitem.count() // 100)


def test_components_tie_equal_edges_once(spark, monkeypatch):
    seen, rounds = [], minhash_join._rounds
    monkeypatch.setattr(minhash_join, "_rounds", lambda e: (seen.append(e.count()), rounds(e))[1])
    rng = random.Random(3)
    edges = [(u, v) for u in range(100, 2100) for v in range(20)] + [(rng.randrange(5000, 5400), rng.randrange(5000, 5400)) for _ in range(260)] + [(7000, 7001), (7002, 7001), (8, 8)]
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            if u != v and label[u] != label[v]:
                label[u] = label[v] = min(label[u], label[v])
                changed = True
    found = minhash_join.components(spark.createDataFrame(edges, "u long, v long"))
    assert {r["u"]: r["root"] for r in found.collect()} == label
    assert seen[0] < 1000 < len(edges)


@pytest.mark.parametrize("shortest", [1, 3, 4])
def test_forest_ties_the_groups_of_each_length(spark, shortest):
    rng = random.Random(8)
    labels = {u: [b"".join(rng.choice([b"aaaa", b"aaab", b"\xff\0\xff\0"]) for _ in range(4)) for _ in range(3)] for u in range(60, 120)}
    ties = minhash_join.forest(spark.createDataFrame([(u, x) for u, x in labels.items()], "u long, labels array<binary>"), shortest, 4).collect()
    assert len(ties) < 3 * len(labels) and all(r["v"] < r["u"] for r in ties)
    for d in range(shortest, 5):
        wanted = [(u, min(v for v in labels if labels[v][t][: 4 * d] == x[t][: 4 * d])) for u, x in labels.items() for t in range(3)]
        assert _connected(labels, wanted) == _connected(labels, [(r["u"], r["v"]) for r in ties if r["depth"] >= d])


def _connected(nodes, edges) -> dict:
    label = {u: u for u in nodes}
    for _ in nodes:
        for u, v in edges:
            label[u] = label[v] = min(label[u], label[v])
    return label


def test_jaccard_join_shuffles_labels_once(spark):
    """Prefixes are shortened here; neither labels nor sets travel again for that, nor for naming the nodes."""
    rng, rows = random.Random(5), []
    for g in range(1500):
        words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        rows.append((len(rows), " ".join(words)))
        if g % 100 == 0:  # a similarity just above the threshold
            rows.append((len(rows), " ".join([*words[:-5], *(f"x{rng.randrange(10**6)}" for _ in range(5))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)

    def moved() -> int:
        return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = moved()
    found = minhash_join.jaccard_join(docs.localCheckpoint()).groupBy("n_links").count().collect()
    assert {r["n_links"]: r["count"] for r in found} == {0: 1485, 1: 30}
    assert moved() - before < 900 * len(rows)


def test_jaccard_join_of_repeated_ids(spark):
    """Sets are found again by id: those of other texts of an id do not take part, and one that several tasks read counts once."""
    text = " ".join(f"w{k}" for k in range(100))
    near = text.replace("w50 ", "x ")
    docs = spark.createDataFrame([(1, text), (1, "other words"), (2, near), (1, text), (1, text), (3, "quite alone here")], "doc_id long, text string").repartition(6)
    got = sorted(tuple(r) for r in minhash_join.jaccard_join(docs).select("doc_id", "class_id", "n_links", "n_linked_texts").collect())
    assert got == [(1, 1, 0, 0), (1, 1, 3, 1), (1, 1, 3, 1), (1, 1, 3, 1), (2, 1, 3, 1), (3, 3, 0, 0)]


@pytest.mark.parametrize("shard, block", [(1 << 21, 1 << 15), (100, 7)])
def test_best_sums(spark, shard, block):
    rng = random.Random(4)
    weights = {(t, i): rng.choice([1e-6, 0.25, 0.5, 3.0]) for t in range(30) for i in [None, *range(90)] if rng.random() < 1 / (1 + t / 4)}
    asked = {q: rng.sample(range(35), rng.randint(1, 12)) for q in range(40)}
    postings = spark.createDataFrame([(f"t{t}", i, w) for (t, i), w in weights.items()], "term string, id long, weight double")
    queries = spark.createDataFrame([(q, f"t{t}") for q, ts in asked.items() for t in ts], "query_id long, term string")
    wanted, least = [], []
    for q, ts in asked.items():
        sums = defaultdict(float)
        for (t, i), w in weights.items():
            if t in ts:
                sums[i] += w
        best = sorted((-round(s, 6), i is None, i or 0, i) for i, s in sums.items())[:3]
        wanted += [(q, i, -s, r + 1) for r, (s, _, _, i) in enumerate(best)]
        least += [(q, -best[2][0])] if len(best) == 3 and q % 2 else []
    for known in (None, spark.createDataFrame(least, "query_id long, least double")):
        found = topk.best_sums(queries, postings, 3, known, shard, block)
        assert sorted(map(tuple, found.collect()), key=lambda r: (r[0], r[3])) == sorted(wanted, key=lambda r: (r[0], r[3]))


@pytest.mark.parametrize("stored", [False, True])
def test_searches_shuffle_no_pairs_of_a_query_and_a_document(spark, tmp_path, stored):
    docs = spark.range(300).select(F.col("id").alias("chunk_id"), F.concat(F.lit("rare word w"), (F.col("id") % 50).cast("string")).alias("text"))
    docs = docs.unionByName(spark.range(1000, 1600).select(F.col("id").alias("chunk_id"), F.lit("other").alias("text")))
    queries = spark.range(400).select(F.col("id").alias("query_id"), F.concat(F.lit("rare word w"), (F.col("id") % 60).cast("string")).alias("text"))
    if stored:
        store = snapshots.Store(spark, f"file://{tmp_path}/index")
        textindex.build(store, docs)
        found = textindex.search_batch(store, queries, 3)
    else:
        found = fulltext.search_batch(fulltext.postings(docs), fulltext.corpus_stats(docs), queries, 3)
    assert len(found.collect()) == 400 * 3
    assert _shuffled(found) < 30_000  # each query meets 300 documents


def _slow_path(scores, floor, jump, fixed):
    n, p = scores.shape
    at = np.arange(p)
    move = np.vstack([np.where(at[None] == at[:, None], 0.0, np.where(at[None] > at[:, None], -jump, -2 * jump)), np.zeros(p)])
    value, came, took = np.append(np.full(p, -np.inf), 0.0), np.tile(np.arange(p + 1), (n, 1)), np.zeros((n, p + 1), bool)
    for i in range(n):
        anchor = fixed.get(i, -1)
        if anchor is None:
            continue
        total = value[:, None] + move
        from_, reached = total.argmax(0), total.max(0)
        if anchor >= 0:
            value = np.full(p + 1, -np.inf)
            value[anchor], came[i, anchor], took[i, anchor] = reached[anchor], from_[anchor], True
            continue
        value = value + floor
        better = reached + scores[i] > value[:p]
        value[:p][better] = (reached + scores[i])[better]
        came[i, :p][better], took[i, :p][better] = from_[better], True
    state, path = int(value.argmax()), []
    for i in range(n - 1, -1, -1):
        path.append(state if took[i, state] else None)
        state = int(came[i, state])
    return path[::-1]


def test_best_path_equals_all_steps():
    rng = np.random.default_rng(3)
    for case in range(200):
        n, p = rng.integers(1, 30), rng.integers(1, 9)
        scores = rng.random((n, p)) if case % 2 else rng.integers(0, 5, (n, p)) / 4  # ties
        fixed = {int(i): [None, int(rng.integers(p))][int(rng.integers(2))] for i in rng.integers(0, n, case % 4)}
        assert align.best_path(scores, 0.25, 0.125, None, fixed) == _slow_path(scores, 0.25, 0.125, fixed)


def test_best_path_is_not_held_whole():
    scores = np.random.default_rng(5).random((1500, 1500), np.float32)
    tracemalloc.start()
    align.best_path(scores)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < scores.nbytes / 2


def test_words_are_split_once(spark):
    df = spark.createDataFrame([("a b c", "a c c")], "r string, f string").select(evals.wer(F.col("r"), F.col("f")).alias("wer"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert df.first()[0] == 1 / 3
    assert plan.count("regexp_replace") <= 4  # twice for each text


def test_names_of_a_long_text_are_found_word_by_word(monkeypatch):
    class Counted(list):
        read = 0

        def __getitem__(self, at):
            found = super().__getitem__(at)
            Counted.read += len(found) if isinstance(at, slice) else 1
            return found

    trie = patterns.trie_of(["this work is licensed", "work", "école"])
    text = "this work Is done, this work is licensed École x\u0301y " * 100
    wanted = patterns.longest(trie, text)
    assert [text[a:b] for a, b, _ in wanted[:5]] == ["work", "this work is licensed", "work", "École", "work"]
    own = patterns.words
    monkeypatch.setattr(patterns, "words", lambda t: Counted(own(t)))
    assert patterns.longest(trie, text) == wanted
    assert Counted.read < 3 * len(own(text))


def _stages(spark) -> dict[int, int]:
    """Rows that each stage of the session wrote to a shuffle, those of tables written on the way included."""
    context, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    context.listenerBus().waitUntilEmpty()
    found = context.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return {s.stageId(): s.shuffleWriteRecords() for s in (found.apply(i) for i in range(found.size()))}


def test_citations_of_documents_that_share_titles_and_authors(spark):
    n = 40_000
    k = F.col("id")
    docs = spark.range(n).select(
        (n - k).alias("doc_id"), F.concat(F.lit("Handbook of subject "), (k % 30).cast("string")).alias("title"),
        F.array(F.concat(F.lit("Ann Name"), (k % 7).cast("string"))).alias("authors"), F.make_date(2000 + k % 4, F.lit(1), F.lit(1)).alias("date"),
    )
    asked = [(i, t, "high", skip) for i, (t, skip) in enumerate([("see handbook of subject 3.", None), ("Name2, 2001", None), ("handbook of sub", 1), ("a subject of the handbook", 1), ("nothing", None), ("see handbook of subject 3.", 7)])]
    before = _stages(spark)
    found = citations.resolve(spark.createDataFrame(asked, "citation_id long, surface_text string, confidence string, skip_doc_id long"), docs)
    got = {r["citation_id"]: (r["doc_id"], r["title"], r["via"], round(r["score"], 2)) for r in found.collect()}
    shuffled = sum(rows for stage, rows in _stages(spark).items() if stage not in before)

    kept = {d: f"Handbook of subject {(n - d) % 30}" for d in range(1, n + 1)}
    three = [d for d in kept if kept[d].endswith(" 3")]
    two = min(d for d in kept if (n - d) % 7 == 2 and (n - d) % 4 == 1)
    assert three[0] == 7
    assert got == {
        0: (7, kept[7], "title", 0.95), 1: (two, kept[two], "author_year", 0.90), 2: (2, kept[2], "title", 0.88),
        3: (2, kept[2], "tokens", 0.75), 5: (three[1], kept[three[1]], "title", 0.95),
    }
    assert shuffled < 2 * n


def test_pairs_of_shared_title_words_are_not_shuffled(spark):
    titles = [sorted({"alpha", "beta", f"gamma{i % 3}", f"delta{i}"}) for i in range(150)]
    norms = [f"alpha of beta gamma{i % 3}, {i}" for i in range(200)] + ["alpha", "beta delta7 alpha", "delta7 delta8"]
    t = spark.createDataFrame([(x, [i]) for i, x in enumerate(titles)], "tokens array<string>, docs array<long>")
    met = citations.by_tokens(spark.createDataFrame([(x,) for x in norms], "norm string"), t)
    got = sorted((r["norm"], r["docs"][0], round(r["score"], 2)) for r in met.collect())
    own = {x: set(re.findall("[a-z0-9]+", x)) for x in norms}
    shared = [(x, i, len(own[x] & set(w)), len(w)) for x in norms for i, w in enumerate(titles)]
    assert got == sorted((x, i, min(0.78, round(0.55 + 0.1 * n, 2))) for x, i, n, m in shared if n >= 2 and n / m >= 0.6)
    assert len(got) > 9_000 and _shuffled(met) < len(got)
