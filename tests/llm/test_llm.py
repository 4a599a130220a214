"""The training-data operators: brute force on small tables, and the cases that data may hold."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserae.llm import common, exact_dedup, hnsw, language_id, minhash_join, mixing, packing, quality, suffix_dedup, token_counts, warc
from tests.oracle import assert_same, connect
from tesserae.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i}" for i in range(30_000))
#: (doc_id, text): nulls, empties, blanks, a very long text, ties and repeated rows.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, LONG + " "), (6, "a b"), (6, "a b"), (7, "a\tb"), (None, "a b"), (8, "é" * 5000 + "x"), (9, "é" * 5000 + "y"), (10, "no. 5!")]


def docs(spark, rows, **more):
    """Documents with other columns, some of whose names operators use inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, name string, pos int, size string, block int, _row int"
    return spark.createDataFrame([(i, t, "en", None if (i or 0) % 3 == 0 else f"s{(i or 0) % 3}", None if t is None else len(t), "x", 1, "y", 2, 3) for i, t in rows], schema)


def collect(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [])


@pytest.fixture(scope="module")
def real():
    return connect(SF).sql("SELECT doc_id, text, lang FROM documents ORDER BY 1").fetchall()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert_same(QUERIES[name](spark, SF).toPandas(), connect(SF).sql(ORACLES[name]).df())


# --- exact dedup ----------------------------------------------------------------------------------
@pytest.mark.parametrize("block", [1, 7, 4096])
def test_exact_dedup_odd(odd, block):
    rows = ODD if block > 1 else [r for r in ODD if r[1] not in (LONG, LONG + " ")]
    df = odd if block > 1 else odd.filter("doc_id IS NULL OR doc_id NOT IN (4, 5)")
    got = collect(exact_dedup.exact_dedup(df, block_chars=block), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    norm = lambda t: __import__("re").sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    wanted = collections.Counter()
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        kept = False
        for i in sorted(ids, key=lambda x: (x is None, x or 0)):
            wanted[i, keep, len(ids), not kept, hashlib.sha256(text.encode()).hexdigest()] += 1
            kept = True
    assert collections.Counter(got) == wanted


def test_exact_dedup_empty(empty):
    assert collect(exact_dedup.exact_dedup(empty), "doc_id") == []
    assert exact_dedup.keep_one(empty).columns == empty.columns


# --- mixing ---------------------------------------------------------------------------------------
def test_mix(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(0, 3000)), rng.choice("aab") if i % 9 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.taken(df).toPandas()
    again = mixing.taken(df.repartition(7)).toPandas()
    assert_same(got, again)
    src = {i: s for i, _, s in rows}
    for s, part in got.groupby(got.doc_id.map(lambda i: str(src[i]))):  # noqa: B007
        assert abs(part.taken.sum() - part.target.iloc[0]) <= mixing.BLOCK_WORDS
    assert (got.taken <= 2 * got["size"]).all()
    assert abs(got.drop_duplicates("source_size").target.sum() - 1.5 * got["size"].sum()) < 1e-6 * got["size"].sum() + 1e-6
    mixed = mixing.mix(df, shards=8).toPandas()
    assert not mixed.duplicated(["doc_id", "block", "copy"]).any()
    assert mixed.words.sum() == got.taken.sum()
    assert mixed.groupby("shard").size().max() - mixed.groupby("shard").size().min() <= 1
    assert sorted(mixed.groupby("shard").slot.apply(lambda s: sorted(s) == list(range(len(s))))) == [True] * 8


def test_water_level(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 1)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert got["a"] == 20.0
    assert got[None] == 2.0
    assert abs(sum(got.values()) - 1.5 * 1511) < 1e-9
    assert all(t <= 2 * s for t, s in ((got["b"], 1000), (got["c"], 500)))


def test_splitting_tree():
    leaves = list(mixing.splitting_tree([7, 0, 25], 5))
    assert [sum(c) for c in zip(*leaves, strict=True)] == [7, 0, 25]
    assert {sum(r) for r in leaves} <= {6, 7}


def test_splitting_tree_of_many_blocks():
    """Quotas beyond what numpy draws from; sums are exact and shards are alike."""
    quotas = [10**11, 3 * 10**12, 0, 7, 10**9 + 1]
    leaves = list(mixing.splitting_tree(quotas, 37))
    assert [sum(c) for c in zip(*leaves, strict=True)] == quotas
    assert {sum(r) for r in leaves} <= {sum(quotas) // 37, sum(quotas) // 37 + 1}
    share = quotas[0] / sum(quotas)
    assert all(abs(r[0] / sum(r) - share) < 1e-3 for r in leaves)
    assert len({r[0] for r in leaves}) > 1


def test_hypergeometric_large_like_exact(monkeypatch):
    rng = np.random.default_rng(5)
    exact = [mixing.hypergeometric(rng, 40_000, 60_000, 30_000) for _ in range(4000)]
    monkeypatch.setattr(mixing, "EXACT_DRAWS", 0)
    normal = [mixing.hypergeometric(rng, 40_000, 60_000, 30_000) for _ in range(4000)]
    assert abs(np.mean(exact) - np.mean(normal)) < 5
    assert abs(np.std(exact) / np.std(normal) - 1) < 0.06
    assert [mixing.hypergeometric(rng, 3, 5, 8), mixing.hypergeometric(rng, 3, 0, 2), mixing.hypergeometric(rng, 0, 5, 2)] == [3, 2, 0]


def test_cells_are_written_in_parts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELLS_AT_ONCE", 7)
    rows = mixing.shard_cells(spark, {0: 100, 2: 9, 5: 1}, 8, 1).collect()
    for no, quota in ((0, 100), (2, 9), (5, 1)):
        places = sorted({(r["first"], r["last"]) for r in rows if r["no"] == no})
        assert [p for a, b in places for p in range(a, b + 1)] == list(range(quota))
        size = -(-quota // 8)
        assert {(r["cell"], r["first"]) for r in rows if r["no"] == no} == {(c, a) for a, b in places for c in range(a // size, b // size + 1)}


def test_mix_of_rows_without_ids(spark):
    """Rows that share an id, or have none, are drawn one by one."""
    df = spark.createDataFrame([(None if i % 2 else 7, " ".join(["w"] * 1500), "a") for i in range(300)] + [(8, "b c", "b")], "doc_id long, text string, source string")
    blocks = mixing.plan(df, "doc_id", "text", "source", 1024, 1)[1]
    assert blocks.select("_key").distinct().count() == blocks.count() == 601
    got = mixing.taken(df).toPandas()
    assert len(got) == 301
    for size, part in got.groupby("source_size"):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= mixing.BLOCK_WORDS, size


def test_shards_grow_with_the_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 10)
    rng = random.Random(12)
    df = spark.createDataFrame([(i, " ".join(["w"] * rng.randint(1, 5000)), rng.choice("aabc")) for i in range(200)], "doc_id long, text string, source string")
    rows = mixing.mix(df, shards=2).toPandas()
    sizes = rows.groupby("shard").size()
    assert len(sizes) == len(rows) // 10 + 1
    assert sizes.max() - sizes.min() <= 1
    assert rows.words.sum() == mixing.taken(df).toPandas().taken.sum()


def test_mix_odd(odd, empty):
    got = collect(mixing.taken(odd), "doc_id", "size", "taken")
    assert len(got) == len(ODD)
    assert all(0 <= t <= 2 * s for _, s, t in got)
    assert collect(mixing.taken(empty), "doc_id") == []
    assert mixing.apply_mix(odd).columns == odd.columns


def test_mix_queries_draw_from_the_tree(spark, monkeypatch):
    """Both queries take their words from the shards' draws, each row its own."""
    drawn, tree = [], mixing.splitting_tree
    monkeypatch.setattr(mixing, "splitting_tree", lambda quotas, shards, seed: drawn.append((quotas, shards)) or tree(quotas, shards, seed))
    words = lambda n: " ".join(["w"] * n)
    df = spark.createDataFrame([(i % 20, words(700 * i), "ab"[i % 2]) for i in range(40)], "doc_id long, text string, source string")
    got = mixing.taken(df).toPandas()
    assert len(drawn) == 1
    assert drawn[0][1] == mixing.SHARDS
    rows = mixing.mix(df).toPandas()
    assert got.groupby("doc_id").taken.sum().to_dict() == rows.groupby("doc_id").words.sum().reindex(range(20), fill_value=0).to_dict()
    mixing.apply_mix(df).collect()
    assert len(drawn) == 3


def test_applied_mix_meets_the_targets(spark):
    """A hot source of long documents, of which the mix wants about a third, beside short ones."""
    rng = random.Random(10)
    long = [(i, "\n" + "  ".join(f"{i}_{k}" for k in range(20_000 + i)) + " ", "b") for i in range(4)]
    short = [(1000 + i, " ".join(["w"] * rng.randint(1, 900)), rng.choice([*"aaaccdddeffgggh", None, None])) for i in range(520)]
    df = spark.createDataFrame([*long, *short, (9000, " \n", "a"), (9001, None, "b"), (3, long[3][1], "b")], "doc_id long, text string, source string")
    wanted = {r["source"]: (r["source_size"], r["target"]) for r in mixing.targets(df.groupBy("source").agg(F.sum(mixing.size_of(F.col("text"))).alias("source_size"))).collect()}
    assert 0.25 < wanted["b"][1] / wanted["b"][0] < 0.5
    rows = mixing.apply_mix(df, shards=4).withColumn("part", F.spark_partition_id()).collect()
    words = collections.Counter()
    for r in rows:
        words[r["source"]] += len((r["text"] or "").split())
    assert all(abs(words[s] - target) <= mixing.BLOCK_WORDS for s, (_, target) in wanted.items())
    draws = mixing.mix(df, shards=4).collect()
    assert collections.Counter((r["doc_id"], len(r["text"].split())) for r in rows if (r["text"] or "").strip()) == collections.Counter((r["doc_id"], r["words"]) for r in draws)
    texts = {i: t for i, t, _ in long}
    for i, t in texts.items():
        cut = spark.range(1).select(mixing.block_texts(F.lit(t), 1024).alias("b")).first()["b"] if i < 2 else []
        assert not cut or ("".join(cut) == t and {len(b.split()) for b in cut[:-1]} == {1024})
    assert all(r["text"] in texts[r["doc_id"]] for r in rows if r["doc_id"] in texts)
    assert len({r["doc_id"] for r in rows} & set(texts)) == 4
    assert [r["doc_id"] for r in rows if not (r["text"] or "").strip()] in ([9000, 9001], [9001, 9000])
    assert max(collections.Counter(r["part"] for r in rows).values()) < len(rows)


# --- packing --------------------------------------------------------------------------------------
def test_ids_equal_the_library(real):
    from tokenizers import Tokenizer

    lib, mine = Tokenizer.from_file(packing.tokenizer_path()), packing.tokens(packing.tokenizer_path())
    rng = random.Random(2)
    chars = "abcXYZ .,'\n\t\r\x0b\x1c\x1f\x85\xa0\xadßÀéñ²½µªİΣς́​　漢字😀<|endoftext|>1 2_s't've"
    texts = [t for _, t, _ in real[:40]] + ["".join(rng.choice(chars) for _ in range(rng.randint(0, 60))) for _ in range(800)] + ["a<|endoftext|>b É", "it's we'VE", " ", "Ǆ ŉ ﬁ"]
    for t in texts:
        assert np.frombuffer(mine.ids(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def best(items, capacity):
    items, low = sorted(items, reverse=True), [len(items)]

    def place(i, bins):
        if len(bins) >= low[0]:
            return
        if i == len(items):
            low[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins) if b + items[i] <= capacity}.values():
            bins[k] += items[i]
            place(i + 1, bins)
            bins[k] -= items[i]
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return low[0]


def test_reductions_never_lose_the_optimum():
    rng = random.Random(3)
    for _ in range(400):
        items = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        have = collections.Counter(items)
        sizes, fixed = sorted(have), 0
        while sizes:  # apply reductions alone, then solve the rest by brute force
            j = sizes[-1]
            have[j] -= 1
            have = collections.Counter({k: v for k, v in have.items() if v})
            sizes = sorted(have)
            partners = packing.dominant_set(have, sizes, j, 20, 21)
            if partners is None:
                have[j] += 1
                break
            for p in partners:
                have[p] -= 1
            have = collections.Counter({k: v for k, v in have.items() if v})
            sizes, fixed = sorted(have), fixed + 1
        assert fixed + best(list(have.elements()), 20) == best(items, 20), items


def test_packing_is_exact_and_tight(spark, odd):
    texts = [(i, f"tok{i} " * (i * 37 % 2500)) for i in range(60)]
    for df, rows in ((docs(spark, texts), texts), (odd, ODD)):
        p = packing.pack_documents(df).toPandas()
        assert p.groupby("sequence_id").length.sum().max() <= 2048
        q = p.sort_values(["sequence_id", "offset"])
        assert (q.offset == q.groupby("sequence_id").length.cumsum() - q.length).all()
        enc = packing.tokens(packing.tokenizer_path())
        wanted = collections.Counter()
        for i, t in rows:
            ids = enc.ids(t) + b"\0\0\0\0"
            for k in range(0, len(ids), 8192):
                part = ids[k : k + 8192]
                wanted[i, k // 8192, k // 4, len(part) // 4, zlib.crc32(part)] += 1
        got = collections.Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in p.itertuples())
        assert got == wanted
        assert p.sequence_id.nunique() <= -(-int(p.length.sum()) // 2048) + 2


def test_packed_sequences_hold_the_ids(spark):
    df = docs(spark, [(1, "one two"), (2, "three"), (3, None)])
    rows = packing.sequences(df).collect()
    enc = packing.tokens(packing.tokenizer_path())
    whole = b"".join(bytes(r["ids"]) for r in rows)
    assert len(rows) == 1
    assert all(enc.ids(t) + b"\0" * 4 in whole for t in ("one two", "three"))


# --- token counts ---------------------------------------------------------------------------------
def test_token_counts_equal_the_library(spark, odd, empty, real):
    c = token_counts.counter(token_counts.model_path())
    rng = random.Random(4)
    chars = "ab cX▁▁ \n\t.,<s></s><0x0A>é漢😀1 2\x00​²."
    for t in [t for _, t, _ in real[:60]] + ["".join(rng.choice(chars) for _ in range(rng.randint(1, 40))) for _ in range(1500)]:
        assert c.count(t) == len(c.lib.encode(t)), repr(t)
    got = collect(token_counts.token_counts(odd), "doc_id", "n_bytes", "n_tokens", "over_limit")
    wanted = [(i, len((t or "").encode()), len(c.lib.encode(t)) if t else 0) for i, t in ODD]
    assert collections.Counter(got) == collections.Counter((i, b, n, n > 4096) for i, b, n in wanted)
    assert collect(token_counts.token_counts(empty), "doc_id") == []
    assert c.cuttable
    assert len(c.memo.fixed) > 30_000


def test_memo_forgets_without_changing_answers():
    m = common.Memo(lambda k: k * 2, 3, {"f": 1})
    assert [m[k] for k in [1, 2, 3, 4, 5, 1, "f"]] == [2, 4, 6, 8, 10, 2, 1]


# --- WARC -----------------------------------------------------------------------------------------
def test_warc_odd(spark):
    pages = [(1, "http://a/\r\nX: y", "<p>é</p>"), (2, None, None), (3, "u", ""), (4, "u", "<p>é</p>"), (4, "u", "<p>é</p>"), (5, "u", "x\r\n\r\nWARC/1.1\r\n" * 3), (6, "u", "z" * 3_000_000), (None, "u", "<p>é</p>")]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, hex string")
    got = collect(warc.archive_pages(df), "record_id", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload")
    assert len(got) == len(pages)
    first = {}
    for i, _, h in sorted(pages, key=lambda p: (p[0] is None, p[0] or 0)):
        first.setdefault(h or "", i)
    by = collections.Counter((r[0], r[1], r[4]) for r in got)
    assert by == collections.Counter({("1", "response", None): 1, ("2", "response", None): 1, ("3", "revisit", "2"): 1, ("4", "revisit", "1"): 2, ("5", "response", None): 1, ("6", "response", None): 1, ("", "revisit", "1"): 1})
    for i, _, h in pages:
        data = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert any(r[0] == ("" if i is None else str(i)) and r[2] == digest and r[3] == len(data) for r in got)
    assert {bytes(r[5]) for r in got if r[1] == "response"} == {(h or "").encode() for _, _, h in pages}
    only = warc.archive_pages(df.filter("page_id = 4").limit(2))
    assert sorted(r[0] for r in collect(only, "record_type")) == ["response", "revisit"]
    assert collect(warc.archive_pages(df.limit(0)), "record_id") == []
    none = spark.createDataFrame([(None, "u", "<p>"), (None, "v", "<p>"), (None, "w", "<q>")], "page_id string, url string, html string")
    assert sorted(collect(warc.archive_pages(none), "record_type", "payload")) == [("response", b"<p>"), ("response", b"<q>"), ("revisit", b"")]
    odd_ids = spark.createDataFrame([("a\r\nX: 1", "u", "<p>"), ("b>", "u", "<p>")], "page_id string, url string, html string")
    assert sorted(collect(warc.archive_pages(odd_ids), "record_id", "refers_to"), key=str) == [("a\r\nX: 1", None), ("b>", "a\r\nX: 1")]


def test_warc_normaliser_members(tmp_path):
    recs = [warc.record(i, "u", b"p" * i * 1000, warc.digest(b"p" * i * 1000), i * 1000, None, False) for i in range(50)]
    source, target, index = tmp_path / "in.gz", tmp_path / "out.gz", tmp_path / "out.idx"
    source.write_bytes(warc.member(b"".join(recs)))
    with source.open("rb") as f, target.open("wb") as o, index.open("wb") as x:
        assert warc.normalise(f, o, x) == 50
    data = target.read_bytes()
    for rec, line in zip(recs, index.read_text().splitlines(), strict=True):
        at, n, _ = line.split("\t")
        assert zlib.decompress(data[int(at) : int(at) + int(n)], 31) == rec
    with pytest.raises(ValueError, match="cut off"):
        list(warc.inflate(iter([source.read_bytes()[:-20]])))


# --- nearest neighbours ---------------------------------------------------------------------------
def test_hnsw_recall_and_order(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(1500, 16)).astype(np.float32)
    v[700:760] = v[0]  # a group of equal vectors
    df = spark.createDataFrame([(i, [float(x) for x in r], "x") for i, r in enumerate(v)], "vec_id long, embedding array<float>, shard string")
    got = hnsw.nearest(df, F.col("vec_id") % 50 == 0, shard_rows=400).toPandas()
    d = v.astype(np.float64)
    unit = d / np.linalg.norm(d, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 1500, 50):
        s = unit @ unit[q]
        s[q] = -9
        top = np.lexsort((np.arange(1500), -np.round(s, 12)))[:5].tolist()
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5]
        assert np.allclose(mine.score, (d[mine.vec_id] @ d[q]) / (np.linalg.norm(d[mine.vec_id], axis=1) * np.linalg.norm(d[q])), atol=1e-12)
        hit += len(set(top) & set(mine.vec_id))
    assert hit / 150 >= 0.9
    assert got[got.query_id == 0].vec_id.tolist() == [700, 701, 702, 703, 704]


def test_hnsw_recall_in_production(spark, tmp_path):
    """The query as it is registered, over a whole table of more than one shard."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((60, 24))
    v = (centres[rng.integers(0, 60, hnsw.SHARD_ROWS + 2000)] + 0.6 * rng.standard_normal((hnsw.SHARD_ROWS + 2000, 24))).astype(np.float32)
    ids = np.arange(len(v))
    spark.createDataFrame(pa.table({"vec_id": ids, "embedding": list(v)})).write.parquet(f"{tmp_path}/embeddings.parquet")
    d = v.astype(np.float64)
    unit = d / np.linalg.norm(d, axis=1, keepdims=True)
    got = QUERIES["op5_hnsw_search"](spark, str(tmp_path)).toPandas().groupby("query_id").vec_id.agg(set)
    hits = []
    for at in np.flatnonzero(ids % hnsw.EVERY == 0):
        s = np.round(unit @ unit[at], 12)
        s[at] = -9
        hits.append(len(set(ids[np.lexsort((ids, -s))[:5]].tolist()) & got[ids[at]]))
    assert len(hits) > 200
    assert np.mean(hits) / 5 >= 0.9


def test_hnsw_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0, 1.0]), (6, [1.0, 1.0]), (7, [1.0, 0.0, 0.0]), (8, []), (None, [1.0, 1.0]), (9, [1e-30, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = hnsw.nearest(df, F.lit(True)).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(0, 9), (0, 6), (6, 0), (6, 9), (9, 0), (9, 6)]
    assert hnsw.nearest(df.limit(0), F.lit(True)).collect() == []


# --- near duplicates ------------------------------------------------------------------------------
def brute_links(rows):
    sets = {i: {tuple((t or "").lower().split()[k : k + 5]) for k in range(max(1, len((t or "").split()) - 4))} if (t or "").split() else set() for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    n = collections.Counter()
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                n[a] += 1
                n[b] += 1
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (find(i), n[i]) for i in sets}


def test_estimated_recall():
    assert minhash_join.estimated_recall([0] * 20, 6, 0.8) == minhash_join.least_recall(0.8, 6) < 0.998
    assert minhash_join.least_recall(0.8, 5) > minhash_join.RECALL
    assert minhash_join.estimated_recall([0] * 19 + [5], 6, 0.8) > 0.999999
    assert abs(minhash_join.estimated_recall([7] + [0] * 19, 5, 0.8) - (1 - (1 - 0.8**5) ** 20)) < 1e-12


@pytest.mark.parametrize("same", [True, False])
def test_compare_counts_exactly(same):
    rng = random.Random(11)
    sets = [np.unique(np.array([rng.randint(0, 12) if rng.random() < 0.7 else rng.randint(0, 10_000) for _ in range(rng.randint(1, 15))], np.uint64)) for _ in range(300)]
    left, right = (sets, None) if same else (sets[:120], sets[120:])
    link, bins = minhash_join.compare(left, right, (4, 5))
    for i, a in enumerate(left):
        for j, b in enumerate(right or left):
            n = len(np.intersect1d(a, b))
            assert link[i, j] == ((not same or i != j) and 5 * n >= 4 * (len(a) + len(b) - n))
    assert bins.sum() == link.sum() // (2 if same else 1)


@pytest.mark.parametrize("block", [200, 1_500_000])
def test_jaccard_join_equals_brute_force(spark, block):
    rng = random.Random(6)
    rows = []
    for g in range(12):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([4, 30, 120]))]
        for _ in range(rng.randint(1, 9)):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"x{rng.randint(0, 9999)}"
            rows.append((len(rows), " ".join(words).title() if rng.random() < 0.2 else " ".join(words)))
    rows += [(1000, None), (1001, ""), (1002, "one"), (1003, "ONE"), (1004, "one two")]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in minhash_join.jaccard_join(docs(spark, rows), block=block, most=block).collect()}
    assert got == brute_links(rows)


def test_prefixes_are_shortened_until_all_is_found(spark, monkeypatch):
    """Links near the threshold, which long prefixes miss, beside parts that do not grow from one length to the next."""
    rng = random.Random(21)
    rows = []
    for g in range(12):
        base = [f"g{g}w{k}" for k in range(260)]
        for _ in range(8):
            words = list(base)
            for at in rng.sample(range(260), 4):  # each costs five shingles of about 256
                words[at] = f"x{rng.random()}"
            rows.append((len(rows), " ".join(words)))
    rows += [(500 + i, " ".join(f"u{i}_{k}" for k in range(30 + i))) for i in range(20)]
    rows += [(600 + i, rows[0][1]) for i in range(5)]
    lengths, verify = [], minhash_join.verify
    monkeypatch.setattr(minhash_join, "verify", lambda *a, **b: lengths.append(1) or verify(*a, **b))
    got = {r[0]: tuple(r[1:]) for r in collect(minhash_join.jaccard_join(docs(spark, rows), trees=10, recall=0.9999), "doc_id", "class_id", "n_links")}
    wanted = brute_links(rows)
    assert got == wanted
    assert len(lengths) >= 3
    assert 0 < sum(n for _, n in wanted.values()) < 12 * 8 * 7  # some pairs of a group are linked and some are not
    with pytest.raises(ValueError, match="trees"):
        minhash_join.jaccard_join(docs(spark, rows), threshold=(1, 10), trees=4)


def test_jaccard_join_odd(odd, empty):
    got = collect(minhash_join.jaccard_join(odd), "doc_id", "class_id", "n_links", "kept")
    assert len(got) == len(ODD)
    assert {r[0]: r[1] for r in got if r[0] in (4, 5)} == {4: 4, 5: 4}
    assert (None, None, 0, True) in got
    assert collect(minhash_join.jaccard_join(empty), "doc_id") == []
    assert minhash_join.keep_one(empty).columns == empty.columns


# --- repeated passages ----------------------------------------------------------------------------
def brute_spans(rows, n=50):
    at = collections.defaultdict(set)
    split = [(i, re.findall(r"\w+", unicodedata.normalize("NFKC", t or "").lower())) for i, t in rows if i is not None]
    for i, w in split:
        for k in range(len(w) - n + 1):
            at[tuple(w[k : k + n])].add(i)
    out = set()
    for i, w in split:
        span = None
        for k in range(len(w) - n + 1):
            if len(at[tuple(w[k : k + n])]) > 1:
                if span and k <= span[1]:
                    span = [span[0], k + n]
                else:
                    out |= {(i, *span)} if span else set()
                    span = [k, k + n]
        out |= {(i, *span)} if span else set()
    return out


@pytest.mark.parametrize("batch", [3, 10_000])
def test_passages_equal_brute_force(spark, batch):
    """Copies may differ in case and punctuation or be glued to what stands around them."""
    rng = random.Random(7)
    passages = [[f"p{g}_{k}" for k in range(n)] for g, n in enumerate([49, 50, 51, 80, 200])]
    rows = []
    for i in range(60):
        words = [f"d{i}_{rng.randint(0, 30)}" for _ in range(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            at, a = rng.randint(0, len(words)), rng.randint(0, 20)
            words[at:at] = p[a if rng.random() < 0.3 else 0 :]
        text = " ".join(words)
        rows.append((i, rng.choice([text, text.title(), text.replace(" ", ". "), text.replace(" ", ",\n", 90), re.sub(r" (p\d_0)\b", r"-\1", text)])))
    hot = " ".join(f"h{k}" for k in range(70))
    rows += [(200 + i, f"a{i} b{i} {hot} c{i}") for i in range(40)] + [(300 + i % 3, rows[1][1] + " same again") for i in range(9)] + [(300, rows[2][1])]
    rows += [(100, "same " * 300), (101, "same " * 90), (102, None), (103, ""), (None, rows[0][1])]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = collect(suffix_dedup.repeated_passages(docs(spark, rows)), "doc_id", "start_word", "end_word")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(got) == len(set(got))
    assert set(got) == brute_spans(rows)


def test_suffixes_are_ranked_and_compared():
    rng = np.random.default_rng(3)
    codes = rng.integers(1, 3, 400)
    for n in (1, 2, 7, 50):
        tables, got = suffix_dedup.ranks(codes, n)
        wanted = [tuple(codes[k : k + n].tolist()) for k in range(400 - n + 1)]
        order = {w: r for r, w in enumerate(sorted(set(wanted)))}
        assert [order[w] for w in wanted] == np.unique(got[: len(wanted)], return_inverse=True)[1].tolist()
    tables, _ = suffix_dedup.ranks(np.concatenate([codes, np.zeros(200, codes.dtype)]), 50)
    a, b = rng.integers(0, 350, (2, 500))
    wanted = [next((k for k in range(50) if codes[i + k] != codes[j + k]), 50) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    assert np.minimum(suffix_dedup.common(tables, a, b), 50).tolist() == wanted


def test_neighbours_equal_brute_force():
    """Windows of 8 words around suffixes, of which each document has several."""
    rng = np.random.default_rng(8)
    codes, n = rng.integers(1, 3, 600), 8
    at = np.arange(10, 580, 7)
    left = (np.maximum(0, rng.integers(-3, 3, len(at))), rng.integers(2, 6, len(at)))
    right = rng.integers(8, 14, len(at))
    right = np.maximum(right, n - left[0])
    doc = rng.integers(0, 25, len(at))
    got = set(zip(*(x.tolist() for x in suffix_dedup.neighbours(codes, at, left, right, doc, doc, n)), strict=True))
    held = collections.defaultdict(list)
    for i, p in enumerate(at.tolist()):
        for l in range(int(left[0][i]), int(left[1][i]) + 1):
            held[(l, tuple(codes[p - l : p - l + n].tolist()))].append((i, l))
    assert got == {x for group in held.values() if len({int(doc[i]) for i, _ in group}) > 1 for x in group}
    assert len(got) > 50


def test_passages_odd(odd, empty):
    assert set(collect(suffix_dedup.repeated_passages(odd), "doc_id", "start_word", "end_word")) == {(4, 0, 30000), (5, 0, 30000)}
    assert collect(suffix_dedup.repeated_passages(empty), "doc_id") == []


# --- language -------------------------------------------------------------------------------------
def test_gradients():
    net = language_id.ByteGru(["a", "b"], hidden=3, seed=0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    codes, mask = language_id.pad([b"abc", b"zq", b"hello"])
    y, w = np.array([0, 1, 1]), np.array([1.0, 2.0, 0.5])
    _, g = net.gradients(codes, mask, y, w)
    for k, p in net.p.items():
        for i in np.flatnonzero(np.abs(g[k]).ravel() > 1e-7)[:5]:
            i = np.unravel_index(i, p.shape)
            old, e = p[i], 1e-3
            p[i] = old + e
            up = net.gradients(codes, mask, y, w)[0]
            p[i] = old - e
            down = net.gradients(codes, mask, y, w)[0]
            p[i] = old
            assert abs((up - down) / (2 * e) - g[k][i]) < 1e-5


def test_windows_hold_whole_characters_and_context():
    data = ("a\u00e9\u6f22\U0001f600 " * 200).encode()
    parts = language_id.cut(data)
    assert b"".join(parts) == data
    assert all(p.decode() is not None and 252 < len(p) <= 256 for p in parts[:-1])
    net = language_id.ByteGru(["a", "b"], seed=1)
    codes, mask = language_id.pad([b"one two", b"oze two"])
    p = net.probabilities(codes, mask)
    assert (p[4:, 0] != p[4:, 1]).all()  # a position sees what stands before the blank
    assert (p[0, 0] != p[0, 1]).all()  # and what stands behind it


def test_language_held_out(spark, real):
    got = QUERIES["op9_language_id"](spark, SF).toPandas()
    lang = {i: x for i, _, x in real}
    held = got[got.held_out]
    assert (held.lang_pred == held.doc_id.map(lang)).mean() > 0.95
    assert set(got[got.held_out].doc_id) == {i for i, _, _ in real if zlib.crc32(str(i).encode()) % 3 == 1}
    assert got.score.between(0, 1).all()


def test_language_odd(spark, odd, empty):
    net = language_id.train(odd, "doc_id", "text", "lang", steps=5)
    got = collect(language_id.identify(odd, net), "doc_id", "lang_pred", "score")
    assert len(got) == len(ODD)
    assert {r[0] for r in got if r[1] == "und"} == {1, 2, 3}
    assert language_id.train(empty, "doc_id", "text", "lang") is None
    assert {r[0] for r in collect(language_id.identify(odd, None), "lang_pred")} == {"und"}
    assert language_id.keep_known(odd).columns == odd.columns


def test_language_null_ids(spark, odd, empty, tmp_path):
    odd.write.parquet(f"{tmp_path}/odd/documents.parquet")
    empty.write.parquet(f"{tmp_path}/none/documents.parquet")
    got = collect(QUERIES["op9_language_id"](spark, f"{tmp_path}/odd"), "doc_id", "held_out")
    assert sorted(got, key=str) == sorted(((i, i is not None and zlib.crc32(str(i).encode()) % 3 == 1) for i, _ in ODD), key=str)
    assert QUERIES["op9_language_id"](spark, f"{tmp_path}/none").collect() == []


# --- quality --------------------------------------------------------------------------------------
def test_quality_held_out(spark):
    """Labels that were never seen; on the real table both views teach each other."""
    sf = "/root/testdata/sf0.01"
    docs_, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    hidden = F.col("doc_id") % 3 == 0
    rows = quality.features(docs_)
    model = quality.train(rows, labels.filter(~hidden))
    got = quality.score(rows, model).toPandas()
    lab = connect(sf).sql("SELECT doc_id, any_value(quality) AS q FROM labels WHERE doc_id % 3 = 0 GROUP BY 1").df()
    j = got.merge(lab, on="doc_id")
    assert len(got) == 1000
    assert (j.kept == (j.q == 1)).mean() > 0.9
    assert got[["score", "text_score", "meta_score"]].apply(lambda s: s.between(0, 1).all()).all()
    given = collections.Counter()
    for _, view, _, n in model.given:
        given[view] += n
    assert given["t"] > 0
    assert given["m"] > 0


def test_quality_exchanges_labels_between_views():
    rng = np.random.default_rng(8)
    y = rng.integers(0, 2, 200).astype(float)
    view = lambda y: np.column_stack([y * 2 - 1 + rng.normal(0, 0.5, len(y)), rng.normal(size=len(y))]).astype(np.float32)
    u = rng.integers(0, 2, 300).astype(float)
    ut, um, open_ = view(u), view(u), np.ones(300, bool)

    def surest(model, name, label):
        p = (model.text if name == "t" else model.meta).logit(ut if name == "t" else um)
        at = np.flatnonzero(open_)
        at = at[np.argsort(-p[at] if label else p[at])[:20]]
        open_[at] = False
        return ut[at], um[at]

    m = quality.cotrain(view(y), view(y), y, np.arange(200) % 4 == 0, surest)
    assert {(k[1], k[2]) for k in m.given if k[3]} == {("t", 1.0), ("t", 0.0), ("m", 1.0), ("m", 0.0)}
    t = rng.integers(0, 2, 500).astype(float)
    assert ((m.predict(view(t), view(t))[2] >= 0.5) == (t == 1)).mean() > 0.97


def test_quality_odd(spark, odd, empty):
    some = spark.createDataFrame([(1, 1), (4, 0), (4, 1), (None, 1), (6, None), (77, 0)], "doc_id long, quality int")
    rows = quality.features(odd)
    assert {r[0] for r in collect(quality.score(rows, quality.train(rows, some.limit(0))), "score")} == {0.5}
    assert quality.score(rows, quality.train(rows, some)).count() == len(ODD)
    bare = quality.features(empty)
    assert quality.score(bare, quality.train(bare, some)).collect() == []


# --- filters --------------------------------------------------------------------------------------
@pytest.mark.parametrize("most", [0, 1_000_000])
def test_filters_drop_rows_not_ids(spark, odd, monkeypatch, most):
    """Of each text one row survives, whatever ids it shares with others; nulls are ids like any other."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    norm = lambda t: __import__("re").sub(r"[\x20\x09-\x0D]+", " ", t or "")
    got = exact_dedup.keep_one(odd)
    assert got.columns == odd.columns
    assert collections.Counter(norm(t) for (t,) in collect(got, "text")) == collections.Counter({norm(t) for _, t in ODD})
    assert {i for i, t in collect(got, "doc_id", "text") if t in ("a b", "a\tb")} == {6}
    base = " ".join(f"v{k}" for k in range(200))
    rows = [(1, "x y"), (1, "x y"), (2, "x y"), (None, "x y"), (None, "clean null"), (None, base), (3, base), (3, "clean three"), (4, base + " end"), (4, base + " fin"), (4, "clean four"), (None, "12 3"), (None, None), (5, "")]
    df = docs(spark, rows)
    wanted = sorted([(1, "x y"), (None, "clean null"), (3, base), (3, "clean three"), (4, base + " end"), (4, base + " fin"), (4, "clean four"), (None, "12 3")], key=str)
    assert sorted((r for r in collect(exact_dedup.keep_one(df), "doc_id", "text") if r[1]), key=str) == wanted
    near = sorted(((i, t) for i, t in wanted if not t.startswith(base + " ")), key=str)
    assert sorted((r for r in collect(minhash_join.keep_one(df), "doc_id", "text") if r[1]), key=str) == near
    known = collect(language_id.keep_known(df), "doc_id", "text")
    assert sorted(known, key=str) == sorted((r for r in rows if r[1] not in ("12 3", None, "")), key=str)


# --- pipeline -------------------------------------------------------------------------------------
def test_pipeline_odd(spark, odd, empty, tmp_path):
    """Nulls, empty and very long texts, repeated rows and ids, an empty table, columns with names that stages use inside."""
    import corpus_pipeline

    for name, df in (("odd", odd), ("none", empty)):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    texts = {i for i, t in ODD if t and any(map(str.isalpha, t))}
    assert {r["doc_id"] for r in got} <= texts
    assert all(0 < r["length"] <= 2048 for r in got)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


def test_pipeline_stages(spark):
    import corpus_pipeline

    rng = random.Random(9)
    base = [" ".join(rng.choice(["the", "of", "and"]) + str(rng.randint(0, 99)) for _ in range(60)) for _ in range(8)]
    rows = [(i, base[i % 8] if i < 16 else base[i - 16] + " end") for i in range(24)] + [(50, None), (51, "123 45"), (52, "")]
    df = docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        df = common.materialise(stage(spark, df, SF))
        kept.append((name, df))
    ids = [sorted(r[0] for r in collect(d, "doc_id")) for _, d in kept]
    assert ids[0] == list(range(24))
    assert ids[1] == [*range(8), *range(16, 24)]
    assert ids[2] == list(range(8))
    assert set(ids[3]) <= set(range(8))
    assert set(ids[4]) == set(ids[3])
    assert all(d.columns == kept[0][1].columns for _, d in kept[:4])
    assert [n for n, _ in kept] == ["language_id", "exact_dedup", "jaccard_join", "mix_sources", "best_fit_packing"]
