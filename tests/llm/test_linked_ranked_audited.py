"""SimHash links, the filter audit and ranked search: brute force, and the cases that data may hold."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from tesserae.llm import common, filter_audit, ranked_search, simhash
from tests.llm.test_llm import LONG, ODD, SF, collect, docs
from tests.oracle import connect


@pytest.fixture(scope="module")
def real():
    return connect(SF).sql("SELECT doc_id, text, lang FROM documents ORDER BY 1").fetchall()


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def edited(rng, words, n):
    """``n`` texts that differ from ``words`` in a word or two."""
    return [" ".join(f"w{rng.random()}" if rng.random() < 0.004 else w for w in words) for _ in range(n)]


# --- SimHash --------------------------------------------------------------------------------------
def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    """``(doc_id, fingerprint, component_id)`` by comparing all pairs."""
    fps = [slow_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    x = np.array(fps, np.uint64)
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= 3) + i + 1:
            root[find(int(j))] = find(i)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows))


def found_components(df, **how):
    return Counter(collect(simhash.simhash_dedup(df, **how), "doc_id", "fingerprint", "component_id"))


def test_simhash_odd(spark, odd_rows):
    assert found_components(docs(spark, odd_rows)) == slow_components(odd_rows)


@pytest.fixture(scope="module")
def odd_rows():
    return [*ODD, (11, "Éa B c"), (12, "Éa b C"), (13, "x"), (14, "x y")]


def test_simhash_windows():
    words = [f"w{i % 977}" for i in range(5000)]
    text = " ".join(words)
    small = lambda data, size=1: common.byte_windows(data, 100)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(simhash, "byte_windows", small)
        assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


@pytest.fixture(scope="module")
def near(real):
    rng, out = random.Random(3), [t for _, t, _ in real]
    for base in out[:3]:
        out += edited(rng, base.split(), 60)
    return list(enumerate(out))


@pytest.mark.parametrize(("most", "chance"), [(32_768, 64), (3, 64), (3, 0)])
def test_simhash_equals_all_pairs(spark, near, most, chance):
    """Also with lists that are too long at every level, so that links are found by probing, and with more positions."""
    wanted = slow_components(near)
    assert found_components(docs(spark, near), most=most, chance=chance) == wanted
    assert max(Counter(c for _, _, c in wanted).values()) > 20


def test_simhash_empty(spark):
    assert simhash.simhash_dedup(docs(spark, [])).count() == 0


def test_list_positions():
    """Every pair within three bits meets in a list at any number of positions."""
    rng = random.Random(1)
    assert [simhash.positions(n) for n in (0, 10**5, 10**6, 10**9, 10**12)] == [2, 2, 3, 4, 5]
    for m in range(2, 6):
        combos = list(itertools.combinations(range(3 + m), m))
        for _ in range(300):
            x = sum(1 << b for b in rng.sample(range(64), 3))
            assert any(all(not x >> 8 * p & 255 for p in c) for c in combos)


def test_probe_at_the_border(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(4)]
    fps = base + [b ^ sum(1 << i for i in rng.sample(range(64), k)) for b in base for k in (1, 2, 3, 4, 3)] + [base[0] ^ 1 << 63]
    signed = [(x - (x >> 63 << 64),) for x in fps]
    edges = {frozenset(r) for r in collect(simhash.probe(spark.createDataFrame(signed, "fp long")), "u", "v")}
    near = {frozenset((a[0], b[0])) for a, b in itertools.combinations(signed, 2) if ((a[0] ^ b[0]) & (2**64 - 1)).bit_count() <= 3}
    assert edges <= near

    def parts(edges):
        root = {x[0]: x[0] for x in signed}
        for _ in signed:
            for a, b in map(tuple, edges):
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert parts(edges) == parts(near)


# --- filter audit ---------------------------------------------------------------------------------
def slow_audit(rows, labels):
    """``rows``: doc_id, text, lang."""
    fails, parts = [], []
    for d, t, lang in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        copies = [e for e, u, _ in rows if (u or "") == (t or "") and e is not None and d is not None and e < d]
        own = ["A"] * (len(words) < 100) + ["B"] * (100 * len(set(words)) < 80 * len(words)) + ["C"] * (100 * len(re.findall("[A-Z]", t or "")) > 10 * len(t or "")) + ["D"] * bool(re.search("[#$%&*|]", t or "")) + ["E"] * bool(copies)
        fails.append(set(own))
        parts.append(lang or "")
    good, toxic = ({d for d, q, t in labels if (q, t)[k] == 1 and d is not None} for k in (0, 1))
    out, shapley = [], Counter()
    for part in set(parts):
        held = [(f, d in good, d in toxic) for f, p, (d, _, _) in zip(fails, parts, rows, strict=True) if p == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, x in enumerate(order):
                before = set(order[:step])
                here = [h for h in held if x in h[0] and not h[0] & before]
                shapley[part, x] += len(here)
                out.append((part, order, step + 1, sum(not h[0] & (before | {x}) for h in held), len(here), sum(x in h[0] and bool(h[0] & before) for h in held), sum(h[0] == {x} for h in held), sum(h[1] for h in here), sum(h[2] for h in here)))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


AUDIT = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_filter_audit_odd(spark):
    rows = [(d, t, [None, "", "en", "fr"][i % 4]) for i, (d, t) in enumerate(ODD)]
    rows += [(20, "SHOUT # " * 60, "en"), (21, "SHOUT # " * 60, "fr"), (19, "SHOUT # " * 60, None), (22, "Ab " * 99, "en"), (23, " ".join(f"w{i % 80}" for i in range(100)), "en"), (24, " ".join(f"w{i % 79}" for i in range(100)), "en"), (25, "A123456789", "en"), (26, "AB1234567", "en")]
    labels = [(20, 1, 0), (20, 0, 1), (6, 1, 1), (None, 1, 1), (99, 1, 0), (21, None, 1), (22, 1, None)]
    df = spark.createDataFrame([(d, t, p, "x", 1) for d, t, p in rows], "doc_id long, text string, lang string, mask string, good int")
    got = filter_audit.filter_audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(collect(got, *AUDIT)) == slow_audit(rows, labels)


def test_filter_audit_windows():
    text = ("Same words # " * 400).encode()
    whole = filter_audit.text_mask(text)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(filter_audit, "byte_windows", lambda data: common.byte_windows(data, 50))
        assert filter_audit.text_mask(text) == whole == 0b1010
    assert filter_audit.text_mask(LONG.encode()) == 0


def test_filter_audit_empty(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(docs(spark, []), labels).count() == 0
    assert filter_audit.filter_audit(docs(spark, [(1, "a")]), labels).count() == 600


# --- ranked search --------------------------------------------------------------------------------
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def slow_search(rows, items, top=50):
    held = [(d, Counter(re.findall(TERM, lowered(t)))) for d, t in rows]
    held = [(d, c) for d, c in held if c]
    n, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, set()).update(re.findall(TERM, lowered(t)))
    out = []
    for i, terms in asked.items():
        scores = []
        for d, c in held:
            m = 100 - 50 + 50 * c.total() * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(i, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def found_search(df, items, postings=1 << 21, **how):
    return sorted(collect(ranked_search.search(ranked_search.build_index(df, postings=postings), items, **how), "item_id", "rank", "doc_id", "score"), key=str)


@pytest.mark.parametrize(("postings", "block"), [(1 << 21, 256), (1, 2), (40, 1)])
def test_search_odd(spark, postings, block):
    """One shard, a shard for each document, and shards of a few; one block of queries and several."""
    rows = [*ODD, (11, "A b c-d_e Ünï5 b"), (12, "word1 WORD1 word2"), (None, "word1"), (None, "word1"), (13, "word1"), (14, "no no no 5")]
    items = [(1, "a B; word1 word1"), (2, None), (3, ""), (4, "Ünï5 no 5"), (None, "word2 b"), (1, "é c"), (5, "missing"), (6, LONG)]
    made = spark.createDataFrame([(i, t, "x", 7) for i, t in items], "item_id long, text string, doc_id string, rank int")
    assert found_search(docs(spark, rows), made, postings, block_queries=block) == slow_search(rows, items)


def test_search_many_ties(spark):
    rows = [(i % 400, "same words here" if i % 3 else "same other text") for i in range(900)]
    made = spark.createDataFrame([(1, "words"), (2, "other same"), (3, "same")], "item_id long, text string")
    assert found_search(docs(spark, rows), made, 300) == slow_search(rows, [(1, "words"), (2, "other same"), (3, "same")])


def test_search_empty(spark):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert found_search(docs(spark, []), items) == []
    assert found_search(docs(spark, [(1, "a b")]), items.limit(0)) == []


def test_packed_integers():
    rng = np.random.default_rng(1)
    x = np.concatenate([np.arange(300), rng.integers(0, 2**40, 500), [0, 127, 128, 2**14 - 1, 2**14, 2**55]])
    data, ends = ranked_search.packed(x)
    assert (ranked_search.unpacked(data) == x).all()
    assert ends[-1] == len(data)
    assert len(ranked_search.unpacked(b"")) == 0 == len(ranked_search.packed(np.zeros(0, np.int64))[0])
