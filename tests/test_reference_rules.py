"""Rules with scores, tiers and states: each table reaches every branch."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions.numbers import coerce_number
from tesserae.operators import align, citations, index, parsing, patterns, recompute, tablesql
from tesserae.plans import models
from tesserae.sources.snapshots import Store


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


# --- patterns, entities ---------------------------------------------------------------------------
@pytest.mark.parametrize(("most", "size"), [(200_000, 1 << 25), (1, 10)])
def test_contained(spark, most, size):
    texts = spark.createDataFrame([(1, "abcabc"), (2, "xbcx"), (3, None), (4, ""), (5, "bc abc")], "key int, text string")
    wanted = spark.createDataFrame([("abc",), ("bc",), ("bc",), ("",), ("zz",), (None,)], "pattern string")
    assert rows(patterns.contained(texts, wanted, most, size), "key", "pattern") == [(1, "abc"), (1, "bc"), (2, "bc"), (5, "abc"), (5, "bc")]
    assert patterns.contained(texts, wanted.limit(0)).count() == 0


@pytest.mark.parametrize("most", [200_000, 1])
def test_entities(spark, most, monkeypatch):
    monkeypatch.setattr(patterns.named_spans, "__defaults__", (most, 1 << 25))
    names = spark.createDataFrame([("New York", "place"), ("New York City", "place"), ("York City Hall", "place"), ("Café de la Paix", "place"), ("TCP", "tool"), ("tcp", "method"), ("", "x"), (None, "x"), ("City", "place")], "name string, kind string")
    texts = ["a new approach to cheese in york", "NEW YORK CITY Hall", "new-york, york city hall", "Le cafe de la paix!", "TCP/IP", None, "", "city city"]
    chunks = spark.createDataFrame([("d", f"c{i}", t) for i, t in enumerate(texts)], "doc_id string, chunk_id string, text string")
    got = models.extract_entities(chunks, names)
    spans = sorted((r["chunk_id"], r["name"], r["kind"], texts[int(r["chunk_id"][1:])][r["char_start"] : r["char_end"]]) for r in got.collect())
    assert spans == [
        ("c1", "New York City", "place", "NEW YORK CITY"),
        ("c2", "New York", "place", "new-york"),
        ("c2", "York City Hall", "place", "york city hall"),
        ("c3", "Café de la Paix", "place", "cafe de la paix"),
        ("c4", "TCP", "tool", "TCP"),
        ("c4", "tcp", "method", "TCP"),
        ("c7", "City", "place", "city"),
        ("c7", "City", "place", "city"),
    ]


# --- citations ------------------------------------------------------------------------------------
DOCS = [
    ("b", "Attention Is All You Need", ["Vaswani, Ashish", "Noam Shazeer"], dt.date(2017, 6, 12)),
    ("a", "Attention is all you need", ["X"], None),
    ("c", "Deep Learning", ["Ian Goodfellow"], dt.date(2016, 1, 1)),
    ("d", "The art of programming the machine", [], dt.date(2016, 1, 1)),
    ("e", "Notes", ["Bo Li"], dt.date(2016, 1, 1)),
    ("f", None, None, None),
]


def test_citation_tiers(spark):
    docs = spark.createDataFrame(DOCS, "doc_id string, title string, authors array<string>, date date")
    asked = [
        ("title", "see Attention is all you need, section 3", "high", None),
        ("own", "Attention is all you need", "high", "a"),
        ("part", "is all you need", "medium", None),
        ("short part", "all you", "low", None),
        ("years", "as in Goodfellow, 2016 and others", "low", None),
        ("two authors", "Vaswani & Shazeer 2017", "high", None),
        ("year over part", "deep learning (Li 2016)", "high", None),
        ("tokens", "programming machine art", "high", None),
        ("too few", "programming machine", "high", None),
        ("two of three", "learning is deep, they say", "high", None),
        ("none", "nothing of this", "high", None),
        ("blank", "  ", "high", None),
        ("tie", "li 2016; goodfellow 2016", "high", None),
    ]
    df = spark.createDataFrame(asked, "citation_id string, surface_text string, confidence string, skip_doc_id string")
    for most in (200_000, 1):
        got = {r["citation_id"]: (r["doc_id"], r["via"], round(r["score"], 2), r["confidence"]) for r in citations.resolve(df, docs, most).collect()}
        assert {k: v[:3] for k, v in got.items()} == {
            "title": ("a", "title", 0.95),
            "own": ("b", "title", 0.95),
            "part": ("a", "title", 0.88),
            "years": ("c", "author_year", 0.90),
            "two authors": ("b", "author_year", 0.90),
            "year over part": ("c", "title", 0.95),
            "tokens": ("d", "tokens", 0.78),
            "two of three": ("c", "tokens", 0.75),
            "tie": ("c", "author_year", 0.90),
        }
        assert math.isclose(got["part"][3], (0.68 + 0.88) / 2)


# --- alignment ------------------------------------------------------------------------------------
DECK = [[1.0, 0, 0], [0, 1.0, 0], [0, 0, 1.0]]


def aligned(spark, chunks, deck=DECK, **how):
    t = spark.createDataFrame([("p", i, [float(x) for x in c[0]], *c[1:], *[None] * (5 - len(c))) for i, c in enumerate(chunks)], "pair_id string, pos long, vector array<double>, start_s double, end_s double, frame_pos long, frame_score double")
    d = spark.createDataFrame([("p", j, [float(x) for x in v], j + 1) for j, v in enumerate(deck)], "pair_id string, pos long, vector array<double>, page long")
    return [(r["page"], round(r["score"], 2)) for r in align.align(t, d, **how).orderBy("chunk_pos").collect()]


@pytest.mark.parametrize(
    ("chunks", "how", "pages"),
    [
        ([[[0.0, 1, 0]], [[0.71, 0.0, 0.70]]], {"method": "greedy"}, [2, 3]),  # a near tie goes forward
        ([[[0.0, 1, 0]], [[0.97, 0.0, 0.2]]], {"method": "greedy"}, [2, 1]),  # a clear step back does not
        ([[[0.3, 0.3, 0.3]]], {"method": "greedy", "floor": 0.7}, [None]),
        ([[[1.0, 0, 0], None, None, 1, 0.88], [[0.71, 0.0, 0.70]]], {"method": "greedy"}, [2, 3]),  # a frame is taken as it is, and leads on
        ([[[0.71, 0.0, 0.70]]], {"method": "greedy"}, [1]),  # nothing to go on from
        ([[[0.0, 1, 0]]], {"time": 0.0}, [2]),
        ([[[0.0, 1, 0]], [[0.73, 0.0, 0.68]]], {"method": "greedy"}, [2, 1]),
        ([[[0.0, 1, 0]], [[0.73, 0.0, 0.68]]], {"time": 0.0, "jump": 0.1}, [2, 3]),  # back costs twice as much as forward
        ([[[0.72, 0.0, 0.70], 90.0, 120.0]], {"jump": 0.0, "time": 0.2}, [3]),  # late in the lecture
        ([[[1.0, 0, 0], None, None, 1, 0.9], [[0.71, 0.0, 0.70]]], {"time": 0.0}, [2, 3]),
        ([[[1.0, 0, 0]], [[0.3, 0.3, 0.3]], [[0.0, 1, 0]]], {"floor": 0.6, "time": 0.0}, [1, None, 2]),
    ],
)
def test_alignment_rules(spark, chunks, how, pages):
    assert [p for p, _ in aligned(spark, chunks, **how)] == pages


def test_alignment_scores(spark):
    assert aligned(spark, [[[0.3, 0.3, 0.3]]], floor=0.7) == [(None, 0.58)] == aligned(spark, [[[0.3, 0.3, 0.3]]], floor=0.7, method="greedy")
    assert aligned(spark, [[[1.0, 0, 0], None, None, 2, 0.93]]) == [(3, 0.93)]
    assert aligned(spark, [[[1.0, 0, 0]], [[0.0, 1, 0]]], []) == [(None, 0.0), (None, 0.0)]


def test_best_path_equals_brute_force():
    """All sequences of pages and gaps, scored one by one."""
    from itertools import product

    rng = np.random.default_rng(3)
    for _ in range(25):
        s = rng.random((4, 3))
        prior = align.time_prior(np.array([0.0, 10, 20, 30]), np.array([10.0, 20, 30, 40]), 3)

        def value(path, s=s, prior=prior):
            total, last = 0.0, None
            for i, k in enumerate(path):
                if k is None:
                    total += 0.5
                    continue
                total += s[i, k] - prior[i, k] - (0 if last in (None, k) else 0.1 if k > last else 0.2)
                last = k
            return total

        best = max(product([None, 0, 1, 2], repeat=4), key=value)
        assert math.isclose(value(align.best_path(s, 0.5, 0.1, prior)), value(best))


def test_documents_are_aligned_and_kept(spark, tmp_path):
    unit = lambda i: [1.0 if j == i else 0.0 for j in range(3)]
    chunks = [("talk", f"t{i}", i, None, 10.0 * i, 10.0 * i + 10, unit(i)) for i in range(3)] + [("deck", f"s{i}", i, i + 1, None, None, unit(i)) for i in range(3)] + [("flat", "f", 0, None, None, None, unit(0))]
    df = spark.createDataFrame(chunks, "document_id string, chunk_id string, char_start int, page long, start_s double, end_s double, vector array<double>")
    pairs = lambda *p: spark.createDataFrame(list(p), "transcript_doc string, deck_doc string")
    for pair, why in ((("x", "deck"), "transcript is not"), (("talk", "x"), "deck is not"), (("talk", "flat"), "no pages")):
        with pytest.raises(align.NotAligned, match=why):
            align.align_documents(pairs(("talk", "deck"), pair), df)
    frames = spark.createDataFrame([("t0", unit(1)), ("t1", [0.6, 0.6, 0.5])], "chunk_id string, vector array<double>")
    out = align.align_documents(pairs(("talk", "deck")), df, frames)
    assert rows(out, "transcript_chunk_id", "deck_chunk_id", "page") == [("t0", "s1", 2), ("t1", "s1", 2), ("t2", "s2", 3)]
    store = Store(spark, f"file://{tmp_path}/s")
    assert align.saved(store) is None
    align.save(store, out)
    align.save(store, out.withColumn("deck_doc", F.lit("deck2")))
    align.save(store, out.filter("page = 3"))
    assert [len(r["blocks"]) for r in align.saved(store, "talk", "deck").collect()] == [1]
    assert rows(align.saved(store, "talk"), "deck_doc") == [("deck",), ("deck2",)]
    assert rows(align.saved(store, "deck2"), "transcript_doc") == [("talk",)]
    assert align.delete(store, "talk", "deck")
    assert not align.delete(store, "talk", "deck")
    assert rows(align.saved(store), "deck_doc") == [("deck2",)]


# --- scopes ---------------------------------------------------------------------------------------
def test_artifact_scopes(spark):
    def hits(ref, token, doc, n, title="t", score=1.0):
        return [(ref, token, doc, title, score)] * n

    h = (
        hits("dominant", "coupe", "a", 2) + hits("dominant", "feu", "a", 2) + hits("dominant", "feu", "b", 2)
        + hits("set", "coupe", "a", 4) + hits("set", "feu", "b", 3) + hits("set", "feu", "c", 2)
        + hits("titled", "coupe", "a", 3) + hits("titled", "feu", "b", 2, "pare-feu réseau")
        + hits("spread", "x", "a", 3) + hits("spread", "y", "b", 3) + hits("spread", "y", "c", 3)
        + hits("weak", "x", "a", 1) + hits("weak", "x", "b", 1)
        + hits("single", "tsmc", "a", 4) + hits("single", "tsmc", "b", 1)
        + hits("single titled", "reseau", "a", 4, "cr350-Réseau") + hits("single titled", "reseau", "b", 1)
        + hits("only", "gantt", "a", 2)
        + hits("sibling", "feu", "a", 6, "feu lecture") + hits("sibling", "coupe", "b", 2, "coupe diagram") + hits("sibling", "coupe", "c", 3, "other")
        + hits("tie", "x", "b", 3, score=2.0) + hits("tie", "y", "a", 3, score=1.0)
        + hits("none", "x", "a", 5)
    )
    tokens = {"single": ["tsmc"], "single titled": ["réseau"], "only": ["gantt"], "spread": ["x", "y"], "weak": ["x", "y"], "tie": ["x", "y"], "none": [], "silent": ["q", "r"]}
    refs = sorted({x[0] for x in h} | {"silent"})
    q = spark.createDataFrame([(r, tokens.get(r, ["coupe", "feu"])) for r in refs], "ref_id string, tokens array<string>")
    df = spark.createDataFrame(h, "ref_id string, token string, doc_id string, title string, score double")
    assert {r["ref_id"]: (r["doc_ids"], r["via"]) for r in index.artifact_scopes(df, q).collect()} == {
        "dominant": (["a"], "dominant"),
        "set": (["a", "b"], "small-set"),
        "titled": (["a", "b"], "small-set"),
        "spread": ([], "none-spread"),
        "weak": ([], "none-weak"),
        "silent": ([], "none-weak"),
        "single": ([], "none-singletoken-ambiguous"),
        "single titled": (["a"], "dominant"),
        "only": (["a"], "dominant"),
        "sibling": (["a", "b"], "dominant"),
        "tie": (["b", "a"], "small-set"),
        "none": ([], "none-no-qualifier"),
    }


# --- routing, refusals ----------------------------------------------------------------------------
SIGNALS = "name string, creator string, producer string, chars_per_page double, chars_p90 double, aspect double, image_area double, image_pages double, empty_pages double, broken_chars double, fonts int, tagged boolean, has_headings boolean, has_tables boolean, has_lists boolean, has_code boolean"


def test_routes(spark):
    base = {"creator": None, "producer": None, "chars_per_page": 400.0, "chars_p90": 500.0, "aspect": 0.7, "image_area": 0.0, "image_pages": 0.0, "empty_pages": 0.0, "broken_chars": 0.0, "fonts": 0, "tagged": False, "has_headings": False, "has_tables": False, "has_lists": False, "has_code": False}
    mixed = {"image_area": 0.35, "image_pages": 0.30}
    cases = {
        "deck": ({"aspect": 1.4, "creator": "Microsoft PowerPoint"}, ("slide-deck", 0.10, "0.5-slide-deck", False)),
        "deck of charts": ({"aspect": 1.4, "chars_per_page": 900.0, "image_area": 0.2}, ("slide-deck", 0.10, "0.5-slide-deck", False)),
        "mixed deck": ({"aspect": 1.4, **mixed}, ("slide-deck-mixed", 0.10, "0.5-slide-deck-mixed", True)),
        "wide text": ({"aspect": 1.4, "chars_per_page": 900.0}, ("slide", 0.85, "4", False)),
        "born digital": ({"producer": "pdfTeX"}, ("born-digital", 0.98, "1.A", False)),
        "born mixed": ({"producer": "pdfTeX", **mixed}, ("mixed-content", 0.20, "1.A-mixed", True)),
        "born and scanned": ({"creator": "Word", "producer": "ABBYY"}, ("born-digital", 0.98, "1.A", False)),
        "scan": ({"producer": "ABBYY FineReader"}, ("scan", 0.0, "1.B", True)),
        "scanned deck": ({"aspect": 1.4, "producer": "Tesseract"}, ("scan", 0.0, "1.B", True)),
        "rasterised": ({"creator": "Keynote", "chars_per_page": 3.0}, ("born-digital-but-rasterised", 0.10, "1.C", True)),
        "tagged": ({"tagged": True}, ("tagged-pdf", 0.90, "2", False)),
        "tagged mixed": ({"tagged": True, **mixed}, ("mixed-content", 0.20, "2-mixed", True)),
        "fonts": ({"fonts": 3}, ("fonted-born-digital", 0.85, "2", False)),
        "images": ({"image_pages": 0.6, "chars_per_page": 60.0}, ("image-heavy", 0.15, "2", True)),
        "mojibake": ({"broken_chars": 0.06}, ("mojibake", 0.10, "3", False)),
        "scan-like": ({"chars_per_page": 5.0, "chars_p90": 20.0}, ("scan-like", 0.0, "3", True)),
        "empty": ({"empty_pages": 0.6}, ("mostly-empty", 0.15, "3", True)),
        "paper": ({"has_headings": True, "has_tables": True}, ("paper", 0.65, "4", False)),
        "paper mixed": ({"has_headings": True, **mixed}, ("mixed-content", 0.20, "4-mixed", True)),
        "paper thin mixed": ({"chars_per_page": 100.0, **mixed}, ("paper", 0.125, "4", False)),
        "square": ({"aspect": 1.1, "chars_per_page": 100.0, "has_lists": True, "has_code": True}, ("unknown", 0.35, "4", False)),
        "capped": ({"chars_per_page": 5000.0, "has_headings": True, "has_tables": True, "has_lists": True, "has_code": True}, ("paper", 1.0, "4", False)),
    }
    names = [c.split()[0] for c in SIGNALS.split(", ")][1:]
    df = spark.createDataFrame([(k, *[(base | v)[n] for n in names]) for k, (v, _) in cases.items()], SIGNALS)
    got = {r["name"]: (r["doc_type"], round(r["confidence"], 6), r["tier"], r["needs_ocr"]) for r in parsing.route(df).collect()}
    assert got == {k: w for k, (_, w) in cases.items()}


def test_refusals(spark):
    reasons = [None, "", "No relevant content found in the vault.", "The sufficiency check failed: x", "The retrieved material addresses a related topic", "I drafted an answer but couldn't ground it", "Verification returned no grounded claims", "I exceeded my reasoning budget", "I couldn't construct a confident answer", "It says No relevant content found in the vault"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(reasons)], "i int, r string")
    got = [r[0] for r in df.orderBy("i").select(parsing.refusal_cause(F.col("r"))).collect()]
    assert got == ["answered", "answered", "assess-empty", "assess-failclosed", "relevance", "verify-zero", "compose-zero", "over-budget", "catch-all", "sufficiency-model"]
    runs = [("a", False, (0, 0)), ("b", False, (1, 1)), ("c", False, (0, 1)), ("d", True, (1, 1)), ("e", True, (1, 0))]
    table = spark.createDataFrame([(q, s, bool(r)) for q, s, rs in runs for r in rs], "query_id string, should_refuse boolean, refused boolean")
    assert rows(parsing.run_verdicts(table), "query_id", "verdict") == [("a", "correct-answer"), ("b", "FALSE-REFUSAL-deterministic"), ("c", "FALSE-REFUSAL-flaky"), ("d", "correct-refusal"), ("e", "FALSE-ANSWER")]


# --- table questions ------------------------------------------------------------------------------
def test_column_is_in_the_question():
    assert tablesql.grounded("total value of fees earned or paid in cash", "Fees Earned or Paid in Cash ($)")
    assert not tablesql.grounded("total value of stock options", "Stock Awards ($)")
    assert tablesql.grounded("how many award were there", "Awards 2024")
    assert tablesql.grounded("what do directors' fee sum to", "Fees")
    assert tablesql.grounded("anything", "Total ($)")
    assert tablesql.grounded("", "Stock Awards")


CELLS = ["$1,200", "(300)", "2.5K", "($ -4)", "5%", "- 7", "1 million", "2 m", "3m", "", None, "x", "1.2.3", "€ 9", "£-9", "+1", "1,", ",", ".5", "5.", "1e5", "12,34", "(1", "$", "-$5", "--4", "5 %", "7thousand", "1.5 billion%"]


def test_two_readings_of_numbers_agree(spark):
    df = spark.createDataFrame([(c,) for c in CELLS], "c string")
    first = [r[0] for r in df.select(coerce_number(F.col("c"))).collect()]
    again = [None if c is None or (x := recompute.read_number(c)) is None else float(x) for c in CELLS]
    assert dict(zip(CELLS, again, strict=True)) == dict(zip(CELLS, first, strict=True))


def test_disagreement_is_refused(spark):
    t = tablesql.load(spark, ["Name", "Net Sales"], [["a", "$1,200"], ["b", "(300)"], ["c", "2.5K"], ["d", ""]]).repartition(3)
    names = ["name", "net_sales"]
    for sql, value in (("SELECT SUM(net_sales) FROM t", 3400.0), ("SELECT AVG(net_sales) FROM t WHERE name != 'c'", 450.0), ("SELECT MIN(net_sales) FROM t", -300.0), ("SELECT MAX(net_sales) FROM t", 2500.0), ("SELECT COUNT(net_sales) FROM t", 3.0), ("SELECT COUNT(*) FROM t", 4.0), ("SELECT SUM(net_sales) FROM t WHERE name = 'z'", None)):
        assert rows(tablesql.query(t, sql, names), "value") == [(value,)]
    wrong = lambda cell: recompute.read_number(cell.replace("K", ""))  # noqa: E731  an arm that forgets the scale
    assert rows(tablesql.query(t, "SELECT SUM(net_sales) FROM t", names, read=wrong), "value") == [(None,)]
    spoilt = t.withColumn("net_sales__num", F.col("net_sales__num") + 10)
    assert rows(tablesql.query(spoilt, "SELECT SUM(net_sales) FROM t", names), "value") == [(None,)]
    assert rows(tablesql.contributing(t, "SELECT SUM(net_sales) FROM t WHERE net_sales > 0", names), "row_no", "name") == [(0, "a"), (2, "c")]
    header = ["Name", "Net Sales"]
    assert rows(tablesql.query(t, "SELECT SUM(net_sales) FROM t", names, "what are the net sales", header), "value") == [(3400.0,)]
    with pytest.raises(tablesql.Refused):
        tablesql.query(t, "SELECT SUM(net_sales) FROM t", names, "what is the gross margin", header)
