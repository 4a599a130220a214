from __future__ import annotations

import math

from pyspark.sql import functions as F

from tesserae.operators import audits as A
from tesserae.operators import evals as E


def test_entities_and_expansion(spark):
    m = spark.createDataFrame([("d1", 1, "A b", "concept"), ("d2", 1, "A b", "concept"), ("d3", 2, "P", "person"), ("d4", 2, "P", "person")], "doc_id string, entity_id int, name string, kind string")
    assert A.entity_set_metrics(m).first()[:4] == (2, 0.5, 0.0, math.log(2) * (1 + 0.25) / 2)
    assert sorted(map(tuple, A.kind_histogram(m).collect())) == [("concept", 1), ("person", 1)]
    hits = spark.createDataFrame([("c1", "d1", 1)], "chunk_id string, document_id string, rank int")
    chunks = spark.createDataFrame([(f"c{d}{i}", f"d{d}", i, "fox text") for d in (1, 2, 3) for i in range(3)], "chunk_id string, document_id string, char_start int, text string")
    assert sorted(r["chunk_id"] for r in A.expand_by_graph(hits, m, chunks).collect()) == ["c20", "c21"]
    assert [r[0] for r in A.anchor_labels(chunks, "fox text", "d1", k=9).collect()] == ["c10"]


def test_entity_sets_are_judged(spark):
    schema = "doc_id string, entity_id int, name string, kind string"
    old = [("a", 1, "TCP", "tool"), ("b", 1, "TCP", "tool"), ("a", 2, "the", "concept"), ("c", 3, "8080", "other"), ("c", 4, "Ada Byron", "person"), ("d", 5, "?", "concept"), ("a", 6, "x", "place"), *[(d, 7, "Network", "concept") for d in "abcd"]]
    got = A.entity_set_metrics(spark.createDataFrame(old, schema)).first()
    assert (got["entities"], got["pairs"]) == (7, 11)
    assert math.isclose(got["noise_rate"], 4 / 7)
    assert math.isclose(got["generic_rate"], 1 / 7)
    assert math.isclose(got["topical_rate"], 4 / 7)
    assert math.isclose(got["proper_rate"], 2 / 7)
    assert math.isclose(got["specificity"], (math.log(2) + math.log(4) * (1 + 0.5 + 0.25 + 1 + 0.25)) / 7)
    hard = A.entity_set_metrics(spark.createDataFrame(old, schema), A.HARD).first()
    assert (hard["entities"], hard["noise_rate"], hard["generic_rate"]) == (4, 0.5, 0.25)
    new = spark.createDataFrame([r for r in old if r[1] in (1, 3, 4, 5, 6)], schema)
    verdict = A.better_entities(A.entity_set_metrics(spark.createDataFrame(old, schema)), A.entity_set_metrics(new)).first()
    assert not verdict["better"]  # more noise
    clean = spark.createDataFrame([r for r in old if r[1] in (1, 4, 6)] + [("a", 8, "UDP", "tool"), ("b", 9, "OSPF", "tool"), ("d", 10, "BGP", "tool")], schema)
    assert A.better_entities(A.entity_set_metrics(spark.createDataFrame(old, schema)), A.entity_set_metrics(clean)).first()["better"]


def test_fabricated_quotes_and_unique_openers(spark):
    row = spark.createDataFrame([("He said:  Big C++ Day, Ann\\E b. Annex", ["big c++ day here"], ["Big C++ day", "Ann", "Ann\\E b", "nex", "", "he SAID"])], "a string, e array<string>, b array<string>")
    assert row.select(E.fabricated_quotes(F.col("a"), F.col("e"), F.col("b"))).first()[0] == ["Ann", "Ann\\E b", "he SAID"]
    long = [f"w{k}" for k in range(9)]
    texts = [("r", "x", long), ("r", "x", [*long[:8], "other"]), ("r", "x", ["q"]), ("r", " \n", []), ("r", "of", []), ("s", " ", [])]
    got = E.unique_openers(spark.createDataFrame(texts, "g string, t string, k array<string>"), "g", "t", "k").collect()
    assert {r["g"]: r["unique_openers"] for r in got} == {"r": 0.75, "s": 1.0}


def test_scores_and_framing(spark):
    df = spark.createDataFrame([("# A\n$x$ b", "# A\n$y$ b")], "r string, f string")
    s = A.parse_quality(F.col("r"), F.col("f"))
    got = df.select(*[v.alias(k) for k, v in s.items()], A.within_thresholds(s, {"cer": 0.5}, {"heading_f1": 1.0}).alias("ok")).first()
    assert (got["heading_f1"], got["equation_f1"], got["wer"], got["ok"]) == (1.0, 0.0, 0.25, True)
    assert A.frame_result("S", ["a", "b"], [["1", "2"]], 3.0) == "SQL: S\nResult: 3\na=1; b=2"
    e = spark.createDataFrame([(1, "x")], "query_id int, chunk_id string")
    a = spark.createDataFrame([(1, "x"), (1, "y")], "query_id int, chunk_id string")
    assert [tuple(r) for r in A.unresolved_citations(a, e).collect()] == [(1, "y")]
    f = spark.createDataFrame([("d", 1, "flow_chart", 0.9, 3e4), ("d", 2, "logo", 0.9, 3e4), ("d", 3, "screenshot", 0.1, 3e4), ("d", 4, "flow_chart", 0.9, 2500.0)], "doc_id string, page int, picture_class string, confidence double, area double")
    assert [tuple(r) for r in A.diagram_pages(f).collect()] == [("d", 1)]


def test_paragraphs_and_headers():
    assert A.group_paragraphs([True, False, True, True, False], 2) == [[0, 1, 2], [3, 4]]
    assert A.group_paragraphs([True, False, False], 2) == [[0, 1], [2]]
    assert A.reattach_header(["a", "b"], [["x", "1", "2"]]) == ["", "a", "b"]
    assert A.reattach_header(["a"], [["x", "1", "2"]]) is None
