from __future__ import annotations

import datetime as dt
import io
import sqlite3
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import evals, fulltext, graph, index, parsing, tablesql, vectors
from tesserae.plans.api import Corpus
from tesserae.plans.models import hashing_embedder
from tesserae.sources import files, vault
from tesserae.streaming import breaker, events


def rows(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]


TEXTS = ["the quick brown fox", "the lazy dog, the end", "Été quick quick_fox", "a fox and a dog and a fox and a dog", ""]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([(f"c{i}", "d0" if i < 2 else "d1", "T", t, i, ["H"]) for i, t in enumerate(TEXTS)], "chunk_id string, document_id string, document_title string, text string, char_start int, heading_path array<string>")


@pytest.mark.parametrize("phrase", ["fox", "quick_fox", "a fox and a", "the", "ete"])
def test_bm25_equals_sqlite(chunks, phrase):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(id UNINDEXED, text, tokenize = 'unicode61 remove_diacritics 2')")
    db.executemany("INSERT INTO f VALUES (?, ?)", [(f"c{i}", t) for i, t in enumerate(TEXTS)])
    wanted = {i: -s for i, s in db.execute("SELECT id, bm25(f) FROM f WHERE f MATCH ?", (f'"{phrase}"',))}
    got = dict(rows(fulltext.search(chunks, [phrase], 10)))
    assert got.keys() == wanted.keys()
    assert all(abs(got[k] - v) < 1e-9 for k, v in wanted.items())


def test_bm25_filter_keeps_statistics(chunks):
    every = dict(rows(fulltext.search(chunks, ["fox"], 10)))
    some = dict(rows(fulltext.search(chunks, ["fox"], 10, only=F.col("document_id") == "d1")))
    assert some == {k: v for k, v in every.items() if k in ("c2", "c3")}
    assert rows(fulltext.search(chunks, ["  \x00"], 5)) == []
    assert fulltext.clean_query("a\nb ") == "ab"


def test_fusion_ties_keep_first_appearance(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "chunk_id string, rank int")
    b = spark.createDataFrame([("z", 1), ("x", 3)], "chunk_id string, rank int")
    assert [r[0] for r in rows(vectors.rrf([a, b]), "chunk_id")] == ["x", "z", "y"]
    assert rows(vectors.carry(a, b).orderBy("rank")) == [("x", 1), ("y", 2), ("z", 3)]


def test_related_and_bridges(spark):
    m = spark.createDataFrame([("d1", 1, "A", "concept"), ("d2", 1, "A", "concept"), ("d1", 2, "P", "person"), ("d3", 2, "P", "person"), ("d4", 3, "Z", "tool"), ("d5", 3, "Z", "tool")], "doc_id string, entity_id int, name string, kind string")
    seed = spark.createDataFrame([("d1",)], "doc_id string")
    got = rows(graph.related(m, seed).orderBy("rank"), "doc_id", "score", "shared_entities")
    assert got == [("d2", round(np.log(5 / 2), 4), ["A"]), ("d3", round(np.log(5 / 2) / 4, 4), ["P"])]
    assert rows(graph.bridges(m, seed), "entity", "doc_count", "strength")[0] == ("A", 1, round(float(np.log(5 / 2) * np.log(2)), 4))


def test_citation_paths_with_a_cycle(spark):
    c = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "x"), ("x", "c"), ("c", "d"), ("d", "e")], "src string, dst string")
    seed = spark.createDataFrame([("a",)], "doc_id string")
    got = {r["doc_id"]: r["path"] for r in graph.citation_paths(c, seed, 3).collect()}
    assert got == {"b": ["a", "b"], "x": ["a", "x"], "c": ["a", "b", "c"], "d": ["a", "b", "c", "d"]}


def test_suggestions_need_one_name(spark):
    schema = "entity_id string, name string, kind string, doc_count int, relation string"
    one = spark.createDataFrame([("1", "Domain Name System", "concept", 3, "expansion"), ("2", "domain name system", "tool", 2, "expansion"), ("3", "Rare", "tool", 1, "expansion")], schema)
    assert rows(graph.suggestions(one, 10, []), "name", "doc_count") == [("Domain Name System", 3)]
    assert rows(graph.suggestions(one.union(spark.createDataFrame([("4", "Other", "tool", 2, "expansion")], schema)), 10, [])) == []


def test_diff_and_rebuild(spark):
    a, b = (spark.createDataFrame([(x,) for x in s], "chunk_id string") for s in ("xy", "yz"))
    assert dict(rows(index.diff(a, b))) == {"x": "delete", "y": "keep", "z": "add"}
    assert dict(rows(index.diff(a, b, F.lit(True)))) == {"x": "delete", "y": "add", "z": "add"}


def table(spark):
    return tablesql.load(spark, ["Name", "Net Sales", "2024", "2024"], [["a", "$1,200", "5", ""], ["B", "(300)", "", "x"], ["c", "2.5K", "7", "y"]])


NAMES = ["name", "net_sales", "c_2024", "c_2024_c"]


@pytest.mark.parametrize(
    ("sql", "value"),
    [
        ("SELECT SUM(net_sales__num) FROM t", 3400.0),
        ("select count(*) from t where name = 'b'", 1.0),
        ("SELECT COUNT(c_2024) FROM t", 2.0),
        ("SELECT COUNT(*) FROM t WHERE c_2024 != 5", 2.0),
        ("SELECT COUNT(*) FROM t WHERE c_2024 IS NULL OR c_2024 > 6", 2.0),
        ("SELECT MAX(net_sales) FROM t WHERE net_sales BETWEEN -500 AND 2000", 1200.0),
        ("SELECT COUNT(*) FROM t WHERE name NOT IN ('a', 'z') AND name LIKE '_'", 2.0),
        ("SELECT AVG(c_2024__num) FROM t;", 6.0),
    ],
)
def test_guarded_sql(spark, sql, value):
    assert rows(tablesql.query(table(spark), sql, NAMES)) == [(value,)]


@pytest.mark.parametrize("sql", ["DELETE FROM t", "SELECT * FROM t; SELECT 1", "SELECT name FROM t", "SELECT SUM(DISTINCT c_2024) FROM t", "SELECT * FROM t WHERE name = 'drop'", "SELECT * FROM t WHERE x IN (SELECT 1)", "SELECT SUM(c_2024) FROM t GROUP BY name", "SELECT SUM(nope) FROM t", "SELECT COUNT(*) FROM t WHERE abs(c_2024) = 1"])
def test_refused_sql(spark, sql):
    with pytest.raises(tablesql.Refused):
        tablesql.query(table(spark), sql, NAMES)


def test_ambiguous_cells_give_no_aggregate(spark):
    t = tablesql.load(spark, ["a"], [["1,2,3"], ["4"]])
    assert rows(tablesql.query(t, "SELECT SUM(a) FROM t", ["a"])) == [(None,)]
    assert tablesql.identifiers(["2024", "A b", "a-b", "a.b", ""]) == ["c_2024", "a_b", "a_b_c", "a_b_c_x", "col"]


def test_metrics(spark):
    df = spark.createDataFrame([("a b c d", "a x c", [1.0, 0.0, 1.0])], "r string, f string, g array<double>")
    got = df.select(evals.wer(F.col("r"), F.col("f")), evals.mrr_at_k(F.col("g"), 2), evals.average_precision(F.col("g"), F.lit(2)), evals.ndcg_at_k(F.col("g"), 3)).first()
    assert got[0] == 0.5
    assert got[1] == 1.0
    assert abs(got[2] - (1 + 2 / 3) / 2) < 1e-9
    assert abs(got[3] - (1 + 0.5) / (1 + 1 / np.log2(3))) < 1e-9
    a = spark.createDataFrame([("The answer is 45 percent, may be.", [["45%", "45 percent"], ["no"], []], ["answer is"], [45_000.0])], "t string, g array<array<string>>, f array<string>, b array<double>")
    assert a.select(evals.mention_recall(F.col("t"), F.col("g")), F.size(evals.asserted(F.col("t"), F.col("f")))).first()[:] == (1 / 3, 1)


def test_repair_is_unique(spark):
    claims = spark.createDataFrame([("d#abcd",), ("d#abxx",), ("q",)], "claim_id string")
    known = spark.createDataFrame([("d#abcd",), ("d#abce",), ("d#zzzz",)], "chunk_id string")
    assert dict(rows(evals.unique_min_repair(claims, known))) == {"d#abcd": "d#abcd", "d#abxx": None, "q": None}


def test_formats(spark):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", "x")
        z.writestr("word/vbaProject.bin", "x")
    data = [("a.pdf", b"%PDF-1.7"), ("b.docx", buf.getvalue()), ("c.html", b"<html>"), ("d.mp3", b"ID3\x03\x00\x01"), ("e.txt", b"ID3 tags are"), ("f.png", b"\x89PNG\r\n\x1a\n"), ("g.mp4", b"\0\0\0\x18ftypisom\0\0\0\0"), ("h.m4a", b"\0\0\0\x18ftypM4A \0\0\0\0"), ("i.md", b"# x"), ("j.rs", b"fn x(){}"), ("k.bin", b"\x00\x01"), ("l.txt", ("a" + "é" * 2048).encode()), ("m", b"")]
    df = spark.createDataFrame([(f"/v/{n}", n.split(".")[0], n.partition(".")[2], len(b), b) for n, b in data], "path string, stem string, suffix string, length long, content binary")
    got = {r["stem"]: (r["kind"], r["rejection_reason"]) for r in files.ingest(df).collect()}
    assert got == {"a": ("pdf", None), "b": ("docx", "macros"), "c": ("html", None), "d": ("audio", None), "e": ("text", None), "f": ("image", None), "g": ("video", None), "h": ("audio", None), "i": ("md", None), "j": ("code", None), "k": ("unknown", "unknown format"), "l": ("text", None), "m": ("text", "empty")}


def test_vault(spark, tmp_path):
    docs = tmp_path / "documents"
    docs.mkdir()
    (docs / "a.md").write_text("---\ntitle: \"Alpha\"\nauthors: [Ann, Bo]\ndate: 2024-05-01\ntags:\n- x\n- y\nmood: calm\n---\nbody of a\n")
    (docs / "b.md").write_text("no front matter")
    got = {r["doc_id"]: r for r in vault.scan(spark, str(tmp_path)).collect()}
    f = got["a"]["frontmatter"]
    assert (f["title"], f["authors"], f["date"], f["tags"], f["custom"]) == ("Alpha", ["Ann", "Bo"], dt.date(2024, 5, 1), ["x", "y"], {"mood": "calm"})
    assert (got["a"]["body"], got["b"]["body"], got["b"]["frontmatter"]["title"]) == ("body of a\n", "no front matter", None)
    assert dict(rows(vault.titles(spark, str(tmp_path)))) == {"a": "Alpha", "b": "b"}
    table = vault.scan(spark, str(tmp_path)).select("doc_id", "body", "content_sha256")
    assert {r["doc_id"] for r in vault.write_document(table, "c", "new").collect()} == {"a", "b", "c"}
    with pytest.raises(vault.StaleDocument):
        vault.write_document(table, "a", "x", expected_sha="stale")


def test_scopes_and_turns(spark):
    s = spark.createDataFrame([], "name string, name_key string, doc_ids array<string>")
    s = vault.save_scope(vault.save_scope(s, "My  Set", ["b", "a", "b"]), "Two", ["c", "a"])
    assert rows(vault.resolve_scopes(s, ["two", "MY set"]).orderBy("pos"), "doc_id") == [("c",), ("a",), ("b",)]
    t = spark.createDataFrame([("x", i, "user", str(i)) for i in range(6)], "conv_id string, turn long, role string, text string")
    assert sorted(rows(vault.recent_turns(vault.append_turn(t, "x", "user", "new")), "turn", "older")) == [(3, 3), (4, 3), (5, 3), (6, 3)]


def test_parse_steps(spark):
    lines = spark.createDataFrame([("d", p, n, "FOOT" if n == 5 else f"l{p}{n}") for p in range(1, 5) for n in range(1, 6)], "doc_id string, page int, line_no int, text string")
    found = parsing.furniture(lines)
    assert rows(found) == [("d", "FOOT")]
    assert parsing.without_furniture(lines, found).count() == 16
    md = spark.createDataFrame([("<!-- image -->\n\nBar chart\n\nx &amp;lt; y  ",)], "t string")
    assert md.select(parsing.clean_markdown(F.col("t"))).first()[0] == "<!-- image: kind=bar-chart -->\n\nx < y"
    h = spark.createDataFrame([(["A", "A", "B"],)], "c array<string>")
    assert h.select(parsing.merge_header(F.col("c"))).first()[0] == "A B"


def test_streams(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    src = tmp_path / "in"
    spark.createDataFrame([(i, dt.datetime(2024, 1, 1, i), 1, "click", 1.0) for i in range(4)], schema).write.parquet(str(src))
    stream = events.read_events(spark, str(src), schema)
    events.publish(stream, str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    q = events.windowed(stream, "2 hours", ["event_type"]).writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["n_events"] for r in spark.table("w").collect()) == [2, 2]


def test_watch(spark, tmp_path):
    (tmp_path / "documents").mkdir()
    (tmp_path / "manifests").mkdir()
    (tmp_path / "documents" / "a.md").write_text("new")
    (tmp_path / "manifests" / "a.json").write_text('{"doc_id": "a", "content_sha256": "old"}')
    seen = []
    events.watch(spark, str(tmp_path), lambda df, _: seen.extend(r["doc_id"] for r in df.collect()), str(tmp_path / "ck")).awaitTermination(60)
    assert seen == ["a"]


def test_breaker():
    now = [0.0]
    b = breaker.Breaker(2, 60, lambda: now[0])

    def fail():
        raise KeyError

    for _ in range(2):
        with pytest.raises(KeyError):
            b.call(fail)
    with pytest.raises(breaker.Open):
        b.call(int)
    now[0] = 61
    assert b.state == "half-open"
    assert b.call(int) == 0
    assert b.state == "closed"


def test_ask_and_refuse(chunks):
    corpus = Corpus(chunks.withColumn("vector", hashing_embedder(F.col("text"))))
    got = corpus.ask("quick brown fox", top_k=2)
    assert not got["refused"]
    assert got["claims"][0]["chunk_id"] in got["evidence"]
    assert corpus.ask("zzz qqq", top_k=1)["refused"]
    assert {r[0] for r in rows(corpus.search("fox", 2, ["d1"]), "chunk_id")} == {"c2", "c3"}
