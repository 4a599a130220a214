"""Queries without SQL, against plain Python."""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tesserae.operators import evals, markdown
from tesserae.registry import QUERIES

SF = "/root/testdata/sf0.001"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def words(text):
    return re.sub(r"[ \t\n\r\f\v]+", " ", text.lower()).strip().split(" ") if text.strip() else []


def test_word_error_rates(spark):
    turns = sorted(tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "text").collect())
    before = {(c, t): x for c, t, x in turns}
    wanted = {}
    for c, t, x in turns:
        if (c, t - 1) in before:
            a, b = words(before[c, t - 1]), words(x)
            wanted[c, t] = round(edits(a, b) / len(a) if a else float(bool(b)), 6)
    got = {(r["conv_id"], r["turn"]): r["wer"] for r in QUERIES["wer_turns"](spark, SF).collect()}
    assert got == pytest.approx(wanted, abs=2e-6)


def test_word_error_rate_of_many_words(spark):
    a = " ".join(f"w{i}" for i in range(2000))
    df = spark.createDataFrame([(a, a.replace("w1000", "x")), ("", "b"), ("", ""), ("a b", "")], "a string, b string")
    assert [r[0] for r in df.select(evals.wer(F.col("a"), F.col("b"))).collect()] == [1 / 2000, 1.0, 0.0, 1.0]
    code = df.select(F.decode(F.unhex(F.lpad(F.hex(F.lit(0x10000 + 60_000)), 8, "0")), "UTF-32").alias("c"), F.lit("x").alias("x")).limit(1)
    assert tuple(code.select(F.length("c"), F.levenshtein("c", "x"), F.levenshtein("c", "c")).first()) == (1, 1, 0)  # one character each, far beyond the first plane


def test_page_text(spark):
    def plain(page):
        out = re.sub(r"(?is)<(script|style|noscript|template)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ", page)
        out = re.sub(r"(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>", "\n", out)
        out = "".join(x for x in re.split(r"(<[^>]*>)", out) if not x.startswith("<"))
        for name in ("lt", "gt", "quot", "#39", "nbsp", "amp"):
            out = out.replace(f"&{name};", " " if name == "nbsp" else html.unescape(f"&{name};"))
        lines = [re.sub(r"[ \t]+", " ", x) for x in out.split("\n")]
        return re.sub(r"\n{3,}", "\n\n", re.sub(r" ?\n ?", "\n", "\n".join(lines))).strip(" ")

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = QUERIES["page_text"](spark, SF)
    column = next(c for c in got.columns if c != "page_id")
    assert {r["page_id"]: r[column] for r in got.collect()} == {i: plain(h) for i, h in pages.items()}


def test_chunks_cover_their_documents(spark):
    """Chunks stand in order, are named by their text, and hold every word of the document as often as it does, at least."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    chunks = {}
    for r in markdown.chunk_documents(spark.read.parquet(f"{SF}/documents.parquet"), linearize=False).collect():
        chunks.setdefault(r["doc_id"], []).append(r)
    assert set(chunks) == {i for i, t in docs.items() if t.strip()}
    for i, own in chunks.items():
        own.sort(key=lambda r: r["char_start"])
        assert all(r["chunk_id"] == f"{i}#{hashlib.sha1(r['text'].encode()).hexdigest()[:10]}" for r in own)
        assert all(r["char_start"] < r["char_end"] for r in own)
        assert not Counter(docs[i].split()) - Counter(w for r in own for w in r["text"].split())
