"""Seams for models: each is a function that a caller may replace, with a deterministic default."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import content_tokens, lexical_overlap, tokens
from tesserae.operators.patterns import named_spans


def hashing_embedder(text: Column, dim: int = 64) -> Column:
    """Unit vector of signed token hashes, as a column expression."""
    toks = tokens(text)
    slot = lambda t: F.pmod(F.xxhash64(t), F.lit(dim)).cast("int")
    sign = lambda t: F.when(F.pmod(F.xxhash64(t, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    pairs = F.transform(toks, lambda t: F.struct(slot(t).alias("i"), sign(t).alias("v")))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(F.filter(pairs, lambda p: p["i"] == i), F.lit(0.0), lambda s, p: s + p["v"]))
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(raw, lambda x: F.when(norm > 0, x / norm).otherwise(0.0).cast("float"))


def batched(function: Callable[[list[str]], list[float]], size: int = 32) -> Callable[[Column], Column]:
    """A pandas UDF around a scorer of text batches; a batch that fails for want of memory is halved."""

    def call(texts: list[str]) -> list[float]:
        try:
            return function(texts)
        except MemoryError:
            if len(texts) < 2:
                raise
            half = len(texts) // 2
            return call(texts[:half]) + call(texts[half:])

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = s.tolist()
            yield pd.Series([x for k in range(0, len(texts), size) for x in call(texts[k : k + size])], dtype=float)

    return score


def extract_entities(chunks: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Default extractor: names of a dictionary (name, kind) that stand in a chunk as whole words, leftmost and longest, with their spans.

    ``doc_id, chunk_id, name, kind, confidence, char_start, char_end``: one row for each occurrence.  Chunks are told apart
    by both ids; where rows share them the texts are searched one by one.
    """
    keyed = chunks.select(F.struct("doc_id", "chunk_id", F.xxhash64("text").alias("h")).alias("key"), "text").dropDuplicates(["key"])
    found = named_spans(keyed, dictionary.select("name"))
    return found.join(dictionary.select("name", "kind").distinct(), "name").select("key.doc_id", "key.chunk_id", "name", "kind", F.lit(0.95).alias("confidence"), F.col("start").alias("char_start"), F.col("end").alias("char_end"))


@dataclass
class Models:
    """What an answer needs; defaults are lexical and deterministic."""

    embed: Callable[[Column], Column] = hashing_embedder
    rerank: Callable[[Column, Column], Column] = lambda query, text: lexical_overlap(query, text)
    rewrite: Callable[[list[str], str], str] = lambda history, text: text
    draft: Callable[[str, list[dict]], list[dict]] | None = None
    notes: dict = field(default_factory=dict)

    def claims(self, question: str, evidence: list[dict]) -> list[dict]:
        """Claims ``{text, chunk_id}``; by default the best matching sentence of each piece of evidence."""
        if self.draft:
            return self.draft(question, evidence)
        import re

        wanted = set(re.findall(r"\w+", question.lower()))
        out = []
        for e in evidence:
            best = max(re.split(r"(?<=[.!?])\s+", e["text"]), key=lambda s: len(wanted & set(re.findall(r"\w+", s.lower()))), default="")
            if wanted & set(re.findall(r"\w+", best.lower())):
                out.append({"text": best, "chunk_id": e["chunk_id"]})
        return out


def summarize(chunks: DataFrame, per_section: int = 1, limit: int = 12) -> DataFrame:
    """Extractive default of the map-reduce summary: the sentences of each section that share most words with its title, sections in turn."""
    from pyspark.sql import Window

    title = F.coalesce(F.try_element_at("heading_path", F.lit(-1)), F.lit(""))
    s = chunks.select("doc_id", title.alias("section"), "char_start", F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("i", "sentence")).filter(F.trim("sentence") != "")
    s = s.withColumn("score", F.size(F.array_intersect(content_tokens(F.col("section")), content_tokens(F.col("sentence")))))
    turn = F.row_number().over(Window.partitionBy("doc_id", "section").orderBy(F.desc("score"), "char_start", "i"))
    s = s.withColumn("turn", turn).filter(F.col("turn") <= per_section)
    first = F.min("char_start").over(Window.partitionBy("doc_id", "section"))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("turn", "_first", "i"))
    return s.withColumn("_first", first).withColumn("pos", order).filter(F.col("pos") <= limit).select("doc_id", "pos", "section", "sentence")
