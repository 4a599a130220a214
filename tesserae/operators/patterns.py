"""Many patterns in many texts: automata over shards of the patterns, tries of tokens, spans.

Patterns are counted.  Up to ``MOST_PATTERNS`` form one shard, more are dealt to several; texts are dealt
to slices by their bytes.  A task gets one shard and one slice, so neither side is ever held whole.
"""

from __future__ import annotations

from math import ceil

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

MOST_PATTERNS = 200_000
SLICE_BYTES = 32 << 20
_WORD = regex.compile(r"[\p{L}\p{N}\p{M}]+")
_MARK = regex.compile(r"\p{M}+")


def _dealt(texts: DataFrame, patterns: DataFrame, most: int, size: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_shard, _slice``."""
    shards = max(1, ceil(patterns.count() / most))
    slices = max(1, ceil((texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / size))
    rows = texts.withColumn("_slice", F.pmod(F.monotonically_increasing_id(), F.lit(slices)).cast("int")).withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    held = patterns.withColumn("_shard", F.pmod(F.xxhash64("pattern"), F.lit(shards)).cast("int")).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    return rows, held


def contained(texts: DataFrame, patterns: DataFrame, most: int = MOST_PATTERNS, size: int = SLICE_BYTES) -> DataFrame:
    """``key, pattern``: which of the distinct ``pattern`` stand in the ``text`` of a ``key``, each once; an empty pattern stands nowhere."""
    rows, held = _dealt(texts.select("key", "text").filter("text IS NOT NULL"), patterns.select("pattern").filter("pattern <> ''").distinct(), most, size)
    ddl = f"key {texts.schema['key'].dataType.simpleString()}, pattern string"
    schema = to_arrow_schema(texts.sparkSession.createDataFrame([], ddl).schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        from ahocorasick import Automaton

        found = Automaton()
        for p in right.column("pattern").to_pylist():
            found.add_word(p, p)
        keys, out = [], []
        if len(found):
            found.make_automaton()
            for k, t in zip(left.column("key").to_pylist(), left.column("text").to_pylist(), strict=True):
                own = {p for _, p in found.iter(t)}
                keys += [k] * len(own)
                out += own
        return pa.table([pa.array(keys, schema.field("key").type), pa.array(out, pa.string())], schema=schema)

    return rows.groupBy("_shard", "_slice").cogroup(held.groupBy("_shard", "_slice")).applyInArrow(run, ddl)


def words(text: str) -> list[tuple[str, int, int]]:
    """Folded words of a text and where they stand."""
    return [(w, m.start(), m.end()) for m in _WORD.finditer(text) if (w := _folded(m[0].lower()))]


def _folded(word: str) -> str:
    return word if word.isascii() else _MARK.sub("", _decomposed(word))


def _decomposed(word: str) -> str:
    from unicodedata import normalize

    return normalize("NFD", word)


#: Marks the end of a name in a trie.
_END = 0


def trie_of(names: list[str]) -> dict:
    """Token trie; ``_END`` holds the names that end at a node."""
    root: dict = {}
    for name in names:
        node, toks = root, [w for w, _, _ in words(name)]
        for w in toks:
            node = node.setdefault(w, {})
        if toks:
            node.setdefault(_END, []).append(name)
    return root


def longest(trie: dict, text: str) -> list[tuple[int, int, list[str]]]:
    """``(start, end, names)`` of the longest name at each word where one begins."""
    toks, out = words(text), []
    for i, (first, start, _) in enumerate(toks):
        if first not in trie:
            continue
        node, best = trie, None
        for k in range(i, len(toks)):
            w, _, end = toks[k]
            node = node.get(w)
            if node is None:
                break
            if _END in node:
                best = (start, end, node[_END])
        if best:
            out.append(best)
    return out


def leftmost(spans: Column) -> Column:
    """Of ``start, end`` spans those that a reading from the left takes: at each place the longest, none that overlaps one before."""
    state = "struct<last int, kept array<struct<start int, end int>>>"
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    first = F.struct(F.lit(0).alias("last"), F.array().cast("array<struct<start int, end int>>").alias("kept")).cast(state)
    taken = lambda s, x: F.when(x["start"] >= s["last"], F.struct(x["end"].alias("last"), F.concat(s["kept"], F.array(x)).alias("kept"))).otherwise(s)
    return F.aggregate(ordered, first, taken)["kept"]


def named_spans(texts: DataFrame, names: DataFrame, most: int = MOST_PATTERNS, size: int = SLICE_BYTES) -> DataFrame:
    """``key, name, start, end``: names (name) of any number of words in the ``text`` of each ``key``, leftmost and longest.

    Words are compared whole, without case and marks; a span is in characters.  Names of the same words share
    a span.  Keys are unique.
    """
    rows, held = _dealt(texts.select("key", "text").filter("text IS NOT NULL"), names.select(F.col("name").alias("pattern")).filter("pattern IS NOT NULL").distinct(), most, size)
    ddl = f"key {texts.schema['key'].dataType.simpleString()}, name string, start int, end int"
    schema = to_arrow_schema(texts.sparkSession.createDataFrame([], ddl).schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        trie = trie_of(right.column("pattern").to_pylist())
        out = [(k, n, a, b) for k, t in zip(left.column("key").to_pylist(), left.column("text").to_pylist(), strict=True) for a, b, own in longest(trie, t) for n in own]
        return pa.table([pa.array([r[i] for r in out], schema.field(i).type) for i in range(4)], schema=schema)

    hits = rows.groupBy("_shard", "_slice").cogroup(held.groupBy("_shard", "_slice")).applyInArrow(run, ddl)
    every = hits.groupBy("key").agg(F.collect_list(F.struct("name", "start", "end")).alias("h"))  # the names of one text
    kept = leftmost(F.array_distinct(F.transform("h", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))))
    fit = F.filter("h", lambda x: F.array_contains(F.col("_k"), F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    return every.withColumn("_k", kept).select("key", F.explode(fit).alias("h")).select("key", "h.name", "h.start", "h.end")
