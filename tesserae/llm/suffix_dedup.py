"""Suffix-array dedup with sparse suffix arrays: passages that repeat across documents.

Words are runs of letters, digits and underscores, in NFKC and lower-cased, so copies that differ in case,
punctuation or white space are copies.  Only suffixes at *minimiser* positions are retained: the
position of the smallest ``GRAM``-word hash in each stretch of ``STRETCH`` positions.  They are chosen
by content, so two copies of a passage of ``MIN_WORDS`` words retain the same suffixes inside it, and
the first of them starts at most ``STRETCH - 1`` words after the passage does.  Hence its first ``HEAD``
words lie inside the passage.  Each window of ``MIN_WORDS`` words belongs to one retained suffix.

1. Retained suffixes are dealt by the hash of their first ``HEAD`` words and sorted by it.  A suffix
   whose neighbours of an equal head all come from the same text cannot begin a repeated passage and
   is dropped.  This is only a filter: a chance meeting of hashes costs time, never a result.
2. What is left is shipped with its words: those of all windows that belong to it, that is, up to
   ``STRETCH - 1`` words to the left of the suffix and ``MIN_WORDS`` words to the right.  It goes to the bucket of its head.
3. In a bucket the suffixes are sorted by their words: words are ranked, then pairs of words, then
   pairs of pairs (prefix doubling).  Neighbours are compared by their common words.  They are
   extended to the left word by word: suffixes part where their words differ, neighbours within a
   part are compared again, and those of different documents with ``MIN_WORDS`` words in common, to
   both sides together, are matches.
4. A document's matched windows are united to maximal spans.

Hot groups: equal texts are handled once, by the smallest id that has them, and their spans are
handed to all copies by a join that Spark may split.  A head, or a stretch of words, that several
documents of one Arrow batch hold is known to repeat there; only one of them is shipped.  So a
passage that a third of all documents hold reaches its bucket once for each batch; only its edges,
where the documents differ, are shipped for each document.

Defined results: null text is empty; rows with a null id take no part; rows with one id are one
document and do not match each other; an empty table gives no rows; other columns are ignored; ids
are whole numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tesserae.llm.common import frugal, materialise, read_words, semi_join, table

MIN_WORDS, GRAM, STRETCH = 50, 5, 32
HEAD = MIN_WORDS - STRETCH + 1
#: Bytes of a text's SHA-256 that tell texts apart.
TEXT_BYTES = 12
#: Buckets for each shuffle partition at least, and bytes of texts for each bucket at most; a task holds one bucket at a time.
BUCKETS, BUCKET_BYTES = 4, 16 << 20
_PRIME = 0x9E3779B97F4A7C15
_ENTRY = np.dtype([("head", "<u8"), ("text", f"S{TEXT_BYTES}"), ("pos", "<i4")])
_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(normalize("NFKC", text).lower())


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def windows(w: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each position that has so many; it selects and deals, and decides no match."""
    if len(w) < n:
        return np.empty(0, np.uint64)
    out, at, span = np.zeros(len(w) - n + 1, np.uint64), 0, 1
    power = w.copy()  # power[i]: hash of `span` words from i
    while n >= span:
        if n & span:  # append `span` words at the right of what is hashed so far
            out = out * np.uint64(pow(_PRIME, span, 2**64)) + power[at : at + len(out)]
            at += span
        power = power[: max(0, len(power) - span)] * np.uint64(pow(_PRIME, span, 2**64)) + power[span:]
        span *= 2
    return _mix(out)


def minimisers(w: np.ndarray, min_words: int = MIN_WORDS, gram: int = GRAM, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Retained positions, ascending, and for each the first and the number of the windows it stands for.

    A window of ``min_words`` words is represented by the (rightmost) smallest gram in its first
    ``stretch`` positions, which depends on nothing outside the window.
    """
    n = len(w) - min_words + 1
    if n < 1:
        return (np.empty(0, np.int64),) * 3
    view = np.lib.stride_tricks.sliding_window_view(windows(w, gram), stretch)[:n]
    return np.unique(np.arange(n) + stretch - 1 - view[:, ::-1].argmin(1), return_index=True, return_counts=True)


def _groups(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, of sorted ``keys``."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)


def _repeated(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries sorted by head; whether each has a neighbour of its head from another text; the first of each head."""
    entries = entries[np.argsort(entries["head"], kind="stable")]
    edge = _groups(entries["head"])
    sizes = np.diff(np.append(edge, len(entries)))
    lead = np.repeat(edge, sizes)
    other = (entries["text"] != entries["text"][lead]) | (entries["pos"] < 0)
    met = np.zeros(len(edge), bool)
    np.logical_or.at(met, np.repeat(np.arange(len(edge)), sizes), other)
    return entries, np.repeat(met, sizes), edge


def _rows(rows: list[tuple[int, bool, bytes]], name: str) -> pa.RecordBatch:
    """Rows ``bucket, known, blob``; those that are known need no comparison and are only carried along."""
    cols = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.bool_(), pa.binary()), strict=True)], ["bucket", "known", name])


def _by_bucket(batches: Iterator[pa.RecordBatch], known, answer) -> Iterator[pa.RecordBatch]:
    """Gathers the blobs of one bucket after the other, which come sorted by bucket."""
    held, at = [], None
    for b in batches:
        for bucket, carried, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if carried:
                yield known(blob)
                continue
            if at != bucket and held:
                yield answer(held)
                held = []
            at = bucket
            held.append(blob)
    if held:
        yield answer(held)


def repeated_heads(docs: DataFrame, min_words: int, gram: int, stretch: int, buckets: int) -> DataFrame:
    """``(sha, text)`` to ``sha, pos``: retained suffixes whose head another text has too, in one shuffle of packed entries."""
    head = min_words - stretch + 1

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            parts = []
            for sha, (_, w) in zip(b.column(0).to_pylist(), read_words(b.column(1).to_pylist(), words_of), strict=True):
                if len(w) < min_words:
                    continue
                pos = minimisers(w, min_words, gram, stretch)[0]
                part = np.empty(len(pos), _ENTRY)
                part["head"], part["text"], part["pos"] = windows(w, head)[pos], sha, pos
                parts.append(part)
            entries, known, edge = _repeated(np.concatenate(parts) if parts else np.empty(0, _ENTRY))
            told = entries[edge][known[edge]]  # of heads that repeat within the batch one goes on, to tell others
            told["text"], told["pos"] = b"", -1
            send = np.concatenate([entries[~known], told])
            at = (send["head"] >> np.uint64(20)) % np.uint64(buckets)
            order = np.argsort(at, kind="stable")
            at, send = at[order].astype(np.int64), send[order]
            cut = _groups(at)
            blobs = [x.tobytes() for x in np.split(send, cut[1:])] if len(cut) else []
            rows = list(zip(at[cut].tolist(), [False] * len(cut), blobs, strict=True))
            if known.any():
                rows.append((int(entries["head"][known][0] % np.uint64(buckets)), True, entries[known].tobytes()))
            yield _rows(rows, "entries")

    def answer(blobs: list[bytes]) -> pa.RecordBatch:
        entries, met, _ = _repeated(np.frombuffer(b"".join(blobs), _ENTRY))
        return _out(entries[met & (entries["pos"] >= 0)])

    def _out(kept: np.ndarray) -> pa.RecordBatch:
        raw = np.ascontiguousarray(kept["text"]).tobytes()
        sha = pa.Array.from_buffers(pa.binary(TEXT_BYTES), len(kept), [None, pa.py_buffer(raw)]).cast(pa.binary())
        return pa.RecordBatch.from_arrays([sha, pa.array(kept["pos"])], ["sha", "pos"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _by_bucket(batches, lambda blob: _out(np.frombuffer(blob, _ENTRY)), answer)

    sent = docs.select("sha", "text").mapInArrow(frugal(select), "bucket int, known boolean, entries binary")
    dealt = sent.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(frugal(compare), "sha binary, pos int")


def ranks(codes: np.ndarray, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Ranks of the 1, 2, 4, ... words from each position, and of the ``n`` words: smaller ranks for what stands earlier in the order of ``codes``, equal ones for equal words only.

    Prefix doubling: a pair of ranks is ranked in turn.
    """
    import pandas as pd

    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = min(len(a), len(b))
        return pd.factorize(a[:k].astype(np.int64) * (int(b.max(initial=0)) + 1) + b[:k], sort=True)[0]

    out, done, span, tables = None, 0, 1, [codes]
    while span <= n:
        if n & span:
            out = tables[-1] if out is None else pair(out, tables[-1][done:])
            done += span
        span *= 2
        if span <= n:
            tables.append(pair(tables[-1], tables[-1][span // 2 :]))
    return tables, out


def common(tables: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words from ``a`` and from ``b`` are the same, up to what the tables tell (at least the longest of them)."""
    n = np.zeros(len(a), np.int64)
    for j in range(len(tables) - 1, -1, -1):
        n += (tables[j][a + n] == tables[j][b + n]).astype(np.int64) << j
    return n


def neighbours(codes: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """``(suffix, left)`` of windows that several documents hold.

    A suffix begins at ``at``, may be extended by ``left[0]`` to ``left[1]`` words to the left, and has ``right`` words.  Suffixes are
    sorted by their words and neighbours are compared.  For one more word to the left they part by that word,
    within which the order to the right is the same, and need one word less in common to the right.
    """
    import pandas as pd

    tables, order = ranks(np.concatenate([codes, np.zeros(4 * min_words, codes.dtype)]), min_words)
    rank, part, found = order[at], np.zeros(len(at), np.int64), []
    for l in range(int(left[1].max(initial=-1)) + 1):
        if l:
            has = left[1] >= l
            part[has] = pd.factorize(part[has] * (int(codes.max(initial=0)) + 1) + codes[at[has] - l])[0]
        i = np.flatnonzero((left[0] <= l) & (l <= left[1]))
        i = i[np.lexsort((rank[i], part[i]))]
        if not len(i):
            continue
        same = common(tables, at[i[1:]], at[i[:-1]])
        same = (part[i[1:]] == part[i[:-1]]) & (np.minimum(same, np.minimum(right[i[1:]], right[i[:-1]])) >= min_words - l)
        run = np.flatnonzero(np.concatenate([[True], ~same]))
        several = np.minimum.reduceat(low[i], run) != np.maximum.reduceat(high[i], run)
        i = i[np.repeat(several, np.diff(np.append(run, len(i))))]
        found.append((i, np.full(len(i), l)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


def _pack(t: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(t)
    return sink.getvalue().to_pybytes()


_FOUND = pa.schema([("sha", pa.binary()), ("a", pa.int32()), ("b", pa.int32())])
_CONTEXT = pa.schema([("sha", pa.binary()), ("low", pa.int64()), ("high", pa.int64()), ("start", pa.int32()), ("words", pa.string()), ("suffix", pa.int32())])


def matches(docs: DataFrame, min_words: int, gram: int, stretch: int, buckets: int) -> DataFrame:
    """``(sha, low, high, text, at)`` to ``sha, a, b``: stretches of the text's words all of whose windows another document has.

    ``low`` and ``high`` are the smallest and largest id of the text, ``at`` the suffixes to look at.
    """
    head = min_words - stretch + 1

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, rows, heads, same = [], [], [], {}
            for sha, low, high, (words, w), wanted in zip(*(c.to_pylist() for c in b.columns[:3]), read_words(b.column(3).to_pylist(), words_of), b.column(4).to_pylist(), strict=True):
                if low != high and len(w) >= min_words:
                    found.append((sha, 0, len(w)))
                pos, begin, count = minimisers(w, min_words, gram, stretch)
                keys = windows(w, head)
                for i in np.flatnonzero(np.isin(pos, np.array(wanted or [], np.int64))).tolist():
                    k, n = int(begin[i]), int(count[i]) + min_words - 1
                    context = " ".join(words[k : k + n])
                    same.setdefault(context, []).append(len(rows))
                    rows.append((sha, low, high, k, context, int(pos[i]) - k, n))
                    heads.append(int(keys[pos[i]]))
            send, at = [], []
            for group in same.values():
                low, high = min(rows[i][1] for i in group), max(rows[i][2] for i in group)
                if low != high:  # the batch itself holds it twice: one row speaks for them
                    found += [(rows[i][0], rows[i][3], rows[i][3] + rows[i][6]) for i in group]
                    send.append((None, low, high, 0, *rows[group[0]][4:6]))
                    at.append(heads[group[0]] // 2**20 % buckets)
                else:
                    send += [rows[i][:6] for i in group]
                    at += [heads[i] // 2**20 % buckets for i in group]
            order = sorted(range(len(at)), key=at.__getitem__)
            cut = _groups(np.array([at[i] for i in order], np.int64)).tolist()
            out: list[tuple[int, bool, bytes]] = []
            for x, y in zip(cut, [*cut[1:], len(order)], strict=True):
                part = [send[i] for i in order[x:y]]
                out.append((at[order[x]], False, _pack(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), _CONTEXT, strict=True)], schema=_CONTEXT))))
            if found:
                out.append((len(found) % buckets, True, _pack(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), _FOUND, strict=True)], schema=_FOUND))))
            yield _rows(out, "rows")

    def answer(blobs: list[bytes]) -> pa.RecordBatch:
        t = pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in blobs]).combine_chunks()
        split = pc.split_pattern(t.column("words"), " ").combine_chunks()
        words = split.flatten().dictionary_encode()
        place = np.empty(len(words.dictionary), np.int64)
        place[pc.sort_indices(words.dictionary).to_numpy()] = np.arange(1, len(words.dictionary) + 1)
        codes = place[words.indices.to_numpy()]
        offsets = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        low, high, start, suffix = (t.column(c).to_numpy() for c in ("low", "high", "start", "suffix"))
        suffix, length = suffix.astype(np.int64), np.diff(offsets)
        least = np.maximum(0, suffix - (length - min_words))  # the last window of the context
        row, left = neighbours(codes, offsets[:-1] + suffix, (least, suffix), length - suffix, low, high, min_words)
        known = np.asarray(t.column("sha").is_valid())[row]
        row, inside = row[known], suffix[row[known]] - left[known]
        order = np.lexsort((inside, row))
        row, inside = row[order], inside[order]
        edge = _groups(row)  # windows of one suffix overlap, so they unite to one stretch
        last = (np.append(edge[1:], len(row)) - 1)[: len(edge)]
        return pa.RecordBatch.from_arrays([t.column("sha").take(pa.array(row[edge])).combine_chunks(), pa.array((start[row[edge]] + inside[edge]).astype(np.int32)), pa.array((start[row[edge]] + inside[last] + min_words).astype(np.int32))], schema=_FOUND)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _by_bucket(batches, lambda blob: pa.ipc.open_stream(blob).read_next_batch(), answer)

    sent = docs.select("sha", "low", "high", "text", "at").mapInArrow(frugal(extend), "bucket int, known boolean, rows binary")
    dealt = sent.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(frugal(compare), "sha binary, a int, b int")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, gram: int = GRAM, stretch: int = STRETCH) -> DataFrame:
    """``doc_id, start_word, end_word, n_words``: maximal spans of words, each of whose ``min_words``-word windows stands in another document too."""
    if gram + stretch - 1 > min_words or min_words - stretch + 1 < gram:
        raise ValueError("a passage must hold a whole stretch and a whole head")
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, IntegralType):
        raise ValueError("ids must be whole numbers")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    texts = texts.withColumn("sha", F.substring(F.unhex(F.sha2("text", 256)), 1, TEXT_BYTES))
    ids = materialise(texts.select("doc_id", "sha", F.octet_length("text").alias("bytes")))
    size = ids.agg(F.sum("bytes")).first()[0] or 0
    ids = ids.drop("bytes")
    buckets = max(BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES + 1)
    groups = ids.groupBy("sha").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    at = repeated_heads(texts, min_words, gram, stretch, buckets).groupBy("sha").agg(F.collect_set("pos").alias("at"))  # bounded by a text's length
    wanted = materialise(groups.join(at, "sha", "left").filter("at IS NOT NULL OR low <> high"))
    one = semi_join(texts, wanted.select(F.col("low").alias("doc_id"), "sha"), ["doc_id", "sha"])  # one row of each text that is looked at
    one = one.join(wanted.withColumnRenamed("low", "doc_id"), ["doc_id", "sha"]).withColumnRenamed("doc_id", "low")
    found = matches(one, min_words, gram, stretch, buckets)
    per_text = found.groupBy("sha").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("m"))
    # Fold the sorted stretches into spans: one that begins inside or next to the last span lengthens it.

    def add(acc, s):
        last = acc["last"]
        joined = F.struct(last["a"].alias("a"), F.greatest(last["b"], s["b"]).alias("b"))
        return F.when(s["a"] <= last["b"], F.struct(acc["done"].alias("done"), joined.alias("last"))).otherwise(F.struct(F.concat(acc["done"], F.array(last)).alias("done"), s.alias("last")))

    start = F.struct(F.array().cast("array<struct<a:int,b:int>>").alias("done"), F.element_at("m", 1).alias("last"))
    spans = F.aggregate(F.slice("m", 2, F.size("m")), start, add, lambda acc: F.concat(acc["done"], F.array(acc["last"])))
    out = materialise(per_text.select("sha", spans.alias("spans"))).join(ids.distinct(), "sha").select("doc_id", F.explode("spans").alias("s"))
    return out.select(F.col("doc_id").cast(kind), F.col("s.a").alias("start_word"), F.col("s.b").alias("end_word"), (F.col("s.b") - F.col("s.a")).alias("n_words"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
