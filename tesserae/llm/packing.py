"""Best-fit packing with Martello-Toth dominance reduction.

Documents become token ids plus an end id; only longer ones than a sequence are cut.  Lengths are
whole numbers up to ``capacity``, so a packing depends on no more than how many pieces have each
length: a histogram of ``capacity`` counters, whatever the size of the corpus.  The driver solves
that histogram:

1. Reduction (Martello and Toth's MTRP).  For the longest piece j left, find a set of at most three
   pieces that holds j and dominates every other feasible set that holds j; fix as many such
   sequences as the counts allow, and shrink the instance.  Sets that dominate: j alone if nothing
   fits beside it; j with a piece that fills the sequence exactly; j with the longest partner that
   fits if no two pieces fit beside j, or if that partner is at least as long as the best such two;
   j with the best two under Martello and Toth's condition on the next smaller pieces.
2. What is left is packed best-fit in order of decreasing length, run by run: equal pieces and
   equal sequences are handled together.

The outcome is a list of patterns with multiplicities.  Pieces get their places by joining on
(length, rank among pieces of that length); the ranks are taken in two levels, inside hash buckets
and over bucket counts, so that a length that a third of all pieces have is no single task.

Defined results: null text is empty and becomes the end id alone; repeated rows are packed as
documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm.common import Memo, frugal, materialise, table

TOKENIZER, CAPACITY, END_ID, MEMO = "word_bpe_49k.json", 2048, 0, 250_000
BUCKET_ROWS = 50_000


class Tokens:
    """Text to ids as little-endian bytes.

    The tokenizer parts words before it merges and never joins what it parted, so a text's ids are
    its words' ids in order.  A text of Latin letters, digits and signs up to U+00FF is lower-cased
    and split by the tokenizer's own pattern; any other text is split at white space, which the
    tokenizer drops, and the chunks that are not Latin go to the library.
    """

    #: Up to U+00FF, but for the soft hyphen and odd spaces, lower case and NFC act on single characters.
    LATIN = re.compile("[\t\n\v\f\r -~\xa1-\xac\xae-\xff]*")
    WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\t\n\v\f\r a-zªµºß-öø-ÿ0-9²³¹¼½¾]+").findall
    SPACES = re.compile(r"[\t\n\v\f\r ]+")

    def __init__(self, path: str, memo: int = MEMO):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.model, self.words = self.lib.model, Memo(self._word, memo)
        config = json.loads(self.lib.to_str())
        kinds = [x["type"] for x in (config.get("normalizer") or {}).get("normalizers", [])]
        split = [x.get("pattern", {}).get("Regex") for x in (config.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        #: The rules above are proven for exactly this pipeline; any other is left to the library.
        self.known = kinds == ["NFC", "Replace", "Lowercase"] and split[:1] == [r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"]
        self.special = re.compile("|".join(re.escape(x["content"]) for x in config.get("added_tokens", [])) or "(?!)")
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.byte_char = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}

    def _word(self, word: str) -> bytes:
        mapped = word if word.isascii() else "".join(map(self.byte_char.__getitem__, word.encode()))
        return b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(mapped))

    def _library(self, text: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self.lib.encode(text, add_special_tokens=False).ids)

    def _latin(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.WORDS(text.lower())))

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.known or self.special.search(text):
            return self._library(text)
        if self.LATIN.fullmatch(text):
            return self._latin(text)
        return b"".join(self._latin(x) if self.LATIN.fullmatch(x) else self._library(x) for x in self.SPACES.split(text))


_tokens: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if asked for, the ids themselves (little-endian 32-bit)."""
    path = path or tokenizer_path()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    end, width = end_id.to_bytes(4, "little"), 4 * capacity
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, crc = tokens(path).ids, zlib.crc32
        for b in batches:
            at, cols = [], [[] for _ in names[1:]]
            for k, text in enumerate(b.column(1).to_pylist()):
                ids = encode(text) + end
                for i, x in enumerate(range(0, len(ids), width)):
                    part = ids[x : x + width]
                    at.append(k)
                    for col, v in zip(cols, (i, x // 4, len(part) // 4, crc(part), part), strict=False):
                        col.append(v)
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), *(pa.array(c, t) for c, t in zip(cols, types, strict=False))], names)

    return rows.mapInArrow(frugal(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def _fit(sizes: list[int], most: int) -> int:
    """Index after the last of the ascending ``sizes`` that is at most ``most``."""
    return bisect_left(sizes, most + 1)


def dominant_set(have: dict[int, int], sizes: list[int], j: int, capacity: int, set_aside: int) -> tuple[int, ...] | None:
    """Partners of the longest piece ``j`` (already taken out of ``have`` once) in a set that dominates, or None.

    ``sizes`` are the lengths with a positive count in ``have``, ascending; ``set_aside`` is the
    shortest piece that an earlier step left for best fit (they still are possible partners).
    """
    room = capacity - j
    n = _fit(sizes, room)
    if n and sizes[n - 1] == room:
        return (room,)  # an exact fit dominates whatever else there is
    if room >= set_aside:
        return None
    if not n:
        return ()
    partner = sizes[n - 1]
    small = [s for s in sizes[:3] for _ in range(min(have[s], 3))][:3]
    if len(small) < 2 or small[0] + small[1] > room:  # only one fits beside j
        return (partner,)
    if len(small) == 3 and sum(small) <= room:  # three or more may fit: larger sets are not searched
        return None
    best: tuple[int, int] | None = None
    for a in reversed(sizes[:n]):
        if best and 2 * a <= sum(best):
            break
        k = _fit(sizes, min(a, room - a))
        if k and sizes[k - 1] == a and have[a] < 2:
            k -= 1
        if k and (best is None or a + sizes[k - 1] > sum(best)):
            best = (a, sizes[k - 1])
    if best is None or partner >= sum(best):
        return (partner,)
    a, b = best
    if partner == a:
        # a is the longest that fits; then (a, b) dominates unless two other pieces, both longer than b, fit
        longer: list[int] = []
        for s in sizes[_fit(sizes, b) :]:
            longer += [s] * min(have[s] - (s == a), 2)
            if len(longer) >= 2:
                break
        if len(longer) < 2 or longer[0] + longer[1] > room:
            return (a, b)
    return None


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Patterns ``(how often, ((length, pieces of it in one sequence), ...))`` that use every piece."""
    have = {s: n for s, n in histogram.items() if n}
    if have and (min(have) < 1 or max(have) > capacity):
        raise ValueError("lengths must lie between 1 and the capacity")
    sizes, out, stuck = sorted(have), [], []

    def take(s: int, n: int) -> None:
        have[s] -= n
        if not have[s]:
            del have[s], sizes[bisect_left(sizes, s)]

    while sizes:  # reduction
        j = sizes[-1]
        count = have[j]
        take(j, 1)
        partners = dominant_set(have, sizes, j, capacity, stuck[-1][0] if stuck else capacity + 1)
        if partners is None:  # j stays for best fit, with all its equals; shorter ones may still reduce
            if j in have:
                take(j, have[j])
            stuck.append((j, count))
            continue
        need: dict[int, int] = {}
        for p in (j, *partners):
            need[p] = need.get(p, 0) + 1
        # A set stays dominant while its pieces last; for three pieces the proof looks at up to three of a length.
        spare = 3 if len(partners) == 2 else 0
        times = max(1, min((count if p == j else have[p]) // k - spare for p, k in need.items()))
        for p, k in need.items():
            extra = k * times - (p == j)
            if extra:
                take(p, extra)
        out.append((times, tuple(sorted(need.items(), reverse=True))))
    bins: dict[int, list[tuple[int, dict[int, int]]]] = {}  # free room to (how many, pattern)
    rooms: list[int] = []

    def put(room: int, n: int, pattern: dict[int, int]) -> None:
        if n:
            if room not in bins:
                bins[room] = []
                insort(rooms, room)
            bins[room].append((n, pattern))

    for s, m in stuck:  # already in decreasing order
        while m:
            at = bisect_left(rooms, s)
            if at < len(rooms):
                room = rooms[at]
                n, pattern = bins[room].pop()
                if not bins[room]:
                    del bins[room], rooms[at]
            else:
                room, n, pattern = capacity, -(-m // (capacity // s)), {}
            each = room // s
            full = min(n, m // each)
            put(room - each * s, full, pattern | {s: pattern.get(s, 0) + each})
            m -= full * each
            rest = min(m, each - 1) if n > full else 0
            put(room - rest * s, 1 if rest else 0, pattern | {s: pattern.get(s, 0) + rest})
            if room != capacity or pattern:
                put(room, n - full - bool(rest), pattern)
            m -= rest
    for group in bins.values():
        out += [(n, tuple(sorted(p.items(), reverse=True))) for n, p in group]
    return out


def slots(patterns: list[tuple[int, tuple[tuple[int, int], ...]]]) -> list[dict]:
    """Rows ``length, first, n, each, sequence, offset``: pieces of that length with rank ``first + i`` (i < n)
    go to sequence ``sequence + i // each`` at offset ``offset + (i % each) * length``."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for n, pattern in patterns:
        offset = 0
        for length, each in pattern:
            first = used.get(length, 0)
            rows.append({"length": length, "first": first, "n": n * each, "each": each, "sequence": sequence, "offset": offset})
            used[length] = first + n * each
            offset += each * length
        sequence += n
    return rows


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (as from :func:`pieces`, written down) with ``sequence_id`` and ``offset``."""
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    plan = slots(solve(counts, capacity))
    spark = parts.sparkSession
    schema = "array<struct<length:long,first:long,n:long,each:long,sequence:long,offset:long>>"
    where = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(plan)), schema)).alias("s"))
    where = where.groupBy("s.length").agg(F.sort_array(F.collect_list(F.struct(F.col("s.first"), F.col("s.n"), F.col("s.each"), F.col("s.sequence"), F.col("s.offset")))).alias("_runs"))
    buckets = max(1, sum(counts.values()) // BUCKET_ROWS + 1)
    rows = parts.withColumn("_h", F.xxhash64("doc_id", "piece")).withColumn("_bucket", F.pmod("_h", F.lit(buckets)))
    sums = rows.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    sums = sums.select("length", "_bucket", F.coalesce(F.sum("_c").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    rows = rows.withColumn("_in", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("_h", "doc_id", "piece", "ids_crc32")) - 1)
    rows = rows.join(sums, ["length", "_bucket"]).withColumn("_rank", F.col("_in") + F.col("_ahead"))
    rows = rows.join(F.broadcast(where), "length")  # at most a few runs for each of `capacity` lengths
    run = F.element_at(F.filter("_runs", lambda r: (r["first"] <= F.col("_rank")) & (F.col("_rank") < r["first"] + r["n"])), 1)
    rows = rows.withColumn("_run", run).withColumn("_i", F.col("_rank") - F.col("_run.first"))
    rows = rows.withColumn("sequence_id", F.col("_run.sequence") + F.floor(F.col("_i") / F.col("_run.each")))
    rows = rows.withColumn("offset", F.col("_run.offset") + F.pmod("_i", F.col("_run.each")) * F.col("length"))
    return rows.select(*parts.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.  Texts are tokenized once; only the narrow piece rows are shuffled."""
    return pack(materialise(pieces(docs, id_col, text_col, path, capacity, end_id)), capacity)


def sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The packed training rows themselves: ``sequence_id, ids`` (little-endian 32-bit), one shuffle of the ids by sequence."""
    rows = pack(materialise(pieces(docs, id_col, text_col, path, capacity, end_id, with_ids=True)), capacity)
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # a sequence holds at most `capacity` tokens
    return rows.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
