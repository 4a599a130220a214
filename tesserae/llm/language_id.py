"""Language ID: a bidirectional gated recurrent network over bytes.

A text is lower-cased and its UTF-8 bytes are read, blanks included, in windows of at most ``WINDOW``
bytes, cut between characters.  The network reads a window from both ends and labels every byte position with a
distribution over the learned languages, from all that stands before and behind it in the window.  A
document's probabilities are the mean over all its positions.

Training is done here, in numpy, by backpropagation through time, on the driver, on a bounded
sample of the rows that may be learned from: the ``LANGS`` most frequent languages, of each about
``DOCS`` documents (smallest hash of the id), and of these ``PIECES`` pieces of ``PIECE`` characters.

Defined results: a null text, or one without a letter, is ``und`` with score 0, and so is every text
if no row can be learned from; ties go to the smaller language name; a text of any length is read
whole; repeated rows are predicted alike; a null ``doc_id`` is predicted, never learned from and not
held out; languages beyond the ``LANGS`` most frequent are not learned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm.common import frugal, materialise, table

LANGS, DOCS, PIECES, PIECE, WINDOW, HIDDEN, STEPS, BATCH, SEED = 200, 300, 1500, 64, 256, 8, 400, 256, 5
#: Windows read side by side, and the bytes of texts gathered for them.
ABREAST, GATHER = 1024, 1 << 20
UNKNOWN = "und"


def least_score(n_labels: int) -> float:
    """A document is rejected by the pipeline's filter below this score: half as much again as chance, or one half."""
    return min(0.5, 1.5 / n_labels)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class ByteGru:
    """One GRU in each direction over bytes and a softmax at every position."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.labels, self.h = labels, hidden
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            self.p[f"u{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)
            self.p[f"c{d}"] = np.zeros(3 * hidden, np.float32)
        self.p["w"] = rng.normal(0, 0.3, (2 * hidden, len(labels))).astype(np.float32)
        self.p["v"] = np.zeros(len(labels), np.float32)

    def _run(self, codes: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States (T, N, H) in the order of ``codes`` (T, N); a masked position passes the state on."""
        h, (t, n) = self.h, codes.shape
        x, u = self.p[f"x{d}"] + self.p[f"c{d}"], self.p[f"u{d}"]
        whole = mask.all(1)
        state, out, tape = np.zeros((n, h), x.dtype), np.empty((t, n, h), x.dtype), []
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            gates = x[codes[k]]
            rec = state @ u
            zr = _sigmoid(gates[:, : 2 * h] + rec[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            cand = np.tanh(gates[:, 2 * h :] + r * rec[:, 2 * h :])
            new = state + z * (cand - state)
            m = mask[k][:, None]
            if not whole[k]:
                new = np.where(m, new, state)
            if keep:
                tape.append((k, state, z, r, cand, rec[:, 2 * h :], m))
            state = out[k] = new
        return out, tape

    def probabilities(self, codes: np.ndarray, mask: np.ndarray) -> np.ndarray:
        f, _ = self._run(codes, mask, "f", False)
        b, _ = self._run(codes, mask, "b", False)
        logits = np.concatenate([f, b], 2) @ self.p["w"] + self.p["v"]
        logits -= logits.max(2, keepdims=True)
        e = np.exp(logits)
        return e / e.sum(2, keepdims=True)

    def gradients(self, codes: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Weighted cross-entropy over all positions and its gradients, by backpropagation through time."""
        h = self.h
        f, tape_f = self._run(codes, mask, "f", True)
        b, tape_b = self._run(codes, mask, "b", True)
        both = np.concatenate([f, b], 2)
        logits = both @ self.p["w"] + self.p["v"]
        logits -= logits.max(2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(2, keepdims=True)
        share = (mask * weight).astype(np.float32)
        share /= share.sum()
        n = np.arange(codes.shape[1])
        loss = -float((np.log(prob[:, n, y] + 1e-12) * share).sum())
        dl = prob * share[:, :, None]
        dl[:, n, y] -= share
        g = {"w": np.einsum("tnh,tnl->hl", both, dl, optimize=True), "v": dl.sum((0, 1))}
        back = dl @ self.p["w"].T
        for d, tape, dout in (("f", tape_f, back[:, :, :h]), ("b", tape_b, back[:, :, h:])):
            u = self.p[f"u{d}"]
            dx, du, dc = np.zeros_like(self.p[f"x{d}"]), np.zeros_like(u), np.zeros(3 * h, np.float32)
            dstate = np.zeros((codes.shape[1], h), np.float32)
            for k, before, z, r, cand, rec_c, m in reversed(tape):
                dnew = dout[k] + dstate
                da = np.where(m, dnew, 0)
                dcand = da * z * (1 - cand * cand)
                dz = da * (cand - before) * z * (1 - z)
                dr = dcand * rec_c * r * (1 - r)
                drec = np.concatenate([dz, dr, dcand * r], 1)
                dgate = np.concatenate([dz, dr, dcand], 1)
                du += before.T @ drec
                dc += dgate.sum(0)
                np.add.at(dx, codes[k], dgate)
                dstate = np.where(m, dnew * (1 - z), dnew) + drec @ u.T
            g |= {f"x{d}": dx, f"u{d}": du, f"c{d}": dc}
        return loss, g

    def fit(self, chunks: list[bytes], y: np.ndarray, weight: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = 0.01, seed: int = SEED) -> ByteGru:
        """Adam over batches of chunks of like length, languages in equal shares."""
        rng = np.random.default_rng(seed)
        order = np.lexsort((rng.random(len(chunks)), [len(c) for c in chunks]))
        weight = weight / np.bincount(y, weight)[y]
        first, second = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            at = rng.integers(0, max(1, len(order) - batch + 1))
            pick = order[at : at + batch]
            codes, mask = pad([chunks[i] for i in pick])
            _, g = self.gradients(codes, mask, y[pick], weight[pick])
            lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, v in g.items():
                np.clip(v, -1, 1, out=v)
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                self.p[k] = (self.p[k] - lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def pad(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte codes (T, N) and which of them are there."""
    lengths = np.array([len(c) for c in chunks])
    t = int(lengths.max())
    codes = np.frombuffer(b"".join(c.ljust(t, b"\0") for c in chunks), np.uint8).reshape(-1, t).T
    return codes, np.arange(t)[:, None] < lengths[None]


def cut(data: bytes, window: int = WINDOW) -> list[bytes]:
    """Windows of at most ``window`` bytes, whole characters each."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + window)
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        out.append(data[at:end])
        at = end
    return out


class Reader:
    """Pools the position probabilities of whole texts, reading windows of many texts side by side."""

    def __init__(self, net: ByteGru, window: int = WINDOW):
        self.net, self.window = net, window

    def _pool(self, texts: list[bytes]) -> np.ndarray:
        parts, owner = [], []
        for i, data in enumerate(texts):
            mine = cut(data, self.window)
            parts += mine
            owner += [i] * len(mine)
        sums, owner = np.zeros((len(texts), len(self.net.labels))), np.array(owner, np.int64)
        order = np.argsort([len(p) for p in parts], kind="stable")
        for k in range(0, len(order), ABREAST):
            pick = order[k : k + ABREAST]
            codes, mask = pad([parts[i] for i in pick])
            np.add.at(sums, owner[pick], (self.net.probabilities(codes, mask) * mask[:, :, None]).sum(0))
        return sums

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        held: list[tuple[int, bytes]] = []

        def answer() -> None:
            for (i, data), total in zip(held, self._pool([d for _, d in held]), strict=True):
                best = int(total.argmax())
                out[i] = self.net.labels[best], min(1.0, float(total[best]) / len(data))
            held.clear()

        size = 0
        for i, t in enumerate(texts):
            if t and any(map(str.isalpha, t)):
                held.append((i, t.lower().encode()))
                size += len(held[-1][1])
            if size >= GATHER:
                answer()
                size = 0
        answer()
        return out


def held_out(id_col: str):
    """crc32 of the id as text, modulo 3, is 1: such rows are never learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, n_langs: int = LANGS, n_docs: int = DOCS, n_pieces: int = PIECES, **options) -> ByteGru | None:
    """The network, or None if there is nothing to learn from.  What comes to the driver is ``n_pieces`` short rows a language, for ``n_langs`` languages."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("id").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out("id"))
    langs = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "lang").limit(n_langs)
    langs = materialise(langs.withColumn("_share", F.least(F.lit(1.0), 3.0 * n_docs / F.col("_n"))))  # a hash leaves about 3 times as many as are wanted
    key = F.xxhash64(F.col("id").cast("string"))
    some = rows.join(F.broadcast(langs), "lang").filter(F.pmod(key, F.lit(1_000_000)) < F.col("_share") * 1_000_000).select("lang", "id", key.alias("_h"))
    some = some.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "id"))).filter(F.col("_r") <= n_docs)
    some = materialise(some.select("lang", "id").distinct())  # n_docs rows a language
    pieces = rows.join(F.broadcast(some), ["lang", "id"], "left_semi").select("lang", "id", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("k", "c"))
    pieces = pieces.filter(F.col("c").rlike(r"\p{L}")).select("lang", "c", F.xxhash64(F.col("id").cast("string"), "k").alias("_h"))
    top = pieces.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "c"))).filter(F.col("_r") <= n_pieces)
    sample = top.select("lang", "c").orderBy("lang", "_h", "c").collect()
    if not sample:
        return None
    labels = sorted({r["lang"] for r in sample})
    y = np.array([labels.index(r["lang"]) for r in sample])
    return ByteGru(labels).fit([r["c"].lower().encode() for r in sample], y, np.ones(len(y)), **options)


def identify(docs: DataFrame, net: ByteGru | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    if net is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(net)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                got = reader.score(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(frugal(run), f"doc_id {kind}, lang_pred string, score double")


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float | None = None) -> DataFrame:
    """``docs`` without the rows that no learned language fits, all columns kept; each row is judged by its own text."""
    net = train(docs, id_col, text_col, lang_col)
    if net is None:
        return docs.filter(F.lit(False))
    least = least_score(len(net.labels)) if least is None else least
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(net)
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                part = b.slice(k, 2000)
                got = reader.score(part.column(at).to_pylist())
                yield part.filter(pa.array([x != UNKNOWN and s >= least for x, s in got], pa.bool_()))

    return docs.mapInArrow(frugal(run), docs.schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = identify(docs, train(docs, "doc_id", "text", "lang"))
    return got.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score")
