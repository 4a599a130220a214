"""Quality classifier by co-training of two views.

Views: the *text* (hashed word shapes and words, and a few shares such as signs, digits, repeated
lines) and the *metadata* (source, language, stated length) of a document.  Each has a logistic
classifier.  In every round both are fitted to their own labelled sets and calibrated (Platt) on a
fold that is never trained on.  Then each scores all documents without a label, on the executors, and
gives the ``GIVE`` of each label that it is surest of, as pseudo-labels, to the *other* view.  It gives
a label only if, of the rows of the calibration fold that it is surest of (``TOP`` times as many as have the
label), at least ``PRECISE`` and no less than the label's own share are right: a view that cannot tell a label does not teach it.
In the end a logistic combination of the two calibrated views, fitted on the calibration fold, scores all documents.

Fitting starts from a bounded sample, drawn by md5 of the id: at most ``LABELLED`` labelled documents; no bound
is put on the others.  Texts are read once: the features of all documents are written in the shared folder.

Defined results: null text is empty, null source or language is a value of its own, null length is
unknown; a document with several labels takes the mean of them; without both kinds of label the
score is the share of good labels (0.5 without any); repeated rows are scored alike; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import Memo, frugal, materialise, table

LABELLED, ROUNDS, GIVE, PRECISE, TOP, FOLDS = 2000, 3, 100, 0.85, 0.5, 4
SHAPES, WORDS, SOURCES, LANGS, DENSE = 256, 512, 128, 32, 11
_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")


def _slots(word: str) -> tuple[int, int, int, int, int]:
    """Slots of a word's shape and of the word, then: letters, digits, other characters."""
    shape = _DIGITS.sub("0", _LETTERS.sub("a", word))
    letters, digits = sum(map(len, _LETTERS.findall(word))), sum(map(len, _DIGITS.findall(word)))
    return crc32(shape.encode()) % SHAPES, SHAPES + crc32(word.lower().encode()) % WORDS, letters, digits, len(word) - letters - digits


_memo = Memo(_slots, 250_000)


def text_features(text: str | None) -> np.ndarray:
    """Shares of word shapes and words, and dense figures, of the whole text."""
    words = text.split() if text else []
    x = np.zeros(SHAPES + WORDS + DENSE, np.float32)
    if not words:
        x[-1] = 1
        return x
    got = np.array(list(map(_memo.__getitem__, words)), np.int64)
    n = len(words)
    x[: SHAPES + WORDS] = np.bincount(got[:, :2].ravel(), minlength=SHAPES + WORDS) / n
    letters, digits, others = got[:, 2:].sum(0)
    total = max(1, letters + digits + others)
    lines = [s for s in text.split("\n") if s.strip()]
    counts, word_counts = Counter(lines), Counter(words)
    x[SHAPES + WORDS :] = (
        letters / total,
        digits / total,
        others / total,
        min(3.0, total / n / 5),
        np.log1p(n) / 10,
        1 - len(counts) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))) / 5,
        len(word_counts) / n,
        max(word_counts.values()) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        0,
    )
    return x


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    x = np.zeros(SOURCES + LANGS + 18, np.float32)
    x[crc32(f"s{source}".encode()) % SOURCES] = 1
    x[SOURCES + crc32(f"l{lang}".encode()) % LANGS] = 1
    at = SOURCES + LANGS
    if n_chars is None or n_chars < 0:
        x[at] = 1
    else:
        x[at + 1 + min(15, int(np.log2(n_chars + 1)))] = 1
        x[at + 17] = np.log1p(n_chars) / 10
    return x


class Logistic:
    """L2 logistic regression on standardised features by Adam, with Platt calibration."""

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-3, steps: int = 120) -> Logistic:
        self.mean, self.std = x.mean(0), x.std(0) + 0.02
        x = (x - self.mean) / self.std
        w, b = np.zeros(x.shape[1], np.float32), 0.0
        weight = weight / weight.sum()
        m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
        for step in range(1, steps + 1):
            p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
            e = (weight * (p - y)).astype(np.float32)
            g = np.append(x.T @ e + l2 * w, e.sum())
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            d = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w, b = w - d[:-1], b - d[-1]
        self.w, self.b, self.scale, self.shift = w, b, 1.0, 0.0
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.std @ self.w + self.b, -30, 30)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        """Platt's scaling with his softened targets."""
        self.scale, self.shift = platt(self.raw(x)[:, None], y)
        self.scale = float(self.scale[0])
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.scale * self.raw(x) + self.shift, -12, 12)


def platt(z: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 60) -> tuple[np.ndarray, float]:
    """Logistic fit on a few columns by Newton steps, to targets softened by the counts."""
    pos, neg = (y > 0.5).sum(), (y <= 0.5).sum()
    t = np.where(y > 0.5, (pos + 1) / (pos + 2), 1 / (neg + 2))
    z1 = np.column_stack([z, np.ones(len(z))])
    beta, ridge = np.zeros(z1.shape[1]), l2 * np.eye(z1.shape[1])
    ridge[-1, -1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z1 @ beta, -30, 30)))
        h = z1.T * (p * (1 - p)) @ z1 + ridge
        beta = beta - np.linalg.solve(h + 1e-9 * np.eye(len(h)), z1.T @ (p - t) + ridge @ beta)
    return beta[:-1], float(beta[-1])


class Model:
    """Both views and their combination."""

    def __init__(self, share: float):
        self.share, self.text, self.meta, self.mix, self.bias, self.given = share, None, None, None, 0.0, []

    @classmethod
    def of(cls, text: Logistic, meta: Logistic) -> Model:
        """The two views alone, as they are now."""
        self = cls(0.5)
        self.text, self.meta, self.mix = text, meta, np.ones(2)
        return self

    def views(self, xt: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.text.logit(xt), self.meta.logit(xm)

    def predict(self, xt: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sig = lambda v: 1 / (1 + np.exp(-v))
        if self.text is None:
            p = np.full(len(xt), self.share)
            return p, p, p
        a, b = self.views(xt, xm)
        return sig(a), sig(b), sig(self.mix[0] * a + self.mix[1] * b + self.bias)


def teaches(sure: np.ndarray, right: np.ndarray) -> bool:
    """Whether the part of the fold that a view is surest of is right often enough."""
    best = np.argsort(-sure, kind="stable")[: max(1, int(np.ceil(TOP * right.sum())))]
    return len(sure) > 0 and right[best].mean() >= max(PRECISE, right.mean())


def cotrain(xt: np.ndarray, xm: np.ndarray, y: np.ndarray, fold: np.ndarray, surest: Callable, rounds: int = ROUNDS) -> Model:
    """``fold`` marks the labelled rows that only calibrate.

    ``surest(model, view, label)`` gives both views' features of the documents without a label, and without a
    pseudo-label so far, that the view (``t`` or ``m``) of the model is surest to have the label.
    """
    model = Model(float(y.mean()) if len(y) else 0.5)
    fit = ~fold
    if len(set(y[fit] > 0.5)) < 2 or len(set(y[fold] > 0.5)) < 2:
        return model
    sets = {"t": ([xt[fit]], [y[fit]]), "m": ([xm[fit]], [y[fit]])}
    for k in range(rounds + 1):
        fitted = {}
        for name, cal in (("t", xt[fold]), ("m", xm[fold])):
            x, lab = np.concatenate(sets[name][0]), np.concatenate(sets[name][1])
            weight = np.where(lab > 0.5, 0.5 / max(1, (lab > 0.5).sum()), 0.5 / max(1, (lab <= 0.5).sum()))
            fitted[name] = Logistic().fit(x, lab, weight).calibrate(cal, y[fold])
        model.text, model.meta = fitted["t"], fitted["m"]
        if k == rounds:
            break
        for mine, other, cal in (("t", "m", xt[fold]), ("m", "t", xm[fold])):
            p = 1 / (1 + np.exp(-fitted[mine].logit(cal)))
            for label in (1.0, 0.0):
                n = 0
                if teaches(p if label else 1 - p, (y[fold] > 0.5) == (label > 0.5)):
                    ut, um = surest(model, mine, label)
                    n = len(ut)
                    sets[other][0].append(um if other == "m" else ut)
                    sets[other][1].append(np.full(n, label))
                model.given.append((k, mine, label, n))
    a, b = model.views(xt[fold], xm[fold])
    model.mix, model.bias = platt(np.column_stack([a, b]), y[fold])
    model.mix = np.maximum(model.mix, 0)  # a calibrated view never counts against itself
    return model


def _columns(docs: DataFrame, id_col: str, text_col: str, meta_cols: tuple[str, str, str]) -> DataFrame:
    s, lang, n = meta_cols
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(s).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"), F.col(n).cast("long").alias("n_chars"))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, str, str] = ("source", "lang", "n_chars")) -> DataFrame:
    """``doc_id, xt, xm`` of every document, written down where it is read: both views' features as bytes."""
    rows = _columns(docs, id_col, text_col, meta_cols)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                b = batch.slice(at, 1000)
                r = b.to_pydict()
                xt = [text_features(t).astype(np.float16).tobytes() for t in r["text"]]
                xm = [meta_features(*v).astype(np.float16).tobytes() for v in zip(r["source"], r["lang"], r["n_chars"], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(xt, pa.binary()), pa.array(xm, pa.binary())], ["doc_id", "xt", "xm"])

    return materialise(rows.mapInArrow(frugal(run), f"doc_id {kind}, xt binary, xm binary"))


def _stack(rows: list, name: str) -> np.ndarray:
    return np.stack([np.frombuffer(r[name], np.float16) for r in rows]).astype(np.float32) if rows else np.zeros((0, 1), np.float32)


def predict(rows: DataFrame, model: Model) -> DataFrame:
    """``doc_id, text_score, meta_score, score`` from features."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                r = b.slice(at, 1000).to_pylist()
                yield pa.RecordBatch.from_arrays([b.slice(at, 1000).column(0), *(pa.array(v, pa.float64()) for v in model.predict(_stack(r, "xt"), _stack(r, "xm")))], ["doc_id", "text_score", "meta_score", "score"])

    return rows.select("doc_id", "xt", "xm").mapInArrow(frugal(run), f"doc_id {kind}, text_score double, meta_score double, score double")


def train(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", n_labelled: int = LABELLED, give: int = GIVE) -> Model:
    """The model for the rows of :func:`features`.  The driver gets ``n_labelled`` rows and at most ``give`` for each round, view and label; features are not shuffled."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("y")).filter("doc_id IS NOT NULL AND y IS NOT NULL")
    known = materialise(known.groupBy("doc_id").agg(F.avg("y").alias("y")))
    some = known.join(rows.select("doc_id"), "doc_id", "left_semi").orderBy(F.md5(F.col("doc_id").cast("string"))).limit(n_labelled)
    got = rows.join(F.broadcast(materialise(some)), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    if not got:
        return Model(0.5)
    y = np.array([r["y"] for r in got], float)
    fold = np.array([crc32(str(r["doc_id"]).encode()) % FOLDS == 0 for r in got], bool)
    spark, kind = rows.sparkSession, rows.schema["doc_id"].dataType.simpleString()
    taken: list = []
    scored: dict[str, tuple[tuple, DataFrame]] = {}

    def surest(model: Model, view: str, label: float) -> tuple[np.ndarray, np.ndarray]:
        if scored.get("at", (None,))[0] != (model.text, model.meta):  # once a round
            scored["at"] = (model.text, model.meta), materialise(predict(rows.filter("doc_id IS NOT NULL"), Model.of(model.text, model.meta)).join(known, "doc_id", "left_anti"))
        used = F.broadcast(spark.createDataFrame([(i,) for i in taken], f"doc_id {kind}"))  # at most `give` for each round, view and label
        by = F.col("text_score" if view == "t" else "meta_score")
        best = scored["at"][1].join(used, "doc_id", "left_anti").groupBy("doc_id").agg(F.max(by).alias("p")).orderBy(F.desc("p") if label else F.asc("p"), F.md5(F.col("doc_id").cast("string"))).limit(give)
        best = materialise(best.select("doc_id"))
        found = rows.join(F.broadcast(best), "doc_id", "left_semi").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
        taken.extend(r["doc_id"] for r in found)
        width = len(got[0]["xt"]) // 2, len(got[0]["xm"]) // 2
        return (_stack(found, "xt"), _stack(found, "xm")) if found else tuple(np.zeros((0, w), np.float32) for w in width)

    return cotrain(_stack(got, "xt"), _stack(got, "xm"), (y >= 0.5).astype(float), fold, surest)


def score(rows: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """``doc_id, text_score, meta_score, score, kept`` of every document, from the rows of :func:`features`."""
    return predict(rows, model).withColumn("kept", F.col("score") >= least)


def op3_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(table(spark, sf_dir, "documents"))
    return score(rows, train(rows, table(spark, sf_dir, "labels")))
