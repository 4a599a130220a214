"""Alignment of a transcript with a deck of slides, a keyed store of alignments, and their computation from chunks.

Greedy: each chunk takes the slide of the largest cosine, none below ``floor``; of slides within ``tie`` of the
best, the smallest page at or after the last one taken is preferred.  Path: a dynamic program whose
state is the last page taken, carried through chunks without a slide.  A step forward costs ``jump``, one
back twice that, the first page is free; a chunk without a slide earns ``floor``; a chunk's share of the
lecture pulls it to the same share of the deck by ``time``.  A chunk whose video frame shows a slide (its
cosine was above the frame's floor) is fixed to it in both.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.sources.snapshots import Store, append, latest

#: Band of near ties, cost of a jump, pull of time, least cosines of text and frame.
TIE, JUMP, TIME, FLOOR, FRAME_FLOOR = 0.02, 0.1, 0.1, 0.4, 0.8
STORE = "alignments"
#: Rows of a pair's scores that are held at once.
ROWS = 256


class NotAligned(ValueError):
    """A document is not indexed, or the deck's chunks have no pages."""


def greedy(scores: Iterable[np.ndarray], pages: np.ndarray, floor: float = FLOOR, tie: float = TIE, fixed: dict[int, float] | None = None) -> list[int | None]:
    """For each row the column taken, None below the floor; ``pages`` of columns may hold NaN; ``fixed``: pages of rows with a frame (their column is not decided here)."""
    out: list[int | None] = []
    last = np.nan
    for i, row in enumerate(scores):
        if fixed and i in fixed:
            last = fixed[i] if fixed[i] == fixed[i] else last
            out.append(None)
            continue
        if not len(row) or row.max() < floor:
            out.append(None)
            continue
        j = int(row.argmax())
        ahead = np.flatnonzero((row >= row[j] - tie) & (pages >= last))  # no page is ahead of NaN
        if len(ahead):
            j = int(ahead[np.lexsort((-row[ahead], pages[ahead]))[0]])
        out.append(j)
        last = pages[j] if pages[j] == pages[j] else last
    return out


def _reached(value: np.ndarray, jump: float) -> tuple[np.ndarray, np.ndarray]:
    """For each page the state it is best reached from, of equal ones the first, and the value there; the last state is that of no page yet."""
    p = len(value) - 1
    ahead, back, at = value[:p] - jump, value[:p] - 2 * jump, np.arange(p)
    top = np.maximum.accumulate(ahead)
    first = np.maximum.accumulate(np.where(ahead > np.append(-np.inf, top[:-1]), at, 0))
    best, from_ = value[:p].copy(), at.copy()
    low = np.maximum.accumulate(back[::-1])[::-1]
    last = np.minimum.accumulate(np.where(back >= np.append(low[1:], -np.inf), at, p)[::-1])[::-1]
    for best_, from__, cols, wins in ((top[:-1], first[:-1], slice(1, p), np.greater_equal), (low[1:], last[1:], slice(0, p - 1), np.greater)):
        better = wins(best_, best[cols])
        best[cols][better], from_[cols][better] = best_[better], from__[better]
    none = value[p] > best
    best[none], from_[none] = value[p], p
    return from_, best


def _path(gains: Callable[[int, int], np.ndarray], n: int, p: int, floor: float, jump: float, fixed: dict[int, int | None] | None) -> list[int | None]:
    """As :func:`best_path`, for rows that ``gains`` gives from one to another: values are kept at the start of each block of about the
    root of ``n`` rows, and where a block's states came from is worked out again on the way back."""
    size = max(1, int(n**0.5))
    value = np.full(p + 1, -np.inf)
    value[p] = 0.0

    def block(a: int, value: np.ndarray, told: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
        b = min(n, a + size)
        rows = gains(a, b)
        came, took = (np.tile(np.arange(p + 1, dtype=np.int32), (b - a, 1)), np.zeros((b - a, p + 1), bool)) if told else (None, None)
        for i in range(b - a):
            anchor = (fixed or {}).get(a + i, -1)
            if anchor is None:
                continue
            from_, reached = _reached(value, jump)
            if anchor >= 0:
                value = np.full(p + 1, -np.inf)
                value[anchor] = reached[anchor]
                if told:
                    came[i, anchor], took[i, anchor] = from_[anchor], True
                continue
            value = value + floor
            gained = reached + rows[i]
            better = gained > value[:p]
            value[:p][better] = gained[better]
            if told:
                came[i, :p][better], took[i, :p][better] = from_[better], True
        return value, came, took

    starts = []
    for a in range(0, n, size):
        starts.append((a, value))
        value = block(a, value, False)[0]
    state, path = int(value.argmax()), []
    for a, value in reversed(starts):
        _, came, took = block(a, value, True)
        for i in range(len(came) - 1, -1, -1):
            path.append(state if took[i, state] else None)
            state = int(came[i, state])
    return path[::-1]


def best_path(scores: np.ndarray, floor: float = FLOOR, jump: float = JUMP, prior: np.ndarray | None = None, fixed: dict[int, int | None] | None = None) -> list[int | None]:
    """For each row the page (a column of ``scores``, in the deck's order) of the best path, None for a chunk without a slide.

    ``prior`` is taken from the scores; ``fixed`` gives rows a page, or None for a frame that no page is known for,
    which leaves the state as it is.
    """
    gain = scores if prior is None else scores - prior
    return _path(lambda a, b: gain[a:b], *scores.shape, floor, jump, fixed)


def time_prior(starts: np.ndarray, ends: np.ndarray, pages: int, weight: float = TIME) -> np.ndarray:
    """What the scores of each chunk lose for each page; nothing without times, or with a single page."""
    total = np.nanmax(ends) if len(ends) and not np.isnan(ends).all() else 0.0
    if total <= 0 or pages <= 1:
        return np.zeros((len(starts), pages))
    off = np.abs(starts[:, None] / total * (pages - 1) - np.arange(pages)) / (pages - 1)
    return np.nan_to_num(weight * off)


def _units(vectors: pd.Series) -> np.ndarray:
    v = np.stack(vectors.to_numpy()).astype(float)
    return v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-12)


COLUMNS = "pair_id, chunk_pos, deck_pos, page, score"


def align(transcripts: DataFrame, decks: DataFrame, method: str = "path", floor: float = FLOOR, tie: float = TIE, jump: float = JUMP, time: float = TIME) -> DataFrame:
    """``pair_id, chunk_pos, deck_pos, page, score``: one pair of documents is aligned in one task, as state runs through it.

    ``transcripts``: pair_id, pos, vector, and if known start_s, end_s, frame_pos (the deck chunk that the frame shows) and
    frame_score; ``decks``: pair_id, pos, vector, and if known page (else pos).  A chunk without a slide keeps its best
    score, 0 where the deck has none.
    """
    frame = lambda df, cols: df.select(*[F.col(c).alias(c) if c in df.columns else F.lit(None).cast(kind).alias(c) for c, kind in cols])
    t_cols = [("pair_id", "string"), ("pos", "long"), ("vector", "array<double>"), ("start_s", "double"), ("end_s", "double"), ("frame_pos", "long"), ("frame_score", "double")]
    left = frame(transcripts, t_cols)
    paged = decks if "page" in decks.columns else decks.withColumn("page", F.col("pos"))
    right = frame(paged, [("pair_id", "string"), ("pos", "long"), ("vector", "array<double>"), ("page", "long")])
    cols = COLUMNS.split(", ")

    def one(t: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if t.empty:
            return pd.DataFrame(columns=cols)
        t, d = t.sort_values("pos", ignore_index=True), d.sort_values("pos", ignore_index=True)
        page, deck, own_units = d["page"].to_numpy(float), _units(d["vector"]) if len(d) else None, _units(t["vector"])
        scores = lambda a, b: own_units[a:b] @ deck.T if deck is not None else np.zeros((b - a, 0))
        blocks = [(a, min(len(t), a + ROWS)) for a in range(0, len(t), ROWS)]
        at = {int(p): j for j, p in enumerate(d["pos"])}
        shown = {i: at.get(int(f)) for i, f in enumerate(t["frame_pos"]) if f == f and f is not None}
        unpaged = np.zeros(len(d), bool)
        if method == "greedy":
            chosen = greedy((row for a, b in blocks for row in scores(a, b)), page, floor, tie, {i: page[j] if j is not None else np.nan for i, j in shown.items()})
        else:
            numbers = np.unique(page[~np.isnan(page)])
            order = np.argsort(page, kind="stable")[: int((~np.isnan(page)).sum())]  # columns of the same page lie together
            firsts = np.searchsorted(page[order], numbers)
            where = {x: k for k, x in enumerate(numbers)}
            fixed = {i: where.get(page[j]) if j is not None else None for i, j in shown.items()}
            starts, ends = t["start_s"].to_numpy(float), t["end_s"].to_numpy(float)

            def gains(a: int, b: int) -> np.ndarray:
                return np.maximum.reduceat(scores(a, b)[:, order], firsts, axis=1) - time_prior(starts[a:b], ends, len(numbers), time)

            path = _path(gains, len(t), len(numbers), floor, jump, fixed) if len(numbers) else [None] * len(t)
            chosen = [None] * len(t)
            for a, b in blocks if len(numbers) else []:
                part = scores(a, b)
                for i in range(a, b):
                    if path[i] is not None:
                        own = order[firsts[path[i]] : firsts[path[i] + 1] if path[i] + 1 < len(firsts) else None]
                        chosen[i] = int(own[part[i - a, own].argmax()])
            unpaged = np.isnan(page) if len(numbers) else unpaged
        told = np.zeros(len(t))  # the score of what is taken, or the best one
        for a, b in blocks if len(d) else []:
            part = np.where(unpaged[None], -np.inf, scores(a, b))
            for i in range(a, b):
                j = shown[i] if i in shown else chosen[i]
                told[i] = part[i - a, j] if j is not None else part[i - a].max()
        rows = []
        for i, j in enumerate(chosen):
            j, score = (shown[i], t["frame_score"][i]) if i in shown else (j, None)
            if score is None or score != score:
                score = told[i]
            rows.append((t["pair_id"][i], int(t["pos"][i]), None if j is None else int(d["pos"][j]), None if j is None or page[j] != page[j] else int(page[j]), float(score)))
        return pd.DataFrame(rows, columns=cols).astype({"page": "Int64", "deck_pos": "Int64"})

    kind = transcripts.schema["pair_id"].dataType.simpleString()
    return left.groupBy("pair_id").cogroup(right.groupBy("pair_id")).applyInPandas(one, f"pair_id {kind}, chunk_pos long, deck_pos long, page long, score double")


def frames_shown(frames: DataFrame, decks: DataFrame, floor: float = FRAME_FLOOR) -> DataFrame:
    """``pair_id, pos, frame_pos, frame_score``: the deck chunk nearest to each frame's vector (pair_id, pos, vector), if at ``floor`` or above; of equal ones the first."""
    unit = lambda c: F.transform(c, lambda x: x / (F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, y: s + y * y)) + 1e-12))
    a = frames.select("pair_id", "pos", unit(F.col("vector").cast("array<double>")).alias("_a"))
    b = decks.select("pair_id", F.col("pos").alias("frame_pos"), unit(F.col("vector").cast("array<double>")).alias("_b"))
    near = a.join(b, "pair_id").withColumn("frame_score", F.aggregate(F.zip_with("_a", "_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))  # a pair's frames by its slides
    top = near.groupBy("pair_id", "pos").agg(F.max(F.struct("frame_score", (-F.col("frame_pos")).alias("n"))).alias("m"))
    return top.filter(F.col("m.frame_score") >= floor).select("pair_id", "pos", (-F.col("m.n")).alias("frame_pos"), "m.frame_score")


# --- documents ------------------------------------------------------------------------------------
def unaligned(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """``transcript_doc, deck_doc, reason`` of pairs that cannot be aligned."""
    known = chunks.groupBy("document_id").agg((F.count("page") > 0).alias("paged"))
    t, d = known.select(F.col("document_id").alias("transcript_doc"), F.lit(True).alias("_t")), known.select(F.col("document_id").alias("deck_doc"), "paged")
    joined = pairs.join(t, "transcript_doc", "left").join(d, "deck_doc", "left")
    reason = F.when(F.col("_t").isNull(), "transcript is not indexed").when(F.col("paged").isNull(), "deck is not indexed").when(~F.col("paged"), "deck has no pages")
    return joined.select("transcript_doc", "deck_doc", reason.alias("reason")).filter("reason IS NOT NULL")


def align_documents(pairs: DataFrame, chunks: DataFrame, frames: DataFrame | None = None, **options) -> DataFrame:
    """``transcript_doc, deck_doc, transcript_chunk_id, deck_chunk_id, page, score, start_s, end_s`` of document pairs (transcript_doc, deck_doc).

    ``chunks``: document_id, chunk_id, char_start, page, start_s, end_s, vector; ``frames``: chunk_id, vector of the slide that the
    video shows.  A pair of which a document is not indexed, or whose deck has no pages, is an error.
    """
    bad = unaligned(pairs, chunks).limit(5).collect()
    if bad:
        raise NotAligned("; ".join(f"{r['transcript_doc']} / {r['deck_doc']}: {r['reason']}" for r in bad))
    keyed = pairs.select("transcript_doc", "deck_doc").distinct().withColumn("pair_id", F.to_json(F.array("transcript_doc", "deck_doc")))
    own = chunks.select("document_id", "chunk_id", F.col("char_start").cast("long").alias("pos"), "page", "start_s", "end_s", "vector")
    t, d = (keyed.join(own.withColumnRenamed("document_id", side), side) for side in ("transcript_doc", "deck_doc"))
    if frames is not None:
        seen = t.drop("vector").join(frames.select("chunk_id", "vector"), "chunk_id")
        t = t.join(frames_shown(seen, d), ["pair_id", "pos"], "left")
    out = align(t, d, **options)
    names = lambda side, at, name: side.select("pair_id", F.col("pos").alias(at), F.col("chunk_id").alias(name))
    out = out.join(keyed, "pair_id").join(t.select("pair_id", F.col("pos").alias("chunk_pos"), F.col("chunk_id").alias("transcript_chunk_id"), "start_s", "end_s"), ["pair_id", "chunk_pos"])
    out = out.join(names(d, "deck_pos", "deck_chunk_id"), ["pair_id", "deck_pos"], "left")
    return out.select("transcript_doc", "deck_doc", "transcript_chunk_id", "deck_chunk_id", "page", "score", "start_s", "end_s")


def save(store: Store, blocks: DataFrame) -> int:
    """Replaces the alignments of the pairs in ``blocks``; one row a pair."""
    each = F.struct("start_s", "transcript_chunk_id", "end_s", "deck_chunk_id", "page", "score")
    return append(store, STORE, blocks.groupBy("transcript_doc", "deck_doc").agg(F.sort_array(F.collect_list(each)).alias("blocks")))


def saved(store: Store, doc: str | None = None, deck: str | None = None) -> DataFrame | None:
    """All alignments, those of a document on either side, or that of one pair (``doc`` a transcript, ``deck`` given)."""
    log = store.read(STORE)
    if log is None:
        return None
    if doc is not None:
        mine = (F.col("transcript_doc") == doc) & (F.col("deck_doc") == deck) if deck is not None else (F.col("transcript_doc") == doc) | (F.col("deck_doc") == doc)
        log = log.filter(mine)
    return latest(log, ["transcript_doc", "deck_doc"])


def delete(store: Store, transcript: str, deck: str) -> bool:
    """Whether there was such an alignment."""
    found = saved(store, transcript, deck)
    if found is None or found.isEmpty():
        return False
    append(store, STORE, found, deleted=True)
    return True
