"""State by key on streams: bursts that end after silence, and the rolling state of conversations.

Both need the RocksDB state store (:func:`use_rocksdb`).  State is a few values for each key, so it
grows with the keys that are open; bursts leave it when they end.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Turns kept as they are, characters of the summary of older ones, chunk ids carried on.
RECENT_TURNS, SUMMARY_CHARS, CARRIED_IDS = 4, 1200, 5


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Bursts(StatefulProcessor):
    """One row for each burst of a key, when ``gap_ms`` have passed without an event of it."""

    def __init__(self, keys: list[str], gap_ms: int, event_time: bool):
        self.keys, self.gap_ms, self.event_time = keys, gap_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "first long, last long, n long")  # in event time several may be open

    def _bursts(self) -> list[list[int]]:
        return [list(x) for x in self.open.get()]

    def _keep(self, bursts: list[list[int]], before: set[int]) -> None:
        ends = {last + self.gap_ms for _, last, _ in bursts}
        for t in before - ends:
            self.handle.deleteTimer(t)
        for t in ends - before:
            self.handle.registerTimer(t)
        if bursts:
            self.open.put([tuple(b) for b in bursts])
        else:
            self.open.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self._bursts()
        before, now = {last + self.gap_ms for _, last, _ in held}, timerValues.getCurrentProcessingTimeInMs()
        fresh = [[ms, ms, 1] for ms in ((r["_ms"] if self.event_time else now) for r in rows)]
        merged: list[list[int]] = []
        for first, last, n in sorted(held + fresh):
            if merged and first < merged[-1][1] + self.gap_ms:
                merged[-1][1], merged[-1][2] = max(merged[-1][1], last), merged[-1][2] + n
            else:
                merged.append([first, last, n])
        self._keep(merged, before)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due, held = expiredTimerInfo.getExpiryTimeInMs(), self._bursts()
        ended = [b for b in held if b[1] + self.gap_ms <= due]
        rest = [b for b in held if b not in ended]
        # The timer that fires is gone already; those of other bursts stay.
        if rest:
            self.open.put([tuple(b) for b in rest])
        else:
            self.open.clear()
        at = lambda ms: datetime.fromtimestamp(ms / 1000)  # noqa: E731  local time of the session, as Spark reads it back
        for first, last, n in ended:
            yield Row(**dict(zip(self.keys, key, strict=True)), burst_start=at(first), burst_end=at(last + self.gap_ms), n_events=n)

    def close(self) -> None:
        pass


def debounce(events: DataFrame, keys: list[str], gap: timedelta = timedelta(milliseconds=500), ts: str | None = None, late: str = "1 minute") -> DataFrame:
    """``keys, burst_start, burst_end, n_events`` of a stream, in append mode; a burst ends after ``gap`` of silence.

    Without ``ts`` silence is of the clock: a burst comes out ``gap`` after its last event has been read.
    With ``ts`` (an event time) it is of the watermark, which trails the newest event by ``late``, and the rows
    are those of a session window of the same gap.
    """
    use_rocksdb(events.sparkSession)
    kinds = [f"`{c.name}` {c.dataType.simpleString()}" for c in events.select(*keys).schema]
    gap_ms = round(gap / timedelta(milliseconds=1))
    stamped = events.select(*keys, F.lit(0).cast("long").alias("_ms")) if ts is None else events.withWatermark(ts, late).select(*keys, ts, F.unix_millis(ts).alias("_ms"))
    return stamped.groupBy(*keys).transformWithState(Bursts(keys, gap_ms, ts is not None), ", ".join([*kinds, "burst_start timestamp, burst_end timestamp, n_events long"]), "Append", "ProcessingTime" if ts is None else "EventTime")


def fold(summary: str, turn: str, most: int = SUMMARY_CHARS) -> str:
    """The default digest: the answer of the turn behind the summary, cut at ``most`` characters."""
    return f"{summary} {turn}".strip()[:most] or summary


def rolled(state: dict, turn: dict, digest: Callable[[str, str], str] = fold) -> dict:
    """The state of a conversation after ``turn`` (turn, text, answer, answered, cited).

    The last ``RECENT_TURNS`` turns are kept; the one that leaves is folded into the summary; the ids
    carried on are the first ``CARRIED_IDS`` that the last answered turn cites.
    """
    recent = [*state["recent"], [turn["turn"], turn["text"] or "", turn["answer"] or ""]]
    summary = state["summary"]
    for old in recent[:-RECENT_TURNS]:
        summary = digest(summary, old[2])
    carried = list(turn["cited"] or [])[:CARRIED_IDS] if turn["answered"] else state["carried"]
    return {"recent": recent[-RECENT_TURNS:], "summary": summary, "carried": carried, "turns": state["turns"] + 1}


class Conversations(StatefulProcessor):
    """The rolling state of each conversation, sent out after each batch that adds turns to it."""

    def __init__(self, key: str, digest: Callable[[str, str], str]):
        self.key, self.digest = key, digest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "state string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        found = self.held.get() if self.held.exists() else None
        state = json.loads(found[0]) if found else {"recent": [], "summary": "", "carried": [], "turns": 0, "last": None}
        last = state.pop("last")
        for r in sorted(rows, key=lambda r: r["turn"]):
            if last is None or r["turn"] > last:  # a turn that came twice counts once
                state, last = rolled(state, r.asDict(), self.digest), r["turn"]
        self.held.update((json.dumps(state | {"last": last}),))
        yield Row(**{self.key: key[0]}, turns=state["turns"], recent=[Row(turn=x[0], text=x[1]) for x in state["recent"]], summary=state["summary"], carried=state["carried"])

    def close(self) -> None:
        pass


def conversation_state(turns: DataFrame, digest: Callable[[str, str], str] = fold, key: str = "conv_id") -> DataFrame:
    """``conv_id, turns, recent, summary, carried`` from a stream of turns (conv_id, turn, text, answer, answered, cited).

    Turns of a conversation come in order; one row is sent for each batch that adds to it.
    """
    use_rocksdb(turns.sparkSession)
    kind = turns.schema[key].dataType.simpleString()
    return turns.groupBy(key).transformWithState(Conversations(key, digest), f"{key} {kind}, turns int, recent array<struct<turn: long, text: string>>, summary string, carried array<string>", "Update", "None")


def conversation_states(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """The same of a table of turns, after all of them, as an aggregation."""
    listed = turns.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("turn", "text", "answer", "answered", "cited"))).alias("t"))
    old = F.slice("t", 1, F.greatest(F.size("t") - RECENT_TURNS, F.lit(0)))
    joined = lambda s, x: F.concat_ws(" ", F.nullif(s, F.lit("")), F.nullif(x["answer"], F.lit("")))
    answered = F.filter("t", lambda x: x["answered"])
    cited: Column = F.when(F.size(answered) > 0, F.slice(F.element_at(answered, -1)["cited"], 1, CARRIED_IDS))
    return listed.select(
        key,
        F.size("t").alias("turns"),
        F.transform(F.slice("t", F.greatest(F.size("t") - RECENT_TURNS + 1, F.lit(1)), RECENT_TURNS), lambda x: F.struct(x["turn"].cast("long").alias("turn"), F.coalesce(x["text"], F.lit("")).alias("text"))).alias("recent"),
        F.aggregate(old, F.lit(""), lambda s, x: F.substring(F.trim(joined(s, x)), 1, SUMMARY_CHARS)).alias("summary"),
        F.coalesce(cited, F.array().cast("array<string>")).alias("carried"),
    )
