"""Streams that keep state: the watcher of a folder, bursts, conversations; each also started again from its checkpoint."""

from __future__ import annotations

import hashlib
import json
import os
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tesserae.streaming import events, listing, stateful


# --- watcher --------------------------------------------------------------------------------------
def write(path, text):
    before = path.stat().st_mtime_ns if path.exists() else 0
    path.write_text(text)
    if path.stat().st_mtime_ns <= before:
        os.utime(path, ns=(before + 1, before + 1))


def run(spark, tmp_path, monkeypatch=None):
    seen = []
    events.watch(spark, str(tmp_path), lambda df, _: seen.extend(tuple(r) for r in df.select("doc_id", "state", F.col("content").cast("string")).collect()), str(tmp_path / "ck")).awaitTermination(120)
    return sorted(seen)


def test_watch_edits_and_removals(spark, tmp_path):
    (tmp_path / "documents").mkdir()
    for name in "abc":
        write(tmp_path / "documents" / f"{name}.md", f"text {name}")
    write(tmp_path / "documents" / "other.txt", "x")
    assert run(spark, tmp_path) == [(n, "new", f"text {n}") for n in "abc"]
    assert run(spark, tmp_path) == []
    (tmp_path / "manifests").mkdir()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    (tmp_path / "manifests" / "m.json").write_text("".join(json.dumps({"doc_id": n, "content_sha256": sha(f"text {n}")}) + "\n" for n in "abc"))
    write(tmp_path / "documents" / "a.md", "text A")  # as long as before
    (tmp_path / "documents" / "b.md").unlink()
    write(tmp_path / "documents" / "c.md", "text c")  # touched: the hash is the manifest's
    write(tmp_path / "documents" / "d.md", "")
    assert run(spark, tmp_path) == [("a", "edited", "text A"), ("b", "removed", None), ("d", "new", "")]


def test_watch_reads_only_what_changed(spark, tmp_path):
    reader = listing.FolderReader({"root": str(tmp_path), "state": f"{tmp_path}/.state", "glob": "*.md"})
    for name in "abc":
        write(tmp_path / f"{name}.md", name)
    first = reader.latestOffset()
    assert reader.latestOffset() == first
    write(tmp_path / "b.md", "B!")
    second = reader.latestOffset()
    (part,) = reader.partitions(first, second)
    assert [(e, p) for e, p, *_ in part.files] == [("edited", "b.md")]
    assert [(r[0], r[1], r[4]) for r in reader.read(part)] == [("edited", "b.md", b"B!")]
    assert sum(len(p.files) for p in reader.partitions(reader.initialOffset(), second)) == 3
    (tmp_path / "b.md").unlink()
    assert list(reader.read(part)) == []  # gone before it was read: the next batch says that it is removed
    reader.commit(second)
    again = listing.FolderReader({"root": str(tmp_path), "state": f"{tmp_path}/.state", "glob": "*.md"})
    (part,) = again.partitions(second, again.latestOffset())
    assert [(e, p) for e, p, *_ in part.files] == [("removed", "b.md")]


def test_tasks_of_a_batch():
    files = [("added", str(i), 0, 10) for i in range(7)]
    assert [len(x) for x in listing.dealt(files, 3, 1000)] == [3, 3, 1]
    assert [len(x) for x in listing.dealt(files, 100, 25)] == [2, 2, 2, 1]
    assert [len(x) for x in listing.dealt([("added", "x", 0, 99), ("removed", "y", 0, 99), ("added", "z", 0, 1)], 9, 25)] == [2, 1]
    assert listing.dealt([]) == []


# --- bursts ---------------------------------------------------------------------------------------
def at(s):
    return datetime(2024, 1, 1) + timedelta(seconds=s)


@pytest.fixture
def feed(spark, tmp_path):
    """A folder of Parquet files that a stream reads one by one, and a function that adds one."""
    (tmp_path / "in").mkdir()

    def add(rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    return str(tmp_path / "in"), add


def drained(spark, df, tmp_path, mode="append"):
    df.writeStream.format("parquet" if mode == "append" else "memory").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode(mode).trigger(availableNow=True).start().awaitTermination(180)
    return spark.read.parquet(str(tmp_path / "out"))


def test_bursts_in_event_time(spark, tmp_path, feed):
    """Append mode, over a restart, with late rows within the watermark: the sessions of a batch query."""
    path, add = feed
    schema = "user string, ts timestamp"
    parts = [[("a", 0), ("a", 2), ("b", 1), ("a", 30)], [("a", 3), ("b", 60), ("b", 4), ("a", 28)], [("c", 200)]]
    for rows in parts[:2]:
        add([(u, at(s)) for u, s in rows], schema)
    stream = lambda: stateful.debounce(events.read_events(spark, path, schema, files_per_trigger=1), ["user"], timedelta(seconds=5), "ts", "40 seconds")
    drained(spark, stream(), tmp_path)
    add([(u, at(s)) for u, s in parts[2]], schema)  # moves the watermark past all others
    out = drained(spark, stream(), tmp_path)
    table = spark.createDataFrame([(u, at(s)) for p in parts for u, s in p], schema)
    wanted = events.debounce(table, ["user"], "5 seconds").filter("user <> 'c'")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, wanted.collect()))


def test_bursts_by_the_clock(spark, tmp_path, feed):
    """Half a second of silence ends a burst; what is open when the query stops comes out after the next start."""
    path, add = feed
    add([("a.md",), ("b.md",), ("a.md",)], "path string")
    made = stateful.debounce(events.read_events(spark, path, "path string"), ["path"])
    query = made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(120):
            time.sleep(0.5)
            if os.path.isdir(tmp_path / "out") and spark.read.schema("path string, n_events long").parquet(str(tmp_path / "out")).count() == 2:
                break
    finally:
        query.stop()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, out.select("path", "n_events").collect())) == [("a.md", 2), ("b.md", 1)]
    assert all(r["burst_end"] - r["burst_start"] == timedelta(milliseconds=500) for r in out.collect())


# --- conversations --------------------------------------------------------------------------------
TURNS = "conv_id string, turn long, text string, answer string, answered boolean, cited array<string>"


def turn(conv, i, answered=True, answer=None):
    return conv, i, f"q{i}", answer if answer is not None else f"answer {i}", answered, [f"{conv}{i}#{k}" for k in range(7)]


def test_conversation_state(spark, tmp_path, feed):
    path, add = feed
    turns = [turn("x", i, i != 6) for i in range(7)] + [turn("y", 0), turn("z", 0, False)] + [turn("w", i, answer="long " * 200) for i in range(6)]
    add(turns[:3] + turns[7:8], TURNS)
    seen = {}

    def keep(df, _):
        for r in df.collect():
            seen[r["conv_id"]] = (r["turns"], [tuple(x) for x in r["recent"]], r["summary"], r["carried"])

    def go():
        state = stateful.conversation_state(events.read_events(spark, path, TURNS, files_per_trigger=1))
        state.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).outputMode("update").trigger(availableNow=True).start().awaitTermination(180)

    go()
    assert seen["x"] == (3, [(i, f"q{i}") for i in range(3)], "", [f"x2#{k}" for k in range(5)])
    add(turns[2:7] + turns[8:], TURNS)  # turn 2 once more
    go()
    assert seen["x"] == (7, [(i, f"q{i}") for i in range(3, 7)], "answer 0 answer 1 answer 2", [f"x5#{k}" for k in range(5)])
    assert seen["z"][3] == []
    assert len(seen["w"][2]) == 1200
    batch = {r["conv_id"]: (r["turns"], [tuple(x) for x in r["recent"]], r["summary"], r["carried"]) for r in stateful.conversation_states(spark.createDataFrame(turns, TURNS)).collect()}
    assert batch == seen
