"""Events: replay, retention, debouncing, windows; batch and stream share the expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.storage import cut


def replay(events: DataFrame, since: Column | None = None, until: Column | None = None, kind: str | None = None, ts: str = "ts") -> DataFrame:
    """Events of an inclusive range of time, compared as timestamps, in order."""
    out = events
    if since is not None:
        out = out.filter(F.col(ts) >= since)
    if until is not None:
        out = out.filter(F.col(ts) <= until)
    if kind is not None:
        out = out.filter(F.col("event_type") == kind)
    return out.orderBy(ts, "event_id")


def retain(events: DataFrame, now: Column, days: int = 30, ts: str = "ts") -> DataFrame:
    return events.filter(F.col(ts) >= now - F.make_dt_interval(F.lit(days)))


def debounce(events: DataFrame, keys: list[str], gap: str = "500 milliseconds", ts: str = "ts") -> DataFrame:
    """One row for each burst of a key of a table: ``keys, burst_start, burst_end, n_events``; a burst ends after ``gap`` without an event.

    For streams see :func:`tesserae.streaming.stateful.debounce`.
    """
    burst = F.session_window(ts, gap)
    out = events.groupBy(*keys, burst.alias("_w")).agg(F.count(F.lit(1)).alias("n_events"))
    return out.select(*keys, F.col("_w.start").alias("burst_start"), F.col("_w.end").alias("burst_end"), "n_events")


def windowed(events: DataFrame, size: str, keys: list[str], late: str = "1 hour", slide: str | None = None, ts: str = "ts") -> DataFrame:
    """Counts and sums in event-time windows; on a stream a watermark drops what comes later than ``late``."""
    stream = events.withWatermark(ts, late) if events.isStreaming else events
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = stream.groupBy(w.alias("_w"), *keys).agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total"))
    return out.select(F.col("_w.start").alias("window_start"), *keys, "n_events", "total")


def read_events(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def publish(events: DataFrame, path: str, checkpoint: str):
    """Appends a stream of events to the log, exactly once by its checkpoint."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def watch(spark: SparkSession, root: str, react: Callable[[DataFrame, int], None], checkpoint: str):
    """Calls ``react(changed, batch)`` with documents below ``root`` that were added, edited or removed.

    ``changed`` has ``doc_id, state`` (new, edited, removed), ``content_sha256`` and ``content``.  A batch reads only
    the files that the listing shows as changed; those that the manifests know by the same hash (the
    library's own writes) are left out, and a batch in which nothing is left calls nothing.
    """
    from tesserae.streaming.listing import folder_changes

    root = root.rstrip("/")
    source = folder_changes(spark, f"{root}/documents", f"{checkpoint.rstrip('/')}-listings", "*.md")

    def on_batch(batch: DataFrame, number: int) -> None:
        seen = batch.select(F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("doc_id"), "event", F.sha2("content", 256).alias("content_sha256"), "content")
        try:
            known = spark.read.json(f"{root}/manifests").select("doc_id", F.col("content_sha256").alias("_was"))
        except AnalysisException:  # none was written yet
            known = spark.createDataFrame([], "doc_id string, _was string")
        changed = seen.join(known, "doc_id", "left").filter("event = 'removed' OR NOT content_sha256 <=> _was")
        state = F.when(F.col("event") == "removed", "removed").when(F.col("_was").isNull(), "new").otherwise("edited")
        changed = cut(changed.select("doc_id", state.alias("state"), "content_sha256", "content"))
        if not changed.isEmpty():
            react(changed, number)

    return source.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
