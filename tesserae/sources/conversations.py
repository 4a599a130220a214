"""Conversations and scope sets in a snapshot store, and Markdown given inline.

Turns are appended as they come; a conversation's own row (title, scope, summary) and a scope set are
keyed rows, of which the newest counts.  Writers that meet try again on what the other one wrote.
"""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import ids
from tesserae.functions.text import normalize_set_name
from tesserae.sources.snapshots import Store, append, latest

HEADS, TURNS, SCOPES = "conversations", "turns", "scopes"
_HEAD = "conv_id string, title string, scope array<string>, summary string, updated_at timestamp"
_TURN = "conv_id string, turn long, text string, answer string, answered boolean, cited array<string>"
_SCOPE = "name_key string, name string, doc_ids array<string>"


class Unknown(KeyError):
    """No conversation of that id."""


def _now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


def conversations(store: Store) -> DataFrame:
    """All heads."""
    log = store.read(HEADS)
    return store.spark.createDataFrame([], _HEAD) if log is None else latest(log, ["conv_id"])


def turns(store: Store, conv: str | None = None) -> DataFrame:
    """Turns of conversations that exist, or of one of them, in order."""
    log = store.read(TURNS)
    if log is None:
        return store.spark.createDataFrame([], _TURN)
    mine = log if conv is None else log.filter(F.col("conv_id") == conv)
    return mine.drop("written", "deleted").join(conversations(store).select("conv_id"), "conv_id", "left_semi").orderBy("conv_id", "turn")


def create(store: Store, title: str = "", scope: list[str] | None = None) -> str:
    conv = uuid.uuid4().hex
    append(store, HEADS, store.spark.createDataFrame([(conv, title, scope or [], "", _now())], _HEAD))
    return conv


def head(store: Store, conv: str) -> dict:
    log = store.read(HEADS)
    found = None if log is None else latest(log.filter(F.col("conv_id") == conv), ["conv_id"]).head()
    if found is None:
        raise Unknown(conv)
    return found.asDict()


def _rewrite(store: Store, conv: str, **new) -> None:
    row = head(store, conv) | {"updated_at": _now()} | new
    append(store, HEADS, store.spark.createDataFrame([tuple(row[c.split()[0]] for c in _HEAD.split(", "))], _HEAD))


def set_scope(store: Store, conv: str, doc_ids: list[str]) -> None:
    _rewrite(store, conv, scope=list(dict.fromkeys(doc_ids)))


def set_summary(store: Store, conv: str, summary: str) -> None:
    _rewrite(store, conv, summary=summary)


def append_turn(store: Store, conv: str, text: str, answer: str = "", answered: bool = False, cited: list[str] | None = None) -> int:
    """The turn's number: how many there are.  Two writers never get the same one, as the slower one counts again."""
    head(store, conv)

    def staged(version: int) -> tuple[dict[str, dict], dict]:
        log = store.read(TURNS, version)
        number[0] = 0 if log is None else log.filter(F.col("conv_id") == conv).count()
        row = store.spark.createDataFrame([(conv, number[0], text, answer, answered, cited or [])], _TURN)
        made = store.stage(TURNS, row.withColumn("written", F.lit(version + 1)).withColumn("deleted", F.lit(False)))
        return {TURNS: store.joined(store.entry(TURNS, version), made)}, {"appended": TURNS}

    number = [0]
    store.change(staged)
    _rewrite(store, conv)
    return number[0]


def list_conversations(store: Store, limit: int) -> DataFrame:
    """The ``limit`` newest, with their number of turns."""
    n = turns(store).groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
    return conversations(store).orderBy(F.desc("updated_at"), "conv_id").limit(limit).join(n, "conv_id", "left").withColumn("turns", F.coalesce("turns", F.lit(0))).orderBy(F.desc("updated_at"), "conv_id")


def delete(store: Store, conv: str) -> bool:
    """Whether there was such a conversation; its turns are not seen any more."""
    try:
        row = head(store, conv)
    except Unknown:
        return False
    append(store, HEADS, store.spark.createDataFrame([tuple(row[c.split()[0]] for c in _HEAD.split(", "))], _HEAD), deleted=True)
    return True


# --- scope sets -----------------------------------------------------------------------------------
def scopes(store: Store) -> DataFrame:
    log = store.read(SCOPES)
    return store.spark.createDataFrame([], _SCOPE) if log is None else latest(log, ["name_key"])


def _named(store: Store, name: str, doc_ids: list[str]) -> DataFrame:
    row = store.spark.createDataFrame([(name, list(dict.fromkeys(doc_ids)))], "name string, doc_ids array<string>")
    return row.select(normalize_set_name(F.col("name")).alias("name_key"), "name", "doc_ids")


def save_scope(store: Store, name: str, doc_ids: list[str]) -> None:
    append(store, SCOPES, _named(store, name, doc_ids))


def get_scope(store: Store, name: str) -> list[str] | None:
    """Its documents, in order; None if there is no such set.  Case and blanks of the name do not count."""
    found = scopes(store).join(_named(store, name, []).select("name_key"), "name_key", "left_semi").head()
    return found and found["doc_ids"]


def delete_scope(store: Store, name: str) -> bool:
    if get_scope(store, name) is None:
        return False
    append(store, SCOPES, _named(store, name, []), deleted=True)
    return True


# --- inline Markdown ------------------------------------------------------------------------------
def inline_markdown(spark: SparkSession, bodies: list[tuple[str, str]]) -> DataFrame:
    """Ingested rows of Markdown texts (stem, body), without validation: ``doc_id, path, stem, kind, sha256, rejection_reason, title, body, size_bytes``."""
    rows = spark.createDataFrame(bodies, "stem string, body string").withColumn("_c", F.col("body").cast("binary"))
    return rows.select(ids.doc_id(F.col("_c"), F.col("stem")).alias("doc_id"), F.concat(F.lit("<inline:"), "stem", F.lit(">")).alias("path"), "stem", F.lit("markdown").alias("kind"), F.sha2("_c", 256).alias("sha256"), F.lit(None).cast("string").alias("rejection_reason"), F.col("stem").alias("title"), "body", F.length("_c").alias("size_bytes"))
