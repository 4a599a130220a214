"""Documents and their manifests in a snapshot store: one-document reads and writes, compare-and-swap, full reindex."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators import markdown
from tesserae.sources.snapshots import Store, append, latest
from tesserae.sources.vault import StaleDocument
from tesserae.storage import cut

DOCUMENTS, MANIFESTS = "documents", "manifests"
_SCHEMA = "doc_id string, body string, content_sha256 string"


def _sha(body: str) -> str:
    return hashlib.sha256(body.encode()).hexdigest()


def documents(store: Store, version: int | None = None) -> DataFrame | None:
    log = store.read(DOCUMENTS, version)
    return None if log is None else latest(log, ["doc_id"])


def read_document(store: Store, doc_id: str, version: int | None = None) -> dict | None:
    """One document; the filter on its id reaches the scan."""
    log = store.read(DOCUMENTS, version)
    found = None if log is None else latest(log.filter(F.col("doc_id") == doc_id), ["doc_id"]).head()
    return found and found.asDict()


def _expecting(doc_id: str, expected_sha: str | None) -> Callable[[DataFrame | None], None]:
    def check(log: DataFrame | None) -> None:
        if expected_sha is not None:
            now = None if log is None else latest(log.filter(F.col("doc_id") == doc_id), ["doc_id"]).head()
            if now is None or now["content_sha256"] != expected_sha:
                raise StaleDocument(doc_id)

    return check


def write_document(store: Store, doc_id: str, body: str, expected_sha: str | None = None) -> str:
    """Replaces or adds a document; returns its hash.

    With ``expected_sha`` the write is refused (:class:`StaleDocument`) unless the newest document has that
    hash, also if another writer came between: the claim of the snapshot then fails, and the check is made again.
    """
    append(store, DOCUMENTS, store.spark.createDataFrame([(doc_id, body, _sha(body))], _SCHEMA), check=_expecting(doc_id, expected_sha))
    return _sha(body)


def write_documents(store: Store, docs: DataFrame) -> int:
    """Replaces or adds many (doc_id, body) at once, whoever wrote before."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "body", F.sha2(F.col("body").cast("binary"), 256).alias("content_sha256"))
    return append(store, DOCUMENTS, rows)


def delete_document(store: Store, doc_id: str, expected_sha: str | None = None) -> int:
    return append(store, DOCUMENTS, store.spark.createDataFrame([(doc_id, None, None)], _SCHEMA), deleted=True, check=_expecting(doc_id, expected_sha))


# --- manifests ------------------------------------------------------------------------------------
def manifests(store: Store, version: int | None = None) -> DataFrame | None:
    log = store.read(MANIFESTS, version)
    return None if log is None else latest(log, ["doc_id"])


def write_manifests(store: Store, rows: DataFrame) -> int:
    """Read, modify, write: columns that ``rows`` lacks keep what the newest manifest of the document says."""

    def staged(version: int) -> tuple[dict[str, dict], dict]:
        old, new = manifests(store, version), rows
        if old is not None:
            missing = [c for c in old.columns if c not in rows.columns]
            new = rows.join(old.select("doc_id", *missing), "doc_id", "left").select(*old.columns) if missing else rows.select(*old.columns)
        made = store.stage(MANIFESTS, new.withColumn("written", F.lit(version + 1)).withColumn("deleted", F.lit(False)))
        return {MANIFESTS: store.joined(store.entry(MANIFESTS, version), made)}, {"appended": MANIFESTS}

    return store.change(staged)


def read_manifest(store: Store, doc_id: str) -> dict | None:
    log = store.read(MANIFESTS)
    found = None if log is None else latest(log.filter(F.col("doc_id") == doc_id), ["doc_id"]).head()
    return found and found.asDict()


def delete_manifest(store: Store, doc_id: str) -> int:
    log = store.read(MANIFESTS)
    if log is None:
        return store.current()
    row = log.filter(F.col("doc_id") == doc_id).drop("written", "deleted").limit(1)
    return append(store, MANIFESTS, row, deleted=True)


# --- reindex --------------------------------------------------------------------------------------
def chunks_and_failures(docs: DataFrame, chunk: Callable[[str, str], list[dict]] | None = None, id_col: str = "doc_id", text_col: str = "body") -> DataFrame:
    """``doc_id, chunk_id, char_start, char_end, text, heading_path, error_type, message``: a document's chunks, or one row that says why it has none."""

    def plain(doc: str, text: str) -> list[dict]:
        return [{"chunk_id": f"{doc}#{hashlib.sha1(t.encode()).hexdigest()[:10]}", "char_start": a, "char_end": b, "text": t, "heading_path": p} for a, b, t, p in markdown.chunk_body(markdown.linearize_tables(text), markdown.TARGET, markdown.OVERLAP)]

    one = chunk or plain
    schema = pa.schema([("doc_id", pa.string()), ("chunk_id", pa.string()), ("char_start", pa.int32()), ("char_end", pa.int32()), ("text", pa.string()), ("heading_path", pa.list_(pa.string())), ("error_type", pa.string()), ("message", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [{"doc_id": doc} | r for r in one(doc, text)]
                except Exception as e:  # a broken document must not stop the others
                    rows.append({"doc_id": doc, "error_type": type(e).__name__, "message": str(e)})
            yield pa.RecordBatch.from_pydict({n: [r.get(n) for r in rows] for n in schema.names}, schema=schema)

    return docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id string, chunk_id string, char_start int, char_end int, text string, heading_path array<string>, error_type string, message string")


def reindex(store: Store, docs: DataFrame | None = None, chunk: Callable[[str, str], list[dict]] | None = None) -> dict:
    """Builds chunks of all documents anew in one snapshot, beside the failures of single documents.

    Readers see the old chunks until the snapshot is there.  Of equal chunks of a document the first stays.
    """

    def staged(version: int) -> tuple[dict[str, dict], dict]:
        source = docs if docs is not None else documents(store, version)
        rows = cut(chunks_and_failures(source, chunk))  # once: both tables are taken from it
        good = rows.filter("error_type IS NULL").drop("error_type", "message")
        first = good.groupBy("doc_id", "chunk_id").agg(F.min("char_start").alias("char_start"))
        chunks = store.stage("chunks", good.join(first, ["doc_id", "chunk_id", "char_start"], "left_semi").dropDuplicates(["doc_id", "chunk_id"]))
        failed = store.stage("failures", rows.filter("error_type IS NOT NULL").select("doc_id", "error_type", "message"))
        report.update(documents_processed=source.count() - store.read_entry("failures", failed).count(), chunks_written=store.read_entry("chunks", chunks).count(), failures=store.read_entry("failures", failed).count())
        return {"chunks": chunks, "failures": failed}, {"reindex": dict(report)}

    report: dict = {}
    report["version"] = store.change(staged)
    return report
