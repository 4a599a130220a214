"""Shared plumbing: the shared folder, written intermediate tables, size-checked broadcasts."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

#: A key table is broadcast only when it holds at most this many rows (about 16 bytes each).
BROADCAST_ROWS = 1_000_000

BATCH_BYTES = 4 << 20

_written: list[tuple[SparkSession, str]] = []


_temporary: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a local session leaves it unset (tests, a laptop) a temporary folder is chosen, once for each
    application.  On a cluster that folder would exist on one machine only, so there it must be set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _temporary:
            _temporary[app] = "file://" + tempfile.mkdtemp(prefix="tesserae-")
        found = _temporary[app]
    return found


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_BYTES``, unless the session chose a size: texts may be long, and a task holds a few batches."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":  # the default
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage with files that survive a lost executor, and freezes values such as
    ``monotonically_increasing_id`` that a re-run could change.  The files go when Python ends.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark).rstrip('/')}/tesserae/{uuid.uuid4().hex}"
    df.write.parquet(path)
    remove_later(spark, path)
    return spark.read.parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that driver and executors share."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def remove_later(spark: SparkSession, path: str) -> None:
    """Delete ``path`` when Python ends."""
    _written.append((spark, path))


def discard() -> None:
    """Delete every table that :func:`materialise` wrote and that is not needed any more."""
    while _written:
        try:
            remove(*_written.pop())
        except Exception:  # the session may be gone already; the folder is temporary anyway
            return


atexit.register(discard)


def semi_join(df: DataFrame, keys: DataFrame, on: list[str], rows: int | None = None) -> DataFrame:
    """Rows of ``df`` whose key is in ``keys``; broadcast only if ``keys`` was counted as small.

    Above ``BROADCAST_ROWS`` keys the join shuffles, and AQE may split its skewed partitions.
    """
    rows = keys.count() if rows is None else rows
    return df.join(F.broadcast(keys) if rows <= BROADCAST_ROWS else keys, on, "left_semi")


def without_copies(docs: DataFrame, key: Column, verdicts: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``verdicts`` reject.

    ``key`` gives a row of ``docs`` a value that only rows with the same id and text share; ``verdicts``
    has the columns ``key, kept``, one row for each row judged.  Rows whose key has no verdict stay, rows
    of a key that is never kept go, and of several rows of a kept key one stays.  Documents are not
    shuffled where the keys were counted as few; else the joins shuffle.
    """
    keys = verdicts.toDF("__key", "__kept").groupBy("__key").agg(F.max("__kept").alias("__kept"), F.count(F.lit(1)).alias("__n"))
    keys = materialise(keys.filter("NOT __kept OR __n > 1").drop("__n"))
    few = keys.count() <= BROADCAST_ROWS // 4  # wider keys than elsewhere
    gone, twins = ((F.broadcast(k) if few else k) for k in (keys.select("__key"), keys.filter("__kept").select("__key")))
    keyed = docs.withColumn("__key", key)
    out = keyed.join(gone, "__key", "left_anti")
    if not keys.filter("__kept").isEmpty():
        out = out.unionByName(keyed.join(twins, "__key", "left_semi").dropDuplicates(["__key"]))
    return out.select(*docs.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which a Python worker gives its free memory back: workers live on, idle, while the JVM works beside them."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped


#: Words read at once by :func:`read_words`.
READ_WORDS = 200_000


def read_words(texts: list[str | None], words_of: Callable[[str], list[str]]) -> Iterator[tuple[list[str], np.ndarray]]:
    """The words of each text and their 64-bit hashes; a distinct word is hashed once for some texts."""

    def told() -> Iterator[tuple[list[str], np.ndarray]]:
        codes = pa.array(list(chain.from_iterable(held)), pa.string()).dictionary_encode()
        hashes = np.fromiter((xxh64_intdigest(x) for x in codes.dictionary.to_pylist()), np.uint64, len(codes.dictionary))
        found = hashes[codes.indices.to_numpy()]
        yield from zip(held, np.split(found, np.cumsum([len(x) for x in held])[:-1]), strict=True)

    held, n = [], 0
    for text in texts:
        held.append(words_of(text) if text else [])
        n += len(held[-1])
        if n >= READ_WORDS:
            yield from told()
            held, n = [], 0
    if held:
        yield from told()


class Memo(dict):
    """A bounded memo of a pure function: two generations, of which the older goes when the younger is full.

    It only saves time; results never depend on what it holds.
    """

    def __init__(self, function, size: int, fixed: dict | None = None):
        super().__init__(fixed or {})
        self.function, self.size, self.fixed, self.old = function, size, fixed or {}, {}

    def __missing__(self, key):
        if len(self) - len(self.fixed) >= self.size:
            self.old = dict(self)
            self.clear()
            self.update(self.fixed)
        found = self.old.get(key)
        if found is None:
            found = self.function(key)
        self[key] = found
        return found


#: Bytes of a text that are split into words at once.
WINDOW_BYTES = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def byte_windows(data: bytes, size: int = WINDOW_BYTES) -> Iterator[bytes]:
    """``data`` in pieces that end before a blank, so that the words of a very long text are never held all at once."""
    at = 0
    while at < len(data):
        cut = _BLANK.search(data, at + size) if len(data) - at > size else None
        end = cut.start() if cut else len(data)
        yield data[at:end]
        at = end
