"""A folder of Markdown documents with a front matter, its manifests and small keyed stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FRONT = r"(?s)\A---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\z)"


class StaleDocument(RuntimeError):
    """The document changed since it was read."""


def scan(spark: SparkSession, root: str) -> DataFrame:
    """``doc_id, frontmatter, body, content_sha256, modified``: all ``*.md`` documents below ``root``/documents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(f"{root.rstrip('/')}/documents")
    text = F.col("content").cast("string")
    doc = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    return files.select(doc.alias("doc_id"), front_matter(text).alias("frontmatter"), F.regexp_replace(text, FRONT, "").alias("body"), F.sha2("content", 256).alias("content_sha256"), F.col("modificationTime").alias("modified"))


def ids_only(spark: SparkSession, root: str) -> DataFrame:
    """Document ids from the listing alone: the content column is never read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(f"{root.rstrip('/')}/documents")
    return files.select(F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("doc_id"))


def titles(spark: SparkSession, root: str) -> DataFrame:
    """Title from the first 8 KiB, else the id."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(f"{root.rstrip('/')}/documents")
    doc = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    head = front_matter(F.substring("content", 1, 8192).cast("string"))
    return files.select(doc.alias("doc_id"), F.coalesce(F.nullif(head["title"], F.lit("")), doc).alias("title"))


def front_matter(text: Column) -> Column:
    """``title, authors, date, source_url, license, tags, custom`` of the block between ``---`` lines; lists are ``[a, b]`` or ``- a`` lines."""
    block = F.regexp_extract(text, FRONT, 1)
    value = lambda key: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(block, rf"(?m)^{key}:[ \t]*([^\n]*)$", 1), "^[\"']|[\"']$", "")), F.lit(""))

    def items(key: str) -> Column:
        inline = F.regexp_extract(block, rf"(?m)^{key}:[ \t]*\[([^\n\]]*)\]", 1)
        lines = F.regexp_extract(block, rf"(?m)^{key}:[ \t]*\n((?:[ \t]*-[^\n]*(?:\n|\z))+)", 1)
        raw = F.when(inline != "", F.split(inline, ",")).otherwise(F.transform(F.split(lines, "\n"), lambda x: F.regexp_replace(x, r"^[ \t]*-", "")))
        return F.filter(F.transform(raw, lambda x: F.trim(F.regexp_replace(F.trim(x), "^[\"']|[\"']$", ""))), lambda x: x != "")

    known = ("title", "authors", "date", "source_url", "license", "tags")
    pairs = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^\w+:[ \t]*\S") & ~F.regexp_extract(x, r"^(\w+):", 1).isin(*known))
    custom = F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, r"^(\w+):", 1), F.trim(F.regexp_extract(x, r"^\w+:(.*)$", 1)))))
    return F.struct(value("title").alias("title"), items("authors").alias("authors"), value("date").try_cast("date").alias("date"), value("source_url").alias("source_url"), value("license").alias("license"), items("tags").alias("tags"), custom.alias("custom"))


def write_document(table: DataFrame, doc_id: str, body: str, expected_sha: str | None = None) -> DataFrame:
    """``table`` (doc_id, body, content_sha256) with one document replaced or added, if it still has the expected hash."""
    now = table.filter(F.col("doc_id") == doc_id).select("content_sha256").head()
    if expected_sha is not None and (now is None or now[0] != expected_sha):
        raise StaleDocument(doc_id)
    new = table.sparkSession.range(1).select(F.lit(doc_id).alias("doc_id"), F.lit(body).alias("body"), F.sha2(F.lit(body).cast("binary"), 256).alias("content_sha256"))
    return table.filter(F.col("doc_id") != doc_id).select("doc_id", "body", "content_sha256").unionByName(new)


def changed(docs: DataFrame, manifests: DataFrame) -> DataFrame:
    """``doc_id, state``: new, edited, removed or same, by comparing hashes with the manifests."""
    j = docs.select("doc_id", "content_sha256").join(manifests.select("doc_id", F.col("content_sha256").alias("_was")), "doc_id", "full_outer")
    return j.select("doc_id", F.when(F.col("_was").isNull(), "new").when(F.col("content_sha256").isNull(), "removed").when(F.col("_was") != F.col("content_sha256"), "edited").otherwise("same").alias("state"))


def integrity(docs: DataFrame, manifests: DataFrame, indexed: DataFrame) -> DataFrame:
    """One row: documents, drifted hashes, missing manifests, missing index rows."""
    m = manifests.select("doc_id", F.col("content_sha256").alias("_was"))
    j = docs.join(m, "doc_id", "left").join(indexed.select("doc_id").distinct().withColumn("_i", F.lit(True)), "doc_id", "left")
    count = lambda c: F.sum(c.cast("long"))
    return j.agg(F.count(F.lit(1)).alias("documents"), count(F.coalesce(F.col("_was") != F.col("content_sha256"), F.lit(False))).alias("drifted"), count(F.col("_was").isNull()).alias("no_manifest"), count(F.col("_i").isNull()).alias("not_indexed"))


def merge_manifest(manifests: DataFrame, updates: DataFrame, columns: list[str]) -> DataFrame:
    """Read-modify-write: columns that an update holds replace the old ones, others stay."""
    u = updates.select("doc_id", *[F.col(c).alias(f"_{c}") for c in columns])
    j = manifests.join(u, "doc_id", "full_outer")
    return j.select("doc_id", *[F.coalesce(f"_{c}", c).alias(c) for c in columns])


def replace_tables(store: DataFrame, doc_ids: DataFrame, tables: DataFrame) -> DataFrame:
    """Full replacement of the tables of some documents."""
    return store.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(tables, allowMissingColumns=True)


def cached(cache: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """What the cache answers, and what still has to be computed; the first writer of a key wins."""
    first = cache.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("written_at"))).filter("_r = 1").drop("_r")
    return first.join(wanted.select(key).distinct(), key, "left_semi"), wanted.join(first.select(key), key, "left_anti")


# --- conversations and scope sets -----------------------------------------------------------------
def append_turn(turns: DataFrame, conv: str, role: str, text: str) -> DataFrame:
    """The next turn's index is the number of turns so far."""
    n = turns.filter(F.col("conv_id") == conv).count()
    return turns.unionByName(turns.sparkSession.range(1).select(F.lit(conv).cast(turns.schema["conv_id"].dataType).alias("conv_id"), F.lit(n).cast(turns.schema["turn"].dataType).alias("turn"), F.lit(role).alias("role"), F.lit(text).alias("text")))


def recent_turns(turns: DataFrame, keep: int = 4) -> DataFrame:
    """The last ``keep`` turns of each conversation, verbatim, with how many older ones there are."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    n = F.count(F.lit(1)).over(Window.partitionBy("conv_id"))
    return turns.withColumn("_r", F.row_number().over(w)).withColumn("older", F.greatest(n - keep, F.lit(0))).filter(F.col("_r") <= keep).drop("_r")


def list_conversations(conversations: DataFrame, limit: int) -> DataFrame:
    return conversations.orderBy(F.desc("updated_at"), "conv_id").limit(limit)


def save_scope(scopes: DataFrame, name: str, doc_ids: list[str]) -> DataFrame:
    """Upsert by normalized name; ids are kept in order, once each."""
    from tesserae.functions.text import normalize_set_name

    ids = F.array(*[F.lit(d) for d in dict.fromkeys(doc_ids)]) if doc_ids else F.array().cast("array<string>")
    row = scopes.sparkSession.range(1).select(F.lit(name).alias("name"), normalize_set_name(F.lit(name)).alias("name_key"), ids.alias("doc_ids"))
    return scopes.join(row.select("name_key"), "name_key", "left_anti").select("name", "name_key", "doc_ids").unionByName(row)


def resolve_scopes(scopes: DataFrame, names: list[str]) -> DataFrame:
    """Documents of the named sets, each once, in order of first appearance: ``doc_id, pos``."""
    from tesserae.functions.text import normalize_set_name

    spark = scopes.sparkSession
    wanted = spark.range(1).select(F.posexplode(F.array(*map(F.lit, names))).alias("i", "n")).select("i", normalize_set_name(F.col("n")).alias("name_key"))
    flat = wanted.join(scopes, "name_key").select("i", F.posexplode("doc_ids").alias("j", "doc_id"))
    first = flat.groupBy("doc_id").agg(F.min(F.struct("i", "j")).alias("at"))
    return first.select("doc_id", (F.row_number().over(Window.orderBy("at")) - 1).alias("pos"))
