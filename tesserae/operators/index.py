"""Chunk tables: reading order, point lookups, keyed stores, incremental diff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(chunks: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row for each chunk id: the first in reading order."""
    w = Window.partitionBy("chunk_id").orderBy(*(order or ["document_id", "char_start"]))
    return chunks.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def upsert_chunks(store: DataFrame, chunks: DataFrame) -> DataFrame:
    new = first_wins(chunks)
    return store.join(new.select("chunk_id"), "chunk_id", "left_anti").unionByName(new, allowMissingColumns=True)


def delete_documents(store: DataFrame, doc_ids: DataFrame) -> DataFrame:
    return store.join(doc_ids.select("document_id").distinct(), "document_id", "left_anti")


def retitle(store: DataFrame, doc: str, title: str) -> DataFrame:
    return store.withColumn("document_title", F.when(F.col("document_id") == doc, F.lit(title)).otherwise(F.col("document_title")))


def by_ids(store: DataFrame, ids: DataFrame) -> DataFrame:
    """Chunks of ``ids`` (pos, chunk_id) in the order asked for; repeated ids repeat, missing ones are left out."""
    return ids.join(store, "chunk_id").orderBy("pos")


def of_document(store: DataFrame, doc: str) -> DataFrame:
    return store.filter(F.col("document_id") == doc).orderBy("char_start")


def identities(store: DataFrame) -> DataFrame:
    return store.select("document_id", "document_title").distinct()


def diff(old: DataFrame, new: DataFrame, rebuild: Column | None = None) -> DataFrame:
    """``chunk_id, action`` (add, delete, keep) from one full outer join on the id; with ``rebuild`` every new chunk is added."""
    a = old.select("chunk_id").distinct().withColumn("_old", F.lit(True))
    b = new.select("chunk_id").distinct().withColumn("_new", F.lit(True))
    action = F.when(F.col("_old").isNull(), "add").when(F.col("_new").isNull(), "delete")
    if rebuild is not None:
        action = action.when(rebuild, "add")
    return a.join(b, "chunk_id", "full_outer").select("chunk_id", action.otherwise("keep").alias("action"))


def needs_rebuild(manifest: DataFrame, current: dict[str, str]) -> DataFrame:
    """Documents of a manifest table whose recipe or model tags are not the current ones."""
    stale = F.lit(False)
    for name, value in current.items():
        stale = stale | ~F.col(name).eqNullSafe(F.lit(value))
    return manifest.filter(stale)


def page_intervals(pages: DataFrame, gap: int = 2) -> DataFrame:
    """``doc_id, page, page_start, page_end`` from the character counts of pages joined by ``gap`` characters."""
    w = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("char_count") + gap).over(w), F.lit(0))
    return pages.select("doc_id", "page", start.alias("page_start"), (start + F.col("char_count")).alias("page_end"))


def page_at(offsets: DataFrame, intervals: DataFrame) -> DataFrame:
    """``offsets`` (doc_id, offset) with the page that holds the offset; in a gap or past the end the last page that starts before it."""
    joined = offsets.join(intervals, (offsets["doc_id"] == intervals["doc_id"]) & (intervals["page_start"] <= offsets["offset"]), "left").drop(intervals["doc_id"])
    return joined.groupBy(*offsets.columns).agg(F.max_by("page", "page_start").alias("page"))


def wikilink_targets(links: DataFrame, chunks: DataFrame) -> DataFrame:
    """First chunk of the linked document, or of the section whose heading equals the link's, case aside: ``doc, section, chunk_id``."""
    hit = F.col("section").isNull() | F.exists("heading_path", lambda h: F.lower(h) == F.lower(F.col("section")))
    j = links.select("doc", "section").distinct().join(chunks, F.col("doc") == F.col("document_id")).filter(hit)
    return j.groupBy("doc", "section").agg(F.min_by("chunk_id", "char_start").alias("chunk_id"))


def near_tables(hits: DataFrame, tables: DataFrame, within: int = 2000, most: int = 6) -> DataFrame:
    """Tables at most ``within`` characters from a hit chunk of their document, nearest first."""
    gap = F.greatest(F.lit(0), F.col("t_start") - F.col("char_end"), F.col("char_start") - F.col("t_end"))
    t = tables.select("document_id", "table_id", F.col("char_start").alias("t_start"), F.col("char_end").alias("t_end"))
    j = hits.select("document_id", "char_start", "char_end").join(t, "document_id").withColumn("gap", gap).filter(F.col("gap") <= within)
    return j.groupBy("document_id", "table_id").agg(F.min("gap").alias("gap")).orderBy("gap", "document_id", "table_id").limit(most)


def matched_tables(tables: DataFrame, terms: Column, own: Column, least: int = 2, most: int = 6) -> DataFrame:
    """Tables whose terms share at least ``least`` with the query's, by overlap, then order."""
    return tables.withColumn("overlap", F.size(F.array_intersect(own, terms))).filter(F.col("overlap") >= least).orderBy(F.desc("overlap"), "char_start").limit(most)


#: Hits that make a document count, and those that do without its title; how far the first must lead; share of the first's hits that the others need; documents of a scope.
LEAST_HITS, STRONG_HITS, DOMINANCE, BAND, SCOPE_DOCS = 2, 3, 2.0, 0.5, 2


def artifact_scopes(hits: DataFrame, qualifiers: DataFrame) -> DataFrame:
    """``ref_id, doc_ids, via``: the documents in which each named artifact lives; none where that is not sure.

    ``hits`` (ref_id, token, doc_id, title, score) are the best chunks of one search for each token, so they are
    few for each reference; ``qualifiers``: ref_id, tokens.  A document needs two hits.  One that has twice the
    hits of the next one, or no next one, is dominant; else those with half of the first's hits that
    name a token in the title or have three hits form a set, if they are no more than two.  A single
    token must stand in the title of a chosen document, unless no other document has a hit.  Where a
    chosen document's title names a token, others of that kind are added, up to two.
    """
    votes = hits.groupBy("ref_id", "doc_id").agg(F.count(F.lit(1)).alias("hits"), F.max("score").alias("score"), F.min_by("title", F.struct("token", F.coalesce("title", F.lit("")))).alias("title"))
    atoms = lambda t: F.regexp_extract_all(_folded(t), F.lit("[0-9a-z]+"), F.lit(0))
    q = qualifiers.select("ref_id", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))
    voted = votes.join(q, "ref_id").withColumn("named", F.arrays_overlap(F.transform("tokens", _folded), atoms(F.coalesce("title", F.lit("")))))
    row = F.struct((-F.col("hits")).alias("h"), (-F.col("score")).alias("s"), "doc_id", "named")
    listed = voted.groupBy("ref_id").agg(F.sort_array(F.collect_list(row)).alias("_all"))
    j = q.join(listed, "ref_id", "left").withColumn("_all", F.coalesce("_all", F.filter(F.array(F.lit(None).cast(listed.schema["_all"].dataType.elementType)), lambda x: x.isNotNull())))
    j = j.withColumn("_d", F.filter("_all", lambda x: x["h"] <= -LEAST_HITS)).withColumn("_top", F.try_element_at("_d", F.lit(1))["h"])
    alone = (F.size("_d") == 1) | (F.col("_top") <= DOMINANCE * F.try_element_at("_d", F.lit(2))["h"])
    band = F.filter("_d", lambda x: (x["h"] <= F.least(F.lit(-LEAST_HITS), BAND * F.col("_top"))) & (x["named"] | (x["h"] <= -STRONG_HITS)))
    j = j.withColumn("_alone", alone).withColumn("_band", band)
    small = F.size("_band").between(1, SCOPE_DOCS)
    base = F.when(F.col("_alone"), F.slice("_d", 1, 1)).when(small, F.col("_band"))
    via = F.when(F.size("tokens") == 0, "none-no-qualifier").when(F.size("_d") == 0, "none-weak").when(F.col("_alone"), "dominant").when(small, "small-set").otherwise("none-spread")
    j = j.withColumn("_base", base).withColumn("_via", via)
    titled = F.exists("_base", lambda x: x["named"])
    unsure = F.col("_via").isin("dominant", "small-set") & (F.size("tokens") == 1) & (F.size("_all") > 1) & ~titled
    more = F.filter("_d", lambda x: x["named"] & ~F.array_contains(F.transform("_base", lambda b: b["doc_id"]), x["doc_id"]))
    chosen = F.slice(F.transform(F.when(titled, F.concat("_base", more)).otherwise(F.col("_base")), lambda x: x["doc_id"]), 1, SCOPE_DOCS)
    sure = F.col("_via").isin("dominant", "small-set") & ~unsure
    return j.select("ref_id", F.when(sure, chosen).otherwise(F.slice(F.transform("_d", lambda x: x["doc_id"]), 1, 0)).alias("doc_ids"), F.when(unsure, "none-singletoken-ambiguous").otherwise(F.col("_via")).alias("via"))


def _folded(token: Column) -> Column:
    from tesserae.functions.text import fold

    return fold(token)


def dominant_route(scores: DataFrame, least: int = 2) -> DataFrame:
    """The form whose overlap is at least ``least`` and strictly above the next one's."""
    w = Window.orderBy(F.desc("overlap"), "form")
    ranked = scores.withColumn("_next", F.lead("overlap").over(w)).withColumn("_r", F.row_number().over(w))
    return ranked.filter((F.col("_r") == 1) & (F.col("overlap") >= least) & (F.col("_next").isNull() | (F.col("overlap") > F.col("_next")))).select("form", "overlap")
