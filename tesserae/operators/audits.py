"""Audits and small compositions: entity sets, graph expansion, labelling, framing, parse scores, report structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.rules import equations
from tesserae.functions.text import STOPWORDS, heading_texts, set_f1
from tesserae.operators import evals, fulltext, graph


#: Words that are no names, kinds of topics, of proper nouns, and those that no gold list covers.
CONNECTORS = (
    "the", "a", "an", "of", "and", "or", "to", "in", "on", "for", "with", "by", "at", "as", "is", "be", "this", "that", "le", "la", "les", "de",
    "des", "du", "un", "une", "et", "ou", "à", "au", "aux", "en", "dans", "pour", "sur", "avec",
)
TOPICAL, PROPER, HARD = ("concept", "method", "tool"), ("person", "place", "org"), ("method", "tool", "concept")


def looks_like_noise(name: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Whether a name is a letter, a word that names nothing, a number, or holds no letter or digit."""
    n = F.lower(F.trim(name))
    return (F.length(n) <= 1) | n.isin(*stopwords, *CONNECTORS) | F.regexp_replace(n, r"[.:/]", "").rlike(r"^\p{Nd}+$") | ~n.rlike(r"[\p{L}\p{N}]")


def entity_set_metrics(mentions: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """One row over the entities of ``mentions`` (doc_id, entity_id, name, kind), or those of some ``kinds``.

    Counts of entities and of (document, entity) pairs, means of words, characters and specificity (``ln(N / df)``
    times the kind's weight, 0 for generic ones), rates of single words, noise, generic, topical and
    proper names.  ``N`` counts the documents of all kinds.
    """
    n = mentions.select("doc_id").distinct().agg(F.count(F.lit(1)).alias("_N"))
    own = mentions if kinds is None else mentions.filter(F.col("kind").isin(*kinds))
    first = own.groupBy("entity_id").agg(F.min(F.struct("name", "kind")).alias("_e")).select("entity_id", "_e.name", "_e.kind")
    df = graph.doc_frequency(own).join(first, "entity_id").crossJoin(F.broadcast(n))
    words = F.size(F.filter(F.split(F.trim("name"), r"\s+"), lambda w: w != ""))
    generic = F.col("df") > graph.GENERIC_SHARE * F.col("_N")
    rate = lambda c, name: F.avg(c.cast("double")).alias(name)
    return df.agg(
        F.count(F.lit(1)).alias("entities"),
        rate(words <= 1, "single_rate"),
        rate(generic, "generic_rate"),
        F.avg(F.coalesce(graph.contribution(F.col("df"), F.col("_N"), F.col("kind")), F.lit(0.0))).alias("specificity"),
        rate(looks_like_noise(F.col("name")), "noise_rate"),
        rate(F.col("kind").isin(*TOPICAL), "topical_rate"),
        rate(F.col("kind").isin(*PROPER), "proper_rate"),
        F.coalesce(F.sum("df"), F.lit(0)).alias("pairs"),
        F.avg(words).alias("mean_words"),
        F.avg(F.length("name")).alias("mean_chars"),
    )


def better_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row ``better``, with what it follows from: of two :func:`entity_set_metrics` the new one keeps 60 % of the entities, has 0.02 less noise, no more generic names and no less specificity."""
    a, b = (df.select(*[F.col(c).alias(f"_{p}_{c}") for c in ("entities", "noise_rate", "generic_rate", "specificity")]) for df, p in ((old, "a"), (new, "b")))
    gain = lambda c: F.coalesce(f"_b_{c}", F.lit(0.0)) - F.coalesce(f"_a_{c}", F.lit(0.0))
    j = a.crossJoin(F.broadcast(b))  # a row each
    out = j.select(F.when(F.col("_a_entities") > 0, F.col("_b_entities") / F.col("_a_entities")).otherwise(0.0).alias("coverage"), (-gain("noise_rate")).alias("noise_cut"), (-gain("generic_rate")).alias("generic_cut"), gain("specificity").alias("specificity_gain"))
    return out.withColumn("better", (F.col("coverage") >= 0.6) & (F.col("noise_cut") >= 0.02) & (F.col("generic_cut") >= 0) & (F.col("specificity_gain") >= 0))


def kind_histogram(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("kind").agg(F.countDistinct("entity_id").alias("entities"))


def expand_by_graph(hits: DataFrame, mentions: DataFrame, chunks: DataFrame, docs: int = 3, near: int = 3, per_doc: int = 2) -> DataFrame:
    """First chunks of documents that share entities with the first documents of a ranking (chunk_id, document_id, rank)."""
    first = hits.groupBy("document_id").agg(F.min("rank").alias("rank")).orderBy("rank", "document_id").limit(docs)
    found = graph.related(mentions, first.select(F.col("document_id").alias("doc_id")), near)
    wanted = found.select(F.col("doc_id").alias("document_id")).distinct().join(hits.select("document_id"), "document_id", "left_anti")
    at = F.row_number().over(Window.partitionBy("document_id").orderBy("char_start", "chunk_id"))
    return chunks.join(wanted, "document_id").withColumn("_r", at).filter(F.col("_r") <= per_doc).drop("_r")


def anchor_labels(chunks: DataFrame, anchor: str, document: str, n: int = 1, k: int = 5) -> DataFrame:
    """Gold chunks of a question: of the ``k`` best for an anchor phrase the first ``n`` of the wanted document."""
    best = fulltext.search(chunks, [anchor], k).join(chunks.select("chunk_id", "document_id"), "chunk_id")
    return best.filter(F.col("document_id") == document).orderBy(F.desc("score"), "chunk_id").limit(n).select("chunk_id")


#: Picture classes that a page is sent to the vision model for.
DIAGRAMS = (
    "flow_chart", "engineering_drawing", "electrical_diagram", "cad_drawing", "screenshot_from_computer", "screenshot_from_manual",
    "screenshot",
)
DIAGRAM_AREA = 20_000.0


def diagram_pages(figures: DataFrame, least: float = 0.5, area: float = DIAGRAM_AREA) -> DataFrame:
    """Pages with a diagram of at least ``area`` square points that was classified with some confidence."""
    return figures.filter(F.col("picture_class").isin(*DIAGRAMS) & (F.col("confidence") >= least) & (F.col("area") >= area)).select("doc_id", "page").distinct()


def frame_result(sql: str, header: list[str], rows: list[list[str]], value: float | None = None, most: int = 900, shown: int = 12) -> str:
    """Evidence text of a table query: the statement, its value, and contributing rows as ``label=cell`` pairs."""
    lines = [f"SQL: {sql}"] + ([f"Result: {value:g}"] if value is not None else [])
    lines += ["; ".join(f"{h}={c}" for h, c in zip(header, r, strict=False)) for r in rows[:shown]]
    return "\n".join(lines)[:most]


def parse_quality(reference: Column, found: Column) -> dict[str, Column]:
    """Character and word error rates and the agreement of headings and equations, as columns."""
    return {
        "cer": evals.cer(reference, found),
        "wer": evals.wer(reference, found),
        "heading_f1": set_f1(heading_texts(found), heading_texts(reference)),
        "equation_f1": set_f1(equations(found), equations(reference)),
    }


def within_thresholds(scores: dict[str, Column], upper: dict[str, float], lower: dict[str, float]) -> Column:
    """All given bounds hold; a score without a bound does not count."""
    ok = F.lit(True)
    for k, v in upper.items():
        ok = ok & (scores[k] <= v)
    for k, v in lower.items():
        ok = ok & (scores[k] >= v)
    return ok


def unresolved_citations(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Cited chunks (query_id, chunk_id) that are not among the evidence of their answer."""
    return answers.join(evidence.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")


def group_paragraphs(starts: list[bool], target: int, most: int = 6) -> list[list[int]]:
    """Indices of points as paragraphs: a new one at every start and after ``most``; the smallest neighbours are joined down to ``target``; a single one is halved."""
    groups: list[list[int]] = []
    for i, start in enumerate(starts):
        if not groups or start or len(groups[-1]) >= most:
            groups.append([])
        groups[-1].append(i)
    while len(groups) > max(1, target):
        k = min(range(len(groups) - 1), key=lambda j: len(groups[j]) + len(groups[j + 1]))
        groups[k : k + 2] = [groups[k] + groups[k + 1]]
    if len(groups) == 1 and len(groups[0]) > 1 and target > 1:
        half = (len(groups[0]) + 1) // 2
        groups = [groups[0][:half], groups[0][half:]]
    return groups


def reattach_header(labels: list[str], rows: list[list[str]]) -> list[str] | None:
    """Header from labels that a parser left outside of a table: only if there is one for each value column."""
    width = max(map(len, rows), default=0)
    if len(labels) == width:
        return labels
    return ["", *labels] if len(labels) == width - 1 else None
