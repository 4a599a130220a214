"""Citations resolved to documents by title, author and year, or title words.

Scores: 0.95 the title (8 letters or more) stands in the citation; 0.90 a form of author and year does; 0.88
the citation (12 or more) stands in the title; ``min(0.78, 0.55 + 0.10 n)`` for ``n >= 2`` shared title words that
are at least 60 % of them.  The best score of a document counts; of equal scores the smaller ``doc_id`` wins.

Citations of the same wording are resolved once, and of documents that share a title, a form or title
words the two smallest ids are kept: one may be the citing document itself.  Substrings are found by
automata, words by an index of each title's rarest ones, so a frequent word never pairs anything.
Forms and words are made for distinct authors and titles, not for each document that has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import rules
from tesserae.operators.patterns import MOST_PATTERNS, contained
from tesserae.storage import written

#: Scores, least lengths, confidence of a candidate by its band.
TITLE, AUTHOR_YEAR, PART_OF_TITLE, LEAST_SCORE = 0.95, 0.90, 0.88, 0.70
TITLE_CHARS, PART_CHARS = 8, 12
CONFIDENCE = {"high": 0.92, "medium": 0.68, "low": 0.42}


def _firsts(df: DataFrame, *key: str) -> DataFrame:
    """``key`` and the two smallest ids that share it.

    Each task leaves out what comes after its own two before rows are shuffled, which a ``distinct`` ahead of the rank would prevent.
    """
    w = Window.partitionBy(*key).orderBy("doc_id")
    top = df.select(*key, "doc_id").withColumn("_r", F.dense_rank().over(w)).filter("_r <= 2").select(*key, "doc_id").distinct()
    return top.groupBy(*key).agg(F.sort_array(F.collect_list("doc_id")).alias("docs"))


def token_score(n: Column) -> Column:
    return F.least(F.lit(0.78), F.lit(0.55) + F.lit(0.10) * n)


def by_tokens(norms: DataFrame, titles: DataFrame) -> DataFrame:
    """``norm, docs, score`` from shared words.

    A title of n words needs ``max(2, ceil(0.6 n))`` of them, so at least one of its ``n - need + 1`` rarest must be
    shared: only those are joined, and what meets there is counted in full, at the first of them that is shared.
    """
    sets = titles.filter(F.size("tokens") >= 2)
    df = sets.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    listed = sets.select("tokens", "docs", F.explode("tokens").alias("t")).join(df, "t")
    need = F.greatest(F.lit(2), F.ceil(F.size("tokens") * 0.6).cast("int"))
    ordered = listed.groupBy("tokens", "docs").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("r"))
    rare = ordered.select("tokens", "docs", F.slice("r.t", 1, F.size("tokens") - need + 1).alias("rare"))
    keys = rare.select("tokens", "docs", "rare", F.explode("rare").alias("t"))
    asked = norms.select("norm", F.array_distinct(F.regexp_extract_all("norm", F.lit("[a-z0-9]+"), F.lit(0))).alias("own"))
    met = asked.select("norm", "own", F.explode("own").alias("t")).join(keys, "t").filter(F.try_element_at(F.array_intersect("rare", "own"), F.lit(1)) == F.col("t"))
    n = F.size(F.array_intersect("own", "tokens"))
    return met.filter((n >= 2) & (n / F.size("tokens") >= 0.6)).select("norm", "docs", token_score(n).alias("score"))


def resolve(candidates: DataFrame, documents: DataFrame, most: int = MOST_PATTERNS) -> DataFrame:
    """``citation_id, doc_id, title, via, score, confidence`` of each candidate (citation_id, surface_text, confidence, skip_doc_id) that a document is found for.

    ``documents``: doc_id, title, authors, date.  ``confidence`` is the mean of the candidate's band (high, medium, low)
    and the score.  The document ``skip_doc_id`` is never the answer.
    """
    c = candidates.withColumn("norm", F.lower(F.trim("surface_text"))).filter("norm <> ''")
    c = written(c.select("citation_id", "norm", "confidence", "skip_doc_id"))
    norms = written(c.select("norm").distinct())
    d = documents.filter("doc_id IS NOT NULL").select("doc_id", F.lower(F.trim(F.coalesce("title", F.lit("")))).alias("lower"), "authors", "date")
    wordings = written(_firsts(d, "lower"))
    titles = wordings.filter(F.length("lower") >= TITLE_CHARS)
    # Written, or Spark filters by the size of the forms below the rank, and makes them for each document.
    signed = written(_firsts(d, "authors", "date")).select(F.explode(rules.author_year_forms(F.col("authors"), F.col("date"))).alias("form"), "docs")
    forms = written(_firsts(signed.select("form", F.explode("docs").alias("doc_id")), "form"))
    listed = wordings.select(rules.title_tokens(F.col("lower")).alias("tokens"), F.explode("docs").alias("doc_id"))
    tokens = written(_firsts(listed.filter(F.size("tokens") > 0), "tokens"))
    texts = norms.select(F.col("norm").alias("key"), F.col("norm").alias("text"))
    scored = lambda df, score, via: df.select("norm", "docs", F.lit(score).alias("score"), F.lit(via).alias("via"))
    whole = contained(texts, titles.select(F.col("lower").alias("pattern")), most).select(F.col("key").alias("norm"), F.col("pattern").alias("lower")).join(titles, "lower")
    part = contained(titles.select(F.col("lower").alias("key"), F.col("lower").alias("text")), norms.filter(F.length("norm") >= PART_CHARS).select(F.col("norm").alias("pattern")), most)
    part = part.select(F.col("pattern").alias("norm"), F.col("key").alias("lower")).join(titles, "lower")
    years = contained(texts, forms.select(F.col("form").alias("pattern")), most).select(F.col("key").alias("norm"), F.col("pattern").alias("form")).join(forms, "form")
    found = scored(whole, TITLE, "title").unionByName(scored(part, PART_OF_TITLE, "title")).unionByName(scored(years, AUTHOR_YEAR, "author_year"))
    found = found.unionByName(by_tokens(norms, tokens).withColumn("via", F.lit("tokens")))
    flat = found.select("norm", F.explode("docs").alias("doc_id"), "score", "via")
    # Two documents of each wording are enough: the best, and the best beside the citing one.
    by_doc = flat.groupBy("norm", "doc_id").agg(F.max(F.struct("score", "via")).alias("s")).select("norm", "doc_id", "s.*")
    top = by_doc.withColumn("_r", F.row_number().over(Window.partitionBy("norm").orderBy(F.desc("score"), "doc_id"))).filter((F.col("_r") <= 2) & (F.col("score") >= LEAST_SCORE))
    named = documents.select("doc_id", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.col("doc_id").cast("string")).alias("title"))
    answers = top.join(named, "doc_id").groupBy("norm").agg(F.sort_array(F.collect_list(F.struct("_r", "doc_id", "score", "via", "title"))).alias("a"))
    best = F.try_element_at(F.filter("a", lambda x: ~x["doc_id"].eqNullSafe(F.col("skip_doc_id"))), F.lit(1))
    band = F.coalesce(*[F.when(F.col("confidence") == k, v) for k, v in CONFIDENCE.items()])
    out = c.join(answers, "norm").withColumn("_b", best).filter("_b IS NOT NULL")
    return out.select("citation_id", "_b.doc_id", "_b.title", "_b.via", "_b.score", ((band + F.col("_b.score")) / 2).alias("confidence"))
