"""Quality metrics of retrieval, parsing and answers, as columns and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.numbers import numbers_in, scale_matches
from tesserae.functions.text import content_tokens, metric_text


def cer(reference: Column, found: Column) -> Column:
    """Character edits by the length of the reference (at least 1)."""
    a, b = metric_text(reference), metric_text(found)
    return F.when(F.length(a) == 0, F.when(F.length(b) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(a, b) / F.length(a))


def wer(reference: Column, found: Column) -> Column:
    """Word edits by the words of the reference: distinct words (up to a million) become single characters, whose edit distance Spark has.

    A word's number is looked up in a map that is made once for a row; a column named in a lambda would be worked out for every word.
    """
    split = lambda c: F.when(metric_text(c) == "", F.array().cast("array<string>")).otherwise(F.split(metric_text(c), " "))
    once = lambda c, f: F.transform(F.array(c), f)[0]
    char = lambda i: F.decode(F.unhex(F.lpad(F.hex(i + 0x10000), 8, "0")), "UTF-32")
    coded = lambda m, words: F.array_join(F.transform(words, lambda w: m[w]), "")
    numbered = lambda v: F.map_from_arrays(v, F.transform(v, lambda w, i: char(i + 1)))
    edits = lambda x, m: F.levenshtein(coded(m, x["a"]), coded(m, x["b"])) / F.size(x["a"])
    rate = lambda x: F.when(F.size(x["a"]) == 0, F.when(F.size(x["b"]) == 0, 0.0).otherwise(1.0)).otherwise(once(numbered(F.array_distinct(F.concat(x["a"], x["b"]))), lambda m: edits(x, m)))
    return once(F.struct(split(reference).alias("a"), split(found).alias("b")), rate)


def content_recall(reference: Column, found: Column) -> Column:
    a, b = F.array_distinct(content_tokens(reference)), F.array_distinct(content_tokens(found))
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def recall_at_k(ranked: Column, gold: Column, k: int) -> Column:
    """1 without gold."""
    g = F.array_distinct(gold)
    return F.when(F.size(g) == 0, 1.0).otherwise(F.size(F.array_intersect(F.slice(ranked, 1, k), g)) / F.size(g))


def citation_precision(cited: Column, gold: Column) -> Column:
    """Share of the cited that are gold, repeated ones counted again; 1 when nothing is cited."""
    return F.when(F.size(cited) == 0, 1.0).otherwise(F.size(F.filter(cited, lambda c: F.array_contains(gold, c))) / F.size(cited))


def _dcg(labels: Column) -> Column:
    terms = F.transform(labels, lambda x, i: x / (F.log2(i + 2)))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def ndcg_at_k(labels: Column, k: int, n_gold: Column | None = None) -> Column:
    """Binary nDCG of labels in ranked order.  The ideal is the same labels sorted, or ``n_gold`` ones if given (the standard form)."""
    got = F.slice(labels, 1, k)
    best = F.slice(F.sort_array(labels, asc=False), 1, k) if n_gold is None else F.array_repeat(F.lit(1.0), F.least(n_gold, F.lit(k)).cast("int"))
    ideal = _dcg(best)
    return F.when(ideal == 0, 0.0).otherwise(_dcg(got) / ideal)


def mrr_at_k(labels: Column, k: int) -> Column:
    at = F.array_position(F.transform(F.slice(labels, 1, k), lambda x: (x > 0).cast("int")), 1)
    return F.when(at > 0, 1.0 / at).otherwise(0.0)


def average_precision(labels: Column, n_gold: Column) -> Column:
    """Over the full list, divided by all gold."""
    hits = F.transform(labels, lambda x, i: F.when(x > 0, F.size(F.filter(F.slice(labels, 1, i + 1), lambda y: y > 0)) / (i + 1)).otherwise(0.0))
    return F.when(n_gold == 0, 0.0).otherwise(F.aggregate(hits, F.lit(0.0), lambda s, x: s + x) / n_gold)


def mention_recall(answer: Column, groups: Column) -> Column:
    """Share of slots (arrays of alternatives) of which one stands in the answer as whole words; an empty slot never does."""
    text = metric_text(answer)
    hit = lambda alt: F.rlike(text, F.concat(F.lit(r"(?<!\w)\Q"), metric_text(alt), F.lit(r"\E(?!\w)")))
    met = F.filter(groups, lambda g: F.exists(g, lambda alt: (metric_text(alt) != "") & hit(alt)))
    return F.when(F.size(groups) == 0, 1.0).otherwise(F.size(met) / F.size(groups))


def asserted(answer: Column, forbidden: Column) -> Column:
    """Forbidden phrases that the answer holds."""
    text = metric_text(answer)
    return F.filter(forbidden, lambda f: F.contains(text, metric_text(f)))


def fabricated_figures(answer: Column, blocked: Column, least: float = 1e4) -> Column:
    """Figures of the answer that equal a blocked one at some scale of a thousand."""
    return F.filter(numbers_in(answer), lambda x: (x >= least) & F.exists(blocked, lambda b: scale_matches(b, x)))


def fabricated_quotes(answer: Column, evidence: Column, blocked: Column) -> Column:
    """Blocked names or quotes that the answer holds as whole tokens and no evidence snippet does."""
    whole = lambda text, q: F.regexp_like(metric_text(text), F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.replace(metric_text(q), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?!\w)")))
    return F.filter(blocked, lambda q: (metric_text(q) != "") & whole(answer, q) & ~F.exists(evidence, lambda e: whole(e, q)))


#: Phrases that hedge, and phrases of an answer that refuses.
HEDGES = (
    "it depends", "in general", "difficult to say", "hard to say", "nuanced", "one should consider", "may touch on",
    "worth examining", "without more", "it is difficult", "generally speaking", "various factors", "a number of factors",
)
REFUSALS = (
    "i cannot answer", "i can't answer", "i am unable to answer", "i'm unable to answer", "no grounded answer",
    "cannot provide an answer", "unable to provide",
)
REFUSAL_WORDS = 40


def hedge_density(answer: Column) -> Column:
    """Hedging phrases by the words of the answer (at least 1)."""
    text = metric_text(answer)
    hits = sum((F.size(F.split(text, rf"\Q{h}\E")) - 1 for h in HEDGES), F.lit(0))
    return hits / F.greatest(F.lit(1), F.size(F.filter(F.split(text, " "), lambda w: w != "")))


def unexpected_refusal(answer: Column, expected: Column) -> Column:
    """A short answer that refuses although ``expected`` says that the case can be answered."""
    text = metric_text(answer)
    refuses = F.exists(F.array(*map(F.lit, REFUSALS)), lambda p: F.contains(text, p))
    return F.coalesce(expected & refuses & (F.size(F.split(text, " ")) < REFUSAL_WORDS), F.lit(False))


def structural_f1(reference: DataFrame, found: DataFrame, keys: list[str], by: str) -> DataFrame:
    """``by, f1`` of two keyed sets for each document; 1 if both are empty there (such documents give no row)."""
    a = reference.select(by, *keys).distinct().withColumn("_a", F.lit(1))
    b = found.select(by, *keys).distinct().withColumn("_b", F.lit(1))
    j = a.join(b, [by, *keys], "full_outer").groupBy(by).agg(F.sum("_a").alias("a"), F.sum("_b").alias("b"), F.sum(F.col("_a") * F.col("_b")).alias("t"))
    z = lambda c: F.coalesce(c, F.lit(0))
    return j.select(by, (2 * z("t") / (z("a") + z("b"))).alias("f1"))


def report(results: DataFrame) -> DataFrame:
    """Summary of results (should_refuse, refused, error, recall, precision): means over rows that answered, refusal rate over those that should."""
    ok = F.col("error").isNull()
    answered = ok & ~F.col("refused") & ~F.col("should_refuse")
    mean = lambda c: F.coalesce(F.avg(F.when(answered, F.col(c))), F.lit(float("nan")))
    refusal = F.coalesce(F.avg(F.when(ok & F.col("should_refuse"), F.col("refused").cast("double"))), F.lit(1.0))
    return results.agg(F.count(F.lit(1)).alias("n"), F.sum((~ok).cast("long")).alias("errors"), mean("recall").alias("mean_recall"), mean("precision").alias("mean_precision"), refusal.alias("refusal_rate"))


def regression_gate(baseline: DataFrame, current: DataFrame, fail: float = 0.15, warn: float = 0.05) -> DataFrame:
    """``metric, verdict``: slower by more than 15 % fails, by more than 5 % warns, missing fails."""
    j = baseline.select("metric", F.col("value").alias("was")).join(current.select("metric", F.col("value").alias("now")), "metric", "left")
    change = (F.col("now") - F.col("was")) / F.nullif(F.col("was"), F.lit(0.0))
    return j.select("metric", F.when(F.col("now").isNull() | (change > fail), "fail").when(change > warn, "warn").otherwise("ok").alias("verdict"))


def distinctness(texts: DataFrame, by: str, id_col: str, token_col: str) -> DataFrame:
    """One minus the mean Jaccard similarity of the pairs of texts of a group (paragraphs of a report: few)."""
    a = texts.select(by, F.col(id_col).alias("i"), F.col(token_col).alias("a"))
    b = texts.select(by, F.col(id_col).alias("j"), F.col(token_col).alias("b"))
    both = F.size(F.array_union("a", "b"))
    j = a.join(b, by).filter("i < j").withColumn("s", F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect("a", "b")) / both))
    return j.groupBy(by).agg((1 - F.avg("s")).alias("distinctness"))


def unique_openers(texts: DataFrame, by: str, text_col: str, token_col: str, n: int = 8) -> DataFrame:
    """Distinct first ``n`` content words by the texts of a group that are not blank; 1 if all are."""
    opener = F.when(F.trim(metric_text(F.col(text_col))) != "", F.array_join(F.slice(token_col, 1, n), " "))
    share = F.count_distinct(opener) / F.nullif(F.count(opener), F.lit(0))
    return texts.groupBy(by).agg(F.coalesce(share, F.lit(1.0)).alias("unique_openers"))


def gold_ranks(ranking: DataFrame, gold: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """1-based rank of each gold id, null if it was not found."""
    return gold.select("query_id", id_col).join(ranking.select("query_id", id_col, "rank"), ["query_id", id_col], "left")


def headroom(winners: Column, expansion: Column, pool: Column, gold: Column) -> Column:
    """Where the first gold chunk is found: among the winners, their neighbours, the pool, or nowhere."""
    return F.when(F.arrays_overlap(winners, gold), "winners").when(F.arrays_overlap(expansion, gold), "expansion").when(F.arrays_overlap(pool, gold), "pool").otherwise("missed")


#: Ids of the evidence of one answer.
MOST_IDS = 10_000


def unique_min_repair(claims: DataFrame, ids: DataFrame, most: int = 2) -> DataFrame:
    """Claimed ids mended: exact, else the one id that ends in the claim, else the one nearest id within ``most`` edits."""
    c, known = claims.select("claim_id").distinct(), ids.select("chunk_id").distinct()
    if known.count() > MOST_IDS:
        raise ValueError(f"claims are mended against one answer's evidence, of at most {MOST_IDS} ids")
    j = c.join(F.broadcast(known), F.lit(True))
    d = F.levenshtein("claim_id", "chunk_id", most)
    kind = F.when(F.col("claim_id") == F.col("chunk_id"), 0).when(F.endswith(F.col("chunk_id"), F.col("claim_id")) & (F.length("claim_id") > 3), 1).when(d >= 0, 1 + d)
    j = j.withColumn("cost", kind).filter("cost IS NOT NULL")
    w = Window.partitionBy("claim_id")
    best = j.withColumn("_m", F.min("cost").over(w)).filter("cost = _m").groupBy("claim_id").agg(F.count(F.lit(1)).alias("n"), F.min("chunk_id").alias("chunk_id"))
    return c.join(best.filter("n = 1").select("claim_id", "chunk_id"), "claim_id", "left")
