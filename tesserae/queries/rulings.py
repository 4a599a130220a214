"""Citations, entities, scopes, routes, verdicts, conversations: rules with scores, tiers and states."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import align, citations, index, parsing
from tesserae.plans import models
from tesserae.queries.base import query
from tesserae.streaming import stateful

#: Documents by parts and what cites them, by customers.
CITED = """
d AS (SELECT p_partkey AS doc_id, p_name || ' ' || lower(p_type) || ' ' || p_size AS title, lower(p_brand) AS author, 1990 + p_size % 20 AS y FROM part),
n AS (SELECT count(*) AS n FROM part),
c AS (SELECT c_custkey AS citation_id, c_custkey % n AS skip, CASE c_custkey % 5
        WHEN 0 THEN 'As shown in ' || title || ', section 2' WHEN 1 THEN p_name || ' ' || lower(p_type) WHEN 2 THEN 'by ' || p_brand || ', ' || (1990 + p_size % 20)
        WHEN 3 THEN p_type || ' of the ' || p_name ELSE c_mktsegment END AS surface,
        CASE c_custkey % 3 WHEN 0 THEN 0.92 WHEN 1 THEN 0.68 ELSE 0.42 END AS band
      FROM customer, n JOIN part ON p_partkey = (c_custkey * 7) % n JOIN d ON doc_id = p_partkey)"""


def _title():
    return F.concat_ws(" ", "p_name", F.lower("p_type"), F.col("p_size").cast("string"))


def _documents(t):
    return t.part.select(F.col("p_partkey").alias("doc_id"), _title().alias("title"), F.array("p_brand").alias("authors"), F.make_date(1990 + F.col("p_size") % 20, F.lit(1), F.lit(1)).alias("date"))


@query(f"""
WITH {CITED},
s AS (SELECT citation_id, doc_id, band, lower(trim(surface)) AS norm, lower(title) AS t, author, y,
        len(list_intersect(list_distinct(regexp_extract_all(lower(surface), '[a-z0-9]+')), list_filter(list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+')), lambda w: length(w) >= 3))) AS k,
        len(list_filter(list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+')), lambda w: length(w) >= 3)) AS m FROM c, d WHERE doc_id <> skip),
r AS (SELECT *, CASE WHEN contains(norm, t) THEN 0.95
        WHEN contains(norm, author || ' ' || y) OR contains(norm, author || ', ' || y) OR contains(norm, author || ' et al. ' || y) OR contains(norm, author || ' et al., ' || y) THEN 0.90
        WHEN length(norm) >= 12 AND contains(t, norm) THEN 0.88
        WHEN k >= 2 AND k / m::DOUBLE >= 0.6 THEN least(0.78, 0.55 + 0.1 * k) ELSE 0 END::DOUBLE AS score FROM s)
SELECT citation_id, doc_id, score, round((band + score) / 2, 6) AS confidence,
  CASE WHEN score = 0.95 OR score = 0.88 THEN 'title' WHEN score = 0.90 THEN 'author_year' ELSE 'tokens' END AS via
FROM r WHERE score >= 0.70 QUALIFY row_number() OVER (PARTITION BY citation_id ORDER BY score DESC, doc_id) = 1""")
def citation_resolution(t):
    """Citations by title, part of a title, author and year, words, or of nothing; a document never cites itself."""
    n = t.part.count()
    d = _documents(t)
    cited = t.part.select(F.col("p_partkey").alias("_p"), "p_name", "p_brand", "p_type", "p_size", _title().alias("title"))
    c = t.customer.withColumn("_p", (F.col("c_custkey") * 7) % n).join(cited, "_p")
    kind = F.col("c_custkey") % 5
    surface = (
        F.when(kind == 0, F.concat(F.lit("As shown in "), "title", F.lit(", section 2")))
        .when(kind == 1, F.concat_ws(" ", "p_name", F.lower("p_type")))
        .when(kind == 2, F.concat(F.lit("by "), "p_brand", F.lit(", "), (1990 + F.col("p_size") % 20).cast("string")))
        .when(kind == 3, F.concat("p_type", F.lit(" of the "), "p_name"))
        .otherwise(F.col("c_mktsegment"))
    )
    band = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (F.col("c_custkey") % 3 + 1).cast("int"))
    c = c.select(F.col("c_custkey").alias("citation_id"), surface.alias("surface_text"), band.alias("confidence"), (F.col("c_custkey") % n).alias("skip_doc_id"))
    return citations.resolve(c, d).select("citation_id", "doc_id", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"), "via")


NAMES = "SELECT DISTINCT unnest(['thin for', 'license', 'this work', 'this work is licensed', 'of the', 'de la', 'work']) AS name"


@query(f"""
WITH n AS ({NAMES}), t AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t),
m AS (SELECT doc_id, i, max_by(name, len(string_split(name, ' '))) AS name, max(len(string_split(name, ' '))) AS k
      FROM p JOIN n ON w[i] = string_split(name, ' ')[1] WHERE array_to_string(w[i:i + len(string_split(name, ' ')) - 1], ' ') = name GROUP BY doc_id, i),
l AS (SELECT doc_id, list({{'i': i, 'k': k, 'name': name}} ORDER BY i) AS ms FROM m GROUP BY doc_id),
g AS (SELECT doc_id, list_reduce(list_prepend({{'last': 0::BIGINT, 'names': []::VARCHAR[]}}, list_transform(ms, lambda x: {{'last': x.i * 100 + x.k, 'names': [x.name]}})),
        lambda a, b: CASE WHEN b.last // 100 > a.last THEN {{'last': b.last // 100 + b.last % 100 - 1, 'names': list_concat(a.names, b.names)}} ELSE a END) AS r FROM l),
o AS (SELECT doc_id, unnest(r.names) AS name FROM g)
SELECT doc_id, name, count(*) AS n FROM o GROUP BY 1, 2""")
def entity_spans(t):
    """How often each name of a small dictionary stands in each document, leftmost and longest."""
    names = ["thin for", "license", "this work", "this work is licensed", "of the", "de la", "work"]
    dictionary = t.spark.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("name"), F.lit("other").alias("kind"))
    chunks = t.documents.select("doc_id", F.col("doc_id").cast("string").alias("chunk_id"), "text")
    return models.extract_entities(chunks, dictionary).groupBy("doc_id", "name").agg(F.count(F.lit(1)).alias("n"))


HITS = "SELECT l_orderkey // 8 AS ref, 't' || l_partkey % 2 AS token, l_suppkey % 4 AS doc, CASE WHEN l_suppkey % 4 = 1 THEN 'T1 chart' ELSE 'other' END AS title, l_extendedprice AS score FROM lineitem"


@query(f"""
WITH h AS ({HITS}), q AS (SELECT ref, CASE WHEN ref % 3 = 0 THEN ['t1'] ELSE ['t0', 't1'] END AS tokens FROM h GROUP BY ref),
v AS (SELECT ref, doc, count(*) AS hits, max(score) AS score, bool_or(title = 'T1 chart') AS named FROM h GROUP BY ref, doc),
a AS (SELECT ref, count(*) AS n_docs FROM v GROUP BY ref),
r AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY hits DESC, score DESC, doc) AS r FROM v WHERE hits >= 2),
w AS (SELECT ref, max(hits) AS top, max(hits) FILTER (WHERE r = 2) AS second, list(doc ORDER BY r) AS docs, list(doc ORDER BY r) FILTER (WHERE named) AS named,
        list({{'doc': doc, 'hits': hits, 'named': named}} ORDER BY r) AS rows FROM r GROUP BY ref),
b AS (SELECT *, second IS NULL OR top >= 2 * second AS alone, list_transform(list_filter(rows, lambda x: x.hits >= greatest(2, 0.5 * top) AND (x.named OR x.hits >= 3)), lambda x: x.doc) AS band FROM w),
c AS (SELECT *, CASE WHEN alone THEN docs[1:1] WHEN len(band) BETWEEN 1 AND 2 THEN band END AS base, CASE WHEN alone THEN 'dominant' WHEN len(band) BETWEEN 1 AND 2 THEN 'small-set' ELSE 'none-spread' END AS via FROM b),
e AS (SELECT q.ref, c.* EXCLUDE ref, coalesce(len(list_intersect(base, named)) > 0, false) AS titled, len(tokens) = 1 AND n_docs > 1 AS lone FROM q JOIN a USING (ref) LEFT JOIN c USING (ref)),
f AS (SELECT ref, CASE WHEN docs IS NULL THEN 'none-weak' WHEN base IS NOT NULL AND lone AND NOT titled THEN 'none-singletoken-ambiguous' ELSE via END AS via,
        CASE WHEN base IS NULL OR lone AND NOT titled THEN [] WHEN titled THEN list_concat(base, list_filter(named, lambda x: NOT list_contains(base, x)))[1:2] ELSE base END AS ids FROM e)
SELECT ref, via, array_to_string(ids, ',') AS docs FROM f""")
def artifact_votes(t):
    """Scopes of references by eight orders each: hits of two tokens in four documents, one of which names a token."""
    li = t.lineitem
    doc = F.col("l_suppkey") % 4
    h = li.select(F.floor(F.col("l_orderkey") / 8).alias("ref_id"), F.concat(F.lit("t"), (F.col("l_partkey") % 2).cast("string")).alias("token"), doc.alias("doc_id"), F.when(doc == 1, "T1 chart").otherwise("other").alias("title"), F.col("l_extendedprice").alias("score"))
    q = h.select("ref_id").distinct().withColumn("tokens", F.when(F.col("ref_id") % 3 == 0, F.array(F.lit("t1"))).otherwise(F.array(F.lit("t0"), F.lit("t1"))))
    return index.artifact_scopes(h, q).select(F.col("ref_id").alias("ref"), "via", F.array_join(F.transform("doc_ids", lambda x: x.cast("string")), ",").alias("docs"))


@query("""
SELECT l_orderkey AS query_id, CASE
  WHEN l_orderkey % 4 = 0 THEN CASE WHEN bool_or(l_returnflag <> 'R') THEN 'FALSE-ANSWER' ELSE 'correct-refusal' END
  WHEN bool_and(l_returnflag <> 'R') THEN 'correct-answer' WHEN NOT bool_or(l_returnflag <> 'R') THEN 'FALSE-REFUSAL-deterministic' ELSE 'FALSE-REFUSAL-flaky' END AS verdict
FROM lineitem GROUP BY 1""")
def run_verdicts(t):
    """Each order is a query, its line items are runs that refused where they were returned; every fourth should be refused."""
    r = t.lineitem.select(F.col("l_orderkey").alias("query_id"), (F.col("l_orderkey") % 4 == 0).alias("should_refuse"), (F.col("l_returnflag") == "R").alias("refused"))
    return parsing.run_verdicts(r)


@query("""
WITH s AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'microsoft powerpoint' WHEN 1 THEN 'abbyy finereader' ELSE 'unknown ' || lower(p_brand) END AS made,
    (p_size * 37 % 1000)::DOUBLE AS chars, CASE p_partkey % 5 WHEN 0 THEN 1.5 WHEN 1 THEN 1.1 ELSE 0.7 END::DOUBLE AS aspect, (p_size % 10) / 10.0::DOUBLE AS area, (p_partkey % 10) / 10.0::DOUBLE AS pages,
    (p_partkey % 7) / 7.0::DOUBLE AS empty, (p_partkey % 11) / 100.0::DOUBLE AS broken, p_partkey % 5 AS fonts, p_partkey % 9 = 0 AS tagged, p_partkey % 2 = 0 AS heads, p_partkey % 3 = 0 AS tabs FROM part),
x AS (SELECT *, chars >= 50 AND area >= 0.35 AND pages >= 0.3 AS mixed, made LIKE '%powerpoint%' AS digital, made LIKE '%abbyy%' AS scanned,
    least(1, least(0.85, chars / CASE WHEN aspect >= 1.3 THEN 200 WHEN aspect < 1 THEN 800 ELSE 400 END) + 0.1 * heads::INT + 0.05 * tabs::INT)::DOUBLE AS density FROM s),
y AS (SELECT *, CASE WHEN aspect >= 1.3 AND chars >= 50 AND (chars < 800 OR area >= 0.2) AND NOT scanned THEN 'deck' WHEN digital AND chars >= 50 THEN '1.A' WHEN scanned THEN '1.B' WHEN digital THEN '1.C'
    WHEN tagged AND chars >= 80 THEN 'tagged' WHEN fonts >= 3 AND chars >= 80 THEN 'fonts' WHEN pages > 0.5 AND chars < 100 THEN 'images' WHEN broken > 0.05 THEN 'broken'
    WHEN chars < 10 AND chars * 1.5 < 30 THEN 'scan-like' WHEN empty > 0.5 THEN 'empty' WHEN aspect >= 1.3 THEN 'slide' WHEN aspect < 1 THEN 'paper' ELSE 'unknown' END AS rule FROM x),
z AS (SELECT *, mixed AND (rule IN ('deck', '1.A', 'tagged', 'fonts') OR rule IN ('slide', 'paper', 'unknown') AND density >= 0.5) AS m FROM y)
SELECT p_partkey, CASE rule WHEN 'deck' THEN CASE WHEN m THEN 'slide-deck-mixed' ELSE 'slide-deck' END WHEN '1.B' THEN 'scan' WHEN '1.C' THEN 'born-digital-but-rasterised' WHEN 'images' THEN 'image-heavy'
    WHEN 'broken' THEN 'mojibake' WHEN 'scan-like' THEN 'scan-like' WHEN 'empty' THEN 'mostly-empty'
    ELSE CASE WHEN m THEN 'mixed-content' WHEN rule = '1.A' THEN 'born-digital' WHEN rule = 'tagged' THEN 'tagged-pdf' WHEN rule = 'fonts' THEN 'fonted-born-digital' ELSE rule END END AS doc_type,
  round(CASE WHEN rule = 'deck' THEN 0.1 WHEN m THEN 0.2 WHEN rule = '1.A' THEN 0.98 WHEN rule IN ('1.B', 'scan-like') THEN 0 WHEN rule IN ('1.C', 'broken') THEN 0.1 WHEN rule = 'tagged' THEN 0.9 WHEN rule = 'fonts' THEN 0.85
    WHEN rule IN ('images', 'empty') THEN 0.15 ELSE density END::DOUBLE, 6) AS confidence,
  m OR rule IN ('1.B', '1.C', 'images', 'scan-like', 'empty') AS needs_ocr FROM z""")
def document_routing(t):
    """Routes of documents whose signals are taken from parts."""
    k, s = F.col("p_partkey"), F.col("p_size")
    made = F.when(k % 6 == 0, "Microsoft PowerPoint").when(k % 6 == 1, "ABBYY FineReader").otherwise(F.concat(F.lit("unknown "), F.col("p_brand")))
    chars = (s * 37 % 1000).cast("double")
    signals = t.part.select(
        k, made.alias("creator"), F.lit(None).cast("string").alias("producer"), chars.alias("chars_per_page"), (chars * 1.5).alias("chars_p90"),
        F.when(k % 5 == 0, 1.5).when(k % 5 == 1, 1.1).otherwise(0.7).alias("aspect"), (s % 10 / 10.0).alias("image_area"), (k % 10 / 10.0).alias("image_pages"), (k % 7 / 7.0).alias("empty_pages"), (k % 11 / 100.0).alias("broken_chars"),
        (k % 5).cast("int").alias("fonts"), (k % 9 == 0).alias("tagged"), (k % 2 == 0).alias("has_headings"), (k % 3 == 0).alias("has_tables"), F.lit(False).alias("has_lists"), F.lit(None).cast("boolean").alias("has_code"),
    )
    return parsing.route(signals).select("p_partkey", "doc_type", F.round("confidence", 6).alias("confidence"), "needs_ocr")


@query("""
WITH t AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
SELECT conv_id, count(*)::INT AS turns, array_to_string(list(turn ORDER BY turn) FILTER (WHERE back <= 4), ',') AS recent,
  substr(trim(coalesce(string_agg(trim(substr(trim(replace(text, chr(10), ' ')), 1, 40)), ' ' ORDER BY turn) FILTER (WHERE back > 4), '')), 1, 1200) AS summary,
  coalesce(array_to_string(string_split(arg_max(text, turn) FILTER (WHERE turn % 2 = 1), ' ')[1:5], '|'), '') AS carried
FROM t GROUP BY conv_id""")
def conversation_state(t):
    """Rolling state of each conversation after its last turn: recent turns, the older ones' digest, ids carried on (words of the last answer stand for them)."""
    turns = t.conversations.select("conv_id", "turn", "text", F.trim(F.substring(F.trim(F.replace("text", F.lit("\n"), F.lit(" "))), 1, 40)).alias("answer"), (F.col("turn") % 2 == 1).alias("answered"), F.split("text", " ").alias("cited"))
    out = stateful.conversation_states(turns)
    return out.select("conv_id", "turns", F.array_join(F.transform("recent", lambda x: x["turn"].cast("string")), ",").alias("recent"), "summary", F.array_join("carried", "|").alias("carried"))


@query(None)
def aligned_vectors(t):
    """Vectors of each label in their order, aligned with those of the next label as a deck of slides."""
    e = t.embeddings.filter("label IS NOT NULL AND embedding IS NOT NULL")
    left = e.select(F.col("label").cast("string").alias("pair_id"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vector"))
    right = e.select(((F.col("label") + 9) % 10).cast("string").alias("pair_id"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vector"))
    return align.align(left, right, floor=0.1)
