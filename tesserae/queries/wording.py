"""Headings, names, hedges and terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import rules
from tesserae.functions import text as T
from tesserae.operators import evals, parsing
from tesserae.queries.base import query

_ATOMS = r"list_filter(list_transform(regexp_split_to_array(lower(text), '[\s\-''’]+'), lambda p: regexp_replace(p, '[^0-9a-zàâäçéèêëîïôöùûüÿœæ]', '', 'g')), lambda p: p <> '')"
_HEDGES = ", ".join(f"'{h}'" for h in evals.HEDGES)
_TITLES = ["## **Table of Contents**", "1.2 Foreword", "Appendix A: Glossary", "IV. References", "3.1 Results", "Contents of the box", "*Notices*", "Variations", "List of Figures", "12 Keywords"]


@query(r"""
WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM conversations)
SELECT conv_id, turn, pos::INT AS pos, regexp_replace(regexp_replace(lower(trim(line)), '[^\p{L}\p{N}\s-]', '', 'g'), '[\s-]+', '-', 'g') AS slug FROM l""")
def heading_slugs(t):
    """The slug of every line."""
    lines = t.conversations.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("conv_id", "turn", "pos", T.slugify_heading(F.col("line")).alias("slug"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
n AS (SELECT *, len(list_filter(regexp_split_to_array(trim(line), '\s+'), lambda w: w <> '')) AS n FROM l)
SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE n > 15 OR (n >= 4 AND regexp_matches(rtrim(line), '[.!?]$'))) AS prose FROM n GROUP BY doc_id""")
def prose_lines(t):
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count(F.when(rules.reads_as_prose(F.col("line")), 1)).alias("prose"))


@query(r"""SELECT p_partkey, lower(trim(regexp_replace('  ' || upper(p_name) || chr(9) || p_brand || ' ', '\s+', ' ', 'g'))) AS name FROM part""")
def set_names(t):
    return t.part.select("p_partkey", T.normalize_set_name(F.concat(F.lit("  "), F.upper("p_name"), F.lit("\t"), "p_brand", F.lit(" "))).alias("name"))


@query(rf"""
WITH a AS (SELECT conv_id, turn, trim(regexp_replace(lower(text || CASE turn % 3 WHEN 0 THEN ' It depends; in  general, it depends.' WHEN 1 THEN ' This is nuanced' ELSE '' END), '\s+', ' ', 'g')) AS x FROM conversations)
SELECT conv_id, turn, list_sum(list_transform([{_HEDGES}], lambda h: (length(x) - length(replace(x, h, ''))) / length(h)))
  / greatest(1, len(list_filter(string_split(x, ' '), lambda w: w <> ''))) AS density FROM a""")
def hedging(t):
    text = F.concat("text", F.when(F.col("turn") % 3 == 0, " It depends; in  general, it depends.").when(F.col("turn") % 3 == 1, " This is nuanced").otherwise(""))
    return t.conversations.select("conv_id", "turn", evals.hedge_density(text).alias("density"))


@query(r"""
WITH a AS (SELECT conv_id, turn, lower(CASE turn % 4 WHEN 0 THEN 'I cannot answer: ' || text WHEN 1 THEN 'No grounded answer. ' || text ELSE text END) AS x FROM conversations)
SELECT conv_id, turn, conv_id % 2 = 0 AND (x LIKE '%i cannot answer%' OR x LIKE '%no grounded answer%')
  AND len(string_split(trim(regexp_replace(x, '\s+', ' ', 'g')), ' ')) < 40 AS refused FROM a""")
def unexpected_refusals(t):
    text = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("I cannot answer: "), F.col("text"))).when(F.col("turn") % 4 == 1, F.concat(F.lit("No grounded answer. "), F.col("text"))).otherwise(F.col("text"))
    return t.conversations.select("conv_id", "turn", evals.unexpected_refusal(text, F.col("conv_id") % 2 == 0).alias("refused"))


@query(rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
x AS (SELECT doc_id, line, [{', '.join(repr(x) for x in _TITLES)}][CAST((pos + doc_id) % {len(_TITLES)} + 1 AS INT)] AS title FROM l),
n AS (SELECT doc_id, [title, line, split_part(title, ' ', 1) || ' ' || line] AS titles FROM x),
u AS (SELECT doc_id, unnest(titles) AS title FROM n),
b AS (SELECT doc_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(trim(title), '^[*# ]+|[*# ]+$', '', 'g'), '(?i)^(appendix\s+[a-z0-9]+|[0-9ivxlc]+(\.[0-9]+)*)[\s.):—–-]+', ''), '^[*#:—– .]+|[*#:—– .]+$', '', 'g'))) AS bare FROM u)
SELECT doc_id, count(*) AS titles, count(*) FILTER (WHERE bare IN ({', '.join(repr(x) for x in parsing.FRONT_MATTER)})) AS front FROM b GROUP BY doc_id""")
def front_matter(t):
    """Every line of a document as a title, alone and behind the number of another, beside ten others in turn."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    other = F.element_at(F.array(*map(F.lit, _TITLES)), ((F.col("pos") + F.col("doc_id")) % len(_TITLES) + 1).cast("int"))
    titles = lines.select("doc_id", F.explode(F.array(other, "line", F.concat_ws(" ", F.split_part(other, F.lit(" "), F.lit(1)), "line"))).alias("title"))
    return titles.groupBy("doc_id").agg(F.count(F.lit(1)).alias("titles"), F.count(F.when(parsing.is_front_matter(F.col("title")), 1)).alias("front"))


@query(r"""
WITH a AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(lower(replace(text, ' ', '-l' || chr(39))), '[-''’]'), lambda p: regexp_replace(p, '[^0-9a-zàâäçéèêëîïôöùûüÿœæ]', '', 'g')), lambda p: p <> '') AS atoms FROM documents)
SELECT doc_id, len(atoms)::INT AS n_atoms, sha256(array_to_string(atoms, '|')) AS atoms_sha256 FROM a""")
def word_atoms(t):
    """The atoms of a whole text, whose words are joined by elisions."""
    atoms = T.atomise(F.replace("text", F.lit(" "), F.lit("-l'")))
    return t.documents.select("doc_id", atoms.alias("a")).select("doc_id", F.size("a").alias("n_atoms"), F.sha2(F.array_join("a", "|"), 256).alias("atoms_sha256"))


@query(f"""
SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter({_ATOMS}, lambda p: length(p) > 1 AND NOT list_contains([{', '.join(f"'{w}'" for w in T.STOPWORDS)}], p)))), ' ') AS terms
FROM conversations""")
def telling_terms(t):
    return t.conversations.select("conv_id", "turn", F.array_join(T.significant_terms(F.col("text")), " ").alias("terms"))


@query(r"""
WITH w AS (SELECT conv_id, turn, regexp_replace(unnest(string_split(text, ' ')), '^\s+|\s+$', '', 'g') AS w FROM conversations)
SELECT conv_id, turn, count(*) AS words, count(*) FILTER (WHERE regexp_matches(w, '^[A-Za-z0-9.+-]{2,7}$') AND regexp_matches(w, '[A-Za-z]') AND (regexp_matches(w, '[A-Z]') OR length(w) <= 6)) AS acronyms FROM w GROUP BY 1, 2""")
def acronym_shapes(t):
    words = t.conversations.select("conv_id", "turn", F.explode(F.split("text", " ")).alias("w"))
    return words.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("words"), F.count(F.when(T.looks_like_acronym(F.col("w")), 1)).alias("acronyms"))
