"""Text and number functions, tables, guarded SQL, pages, events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import ids, numbers
from tesserae.functions import text as T
from tesserae.operators import markdown, tablesql
from tesserae.plans.models import summarize
from tesserae.queries.base import query
from tesserae.sources import files
from tesserae.streaming import events as E

CELL = """CASE l_linenumber WHEN 1 THEN '$' || printf('%.2f', l_extendedprice) WHEN 2 THEN '(' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ',500)' WHEN 3 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '%'
  WHEN 4 THEN '2.5B' WHEN 5 THEN '-' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' million' WHEN 6 THEN l_returnflag || '/' || l_linestatus ELSE '  1,2,3 ' END"""


def _cell():
    q = F.col("l_quantity").cast("long").cast("string")
    return (
        F.when(F.col("l_linenumber") == 1, F.concat(F.lit("$"), F.format_string("%.2f", "l_extendedprice")))
        .when(F.col("l_linenumber") == 2, F.concat(F.lit("("), q, F.lit(",500)")))
        .when(F.col("l_linenumber") == 3, F.concat(q, F.lit("%")))
        .when(F.col("l_linenumber") == 4, "2.5B")
        .when(F.col("l_linenumber") == 5, F.concat(F.lit("-"), q, F.lit(" million")))
        .when(F.col("l_linenumber") == 6, F.concat_ws("/", "l_returnflag", "l_linestatus"))
        .otherwise("  1,2,3 ")
    )


@query(f"""
SELECT l_orderkey, l_linenumber, {CELL} AS cell, CASE l_linenumber WHEN 1 THEN round(l_extendedprice, 2) WHEN 2 THEN -(l_quantity * 1000 + 500) WHEN 3 THEN l_quantity WHEN 4 THEN 2.5e9 WHEN 5 THEN -l_quantity * 1e6 WHEN 6 THEN NULL ELSE 123 END AS number,
  l_linenumber NOT IN (6, 7) AS canonical FROM lineitem""")
def number_grammar(t):
    c = t.lineitem.select("l_orderkey", "l_linenumber", _cell().alias("cell"))
    return c.select("l_orderkey", "l_linenumber", "cell", numbers.coerce_number(F.col("cell")).alias("number"), numbers.is_canonical_number(F.col("cell")).alias("canonical"))


@query("SELECT l_returnflag AS doc_id, l_linenumber AS col_no, l_linenumber <> 6 AS numeric FROM lineitem GROUP BY ALL")
def numeric_columns(t):
    c = t.lineitem.select(F.col("l_returnflag").alias("doc_id"), F.lit("t").alias("table_id"), F.col("l_linenumber").alias("col_no"), _cell().alias("cell"))
    return tablesql.numeric_columns(c).select("doc_id", "col_no", "numeric")


def _parts(t):
    cols = {"p_name": "string", "p_brand": "string", "p_size": "string", "p_price": "string"}
    df = t.part.select(F.col("p_partkey").alias("row_no"), "p_name", "p_brand", F.when(F.col("p_size") % 11 == 0, "").otherwise(F.col("p_size").cast("string")).alias("p_size"), F.concat(F.lit("$"), F.format_string("%.2f", "p_retailprice")).alias("p_price"))
    return tablesql.with_numbers(df, list(cols)), list(cols)


PARTS = "p AS (SELECT p_partkey AS row_no, p_name, p_brand, CASE WHEN p_size % 11 = 0 THEN NULL ELSE p_size END AS p_size, CAST(printf('%.2f', p_retailprice) AS DOUBLE) AS p_price FROM part)"


@query(f"WITH {PARTS} SELECT round(sum(p_price), 2) AS value FROM p WHERE (coalesce(lower(p_brand) = 'brand#11', false) OR p_size BETWEEN 3 AND 9)")
def guarded_sum(t):
    df, names = _parts(t)
    return tablesql.query(df, "SELECT SUM(p_price__num) FROM t WHERE p_brand = 'brand#11' OR p_size BETWEEN 3 AND 9", names).select(F.round("value", 2).alias("value"))


@query(f"WITH {PARTS} SELECT CAST(count(p_size) AS DOUBLE) AS value FROM p WHERE lower(p_name) LIKE '%e_%' AND p_brand NOT IN ('Brand#12', 'Brand#13')")
def guarded_count(t):
    df, names = _parts(t)
    return tablesql.query(df, "SELECT COUNT(p_size) FROM t WHERE p_name LIKE '%E_%' AND p_brand NOT IN ('Brand#12', 'brand#13')", names)


@query(f"WITH {PARTS} SELECT avg(p_size) AS value FROM p WHERE p_size IS NULL OR p_size >= 20")
def guarded_avg_nulls(t):
    df, names = _parts(t)
    return tablesql.query(df, "SELECT AVG(p_size) FROM t WHERE p_size IS NULL OR p_size >= 20", names)


@query(f"WITH {PARTS} SELECT row_no, p_name, p_brand FROM p WHERE p_size IS DISTINCT FROM 7 ORDER BY p_price DESC, row_no LIMIT 1")
def guarded_superlative(t):
    df, names = _parts(t)
    return tablesql.query(df, "SELECT * FROM t WHERE p_size != 7 ORDER BY p_price__num DESC LIMIT 1", names).select("row_no", "p_name", "p_brand")


@query(f"WITH {PARTS} SELECT row_no, p_name FROM p WHERE p_size IS NULL ORDER BY row_no LIMIT 1000")
def guarded_rows(t):
    df, names = _parts(t)
    return tablesql.query(df, "SELECT * FROM t WHERE p_size IS NULL", names).select("row_no", "p_name")


@query(None)
def chunked_documents(t):
    return markdown.chunk_documents(t.documents).select("doc_id", "chunk_id", "char_start", "char_end", F.size("heading_path").alias("depth"))


@query(None)
def extracted_tables(t):
    """Every order as a Markdown table of its lines, parsed back."""
    row = F.concat_ws(" | ", F.lit(""), "l_linenumber", "l_partkey", _cell(), F.lit(""))
    body = t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", F.trim(row).alias("r")))), lambda x: x["r"]), "\n").alias("rows"))
    docs = body.select(F.col("l_orderkey").cast("string").alias("doc_id"), F.concat(F.lit("# Order\n\n| line | part | price |\n|---|---|---|\n"), "rows", F.lit("\n")).alias("text"))
    return markdown.cells_of(markdown.tables_of(docs)).select("doc_id", "row_no", "col_no", "label", "cell")


@query("""
SELECT doc_id, source || '-' || lang AS slug, regexp_replace(sha256(text)[1:8] || '-' || source, '^[0-9a-f]{8}-', '') AS bare,
  CAST(list_reduce(list_transform(range(16), lambda i: ('0x' || substr(sha256(CAST(doc_id AS VARCHAR) || '|draw'), CAST(4 * i + 1 AS INT), 4))::BIGINT), lambda a, x: (a * 65536 + x) % 1000) AS BIGINT) AS draw FROM documents""")
def slugs_and_draws(t):
    return t.documents.select("doc_id", ids.slug(F.concat_ws(" / ", "source", "lang")).alias("slug"), ids.strip_content_hash(F.concat_ws("-", F.substring(F.sha2("text", 256), 1, 8), "source")).alias("bare"), ids.hash_draw(F.col("doc_id"), F.lit("draw"), below=1000).alias("draw"))


@query(r"""
WITH a AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(lower(text), '[\s\-''’]+'), lambda p: regexp_replace(p, '[^0-9a-zàâäçéèêëîïôöùûüÿœæ]', '', 'g')), lambda p: p <> '') AS w FROM conversations)
SELECT conv_id, turn, CAST(len(w) AS BIGINT) AS n_tokens, array_to_string(w[1:5], ' ') AS head FROM a""")
def content_tokens(t):
    return t.conversations.select("conv_id", "turn", T.content_tokens(F.col("text")).alias("w")).select("conv_id", "turn", F.size("w").cast("long").alias("n_tokens"), F.array_join(F.slice("w", 1, 5), " ").alias("head"))


@query(r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents)
SELECT doc_id, CASE WHEN len(list_filter(w, lambda x: x IN ('le', 'la', 'les', 'des', 'une', 'est', 'dans', 'pour', 'avec', 'qui', 'sont', 'été', 'être', 'aux', 'cette')))
  > len(list_filter(w, lambda x: x IN ('the', 'of', 'and', 'is', 'for', 'with', 'that', 'are', 'was', 'this', 'from'))) THEN 'fr' ELSE 'en' END AS lang FROM w""")
def hint_language(t):
    return t.documents.select("doc_id", T.guess_language(F.col("text")).alias("lang"))


@query(r"""SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]\s*>', 1), lambda h: trim(regexp_replace(h, '<[^>]*>', '', 'g'))), '|') AS headings FROM pages""")
def page_headings(t):
    return t.pages.select("page_id", F.array_join(files.html_headings(F.col("html")), "|").alias("headings"))


@query(r"""SELECT page_id, CAST(len(l) AS BIGINT) AS n_links, array_to_string(l, ' ') AS links FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\b[^>]*\bhref="([^"]*)"', 1) AS l FROM pages)""")
def page_links(t):
    return t.pages.select("page_id", files.html_links(F.col("html")).alias("l")).select("page_id", F.size("l").cast("long").alias("n_links"), F.array_join("l", " ").alias("links"))


@query(None)
def page_text(t):
    return t.pages.select("page_id", files.strip_html(F.col("html")).alias("text"))


@query("SELECT page_id, CASE WHEN html LIKE '<!doctype html%' OR html LIKE '<!DOCTYPE html%' OR html LIKE '<html%' THEN 'html' ELSE 'text' END AS kind FROM pages")
def detected_formats(t):
    return t.pages.select("page_id", files.detect(F.col("html").cast("binary"), F.lit("")).alias("kind"))


@query(r"""
SELECT p_partkey, regexp_matches(p_name, '[A-Za-z0-9]_[A-Za-z0-9]|[a-z][A-Z]') AS code, regexp_matches(p_brand, '[0-9$%]') AS value, p_name <> '' AS told FROM part""")
def query_shapes(t):
    return t.part.select("p_partkey", T.has_code_identifier(F.col("p_name")).alias("code"), numbers.looks_like_value(F.col("p_brand")).alias("value"), (F.col("p_name") != "").alias("told"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey >= 3600 THEN printf('%02d:%02d:%02d', l_partkey // 3600, l_partkey % 3600 // 60, l_partkey % 60) ELSE printf('%02d:%02d', l_partkey // 60, l_partkey % 60) END AS label FROM lineitem")
def timestamp_labels(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", numbers.timestamp_label(F.col("l_partkey")).alias("label"))


@query(None)
def extractive_summary(t):
    chunks = markdown.chunk_documents(t.documents)
    return summarize(chunks).select("doc_id", "pos", "sentence")


# --- events ---------------------------------------------------------------------------------------
@query("SELECT event_id, ts, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-09' AND event_type = 'click'")
def event_replay(t):
    return E.replay(t.events, F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-09").cast("timestamp"), "click").select("event_id", "ts", "event_type")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY")
def event_retention(t):
    return E.retain(t.events, F.lit("2024-01-31").cast("timestamp"), 10).select("event_id")


@query("""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS b FROM g)
SELECT user_id, min(ts) AS burst_start, max(ts) + INTERVAL 6 HOUR AS burst_end, count(*) AS n_events FROM b GROUP BY user_id, b""")
def event_debounce(t):
    return E.debounce(t.events, ["user_id"], "6 hours")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n_events, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_tumbling(t):
    return E.windowed(t.events, "1 day", ["event_type"]).withColumn("total", F.round("total", 4))


@query("""SELECT window_start, event_type, count(*) AS n_events, round(sum(value), 4) AS total FROM (SELECT event_type, value, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS window_start FROM events) GROUP BY ALL""")
def event_sliding(t):
    return E.windowed(t.events, "12 hours", ["event_type"], slide="6 hours").withColumn("total", F.round("total", 4))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def event_payload(t):
    return t.events.select("event_id", F.from_json("props", "k long")["k"].alias("k"))
