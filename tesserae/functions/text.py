"""Text functions: folding, tokens, markers, links, acronyms.  All are column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Articles, connectors and words that tell no document apart (French and English).
STOPWORDS = (
    "de du des d l la le les au aux un une ce cette ces son sa ses "
    "the a an of in on for to and or this that with from "
    "cours course paper example project status shown above below following main given "
    "diagram diagramme figure chart page"
).split()
ATOM = "[^0-9a-zàâäçéèêëîïôöùûüÿœæ]"


def _fold_map() -> tuple[str, str]:
    """Latin letters that decompose to one ASCII letter and marks, and that letter."""
    src, dst = [], []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFD", chr(cp).lower()) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(cp) and base.isascii():
            src.append(chr(cp))
            dst.append(base)
    return "".join(src), "".join(dst)


_FOLD = _fold_map()


def fold(text: Column) -> Column:
    """Lower case without the diacritics of Latin letters."""
    return F.translate(F.lower(text), *_FOLD)


def _single_capitals() -> dict[str, str]:
    """Letters whose full capitals are several characters, or newer than some tables of Unicode, and the one character that a mapping by character gives."""
    out = {}
    for c in map(chr, (*range(0xD800), *range(0xE000, 0x10000))):
        if len(c.upper()) > 1:
            out[c] = c.title() if len(c.title()) == 1 else c
    return out | {"ß": "ẞ"} | {chr(c): chr(c) for c in (0x19B, 0x264, 0x1C8A, 0xA7CD, 0xA7DB, *range(0x10D70, 0x10D86))}


_CAPITALS = _single_capitals()


def upper_by_character(text: Column) -> Column:
    """Upper case where each character stays one, as DuckDB has it: 'ß' gives 'ẞ', a ligature stays."""
    special = f"[{''.join(_CAPITALS)}]"
    pieces = F.regexp_extract_all(text, F.lit(f"{special}|[^{special[1:]}+"), F.lit(0))
    by_piece = F.transform(pieces, lambda x: F.when(F.rlike(x, F.lit(special)), F.translate(x, "".join(_CAPITALS), "".join(_CAPITALS.values()))).otherwise(F.upper(x)))
    return F.when(F.rlike(text, F.lit(special)), F.array_join(by_piece, "")).otherwise(F.upper(text))


def tokens(text: Column) -> Column:
    """Index tokens: folded runs of letters and digits; an underscore separates."""
    return F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def atomise(word: Column) -> Column:
    parts = F.transform(F.split(F.lower(word), "[-'’]"), lambda p: F.regexp_replace(p, ATOM, ""))
    return F.filter(parts, lambda p: p != "")


def content_tokens(text: Column) -> Column:
    """Atoms of all words, in order."""
    return F.filter(F.transform(F.split(F.lower(text), r"[\s\-'’]+"), lambda p: F.regexp_replace(p, ATOM, "")), lambda p: p != "")


def significant_terms(text: Column) -> Column:
    kept = F.filter(content_tokens(text), lambda p: F.length(p) > 1)
    return F.array_sort(F.array_distinct(F.array_except(kept, F.array(*map(F.lit, STOPWORDS)))))


def fold_identity(text: Column) -> Column:
    """Folded letters and digits without any separator."""
    return F.regexp_replace(fold(text), r"[^\p{L}\p{N}]+", "")


def provenance_matches(wanted: Column, blob: Column) -> Column:
    """Any folded token is part of the folded text."""
    folded = fold_identity(blob)
    return F.exists(F.filter(F.transform(wanted, fold_identity), lambda t: t != ""), lambda t: F.contains(folded, t))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def set_precision(found: Column, gold: Column) -> Column:
    n = F.size(F.array_distinct(found))
    return F.when(n == 0, F.when(F.size(gold) == 0, 1.0).otherwise(0.0)).otherwise(F.size(F.array_intersect(found, gold)) / n)


def set_f1(found: Column, gold: Column) -> Column:
    """1 for two empty sets."""
    a, b, both = F.size(F.array_distinct(found)), F.size(F.array_distinct(gold)), F.size(F.array_intersect(found, gold))
    return F.when(a + b == 0, F.lit(1.0)).otherwise(2 * both / (a + b))


# --- markers in Markdown bodies -------------------------------------------------------------------
CHART, ROWS = r"\[chart-extracted\]", r"\[table-rows\]"
CHART_BLOCK = r"(?s)\[chart-extracted\].*?\[/chart-extracted\]"
ROWS_BLOCK = r"(?s)\[table-rows\].*?\[/table-rows\]"
TABLE = r"(?m)^[ \t]*\|.*\|[ \t]*\n[ \t]*\|?[ \t:|-]*-[ \t:|-]*\|?[ \t]*\n(?:[ \t]*\|.*\|[ \t]*(?:\n|$))+"
IMAGE = r"(?i)<!--\s*image(?::[^>]*)?\s*-->"
HEADING = r"(?m)^(#{1,6})[ \t]+(.+?)[ \t]*$"


def strip_chart_blocks(text: Column) -> Column:
    return F.regexp_replace(text, CHART_BLOCK, "")


def strip_table_rows(text: Column) -> Column:
    return F.regexp_replace(text, ROWS_BLOCK, "")


def strip_superseded_tables(text: Column) -> Column:
    """Drops a table that its key-value rows follow."""
    return F.regexp_replace(text, TABLE + r"(?=[ \t\n]*\[table-rows\])", "")


def index_text(text: Column) -> Column:
    """What full-text search indexes of a chunk."""
    return strip_superseded_tables(strip_chart_blocks(text))


def heading_texts(text: Column) -> Column:
    """Texts of ATX headings outside of chart blocks, in order."""
    return F.filter(F.transform(F.regexp_extract_all(strip_chart_blocks(text), F.lit(HEADING), F.lit(2)), lambda x: F.trim(x)), lambda h: h != "")


def is_name_only(text: Column) -> Column:
    """Nothing but headings and at least two short lines: no line of eight words, no table, no derived block."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, IMAGE, "")))
    lines = F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^#{1,6}[ \t]+.+"))
    bare = F.transform(lines, lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^[-*+>]+", ""), r"^[\s|]+|[\s|]+$", ""), r"^\d{1,3}[.)]\s+", "")))
    longest = F.coalesce(F.array_max(F.transform(bare, lambda x: F.when(x == "", 0).otherwise(F.size(F.split(x, r"\s+"))))), F.lit(0))
    block = text.rlike(CHART) | text.rlike(ROWS) | text.rlike(TABLE)
    return ~block & (F.size(lines) >= 2) & (longest < 8)


def wikilinks(text: Column) -> Column:
    """``[[doc#section]]`` as structs; a section with brackets does not count."""
    inner = F.regexp_extract_all(text, F.lit(r"\[\[([^\[\]]+?)\]\]"), F.lit(1))
    return F.transform(inner, lambda x: F.struct(F.trim(F.substring_index(x, "#", 1)).alias("doc"), F.when(F.contains(x, F.lit("#")), F.trim(F.regexp_extract(x, r"^[^#]*#(.*)$", 1))).alias("section")))


def format_wikilink(doc: Column, section: Column) -> Column:
    plain = section.isNull() | (F.trim(section) == "") | section.rlike(r"[\[\]]")
    return F.when(plain, F.concat(F.lit("[["), doc, F.lit("]]"))).otherwise(F.concat(F.lit("[["), doc, F.lit("#"), section, F.lit("]]")))


# --- acronyms -------------------------------------------------------------------------------------
#: Connectors that give no letter to an initialism.
SKIPPED = ("of", "the", "a", "an", "and", "or", "for", "to", "in", "on", "de", "des", "du", "la", "le", "les", "d", "l")


def derive_initialism(name: Column) -> Column:
    """First letters of at least two telling words, two to seven of them; else null."""
    words = F.filter(F.split(F.lower(F.trim(name)), r"[\s/–—'’-]+"), lambda w: (w != "") & ~w.isin(*SKIPPED))
    letters = F.filter(F.transform(words, lambda w: F.regexp_extract(w, r"[\p{L}\p{N}]", 0)), lambda c: c != "")
    return F.when(F.size(letters).between(2, 7), F.upper(F.array_join(letters, "")))


def looks_like_acronym(text: Column) -> Column:
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    return t.rlike(r"^[A-Za-z0-9.+-]{2,7}$") & t.rlike(r"[A-Za-z]") & (t.rlike("[A-Z]") | (F.length(t) <= 6))


def initialism_matches(acronym: Column, name: Column) -> Column:
    """The name's initialism is the acronym, and at least half of it are letters."""
    got = derive_initialism(name)
    letters = F.length(F.regexp_replace(got, r"[^\p{L}]", ""))
    return F.coalesce((got == F.upper(F.trim(acronym))) & (letters * 2 >= F.length(got)), F.lit(False))


# --- code queries ---------------------------------------------------------------------------------
def has_code_identifier(query: Column) -> Column:
    return query.rlike(r"[A-Za-z0-9]_[A-Za-z0-9]|[a-z][A-Z]")


def query_symbol(query: Column) -> Column:
    """The first identifier with an underscore or inner capital; null if none."""
    found = F.filter(F.regexp_extract_all(query, F.lit(r"\b[A-Za-z_][A-Za-z0-9_]*\b"), F.lit(0)), lambda t: F.contains(t, F.lit("_")) | t.rlike("[a-z][A-Z]"))
    return F.try_element_at(found, F.lit(1))


#: Verbs that ask who uses a symbol.
USAGE = (
    r"\b(?:call(?:s|ed)?|invoke[sd]?|use[sd]?|using|own(?:s|ed)?|hold(?:s|ed)?|held|wrap(?:s|ped)?|create[sd]?|creating"
    r"|instantiate[sd]?|construct(?:s|ed)?|spawn(?:s|ed)?|reference[sd]?|consume[sd]?)\b"
)


def usage_intent(query: Column) -> Column:
    """The symbol of a question for its users (``which ... calls X``), null for any other question."""
    q = F.lower(F.trim(query))
    asks = ~q.rlike("^(what|how) ") & q.rlike(USAGE) & (q.rlike(r"\bwhich\b") | q.rlike(r"\bwhere\s+is\b"))
    return F.when(asks, query_symbol(query))


def last_ident(heading: Column) -> Column:
    """The name that a heading such as ``fn parse`` or ``Type::method`` defines."""
    tail = F.trim(F.element_at(F.split(heading, "::"), -1))
    return F.element_at(F.split(tail, r"\s+"), -1)


def is_demoted(heading_path: Column, symbol: Column) -> Column:
    """The chunk defines the symbol itself, or is a test."""
    own = F.coalesce(last_ident(F.try_element_at(heading_path, F.lit(-1))) == symbol, F.lit(False))
    test = F.exists(heading_path, lambda h: F.lower(F.trim(h)).rlike(r"^(mod tests|tests)$|^tests::|::tests::") | F.lower(last_ident(h)).startswith("test_"))
    return own | test


# --- small text jobs ------------------------------------------------------------------------------
def normalize_set_name(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def metric_text(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def slugify_heading(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}\s-]", ""), r"[\s-]+", "-")


#: Interjections that carry no content in a transcript.
FILLERS = ("um", "umm", "ummm", "uh", "uhh", "uhhh", "uhm", "erm", "euh", "euhh", "heu", "heuh")


def normalize_transcript(text: Column) -> Column:
    """Drops filler words that stand alone, with a comma behind them, and the punctuation they leave; lines that become empty go."""
    rules = (
        (r"(?iU)(?<![\w-])(?:" + "|".join(FILLERS) + r")(?![\w-])[ \t]*,?", ""),
        (r"([,;:])(?:\s*[,;:])+", "$1"),
        (r",\s*([.!?])", "$1"),
        (r"([.!?])\s*\.", "$1"),
        (r"\s+([,.;:!?])", "$1"),
        (r"[ \t]{2,}", " "),
    )
    for pattern, by in rules:
        text = F.regexp_replace(text, pattern, by)
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*[.!?]+\s*", "")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def structure_is_faithful(block: Column, source: Column) -> Column:
    """Same figures, and the same words once a word said twice in a row counts once."""
    words = lambda c: F.regexp_extract_all(fold(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    once = lambda a: F.filter(a, lambda x, i: (i == 0) | (x != F.try_element_at(a, i)))
    figures = lambda c: F.regexp_extract_all(c, F.lit(r"[0-9][0-9.,]*"), F.lit(0))
    return (F.array_join(figures(block), " ") == F.array_join(figures(source), " ")) & (F.array_join(once(words(block)), " ") == F.array_join(once(words(source)), " "))


def embed_input(title: Column, heading_path: Column, text: Column) -> Column:
    """``title: ... | text: ...`` with the deepest heading that is not empty, or the title."""
    deepest = F.try_element_at(F.filter(heading_path, lambda h: F.trim(h) != ""), F.lit(-1))
    head = F.substring(F.replace(F.trim(F.coalesce(deepest, title, F.lit("none"))), F.lit(" | "), F.lit(" / ")), 1, 80)
    return F.concat(F.lit("title: "), head, F.lit(" | text: "), text)


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s != "")


def bigrams(words: Column) -> Column:
    n = F.size(words)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))


def lexical_overlap(claim: Column, evidence: Column) -> Column:
    """0.7 of the attested words plus 0.3 of the attested pairs of words."""
    share = lambda a, b: F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.filter(a, lambda x: F.array_contains(b, x))) / F.size(a))
    a, b = content_tokens(claim), content_tokens(evidence)
    return 0.7 * share(a, b) + 0.3 * share(bigrams(a), bigrams(b))


def unsupported_bigrams(query: Column, summary: Column, evidence: Column) -> Column:
    """Pairs of words that query and summary share and the evidence lacks."""
    q, s, e = (bigrams(content_tokens(x)) for x in (query, summary, evidence))
    return F.array_sort(F.array_except(F.array_intersect(q, s), e))


#: Words that hint at one of two languages.
HINTS = {
    "fr": "le la les des une est dans pour avec qui sont été être aux cette".split(),
    "en": "the of and is for with that are was this from".split(),
}


def guess_language(text: Column) -> Column:
    """French if it has more French than English hint words, else English."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    count = lambda k: F.size(F.filter(words, lambda w: w.isin(*HINTS[k])))
    return F.when(count("fr") > count("en"), "fr").otherwise("en")
