"""Parse-side relational steps: page signals, furniture, heading tiers, routing, escalation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def signals(pages: DataFrame, by: str = "doc_id", value: str = "n_chars") -> DataFrame:
    """Mean, median, 10th and 90th percentile (interpolated) and population deviation of a page figure."""
    return pages.groupBy(by).agg(
        F.avg(value).alias("mean"), F.median(value).alias("median"), F.percentile(value, F.lit(0.1)).alias("p10"), F.percentile(value, F.lit(0.9)).alias("p90"), F.stddev_pop(value).alias("pstdev"), F.count(F.lit(1)).alias("pages")
    )


def furniture(lines: DataFrame, band: int = 3, share: float = 0.5, least: int = 3) -> DataFrame:
    """Lines (doc_id, page, line_no, text) that stand in the top or bottom band of enough pages: ``doc_id, text``."""
    w = Window.partitionBy("doc_id", "page")
    near = lines.withColumn("_n", F.max("line_no").over(w)).filter((F.trim("text") != "") & ((F.col("line_no") <= band) | (F.col("line_no") > F.col("_n") - band)))
    n = lines.groupBy("doc_id").agg(F.countDistinct("page").alias("_pages"))
    counts = near.groupBy("doc_id", F.trim("text").alias("text")).agg(F.countDistinct("page").alias("_on"))
    return counts.join(n, "doc_id").filter(F.col("_on") >= F.greatest(F.lit(float(least)), share * F.col("_pages"))).select("doc_id", "text")


def without_furniture(lines: DataFrame, found: DataFrame, band: int = 3) -> DataFrame:
    w = Window.partitionBy("doc_id", "page")
    marked = lines.withColumn("_n", F.max("line_no").over(w)).withColumn("_near", (F.col("line_no") <= band) | (F.col("line_no") > F.col("_n") - band))
    gone = found.select("doc_id", F.col("text").alias("_t"))
    out = marked.join(gone, (marked["doc_id"] == gone["doc_id"]) & (F.trim(marked["text"]) == gone["_t"]) & marked["_near"], "left_anti")
    return out.drop("_n", "_near")


def heading_tiers(spans: DataFrame, most: int = 6) -> DataFrame:
    """``doc_id, size, level``: the most frequent font size is body text; larger ones are levels, largest first."""
    counts = spans.groupBy("doc_id", "size").agg(F.sum("n_chars").alias("n"))
    body = counts.groupBy("doc_id").agg(F.max_by("size", F.struct("n", "size")).alias("body"))
    larger = counts.join(body, "doc_id").filter("size > body")
    return larger.withColumn("level", F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.desc("size")))).filter(F.col("level") <= most).select("doc_id", "size", "level")


def heading_levels_by_height(headers: DataFrame, most: int = 4) -> DataFrame:
    """Level of each header from the dense rank of its height."""
    return headers.withColumn("level", F.least(F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.desc("height"))), F.lit(most)))


def image_fraction(pages: DataFrame, figures: DataFrame) -> DataFrame:
    """``doc_id, page, fraction``: area of figures that are no charts by page area, within 0 and 1."""
    area = figures.filter(~F.col("is_chart")).groupBy("doc_id", "page").agg(F.sum("area").alias("_a"))
    return pages.join(area, ["doc_id", "page"], "left").select("doc_id", "page", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("_a", F.lit(0.0)) / F.nullif(F.col("area"), F.lit(0.0)))).alias("fraction"))


#: Parts of producer names that mean a native text layer, and those that mean a scan.
BORN_DIGITAL = (
    "powerpoint", "keynote", "word", "pages", "openoffice", "libreoffice", "google docs", "google slides", "latex", "tex", "xetex", "lualatex",
    "pandoc", "wkhtmltopdf", "chromium", "weasyprint", "prince", "acrobat distiller", "indesign", "quark",
)
SCANNERS = ("scanner", "omnipage", "abbyy", "readiris", "tesseract", "kofax", "capture", "scansoft", "iris")
#: Share of image area, and of pages full of images, that make mixed content; aspect, letters and image area of a deck of slides.
MIXED_AREA, MIXED_PAGES, DECK_ASPECT, DECK_CHARS, DECK_AREA = 0.35, 0.30, 1.3, 800.0, 0.20


def route(signals: DataFrame) -> DataFrame:
    """``signals`` with ``doc_type, confidence, tier, needs_ocr``; the first rule that holds wins.

    Signals: creator, producer, chars_per_page, chars_p90, aspect, image_area (share), image_pages (share), empty_pages (share),
    broken_chars (share), fonts, tagged, has_headings, has_tables, has_lists, has_code.
    """
    made_by = F.lower(F.concat_ws(" ", F.coalesce("creator", F.lit("")), F.coalesce("producer", F.lit(""))))
    any_of = lambda names: F.exists(F.array(*map(F.lit, names)), lambda x: F.contains(made_by, x))
    digital, scanned, chars, aspect = any_of(BORN_DIGITAL), any_of(SCANNERS), F.col("chars_per_page"), F.col("aspect")
    mixed = (chars >= 50) & (F.col("image_area") >= MIXED_AREA) & (F.col("image_pages") >= MIXED_PAGES)
    deck = (aspect >= DECK_ASPECT) & (chars >= 50) & ((chars < DECK_CHARS) | (F.col("image_area") >= DECK_AREA))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("double")
    bonus = 0.10 * yes("has_headings") + 0.05 * yes("has_tables") + 0.05 * yes("has_lists") + 0.05 * yes("has_code")
    wide, tall = aspect >= 1.3, aspect < 1.0
    density = F.least(F.lit(1.0), F.least(F.lit(0.85), chars / F.when(wide, 200.0).when(tall, 800.0).otherwise(400.0)) + bonus)

    def rule(kind: str, confidence: float | Column, tier: str, ocr: bool | Column = False) -> Column:
        return F.struct(F.lit(kind).alias("doc_type"), (confidence if isinstance(confidence, Column) else F.lit(confidence)).alias("confidence"), F.lit(tier).alias("tier"), (ocr if isinstance(ocr, Column) else F.lit(ocr)).alias("needs_ocr"))

    def unless_mixed(kind: str, confidence: float | Column, tier: str, when: Column | None = None) -> Column:
        return F.when(mixed if when is None else mixed & when, rule("mixed-content", 0.20, f"{tier}-mixed", True)).otherwise(rule(kind, confidence, tier))

    told = (
        F.when(deck & ~scanned, F.when(mixed, rule("slide-deck-mixed", 0.10, "0.5-slide-deck-mixed", True)).otherwise(rule("slide-deck", 0.10, "0.5-slide-deck")))
        .when(digital & (chars >= 50), unless_mixed("born-digital", 0.98, "1.A"))
        .when(scanned, rule("scan", 0.0, "1.B", True))
        .when(digital, rule("born-digital-but-rasterised", 0.10, "1.C", True))
        .when(F.coalesce("tagged", F.lit(False)) & (chars >= 80), unless_mixed("tagged-pdf", 0.90, "2"))
        .when((F.col("fonts") >= 3) & (chars >= 80), unless_mixed("fonted-born-digital", 0.85, "2"))
        .when((F.col("image_pages") > 0.5) & (chars < 100), rule("image-heavy", 0.15, "2", True))
        .when(F.col("broken_chars") > 0.05, rule("mojibake", 0.10, "3"))
        .when((chars < 10) & (F.col("chars_p90") < 30), rule("scan-like", 0.0, "3", True))
        .when(F.col("empty_pages") > 0.5, rule("mostly-empty", 0.15, "3", True))
        .when(wide, unless_mixed("slide", density, "4", density >= 0.5))
        .when(tall, unless_mixed("paper", density, "4", density >= 0.5))
        .otherwise(unless_mixed("unknown", density, "4", density >= 0.5))
    )
    return signals.withColumn("_r", told).select(*signals.columns, "_r.*")


def escalate(pages: DataFrame, least: float = 0.6, most_image: float = 0.5) -> DataFrame:
    """Pages for the vision model: unsure, full of images, or with a diagram."""
    return pages.filter((F.col("confidence") < least) | (F.col("image_fraction") > most_image) | F.col("has_diagram"))


def figures_left(figures: DataFrame, escalated: DataFrame) -> DataFrame:
    return figures.join(escalated.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")


def chart_sidecar(placeholders: DataFrame, extractions: DataFrame) -> DataFrame:
    """``doc_id, ordinal, markdown`` where a document has as many extractions as placeholders, else none."""
    a = placeholders.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    b = extractions.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return extractions.join(a.join(b, ["doc_id", "n"]).select("doc_id"), "doc_id", "left_semi").select("doc_id", "ordinal", "markdown")


def assemble_pages(decisions: DataFrame, counts: DataFrame) -> DataFrame:
    """Every page 1..n of a document in order; those that failed have confidence 0 and no text."""
    every = counts.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("n_pages"))).alias("page"))
    return every.join(decisions, ["doc_id", "page"], "left").select("doc_id", "page", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("markdown", F.lit("")).alias("markdown"))


def best_of(draws: DataFrame) -> DataFrame:
    """Longest draw of each item, the first of equal ones."""
    return draws.groupBy("item_id").agg(F.max_by("markdown", F.struct(F.length("markdown"), -F.col("draw"))).alias("markdown"))


def transcript(segments: DataFrame) -> DataFrame:
    """``doc_id, body`` with a ``## [mm:ss]`` heading for each segment."""
    from tesserae.functions.numbers import timestamp_label

    block = F.concat(F.lit("## ["), timestamp_label(F.col("start_s")), F.lit("]\n\n"), F.trim("text"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("index", block.alias("b")))), lambda x: x["b"])
    return segments.groupBy("doc_id").agg(F.array_join(parts, "\n\n").alias("body"))


#: Labels of pictures that may follow an image marker as a paragraph of their own.
PICTURE_LABELS = (
    "logo", "icon", "photograph", "picture", "natural image", "pictogram", "line chart", "bar chart", "pie chart", "scatter plot",
    "box plot", "flow chart", "engineering drawing", "diagram", "screenshot", "screenshot from computer", "table", "signature",
    "stamp", "map", "geographical map", "remote sensing", "bar code", "qr code", "calendar", "chemistry molecular structure",
    "chemistry markush structure", "other",
)


def enrich_image_markers(text: Column) -> Column:
    """Folds the line with a known picture label into the marker before it; blanks of the label become hyphens."""
    for label in PICTURE_LABELS:
        text = F.regexp_replace(text, rf"(?im)^[ \t]*<!--\s*image\s*-->[ \t]*\n\s*?{label}[ \t]*$", f"<!-- image: kind={label.replace(' ', '-')} -->")
    return text


def clean_markdown(text: Column) -> Column:
    out = enrich_image_markers(text)
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, r"(?m)[ \t]+$", "")


def strip_fence(text: Column) -> Column:
    """A page that is one Markdown fence loses the fence."""
    return F.regexp_replace(text, r"(?s)\A\s*```(?:markdown|md)?[ \t]*\n(.*?)\n```\s*\z", "$1")


def derive_title(path: Column, doc: Column) -> Column:
    stem = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    return F.when(F.coalesce(stem, F.lit("")) == "", doc).otherwise(stem)


def merge_header(cells: Column) -> Column:
    """Header cells joined by a blank, equal neighbours once."""
    return F.array_join(F.filter(cells, lambda x, i: (i == 0) | (x != F.try_element_at(cells, i))), " ")


#: Titles of sections that are not the body.
FRONT_MATTER = (
    "authority", "comments", "comments on this publication", "reports on computer systems technology", "acknowledgments",
    "acknowledgements", "trademark information", "trademarks", "patent disclosure notice", "patent disclosure",
    "table of contents", "contents", "list of figures", "list of tables", "keywords", "references", "bibliography", "notices",
    "legal notice", "disclaimer", "copyright", "how to cite this publication", "foreword", "preface", "acronyms", "glossary",
    "abbreviations",
)
SECTION_NUMBER = r"(?i)^(?:appendix\s+[a-z0-9]+|[0-9ivxlc]+(?:\.[0-9]+)*)[\s.):—–-]+"


def is_front_matter(title: Column) -> Column:
    """Whether a heading, without marks and section number, is such a title."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(title), r"^[*# ]+|[*# ]+$", ""), SECTION_NUMBER, "")
    return F.lower(F.trim(F.regexp_replace(bare, r"^[*#:—– .]+|[*#:—– .]+$", ""))).isin(*FRONT_MATTER)


def document_route(sections: DataFrame, short: int = 14_000, many: int = 12, tiny: int = 600, share: float = 0.6) -> DataFrame:
    """``doc_id, route``: short documents go whole, those of many tiny sections are packed, others by section."""
    a = sections.groupBy("doc_id").agg(F.sum("n_chars").alias("n"), F.count(F.lit(1)).alias("k"), F.avg(F.when(F.col("n_chars") < tiny, 1.0).otherwise(0.0)).alias("t"))
    return a.select("doc_id", F.when((F.col("n") <= short) | (F.col("k") <= 1), "short").when((F.col("k") >= many) & (F.col("t") >= share), "pack").otherwise("sections").alias("route"))


def section_groups(chunks: DataFrame) -> DataFrame:
    """``doc_id, title, pos, n_chars``: chunks by their deepest heading, in order of first appearance."""
    title = F.coalesce(F.try_element_at("heading_path", F.lit(-1)), F.lit(""))
    return chunks.groupBy("doc_id", title.alias("title")).agg(F.min("char_start").alias("pos"), F.sum(F.length("text")).alias("n_chars"))


#: How the reasons of each step begin.
REFUSAL_STARTS = (
    ("assess-empty", "No relevant content found in the vault"),
    ("assess-failclosed", "The sufficiency check failed"),
    ("relevance", "The retrieved material addresses a related topic"),
    ("verify-zero", "I drafted an answer but couldn't ground"),
    ("compose-zero", "Verification returned no grounded claims"),
    ("over-budget", "I exceeded my reasoning budget"),
    ("catch-all", "I couldn't construct a confident answer"),
)


def refusal_cause(reason: Column) -> Column:
    """The step that refused, by the beginning of its reason; any other text is the sufficiency model's own, and no reason means an answer."""
    known = F.coalesce(*[F.when(F.startswith(reason, F.lit(start)), step) for step, start in REFUSAL_STARTS])
    return F.when(F.coalesce(reason, F.lit("")) == "", "answered").otherwise(F.coalesce(known, F.lit("sufficiency-model")))


def run_verdicts(runs: DataFrame) -> DataFrame:
    """``query_id, verdict`` over several runs (query_id, should_refuse, refused): any answer where a refusal is due is a false one; else all runs should answer."""
    all_, any_ = F.bool_and(~F.col("refused")), F.bool_or(~F.col("refused"))
    answerable = F.when(all_, "correct-answer").when(~any_, "FALSE-REFUSAL-deterministic").otherwise("FALSE-REFUSAL-flaky")
    return runs.groupBy("query_id").agg(F.when(F.bool_or("should_refuse"), F.when(any_, "FALSE-ANSWER").otherwise("correct-refusal")).otherwise(answerable).alias("verdict"))


def verify_verdicts(n_claims: Column, grounded: Column, contested: Column) -> Column:
    """Indices of claims that stay: named as grounded, in range, and not contested."""
    return F.filter(F.sequence(F.lit(0), n_claims - 1), lambda i: F.array_contains(grounded, i) & ~F.array_contains(contested, i))


def report_confidence(cosine: Column, lexical: Column) -> Column:
    return F.round(0.7 * cosine + 0.3 * lexical, 3)
