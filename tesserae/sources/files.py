"""Files by content: format detection, validation, ingest."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import ids

MAX_BYTES = 256 << 20
#: Suffixes of program sources and their language.
LANGUAGES = {
    "rs": "rust", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "go": "go",
    "c": "c", "cc": "c++", "cpp": "c++", "cxx": "c++", "h": "c", "hpp": "c++", "hh": "c++", "java": "java", "kt": "kotlin",
    "kts": "kotlin", "scala": "scala", "swift": "swift", "rb": "ruby", "php": "php", "cs": "c#", "sh": "shell", "bash": "bash",
    "zsh": "zsh", "lua": "lua", "pl": "perl", "pm": "perl", "r": "r", "m": "objective-c", "mm": "objective-c++", "sql": "sql",
}
#: Brands of the ISO media container that mean video.
VIDEO_BRANDS = "isom iso2 iso4 iso5 iso6 mp41 mp42 avc1 M4VH M4VP dash hev1 hvc1".split() + ["M4V ", "qt  "]


def scan_binary(spark: SparkSession, path: str, recursive: bool = True, glob: str | None = None) -> DataFrame:
    """``path, stem, suffix, length, content``; names that begin with a dot, and folders of such names, are left out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    df = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    tail = F.replace(F.col("path"), F.lit(path.rstrip("/")), F.lit(""))
    return df.filter(~tail.rlike(r"(^|/)\.")).select("path", F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("suffix"), "length", "content")


def looks_like_text(content: Column) -> Column:
    """No NUL in the first 4 KiB, and UTF-8; up to three bytes of a character that the cut hits don't count."""
    return ~_has_nul(F.substring(content, 1, 4096)) & _utf8_head(content)


def _has_nul(head: Column) -> Column:
    return F.hex(head).rlike("^(?:[0-9A-F]{2})*00")


def detect(content: Column, suffix: Column) -> Column:
    """Kind by magic bytes, in this order: document formats, audio, video, image, Markdown, program source, text."""
    head = F.substring(content, 1, 64)
    starts = lambda h: F.startswith(F.hex(head), F.lit(h))
    at = lambda pos, n: F.hex(F.substring(content, pos + 1, n))
    ascii_ = lambda s: s.encode().hex().upper()
    text = looks_like_text(content)
    brands = [at(8, 4), *(at(k, 4) for k in range(16, 40, 4))]
    brand_in = lambda names: F.array_contains(F.array([F.lit(ascii_(b)) for b in names]), brands[0]) | F.arrays_overlap(F.array(*brands[1:]), F.array([F.lit(ascii_(b)) for b in names]))
    ftyp = at(4, 4) == ascii_("ftyp")
    ogg = F.lit(False)
    for codec in ("OpusHead", "vorbis", "FLAC", "Speex"):
        ogg = ogg | (F.instr(F.hex(head), ascii_(codec)) > 0)
    audio = at(0, 2).isin("FFF1", "FFF9", "FFF0", "FFF8", "FFFB", "FFFA", "FFF3", "FFF2") | (
        ~text & (starts(ascii_("ID3")) | starts(ascii_("fLaC")) | (starts(ascii_("OggS")) & ogg) | (starts(ascii_("RIFF")) & (at(8, 4) == ascii_("WAVE"))) | (ftyp & brand_in(["M4A "])))
    )
    video = ~text & ((ftyp & brand_in(VIDEO_BRANDS)) | starts("1A45DFA3"))
    image = starts("89504E470D0A1A0A") | starts("FFD8FF") | (starts(ascii_("RIFF")) & (at(8, 4) == ascii_("WEBP"))) | starts("49492A00") | starts("4D4D002A") | (~text & (starts(ascii_("BM")) | starts(ascii_("GIF87a")) | starts(ascii_("GIF89a"))))
    return (
        F.when(starts(ascii_("%PDF-")), "pdf")
        .when(starts("504B0304"), "office")
        .when(starts(ascii_("<!doctype html")) | starts(ascii_("<!DOCTYPE html")) | starts(ascii_("<html")), "html")
        .when(audio, "audio")
        .when(video, "video")
        .when(image, "image")
        .when(text & suffix.isin("md", "markdown"), "md")
        .when(text & suffix.isin(*LANGUAGES), "code")
        .when(text, "text")
        .otherwise("unknown")
    )


def _utf8_head(content: Column) -> Column:
    head = F.substring(content, 1, 4096)
    n = F.octet_length(head)
    valid = F.is_valid_utf8(head.cast("string"))
    for cut in (1, 2, 3):
        valid = valid | ((n == 4096) & F.is_valid_utf8(F.substr(head, F.lit(1), n - cut).cast("string")))
    return valid


def office_kind(content: Column) -> Column:
    """``kind, has_macros`` of a ZIP from its entry names."""

    @F.pandas_udf("kind string, has_macros boolean")
    def look(data: pd.Series) -> pd.DataFrame:
        rows = []
        for b in data:
            try:
                names = zipfile.ZipFile(io.BytesIO(b)).namelist()
            except (zipfile.BadZipFile, TypeError):
                rows.append(("unknown", False))
                continue
            kind = next((k for p, k in (("word/", "docx"), ("ppt/", "pptx"), ("xl/", "xlsx")) if any(n.startswith(p) for n in names)), "unknown")
            rows.append((kind, any("vbaproject.bin" in n.lower() for n in names)))
        return pd.DataFrame(rows, columns=["kind", "has_macros"])

    return look(content)


def language_of(suffix: Column) -> Column:
    """Display name of a source file's language; the suffix itself if unknown."""
    return F.coalesce(F.element_at(F.create_map(*[x for k, v in LANGUAGES.items() for x in (F.lit(k), F.lit(v))]), F.lower(suffix)), F.lower(suffix))


def ingest(files: DataFrame, max_bytes: int = MAX_BYTES, allow_macros: bool = False) -> DataFrame:
    """``doc_id, path, stem, kind, sha256, rejection_reason``: one row a file, rejected ones too."""
    kind = detect(F.col("content"), F.col("suffix"))
    rows = files.withColumn("_kind", kind).withColumn("_office", F.when(F.col("_kind") == "office", F.col("content")))
    rows = rows.withColumn("_o", office_kind(F.col("_office"))).withColumn("kind", F.when(F.col("_kind") == "office", F.col("_o.kind")).otherwise(F.col("_kind")))
    macros = (F.col("_kind") == "office") & F.col("_o.has_macros")
    reason = F.when(F.col("length") > max_bytes, "too large").when(F.col("length") == 0, "empty").when(F.col("kind") == "unknown", "unknown format").when(macros & ~F.lit(allow_macros), "macros")
    return rows.select(ids.doc_id(F.col("content"), F.col("stem")).alias("doc_id"), "path", "stem", "kind", F.sha2("content", 256).alias("sha256"), reason.alias("rejection_reason"))


def strip_html(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags go, entities are decoded, blank runs collapse."""
    out = F.regexp_replace(html, r"(?is)<(script|style|noscript|template)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def html_headings(html: Column) -> Column:
    found = F.regexp_extract_all(html, F.lit(r"(?is)<h([1-6])\b[^>]*>(.*?)</h\1\s*>"), F.lit(2))
    return F.transform(found, lambda h: F.trim(F.regexp_replace(h, r"<[^>]*>", "")))


def html_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?i)<a\b[^>]*\bhref=\"([^\"]*)\""), F.lit(1))
