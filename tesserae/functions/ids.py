"""Content-derived identities; all are plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(text: Column, most: int = 48) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def doc_id(content: Column, stem: Column) -> Column:
    """First 8 hex digits of the content's SHA-256, then the slug of the file stem if there is one."""
    prefix = F.substring(F.sha2(content, 256), 1, 8)
    return F.when(slug(stem) == "", prefix).otherwise(F.concat(prefix, F.lit("-"), slug(stem)))


def chunk_id(doc: Column, text: Column) -> Column:
    """Depends on the text alone, so equal chunks of a document share an id."""
    return F.concat(doc, F.lit("#"), F.substring(F.sha1(text.cast("binary")), 1, 10))


def entity_id(kind: Column, name: Column) -> Column:
    return F.concat(F.lit("ent_"), F.substring(F.sha1(F.concat(kind, F.lit("::"), F.lower(F.trim(name))).cast("binary")), 1, 16))


def table_id(doc: Column, char_start: Column, first_row: Column) -> Column:
    nul = F.lit("\0")
    return F.substring(F.sha1(F.concat(doc, nul, char_start.cast("string"), nul, F.array_join(first_row, " ")).cast("binary")), 1, 10)


def strip_content_hash(doc: Column) -> Column:
    return F.regexp_replace(doc, "^[0-9a-f]{8}-", "")


def hash_draw(*parts: Column, below: int) -> Column:
    """A number below ``below`` (less than 2**40) that depends on the parts alone: the SHA-256 of the parts joined by ``|``, modulo it."""
    digest = F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)
    digits = F.transform(F.regexp_extract_all(digest, F.lit("[0-9a-f]{4}"), F.lit(0)), lambda d: F.conv(d, 16, 10).cast("long"))
    return F.aggregate(digits, F.lit(0).cast("long"), lambda rest, d: F.pmod(rest * 65536 + d, F.lit(below).cast("long")))
