"""Numbers written in text: grammar, canonical form, evidence, column inference.

The grammar, in order: a pair of round brackets around everything negates; a currency sign, with an
optional minus after it; a sign; the digits, from which all commas go; a scale word, or a scale
letter right after a digit; a percent sign, which does not scale.  Anything else is no number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the grammar.
SCALES = {"thousand": 1e3, "million": 1e6, "billion": 1e9, "trillion": 1e12, "k": 1e3, "m": 1e6, "b": 1e9, "t": 1e12}
CURRENCY = "$€£"
#: Groups: 1 minus after the currency, 2 sign, 3 digits, 4 scale word, 5 scale letter.
PATTERN = r"^(?:[$€£]\s*(-)?\s*)?(?:([-+])\s*)?(-?[0-9,]*[0-9,](?:\.[0-9,]*)?)(?:\s*(thousand|million|billion|trillion)|(?<=[0-9])([kmbt]))?\s*%?$"
SPACE = r"^\s+|\s+$"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, SPACE, "")


def coerce_number(cell: Column) -> Column:
    """The number that the cell reads as, or null."""
    text = _strip(F.lower(cell))
    wrapped = F.coalesce(text.rlike(r"(?s)^\(.*\)$"), F.lit(False))
    body = F.when(wrapped, _strip(F.regexp_replace(text, r"(?s)^\(|\)$", ""))).otherwise(text)
    part = lambda i: F.regexp_extract(body, PATTERN, i)
    digits = F.regexp_replace(part(3), ",", "")
    scale_text = F.concat(part(4), part(5))
    scale = F.coalesce(F.element_at(F.create_map(*[x for k, v in SCALES.items() for x in (F.lit(k), F.lit(v))]), scale_text), F.lit(1.0))
    minus = (wrapped.cast("int") + (part(1) == "-").cast("int") + (part(2) == "-").cast("int")) % 2 == 1
    number = F.when(digits.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), digits).try_cast("double") * scale
    return F.when(minus, -number).otherwise(number)


def is_canonical_number(cell: Column) -> Column:
    """Plain digits or groups of three, with at most one decimal point, once dressing is off."""
    text = _strip(cell)
    text = F.when(text.rlike(r"(?s)^\(.*\)$"), _strip(F.regexp_replace(text, r"(?s)^\(|\)$", ""))).otherwise(text)
    text = F.regexp_replace(text, r"^[\s$€£+\-]*", "")
    text = _strip(F.regexp_replace(text, r"(?i)\s*(?:%|thousand|million|billion|trillion|[kmbt])\s*$", ""))
    return text.rlike(r"^(?:[0-9]{1,3}(?:,[0-9]{3})*|[0-9]+)(?:\.[0-9]+)?$")


def looks_like_value(cell: Column) -> Column:
    return cell.rlike(r"[\p{Nd}$%]")


def numbers_in(text: Column) -> Column:
    """All figures of a text, commas removed."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"[0-9][0-9,]*(?:\.[0-9]+)?"), F.lit(0)), lambda x: F.regexp_replace(x, ",", "").try_cast("double"))


def scale_matches(figure: Column, value: Column, powers: tuple[int, ...] = (-12, -9, -6, -3, 0, 3, 6, 9, 12)) -> Column:
    """Whether ``value`` is ``figure`` at some power of a thousand, to within max(1, 1e-6 of the figure)."""
    tolerance = F.greatest(F.lit(1.0), F.abs(figure) * 1e-6)
    hits = [F.abs(value * F.lit(10.0**p) - figure) <= tolerance for p in powers]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return F.coalesce(out, F.lit(False))


def figures_supported(claim: Column, evidence: Column, least: float = 1e4) -> Column:
    """Every figure of the claim of at least ``least`` has a number of the evidence at some scale of a thousand."""
    found = numbers_in(evidence)
    return F.forall(F.filter(numbers_in(claim), lambda x: x >= least), lambda f: F.exists(found, lambda v: scale_matches(f, v)))


def verbatim_figures(claim: Column, text: Column) -> Column:
    """At least one figure of the claim stands literally in the text (commas apart)."""
    plain = F.regexp_replace(text, ",", "")
    figures = F.transform(F.regexp_extract_all(claim, F.lit(r"[0-9][0-9,]*(?:\.[0-9]+)?"), F.lit(0)), lambda x: F.regexp_replace(x, ",", ""))
    return F.exists(figures, lambda f: F.contains(plain, f))


def surface_forms(cell: Column) -> Column:
    """Other ways to write a figure: ``45%`` as ``45 percent``, ``$2B`` as ``$2 billion``."""
    word = F.element_at(F.create_map(*[x for k, v in {"k": "thousand", "m": "million", "b": "billion", "t": "trillion"}.items() for x in (F.lit(k), F.lit(v))]), F.lower(F.regexp_extract(cell, r"^\$?[0-9.,]+([kKmMbBtT])$", 1)))
    percent = F.when(cell.rlike(r"^[0-9.,]+\s*%$"), F.concat(F.regexp_extract(cell, r"^([0-9.,]+)", 1), F.lit(" percent")))
    scaled = F.when(word.isNotNull(), F.concat(F.regexp_extract(cell, r"^(\$?[0-9.,]+)", 1), F.lit(" "), word))
    return F.array_compact(F.array(percent, scaled))


def timestamp_label(seconds: Column) -> Column:
    """``mm:ss``, or ``hh:mm:ss`` from one hour on."""
    s = F.floor(seconds).cast("int")
    h, m = F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int")
    short = F.format_string("%02d:%02d", F.floor(s / 60).cast("int"), s % 60)
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, s % 60)).otherwise(short)
