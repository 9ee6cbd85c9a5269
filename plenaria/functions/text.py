"""Text expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plenaria import schema

#: A word: letters and digits, joined by straight or curly apostrophes.
WORD = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"


def word_count(text: Column) -> Column:
    """Number of words as int; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))


def casefold(text: Column) -> Column:
    """Lower case with sharp s spelt out."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def iso_date(text: Column) -> Column:
    """Date of an ISO string; null for anything else."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


#: Notations of a date in the order they are tried; day and month lead with the day.
DATE_FORMS = (
    (r"^\d{4}-\d{2}-\d{2}(?:[T ].*)?$", r"^(\d{4})-(\d{2})-(\d{2})", (1, 2, 3)),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", r"^(\d{4})/(\d{1,2})/(\d{1,2})$", (1, 2, 3)),
    (r"^\d{8}$", r"^(\d{4})(\d{2})(\d{2})$", (1, 2, 3)),
    (r"^\d{1,2}[./-]\d{1,2}[./-]\d{4}$", r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4})$", (3, 2, 1)),
)


def any_date(text: Column) -> Column:
    """Date of a string in any of DATE_FORMS; null for null, impossible days and other notations."""
    text = F.trim(text)
    tries = []
    for shape, pattern, (y, m, d) in DATE_FORMS:
        part = lambda g, p=pattern: F.regexp_extract(text, p, g)
        iso = F.format_string("%s-%s-%s", part(y), F.lpad(part(m), 2, "0"), F.lpad(part(d), 2, "0"))
        tries.append(F.when(text.rlike(shape), F.try_to_date(iso, "yyyy-MM-dd")))
    return F.coalesce(*tries)


def blank_to_null(text: Column) -> Column:
    """Trimmed text, null if nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def normalized(text: Column) -> Column:
    """One-line casefolded text without blanks before closing punctuation."""
    one_line = F.trim(F.regexp_replace(casefold(text), r"[\s\p{Z}]+", " "))
    return F.regexp_replace(one_line, r"\s+([.,;:!?)\]»”])", "$1")


#: What a loose form leaves out of a normalized text.
LOOSE = r"[^0-9a-zà-öø-ÿ]+"


def loose(text: Column) -> Column:
    """Only digits and Latin-1 letters of the normalized text."""
    return F.regexp_replace(normalized(text), LOOSE, "")


def text_digest(text: Column) -> Column:
    """SHA-256 of the casefolded text with collapsed blanks."""
    return F.sha2(F.trim(F.regexp_replace(casefold(text), r"[\s\p{Z}]+", " ")), 256)


def length_band(words: Column) -> Column:
    return F.when(words < 100, "short").when(words < 250, "medium").otherwise("long")


def length_label(words: Column) -> Column:
    return F.when(words < 100, "40–99").when(words < 250, "100–249").otherwise("250+")


def period(day: Column, kind: str) -> Column:
    """Label of the month, quarter or year of a date."""
    if kind == "year":
        return F.date_format(day, "yyyy")
    if kind == "quarter":
        return F.concat(F.date_format(day, "yyyy"), F.lit("-Q"), F.quarter(day).cast("string"))
    if kind == "month":
        return F.date_format(day, "yyyy-MM")
    raise ValueError("period must be month, quarter or year")


def role_text(text: Column) -> Column:
    return F.trim(F.translate(casefold(F.coalesce(text, F.lit(""))), "’", "'"))


def _any(text: Column, test: str, markers: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for marker in markers:
        out = out | getattr(text, test)(marker.replace("ß", "ss"))
    return out


def is_minister(role: Column) -> Column:
    return _any(role_text(role), "contains", schema.MINISTER_MARKERS)


def is_chair(role: Column, name: Column) -> Column:
    """A presiding officer by role, else by name; the head of a state government is none whatever the name says."""
    r, n = role_text(role), role_text(name)
    by_name = _any(n, "startswith", schema.CHAIR_NAME_PREFIXES) | _any(n, "contains", schema.CHAIR_NAME_MARKERS)
    return (
        F.when(r == schema.CHAIR_TOKEN, True)
        .when(r.contains(schema.HEAD_OF_STATE_GOVERNMENT), False)
        .when(_any(r, "contains", schema.CHAIR_ROLE_MARKERS), True)
        .otherwise(by_name)
    )


def window_label(label: Column) -> Column:
    """Lower case with every run of other characters than a-z and 0-9 as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(casefold(F.coalesce(label, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def label_class(label: Column) -> Column:
    """ai, mixed, human or unknown."""
    key = window_label(label)
    return (
        F.when(key.isin(*schema.AI_LABELS), "ai").when(key.isin(*schema.MIXED_LABELS), "mixed").when(key.isin(*schema.HUMAN_LABELS), "human").otherwise("unknown")
    )


def pseudonym(country: Column, speaker_id: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", country, speaker_id), 256), 1, 16)


def known_id(speaker_id: Column) -> Column:
    """The trimmed id, null for missing ones and the sentinels."""
    plain = F.trim(speaker_id)
    return F.when((plain != "") & ~F.lower(plain).isin(*schema.MISSING_IDS), plain)


def units(words: Column, block: int = 100) -> Column:
    """Begun blocks of words."""
    return F.ceil(words / F.lit(float(block))).cast("bigint")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def exact(x: Column) -> Column:
    """A double as a decimal, so that sums don't depend on the order of the rows."""
    return F.round(x, 9).cast("decimal(18,9)")
