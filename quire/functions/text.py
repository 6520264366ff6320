"""Column functions on text: estimates, counts, escapes and keys.  All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: letters, digits and underscores, joined by apostrophes and hyphens; explicit classes, as engines
#: differ in what \w is.
WORD = r"[\p{L}\p{N}_]+(?:['-]+[\p{L}\p{N}_]+)*"
#: Placeholders of protected objects.
TOKEN = r"\[\[(?:IMG|CODE|MEDIA)_[0-9]+\]\]"
TAG = r"<[^>]*>"


def ascii_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))


def estimate_tokens(text: Column) -> Column:
    """Offline token estimate: a third of the ASCII characters rounded up, two for any other, at least one."""
    ascii_n = ascii_count(text)
    return F.greatest(F.lit(1), F.floor((ascii_n + 2) / 3) + 2 * (F.length(text) - ascii_n)).cast("bigint")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def image_count(markup: Column) -> Column:
    return F.regexp_count(markup, F.lit(r"<img[\s/>]")).cast("bigint")


def visible_text(markup: Column) -> Column:
    """Flat markup without tags, blanks collapsed; for trees see ``quire.operators.markup``."""
    return F.trim(F.regexp_replace(F.regexp_replace(markup, TAG, " "), r"\s+", " "))


def unescape(text: Column) -> Column:
    """The five predefined entities."""
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def escape(text: Column) -> Column:
    """Markup-safe text; & comes first."""
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def content_key(*parts: Column) -> Column:
    """SHA-256 of the parts one after another, without separators; null counts as empty."""
    return F.sha2(F.concat(*(F.coalesce(p, F.lit("")) for p in parts)).cast("binary"), 256)


def canonical_json(fields: Column) -> Column:
    """A map as JSON with its keys in order, so that equal maps have equal keys, however they were made."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(fields))), {"ignoreNullFields": "false"})


def placeholders(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def chapter_name(index: Column) -> Column:
    return F.format_string("chap_%03d.xhtml", index.cast("int"))


def dollars(amount: Column) -> Column:
    return F.format_string("$%.4f", amount.cast("double"))


def has_property(properties: Column, name: str) -> Column:
    return F.array_contains(F.split(F.coalesce(properties, F.lit("")), r"\s+"), name)


def is_external(reference: Column) -> Column:
    """Has a scheme or a network location."""
    return reference.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | reference.rlike("^//")
