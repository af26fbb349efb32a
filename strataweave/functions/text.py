"""Text functions: terms, folding, paths, escaping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no search meaning.
STOP_WORDS = (
    "the and for with from that this what where when how why which who does are was were has have had can could should would into about its not but you"
).split()


def terms(text: Column, least: int = 3) -> Column:
    """Distinct folded terms of letters, digits and underscores, without stop words."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+")
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.array_distinct(F.filter(parts, lambda w: (F.length(w) >= least) & ~F.array_contains(stop, w)))


def area(path: Column) -> Column:
    """The first two parent directories of a path."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, 1, F.least(F.lit(2), F.size(parts) - 1)), "/")


def module_name(path: Column) -> Column:
    """The last part of a path without its extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


def doc_number(path: Column) -> Column:
    """``ADR-7`` or ``RFC-12`` of a numbered document (``docs/adr/0007-name.md``, ``rfcs/RFC-12.md``), else null."""
    folder = F.regexp_extract(F.lower(path), r"(?:^|/)(adr|rfc)s?/(?:[^/]*/)*(?:adr|rfc)?[-_ ]?0*([0-9]+)[^/]*$", 1)
    number = F.regexp_extract(F.lower(path), r"(?:^|/)(adr|rfc)s?/(?:[^/]*/)*(?:adr|rfc)?[-_ ]?0*([0-9]+)[^/]*$", 2)
    return F.when(number != "", F.concat(F.upper(folder), F.lit("-"), number))


def rfc3339(millis: Column) -> Column:
    """Milliseconds of the epoch as an instant in UTC, to the millisecond; days and times by whole-number arithmetic, whatever the session's zone.

    Years have four digits, or as many as they need.
    """
    left = F.pmod(millis, F.lit(86_400_000)).cast("long")
    date = F.date_add(F.lit("1970-01-01").cast("date"), F.call_function("div", millis - left, F.lit(86_400_000)).cast("int"))
    year = F.year(date).cast("string")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    part = lambda unit, most: pad(F.pmod(F.call_function("div", left, F.lit(unit)), F.lit(most)), 2)
    clock = F.concat(part(3_600_000, 24), F.lit(":"), part(60_000, 60), F.lit(":"), part(1000, 60), F.lit("."), pad(left % 1000, 3))
    return F.concat(F.when((F.length(year) < 4) & (F.year(date) >= 0), pad(year, 4)).otherwise(year), F.date_format(date, "-MM-dd"), F.lit("T"), clock, F.lit("Z"))


def token_estimate(text: Column) -> Column:
    """Four characters a token, rounded up."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def is_doc(path: Column) -> Column:
    return F.lower(F.substring_index(path, ".", -1)).isin("md", "markdown", "mdx", "txt", "rst", "adoc") & path.contains(".")


def xml_escape(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def cypher_escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
