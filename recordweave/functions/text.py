"""Text and key functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank(c: Column) -> Column:
    """The trimmed value; null becomes the empty string, the only 'missing' that rules see."""
    return F.coalesce(F.trim(c.cast("string")), F.lit(""))


def space(c: Column) -> Column:
    """Trims and collapses white space, Unicode's included."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def name_key(c: Column) -> Column:
    return F.lower(space(c))


def dedupe_key(name: Column, host: Column) -> Column:
    return F.concat_ws("|", name_key(name), host)


def company_country_key(name: Column, country: Column) -> Column:
    return F.concat_ws("|", name_key(name), name_key(country))


def missing(c: Column, sentinels: tuple[str, ...] = ("", "Not Found")) -> Column:
    return blank(c).isin(*sentinels)


def any_term(text: Column, terms: list[str]) -> Column:
    """Whether any term occurs in the lower-cased text, as a substring."""
    low = F.lower(text)
    return F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(low, t))


def terms_in(text: Column, terms: list[str]) -> Column:
    """The terms that occur, in their order."""
    low = F.lower(text)
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(low, t))


def phrase(text: Column, term: str) -> Column:
    """Whether the term's words follow each other with signs or spaces between, not inside longer words."""
    words = r"[^\w]+".join(term.lower().split())
    return F.lower(text).rlike(rf"(?U)(?<!\w){words}(?!\w)")


def reasons(*rules: tuple[Column, str]) -> Column:
    """The reasons whose rule holds, in order and once each."""
    return F.array_distinct(F.array_compact(F.array(*(F.when(rule, F.lit(reason)) for rule, reason in rules))))


def ratio(a: Column, b: Column) -> Column:
    return a.cast("double") / F.greatest(b, F.lit(1))


def title_case_label(domain: Column) -> Column:
    """A name from the first label of a domain."""
    return F.initcap(F.regexp_replace(F.split_part(domain, F.lit("."), F.lit(1)), "[-_]+", " "))
