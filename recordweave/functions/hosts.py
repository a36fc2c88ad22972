"""Hosts, registrable domains, mailboxes and who belongs to whom."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of two labels under which names are registered; a parameter of registrable_domain.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "uk.com", "com.au", "co.jp", "com.br", "com.cn", "co.in", "com.mx")


def host(url: Column, strip_www: bool = True) -> Column:
    """The lower-case host of a URL or bare host; empty if it isn't a valid ASCII host name."""
    raw = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    h = F.regexp_extract(raw, r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:@]*)", 1)
    h = F.regexp_replace(h, r"^\.+|\.+$", "")
    h = F.regexp_replace(h, r"^www\.", "") if strip_www else h
    valid = h.rlike(r"^(?=.{1,253}$)(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)*[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?$") & ~h.rlike(r"(^|\.)[0-9]+$")
    return F.when(valid, h).otherwise("")


def registrable_domain(h: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The label before the suffix and the suffix; empty for a bare suffix or a single label."""
    labels = F.split(h, r"\.")
    n = F.size(labels)
    two = F.array_join(F.slice(labels, -2, 2), ".")
    three = F.array_join(F.slice(labels, -3, 3), ".")
    return F.when(n < 2, "").when(~two.isin(*suffixes), two).when(n < 3, "").otherwise(three)


def attributable(a: Column, b: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """Whether host b is host a or below it, under the same registrable domain; directional."""
    same = (registrable_domain(a, suffixes) == registrable_domain(b, suffixes)) & (registrable_domain(a, suffixes) != "")
    return same & ((a == b) | F.endswith(b, F.concat(F.lit("."), a)))


def same_company(a: Column, a_domain: Column, b: Column, b_domain: Column) -> Column:
    """attributable(a, b), where the registrable domains are known already."""
    return (a_domain == b_domain) & (a_domain != "") & ((a == b) | F.endswith(b, F.concat(F.lit("."), a)))


def mailbox(c: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The lower-case ASCII mailbox; empty if it isn't one with a registrable domain."""
    m = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    atom = r"[a-z0-9!#$%&'*+/=?^_`{|}~-]+"
    domain = F.substring_index(m, "@", -1)
    valid = m.rlike(rf"^(?=[\x00-\x7f]*$)(?!www\.){atom}(?:\.{atom})*@[^@]+$") & (F.length(F.split_part(m, F.lit("@"), F.lit(1))) <= 64) & (F.length(m) <= 254)
    return F.when(valid & (registrable_domain(host(domain, False), suffixes) != ""), m).otherwise("")


def mailbox_domain(m: Column) -> Column:
    return F.when(F.contains(m, F.lit("@")), F.substring_index(m, "@", -1)).otherwise("")


def page_key(url: Column) -> Column:
    """A URL without fragment and trailing slashes: one page, one key."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"#.*$", ""), r"/+$", "")
