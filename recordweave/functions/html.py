"""Titles, links and visible text of pages by expressions that tolerate unclosed tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordweave.functions import markup

HREF = r"""(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>"""


def title(html: Column, unknown: str = "") -> Column:
    """The title, else the first heading, else the sentinel."""
    return F.coalesce(F.nullif(markup.title(html), F.lit("")), F.lit(unknown))


def visible_text(html: Column) -> Column:
    """Text outside comments, dropped elements and tags, entities as their characters."""
    return markup.text(html)


def links(html: Column) -> Column:
    """The href of each anchor, in order."""
    return F.regexp_extract_all(html, F.lit(HREF), F.lit(1))


def resolve(href: Column, base: Column) -> Column:
    """href against its page's URL: absolute, host-relative or relative to the folder."""
    origin = F.regexp_extract(base, r"^([a-z]+://[^/?#]*)", 1)
    return F.when(href.rlike("^[a-z]+:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, "^([a-z]+:)", 1), href)).when(href.startswith("/"), F.concat(origin, href)).otherwise(F.concat(F.regexp_extract(base, r"^([a-z]+://[^?#]*/)", 1), href))
