"""Candidates resolved in two phases, and contacts sought by branches of which each sees only what the ones before left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordweave.operators import dedupe
from recordweave.shared import keep

Branch = Callable[[DataFrame], DataFrame]


def fall_through(rows: DataFrame, key: str, branches: list[tuple[str, Branch]]) -> DataFrame:
    """What the branches find for rows, and which branch (column branch): each in turn gets the rows that none before it solved.

    A branch returns rows with the key, of equal columns; what it found is kept, so that no
    branch runs again for a later one, and a row it solved never reaches the next.
    """
    left, found = rows, None
    for name, branch in branches:
        new = keep(branch(left).withColumn("branch", F.lit(name)))
        found = new if found is None else found.unionByName(new)
        left = left.join(new.select(key).distinct(), key, "left_anti")
    return found


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The first rule's reason that holds; null if none does."""
    return F.coalesce(*(F.when(cond, F.lit(reason)) for cond, reason in rules))


def resolved(results: DataFrame, reason: Column, order: str, domain: str, existing: DataFrame, sent: DataFrame) -> DataFrame:
    """results with outcome: why one is no candidate, or accepted; all domains are settled before any contact is sought.

    reason is that of the result itself, null if it may be one.  Then a domain of the
    sent(domain) or existing(domain) goes, then all but the first of each domain in order.
    """
    known = lambda table, name: table.select(F.col("domain").alias(domain)).where(F.col(domain) != "").distinct().withColumn(name, F.lit(True))
    marked = results.withColumn("_reason", reason).join(known(sent, "_sent"), domain, "left").join(known(existing, "_known"), domain, "left")
    marked = marked.withColumn("_reason", F.coalesce("_reason", first_reason((F.col("_sent"), "sent history domain"), ((F.col(domain) == "") | F.col("_known"), "missing or duplicate domain"))))
    open_ = marked.where("_reason is null")
    first = dedupe.first_by(open_.select(domain, order), [domain], [order]).select(order).withColumn("_first", F.lit(True))
    out = marked.join(first, order, "left")
    return out.withColumn("outcome", F.coalesce("_reason", F.when(F.col("_first"), "accepted").otherwise("missing or duplicate domain"))).drop("_reason", "_sent", "_known", "_first")


def pages_at(rows: DataFrame, pages: DataFrame, paths: Column, key: str = "id") -> DataFrame:
    """key, rank, page_url, html: of pages(page_key, page_url, html) those under a row's origin at its paths, in their order; what is read of a page is read after this."""
    wanted = rows.select(key, "origin", F.posexplode(paths).alias("rank", "path")).withColumn("page_key", F.concat_ws("/", "origin", "path"))
    return wanted.join(pages, "page_key").select(key, "rank", "page_url", "html")


def frontier(pages: DataFrame, seeds: DataFrame, depth: int, per_host: int) -> DataFrame:
    """page_key, host, step, place: the pages that links lead to from seeds(page_key), at most so many steps away and so many of a host.

    pages has page_key, host and links (array of page_keys).  Pages of a step are taken in
    the order in which the links to them stand (the page before, then the place in it);
    every page is visited once, at its first step; a host that is full takes no more.  Each
    step is a join of the last one's links against pages that were not visited.
    """
    slim = pages.select("page_key", "host")
    new = keep(_bounded(seeds.select("page_key").distinct().join(slim, "page_key").withColumn("from", F.lit("")).withColumn("place", F.lit(0).cast("long")), None, per_host).withColumn("step", F.lit(0)))
    visited = new
    for step in range(1, depth + 1):
        links = pages.join(new.select("page_key"), "page_key", "left_semi").select(F.col("page_key").alias("from"), F.posexplode("links").alias("place", "page_key")).withColumn("place", F.col("place").cast("long"))
        ahead = dedupe.first_by(links.join(visited.select("page_key"), "page_key", "left_anti"), ["page_key"], ["from", "place"])
        new = keep(_bounded(ahead.join(slim, "page_key"), visited, per_host).withColumn("step", F.lit(step)))
        if new.isEmpty():
            break
        visited = keep(visited.unionByName(new))
    return visited.select("page_key", "host", "step", F.row_number().over(Window.partitionBy("host").orderBy("step", "from", "place", "page_key")).alias("place"))


def _bounded(ahead: DataFrame, visited: DataFrame | None, per_host: int) -> DataFrame:
    """Of each host the first rows that its bound leaves room for."""
    ranked = ahead.withColumn("_n", F.row_number().over(Window.partitionBy("host").orderBy("from", "place", "page_key"))).where(F.col("_n") <= per_host)
    if visited is None:
        return ranked.drop("_n")
    had = visited.groupBy("host").agg(F.count("*").alias("_had"))
    return ranked.join(had, "host", "left").where(F.col("_n") + F.coalesce("_had", F.lit(0)) <= per_host).drop("_n", "_had")
