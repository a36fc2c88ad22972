"""Chains, frontiers, budgets, suffixes and claimed versions on small cases."""

import threading
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from recordweave.functions import sites
from recordweave.operators import budget, chain, dedupe
from recordweave.sources import tables

RULES = ("com", "uk", "co.uk", "*.ck", "!www.ck", "xn--85x722f.xn--55qx5d.cn", "s3.amazonaws.com")


@pytest.mark.parametrize(
    ("host", "domain"),
    [
        ("a.b.example.com", "example.com"), ("example.co.uk", "example.co.uk"), ("x.example.co.uk", "example.co.uk"), ("co.uk", ""), ("uk", ""), ("b.uk", "b.uk"), ("a.b.ck", "a.b.ck"), ("x.a.b.ck", "a.b.ck"), ("b.ck", ""), ("www.ck", "www.ck"), ("a.www.ck", "www.ck"),
        ("what.ever", "what.ever"), ("a.what.ever", "what.ever"), ("", ""), ("single", ""), ("b.s3.amazonaws.com", "b.s3.amazonaws.com"), ("s3.amazonaws.com", ""), ("amazonaws.com", "amazonaws.com"), ("www.xn--85x722f.xn--55qx5d.cn", "www.xn--85x722f.xn--55qx5d.cn"),
    ],
)
def test_registrable_domains(host, domain):
    assert sites.Suffixes(RULES).registrable(host) == domain


def test_sites_of_texts(spark):
    rows = [(1, "see HTTPS://www.Bücher.example/a). or http://user@shop.co.uk:80/x; https://1.2.3.4/ http://-bad-.example"), (2, None), (3, "")]
    d = spark.createDataFrame(rows, "i int, t string")
    rules = sites.rules_of(spark.createDataFrame([("co.uk",), (None,), ("example",), ("co.uk",), ("食狮.公司.cn",)], "rule string"))
    assert rules == ("co.uk", "example", "xn--85x722f.xn--55qx5d.cn")
    got = {r.i: [tuple(u) for u in r.u] for r in d.select("i", sites.of(F.col("t"), rules).alias("u")).collect()}
    assert got == {1: [("HTTPS://www.Bücher.example/a", "xn--bcher-kva.example", "xn--bcher-kva.example"), ("http://user@shop.co.uk:80/x", "shop.co.uk", "shop.co.uk"), ("https://1.2.3.4/", "", ""), ("http://-bad-.example", "", "")], 2: [], 3: []}


def test_each_branch_sees_what_is_left(spark):
    seen = []

    def branch(good):
        def run(left):
            seen.append(sorted(r.id for r in left.collect()))
            return left.where(F.col("id").isin(good)).select("id", F.lit(good[0]).alias("found"))

        return run

    got = chain.fall_through(spark.range(6), "id", [("a", branch([1, 2])), ("b", branch([2, 3])), ("c", branch([9])), ("d", branch([5]))])
    assert seen == [[0, 1, 2, 3, 4, 5], [0, 3, 4, 5], [0, 4, 5], [0, 4, 5]]
    assert sorted(map(tuple, got.collect())) == [(1, 1, "a"), (2, 1, "a"), (3, 2, "b"), (5, 5, "d")]


def test_domains_are_settled_before_contacts(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "s", None), (4, "k", None), (5, "", None), (6, "b", "odd"), (7, "b", None)], "id long, d string, why string")
    known = lambda *d: spark.createDataFrame([(x,) for x in d], "domain string")
    got = chain.resolved(rows, F.col("why"), "id", "d", known("k", "k", ""), known("s"))
    assert {r.id: r.outcome for r in got.collect()} == {1: "accepted", 2: "missing or duplicate domain", 3: "sent history domain", 4: "missing or duplicate domain", 5: "missing or duplicate domain", 6: "odd", 7: "accepted"}


@pytest.mark.parametrize(("depth", "per_host"), [(0, 3), (1, 2), (3, 3), (9, 50)])
def test_frontier_equals_a_walk(spark, depth, per_host):
    import random

    rng = random.Random(depth)
    pages = [(f"p{k:02}", f"h{k % 4}", [f"p{rng.randrange(45):02}" for _ in range(rng.randrange(6))]) for k in range(40)]
    seeds, host, links = ["p00", "p01", "p02"], {p: h for p, h, _ in pages}, {p: x for p, _, x in pages}
    taken, step, had = [(p, 0) for p in seeds], seeds, defaultdict(int)
    for p in seeds:
        had[host[p]] += 1
    for n in range(1, depth + 1):
        ahead = {}
        for p in sorted(step):
            for place, x in enumerate(links[p]):
                if x in host and x not in {t for t, _ in taken}:
                    ahead.setdefault(x, (p, place, x))
        step, room = [], dict(had)
        for x in sorted(ahead, key=ahead.get):
            if room.get(host[x], 0) < per_host:
                room[host[x]] = room.get(host[x], 0) + 1
                step.append(x)
        had.update(room)
        taken += [(x, n) for x in step]
    got = chain.frontier(spark.createDataFrame(pages, "page_key string, host string, links array<string>"), spark.createDataFrame([(s,) for s in seeds], "page_key string"), depth, per_host)
    assert sorted((r.page_key, r.step) for r in got.collect()) == sorted(taken)


def test_a_running_total_is_carried_over_ranges(spark):
    rows = [(None if k == 7 else k * 37 % 101, k, k % 5 or None) for k in range(101)]
    d = spark.createDataFrame(rows, "a int, b int, c int").repartition(9)
    want, spent = {}, 0
    for a, b, c in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        spent += c or 0
        want[b] = spent
    assert {r.b: r.spent for r in budget.running_total(d, ["a", "b"], F.col("c")).collect()} == want
    assert {r.b for r in budget.within_budget(d, ["a", "b"], F.col("c"), 60).where("allowed").collect()} == {b for b, s in want.items() if s <= 60}
    assert budget.running_total(d.limit(0), ["a", "b"], F.col("c")).collect() == []


def test_two_writers_get_two_versions(spark, tmp_path):
    folder, got = f"file://{tmp_path}/t", []
    frames = [spark.range(50).withColumn("w", F.lit(k)) for k in range(4)]
    threads = [threading.Thread(target=lambda d=d: got.append(tables.replace(d, folder))) for d in frames]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(got) == [1, 2, 3, 4] == tables.versions(spark, folder)
    for v in got:
        assert tables.read(spark, folder, v).count() == 50 and tables.read(spark, folder, v).select("w").distinct().count() == 1


def test_columns_are_added_and_rows_replaced_by_key(spark, tmp_path):
    folder = f"file://{tmp_path}/s"
    assert tables.ensure(spark, folder, {"id": F.lit(None).cast("long"), "a": F.lit("")}) == 1 and tables.read(spark, folder).columns == ["id", "a"]
    assert tables.upsert(spark.createDataFrame([(1, "x"), (2, "y"), (None, "n")], "id long, a string"), folder, ["id"]) == 2
    assert tables.ensure(spark, folder, {"a": F.lit("?")}) == 2
    assert tables.ensure(spark, folder, {"a": F.lit("?"), "b": F.upper("a")}) == 3
    tables.upsert(spark.createDataFrame([(2, "z", 1.5), (None, "m", 2.5), (4, "w", None)], "id long, a string, more double"), folder, ["id"])
    got = sorted(map(tuple, tables.read(spark, folder).select("id", "a", "b", "more").collect()), key=repr)
    assert got == sorted([(1, "x", "X", None), (2, "z", None, 1.5), (None, "m", None, 2.5), (4, "w", None, None)], key=repr)
    assert tables.upsert(spark.range(1).select("id"), folder, ["id"], dry_run=True) == 1 and tables.versions(spark, folder)[-1] == 4


def test_greedy_keeps_a_long_chain_right(spark):
    rows = [(k, f"x{k // 2}", f"y{(k + 1) // 2}") for k in range(14)]
    got = sorted(r.p for r in dedupe.greedy(spark.createDataFrame(rows, "p int, a string, b string"), "p", ["a", "b"]).collect())
    taken, keys = [], set()
    for p, a, b in rows:
        if not {a, b} & keys:
            taken.append(p)
            keys |= {a, b}
    assert got == taken
