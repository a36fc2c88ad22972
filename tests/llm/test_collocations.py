"""Collocations against counting every phrase, and their SQL."""

import collections
import random
import re

import oracle
import pytest
from pyspark.sql import functions as F

from recordweave.llm import collocations, queries
from recordweave.llm.common import read


def plain(rows, top=2000, least=100):
    """The rows by counting all phrases of one to five words of each language."""
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = set()
        for p, a in candidates.items():
            inside.update(p[i : i + k] for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 100 * c[p[i : i + k]])
        found = []
        for p, a in candidates.items():
            if p not in inside:
                score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def made(seed=1, texts=120):
    rng = random.Random(seed)
    common, rare = [f"c{i}" for i in range(6)], [f"r{i}" for i in range(60)]
    fixed = [["new", "york", "city"], ["in", "the", "sense", "of", "it"], ["a", "b"], ["A", "b", "a", "b", "a"], ["l1", "l2", "l3", "l4", "l5", "l6", "l7"]]
    rows = []
    for i in range(texts):
        words = []
        for _ in range(rng.randrange(60)):
            kind = rng.random()
            words += rng.choice(fixed) if kind < 0.15 else [rng.choice(rare) if kind < 0.4 else rng.choice(common)]
            if rng.random() < 0.1:
                words[-1] += rng.choice([".", ", ", "\n", "!", " ", "\t", " - "])
        rows.append((rng.choice(["en", "en", "fr", None]), " ".join(words)))
    return [*rows, ("en", None), ("en", ""), ("xx", "one two"), ("en", "the the the the the the the " * 5), ("fr", "É é Ž ž " * 9), ("a\x00b", "x y " * 20), *[("en", "same words here, same words here")] * 9]


@pytest.mark.parametrize(("top", "least", "beam"), [(2000, 5, 4096), (10, 5, 2), (3, 3, 1), (1, 2, 5), (25, 8, 3)])
def test_equals_counting_every_phrase(spark, top, least, beam):
    rows = made()
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(4).withColumn("a", F.lit("x")).withColumn("rank", F.lit(None).cast("int")).withColumn("w", F.lit(1))
    got = collocations.collocations(frame, top=top, least=least, beam=beam)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, top, least)


def test_several_rounds_are_needed_and_stop_early(spark, monkeypatch):
    rows, passes = made(2, 200), []
    count = collocations.phrase_counts
    monkeypatch.setattr(collocations, "phrase_counts", lambda *a: passes.append(1) or count(*a))
    frame = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in collocations.collocations(frame, top=4, least=3, beam=8).collect()) == plain(rows, 4, 3)
    assert 1 < len(passes) < 6


def test_products_beyond_64_bits(spark):
    a, n, left, right = 10**12, 10**13, 10**12 + 7, 10**12 + 9
    row = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long")
    assert row.select(collocations._floor_score("a", "n", "l", "r")).first()[0] == 1000 * a * n // (left * right)


def test_empty_table_and_tables_without_phrases(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    few = spark.createDataFrame([("en", "a. b. c"), (None, None)], "lang string, text string")
    assert collocations.collocations(few, least=1).collect() == []


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_same_rows_as_sql_and_as_counting(spark, folder):
    got = queries.op12_collocations(spark, folder)
    assert oracle.difference(got, queries.ORACLE_SQL["op12_collocations"], oracle.connect(folder)) == ""
    if folder.endswith("0.001"):
        assert sorted(tuple(r) for r in got.collect()) == plain([(r.lang, r.text) for r in read(spark, folder, "documents").select("lang", "text").collect()])
