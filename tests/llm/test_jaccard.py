"""The Jaccard join against comparing every pair of texts, and its SQL."""

import random

import numpy as np
import oracle
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recordweave.llm import jaccard, queries
from recordweave.llm.common import read


def plain(rows, width=5, num=4, den=5):
    """(doc_id, shingles, smallest doc_id reachable) of each row, by comparing every pair of different sets."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        k = min(width, len(w))
        sets.append(frozenset(tuple(w[a : a + k]) for a in range(len(w) - k + 1)) if w else frozenset())
    distinct = sorted(set(sets) - {frozenset()}, key=len)
    up = {s: s for s in distinct}

    def root(s):
        while up[s] != s:
            up[s] = up[up[s]]
            s = up[s]
        return s

    for n, x in enumerate(distinct):
        for y in distinct[n + 1 :]:
            if den * len(x) < num * len(y):
                break
            if den * len(x & y) >= num * len(x | y):
                up[root(x)] = root(y)
    least = {}
    for (i, _), s in zip(rows, sets, strict=True):
        if s and i is not None:
            least[root(s)] = min(i, least.get(root(s), i))
    return sorted(((i, len(s), least.get(root(s)) if s else i) for (i, _), s in zip(rows, sets, strict=True)), key=repr)


def made(seed=5):
    """Copies, near copies on both sides of the threshold, chains, common passages in short texts, odd texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    passage, base, out = [word() for _ in range(60)], [word() for _ in range(150)], []
    for i in range(80):
        out.append(passage + [word() for _ in range(rng.choice((3, 5, 8, 12, 16, 80)))])
        out.append([word() for _ in range(rng.choice((3, 6, 9)))] + passage)
        t = list(base)
        for _ in range(rng.choice((1, 2, 3, 5, 9))):
            t[rng.randrange(150)] = word()
        out.append(t)
    for _ in range(30):
        out.append(base[: rng.randrange(100, 150)])
    for n in range(5, 40):
        out.append([f"x{k}" for k in range(n)])
        out.append([f"y{k % 7}" for k in range(n)])
    texts = [" ".join(t) for t in out] + ["", " \t", "a b", "A  b", "a b c d e f", "a b c d e g", "a b c d e", None, "É a b c d e", "é a b c d e", "a\x0bb c d e", "one\xa0word"]
    rows = [(i, t) for i, t in enumerate(texts)]
    return [*rows, *rows[:20], (None, rows[0][1]), (None, "only here and without an id at all"), (3, "another text of this id here"), (-5, rows[4][1]), (10**15, "q " * 30_000)]


def shown(frame):
    return sorted(((r.doc_id, r.n, r.component_id) for r in frame.collect()), key=repr)


@pytest.mark.parametrize(("width", "least", "crowd"), [(5, (4, 5), 4096), (5, (4, 5), 8), (1, (1, 2), 4), (3, (9, 10), 2)])
def test_equals_all_pairs(spark, width, least, crowd):
    rows = made()
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("n", F.lit("x")).withColumn("node", F.lit(None).cast("int")).withColumn("data", F.lit(1))
    assert shown(jaccard.near_copies(frame, width, least, crowd=crowd)) == plain(rows, width, *least)


def test_proposals_change_no_link(spark, sf):
    rows = [*((r.doc_id + 10**6, r.text) for r in read(spark, sf, "documents").collect()), *made(7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = plain(rows)
    assert sum(i != c for i, _, c in want) > 100
    assert shown(jaccard.near_copies(frame, bits=4)) == shown(jaccard.near_copies(frame)) == want


def test_a_crowded_shingle_is_compared_part_by_part(spark, monkeypatch):
    """Hundreds of texts share a passage and are chained by their other halves; chance neighbours are left out."""
    monkeypatch.setattr(jaccard, "_one_each", lambda pairs: pairs.limit(0))
    rng = random.Random(2)
    passage = [f"p{k}" for k in range(40)]
    rows = [(i, " ".join([*passage, *(f"t{i // 3}-{k}" for k in range(30)), *(f"u{rng.randrange(9)}" for _ in range(3))])) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain(rows)
    assert 90 < len({c for _, _, c in want}) < 250
    assert shown(jaccard.near_copies(frame, crowd=10)) == want


def test_one_large_group_is_not_paired_in_full(spark, monkeypatch):
    """The last comparison, of all pairs that are left, finds near copies joined already."""
    rng, made = random.Random(4), []
    base = [f"b{k}" for k in range(100)]
    rows = [(i, " ".join(f"x{rng.randrange(10**6)}" if k in changed else w for k, w in enumerate(base))) for i in range(500) for changed in [rng.sample(range(100), 1)]]
    linked = jaccard._linked

    def counted(*args):
        out = linked(*args)
        if args[4] == 0 and args[5:] in ((), (False,)):
            made.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "_linked", counted)
    assert shown(jaccard.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == plain(rows)
    assert len(made) == 1 and made[0] < 10 * len(rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.near_copies(none).collect() == []
    empty = [(1, None), (2, ""), (None, " \n"), (2, "")]
    assert shown(jaccard.near_copies(spark.createDataFrame(empty, "doc_id long, text string"))) == plain(empty)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_same_rows_as_sql(spark, folder):
    got = queries.op11_jaccard_join(spark, folder)
    assert oracle.difference(got, queries.ORACLE_SQL["op11_jaccard_join"], oracle.connect(folder)) == ""


def test_large_sets_that_differ_are_told_apart_without_being_fetched(spark, monkeypatch):
    """Long texts share two thirds of their shingles, too few; sketches of 512 bits can't tell, marks can."""
    rng, asked = random.Random(6), []
    passage = [f"p{k}" for k in range(1200)]
    rows = [(i, " ".join([*passage, *(f"t{i}-{rng.randrange(10**6)}" for _ in range(300))])) for i in range(20)]
    within = jaccard.within

    def counted(docs, ids):
        asked.append(ids.count())
        return within(docs, ids)

    monkeypatch.setattr(jaccard, "within", counted)
    got = shown(jaccard.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    assert [(i, c) for i, _, c in got] == [(i, i) for i in sorted(range(20), key=repr)]
    assert asked and not sum(asked)


def test_marks_bound_how_many_shingles_differ():
    rng = np.random.default_rng(3)
    for n, m in ((1, 2), (400, 500), (1000, 1100), (3000, 2500), (5000, 4000)):
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[: n // 2], rng.integers(0, 2**63, m - n // 2).astype(np.uint64)]))
        differ = len(np.setxor1d(x, y))
        assert differ // 4 < jaccard.apart(jaccard.mark(x), jaccard.mark(y)) <= differ
        assert jaccard.apart(jaccard.mark(x), jaccard.mark(x)) == 0


@pytest.mark.parametrize("width", [1, 3, 5])
def test_shingles_of_whole_batches_are_those_of_each_text(width):
    rng = random.Random(2)
    long = ["x" * 513, "X" * 513 + " y", "x" * 512 + "y", "abcdefgh", "abcdefghi", "abcdefgh\0", "a\0", "a", "", " \t"]
    texts = [*long, *("".join(rng.choice("aB \n\0\x85éA ") for _ in range(rng.randrange(40))) for _ in range(800))]
    h, before = jaccard.Shingles(width).all(pa.array(texts))
    name, text = {}, {}
    for t, a, b in zip(texts, before, before[1:], strict=False):
        w = t.encode().lower().split()
        k = min(width, len(w))
        want = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if w else []
        assert len(want) == b - a
        assert all(name.setdefault(x, y) == y and text.setdefault(y, x) == x for x, y in zip(h[a:b].tolist(), want, strict=True))
        assert (jaccard.Shingles(width).set(t) == np.unique(h[a:b])).all()


@pytest.mark.parametrize("again", [False, True])
def test_no_set_is_shuffled_for_copies_and_repeated_rows(spark, monkeypatch, again):
    """Bits of copies' rows may be set as well; here all are."""
    plans, fresh = [], jaccard.fresh
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    monkeypatch.setattr(jaccard, "fresh", lambda df, *parts: fresh(plan(df), *parts))
    monkeypatch.setattr(jaccard, "bit_set", lambda *_: np.full(1 << 20, ~np.uint64(0)))
    texts = [" ".join(f"w{n * k % 89}" for k in range(1, 30)) for n in range(1, 21)]
    rows = [(i, texts[i % 20]) for i in reversed(range(100))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    docs = docs.unionByName(docs) if again else docs
    want = {jaccard.digest(s): s.view(np.int64).tolist() for s in map(jaccard.Shingles(5).set, texts)}
    wanted = spark.createDataFrame([(jaccard.digest(jaccard.Shingles(5).set(t)), i) for i, t in enumerate(texts)], "node long, rep long")
    got = plan(jaccard.sets(docs, 5, wanted)).collect()
    assert len(got) == 20 and {r.node: r.s for r in got} == want
    assert not any("hashpartitioning" in p for p in plans)
