"""The pipeline's near copies against all pairs of five-word shingle sets."""

import random

import corpus_pipeline
from recordweave.llm.common import read


def plain_groups(rows, width=5):
    """doc_id -> smallest doc_id reachable, by comparing every pair."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        k = min(width, len(w))
        sets[i] = frozenset(tuple(w[a : a + k]) for a in range(len(w) - k + 1)) if w else frozenset()
    ids = sorted(sets)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x == y or 9 * len(x & y) >= 4 * (len(x) + len(y)) > 0:
                low, high = sorted((root(a), root(b)))
                up[high] = low
    return {i: root(i) for i in ids}


def made():
    """Copies with few changed words, chains, a shared passage, short and empty texts."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    passage, base, out = [word() for _ in range(60)], [word() for _ in range(150)], []
    for i in range(60):
        out.append(passage + [word() for _ in range(rng.choice((5, 12, 16, 80)))])
        t = list(base)
        for _ in range(rng.choice((1, 2, 3, 5, 9))):
            t[rng.randrange(150)] = word()
        out.append(t)
    for _ in range(20):
        out.append(base[: rng.randrange(100, 150)])
    texts = [" ".join(t) for t in out] + ["", " \t", "a b", "A  b", "a b c d e f", "a b c d e g", "a b c d e", None]
    return [(i, t) for i, t in enumerate(texts)]


def test_near_dedup_equals_all_pairs(spark, sf):
    docs = [*((r.doc_id + 1000, r.text) for r in read(spark, sf, "documents").collect()), *made()]
    random.Random(1).shuffle(docs)
    want = plain_groups(docs)
    assert sum(i != g for i, g in want.items()) > 40
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    kept = corpus_pipeline.near_dedup(spark, frame, sf)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_rows_of_no_or_repeated_id_and_empty_tables(spark, sf):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id or 0) for r in corpus_pipeline.near_dedup(spark, frame, sf).collect())) == [0, 0, 1]
    assert corpus_pipeline.near_dedup(spark, frame.limit(0), sf).count() == 0
