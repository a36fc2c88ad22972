"""Vector searches, WARC archives, components and the pipeline."""

import base64
import collections
import hashlib
import random
import zlib

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recordweave.llm import ann, pii, queries, topk, warc
from recordweave.llm.common import new_folder, read, tokenizer_path
from recordweave.llm.components import components


@pytest.fixture(scope="module")
def vectors(spark, sf):
    """All vectors, unusable ones, and many copies of one."""
    e = read(spark, sf, "embeddings").select("vec_id", "embedding")
    first = e.orderBy("vec_id").first().embedding
    odd = [(70_000, None), (70_050, [0.0] * 64), (70_100, [float("nan")] * 64), (70_150, [1.0, None] * 32), (70_200, [1.0]), (None, first), *((80_000 + i, first) for i in range(120))]
    return e.unionByName(spark.createDataFrame(odd, "vec_id long, embedding array<float>")).withColumn("score", F.lit("clash"))


def usable(vectors):
    rows = [(r.vec_id, r.embedding) for r in vectors.collect() if r.vec_id is not None and r.embedding and len(r.embedding) == 64 and None not in r.embedding]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return ids[good], x[good]


def test_ann_recall_and_scores(vectors):
    got = collections.defaultdict(list)
    for r in ann.nearest(vectors).orderBy("rank").collect():
        got[r.query_id].append(r)
    ids, x = usable(vectors)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert set(got) == set(ids[ids % 50 == 0].tolist())
    hit = 0
    for q, rows in got.items():
        s = x @ x[ids == q][0]
        s[ids == q] = -9
        s = s.round(12)
        assert [r.rank for r in rows] == [1, 2, 3, 4, 5] and q not in [r.vec_id for r in rows]
        assert all(abs(r.score - s[ids == r.vec_id][0]) < 1e-9 for r in rows)
        hit += len({r.vec_id for r in rows} & set(ids[np.lexsort((ids, -s))[:5]].tolist()))
    assert hit >= 0.9 * 5 * len(got)


def test_hamming_equals_brute_force(vectors):
    got = collections.defaultdict(list)
    for r in topk.nearest_codes(topk.codes_of(vectors.where("size(embedding) = 64"))).orderBy("rank").collect():
        got[r.query_id].append((r.distance, r.vec_id))
    ids, x = usable(vectors)
    for q in ids[ids % 100 == 0].tolist():
        d = ((x > 0) != (x[ids == q][0] > 0)).sum(1)
        d[ids == q] = 99
        assert got[q] == [(d[i], ids[i]) for i in np.lexsort((ids, d))[:10]]


def test_hamming_equals_sql(spark, sf):
    assert oracle.difference(queries.op6_hamming_topk(spark, sf), queries.ORACLE_SQL["op6_hamming_topk"], oracle.connect(sf)) == ""


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.rank) for r in ann.nearest(few).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert [(r.vec_id, r.rank) for r in topk.nearest_codes(topk.codes_of(few)).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert ann.nearest(few.limit(0)).count() == 0 and topk.nearest_codes(topk.codes_of(few.limit(0))).count() == 0


def test_warc_round_trip(spark, sf):
    odd = [(90_001, None, None), (90_002, "http://a b\n", ""), (90_003, "x", "é"), (90_004, "x", "é"), (90_004, "x", "é"), (None, "q", "é"), (None, "q", "only")]
    pages = read(spark, sf, "pages").select("page_id", "url", "html").unionByName(spark.createDataFrame(odd, "page_id long, url string, html string")).withColumn("digest", F.lit("clash"))
    folder, again = new_folder(spark, "warc"), new_folder(spark, "warc")
    one = warc.write_warc(pages, folder, shard_bytes=60_000, file_bytes=10_000).collect()
    assert sorted(one) == sorted(warc.write_warc(pages.repartition(3), again, shard_bytes=60_000, file_bytes=10_000).collect()) and len(one) > 3
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    top = {}
    for i, b in rows:
        if i is not None:
            top[b] = max(top.get(b, i), i)
    want = collections.Counter((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if top.get(b, i) == i else "revisit", None if top.get(b, i) == i else top[b]) for i, b in rows)
    got = warc.read_warc(spark, folder).collect()
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert all(r.payload == dict(rows)[r.page_id] for r in got if r.record_type == "response" and r.page_id is not None)
    assert warc.write_warc(pages.limit(0), new_folder(spark, "warc")).count() == 0


@pytest.mark.parametrize("few", [0, 200_000])
def test_components_of_paths_and_stars(spark, monkeypatch, few):
    monkeypatch.setattr("recordweave.llm.components.FEW", few)
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(500, 500), (None, 1)]
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in list(up)}


def test_ann_prunes_clustered_vectors(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((150, 24))[rng.integers(0, 150, 12_000)] + 0.2 * rng.standard_normal((12_000, 24))
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    shares, plain = [], ann.budget_share
    monkeypatch.setattr(ann, "budget_share", lambda *a: shares.append(plain(*a)) or shares[-1])
    got = collections.defaultdict(set)
    for r in ann.nearest(frame).collect():
        got[r.query_id].add(r.vec_id)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for i in range(0, 12_000, 50):
        s = x @ x[i]
        s[i] = -9
        hit += len(got[i] & set(np.argpartition(-s, 5)[:5].tolist()))
    assert shares[0] < 0.5 and hit >= 0.9 * 5 * 240


def test_warc_shards_of_outlying_null_and_negative_ids(spark):
    rows = [(i, "u", hashlib.sha256(str(i).encode()).hexdigest()) for i in range(3000)] + [(2**60, "u", "x"), (-(2**62), "u", "x"), (2**62, "v", "y")] + [(None, "u", str(i) * 9) for i in range(1500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = new_folder(spark, "warc")
    per = collections.Counter()
    for r in warc.write_warc(pages, folder, shard_bytes=200_000, file_bytes=50_000).collect():
        per[r.shard] += r.records
    assert len(per) > 8 and sum(per.values()) == len(rows) and max(per.values()) < 2 * len(rows) / len(per)
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.read_warc(spark, folder, payloads=False).where("page_id is not null").collect()}
    assert got[-(2**62)] == ("revisit", 2**60) and got[2**60] == ("response", None) and len(got) == 3003


def test_pipeline_equals_plain_python(spark, sf):
    """Junk goes, groups are those of all pairs, no base span stays, and pieces are the library's ids without a gap."""
    from test_near_copies import plain_groups
    from tokenizers import Tokenizer

    junk = {9_000_001: "xqzt wvkj pqrx zzkf jjqw", 9_000_002: "日本語のテキストです、これは文です", 9_000_003: "Это русский текст о погоде и людях", 9_000_004: None, 9_000_005: " 123 "}
    docs = read(spark, sf, "documents")
    first = docs.first()
    more = [(i, t, None, "s", 0) for i, t in junk.items()] + [(None, first.text, None, None, None), (first.doc_id, first.text, first.lang, first.source, first.n_chars)]
    frames = [docs.unionByName(spark.createDataFrame(more, docs.schema)).withColumn("key", F.lit("clash"))]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "redact_pii", "pack"]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(spark.createDataFrame(stage(spark, frames[-1], sf).toArrow()))
    assert all(f.columns == frames[0].columns for f in frames[:-1])
    rows = [[(r.doc_id, r.text) for r in f.select("doc_id", "text").collect()] for f in frames[1:4]]
    ids = [sorted(-1 if i is None else i for i, _ in x) for x in rows]
    assert ids[0] == sorted([r.doc_id for r in docs.select("doc_id").collect()] + [-1, first.doc_id])
    want = plain_groups([x for x in rows[0] if x[0] is not None])
    assert ids[1] == ids[2] == sorted([*{*want.values()}, -1])
    assert frames[3].where(F.col("text").rlike(pii.EMAIL)).count() == 0
    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    pieces, at = collections.defaultdict(dict), {}
    for r in frames[4].collect():
        pieces[r.doc_id][r.start] = (r.length, r.ids_crc32, r.doc_tokens)
        assert at.setdefault((r.sequence_id, r.offset), r.length) == r.length
    for i, text in rows[2]:
        ids, done = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for start, (n, crc, total) in sorted(pieces[i].items()):
            assert start == done and total == len(ids) and zlib.crc32(ids[start : start + n].tobytes()) == crc
            done += n
        assert done == len(ids)


def test_pipeline_of_an_empty_table(spark, sf):
    docs = read(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
