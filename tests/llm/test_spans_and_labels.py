"""Language identification, chains and personal data."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recordweave.llm import chain, chunks, langid, pii, queries
from recordweave.llm.common import read


def test_chain_equals_enumeration_and_any_step(monkeypatch):
    rng = np.random.default_rng(0)
    e, start, move = rng.random((4, 3)), rng.random(3), rng.random((3, 3))
    c = chain.Chains(e, np.array([4]), start, move)
    total, p = 0.0, np.zeros((4, 3))
    for s in itertools.product(range(3), repeat=4):
        w = start[s[0]] * e[0, s[0]] * np.prod([move[s[t - 1], s[t]] * e[t, s[t]] for t in range(1, 4)])
        total += w
        for t in range(4):
            p[t, s[t]] += w
    assert abs(c.forward()[0] - np.log(total)) < 1e-12 and np.abs(c.backward() - p / total).max() < 1e-12
    lengths = np.array([1, 5, 70, 150, 2, 51])
    e = rng.random((lengths.sum(), 3))
    out = []
    for step in (7, 50, 5000):
        monkeypatch.setattr(chain, "STEP", step)
        c = chain.Chains(e, lengths, start, move)
        out.append((c.forward(), c.backward(), c.pairs()))
    for other in out[1:]:
        assert all(np.abs(a - b).max() < 1e-9 for a, b in zip(out[0], other, strict=True))


def test_language_on_held_out_documents(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    odd = spark.createDataFrame([(90001, None, "en"), (90002, "", None), (90003, "123 !! ½²", "fr"), (None, "und der die das nicht", None)], "doc_id long, text string, lang string")
    got = langid.identify(docs.select("doc_id", "text", "lang").unionByName(odd)).join(docs.select("doc_id", "lang"), "doc_id", "left").collect()
    held = [r for r in got if r.held_out and r.lang]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert [by[i] for i in (90001, 90002, 90003)] == [("und", 0.0)] * 3 and by[None][0] == "de" and len(got) == docs.count() + 4
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)


def test_words_of_whole_batches_are_those_of_each_text(monkeypatch):
    """A chunk is read and weighed once for a batch, however often it comes; sigma, ligatures and fractions as in whole texts."""
    rng = random.Random(3)
    some = ["the", "Cat", "der", "Hund", "é", "İx", "ß", "ΟΔΟΣ", "a'Σ", "Σ'a", "½", "²", "_", " ", "\n", "\xa0", ", ", ".", "7", "“", "\x1f", "x" * 90]
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(20))) for _ in range(3000)]
    for part in (texts, [t for t in texts if "Σ" not in t]):
        words, at, before = chunks.letters(pa.array(["before", *part, ""]).slice(1))
        lists = list(map(langid._real, words))
        got = [[w for i in at[a:b] for w in lists[i]] for a, b in itertools.pairwise(before)]
        assert got == [[w for w in langid.words_of(t) if any(map(str.isalpha, w))] for t in [*part, ""]]
    m = langid.fit(["the cat and the dog of this house"] * 4 + ["der hund und die katze in dem haus"] * 4, ["en"] * 4 + ["de"] * 4)
    weighed = []
    monkeypatch.setattr(langid, "_grams", lambda words, plain=langid._grams: weighed.extend(words) or plain(words))
    langid._labelled(m, pa.array(["der Hund, der. Hund; (der) Hund! the 'der' hund-der"] * 3), langid._table(m), 100)
    assert sorted(weighed) == ["der", "hund", "hund", "the"]


def test_a_words_features_are_added_up_once_and_familiarity_only_if_asked_for():
    m = langid.fit(["the cat and the dog of this house"] * 4 + ["der hund und die katze in dem haus"] * 4, ["en"] * 4 + ["de"] * 4)
    some = ["der", "Hund", "xyzzy", "é", "a½b", "½", "Σ'a"]
    words = [w for x in map(langid._real, some) for w in x]
    assert langid._reals(some)[0] == words and langid._reals(some)[1].tolist() == [0, 1, 2, 3, 4, 5, 5, 7]
    grams = langid._grams(words)
    want = langid._even(m.scores(grams, m.held(words))).astype("f4"), m.familiar(grams, len(words)).astype("f4")
    made = [langid._table(m, familiar).look(some) for familiar in (True, False)]
    both, alone = (np.frombuffer(b"".join(map(look, some)), "f4").reshape(len(words), -1) for look in made)
    assert (both == np.hstack(want)).all() and (alone == want[0]).all()


def test_code_switched_words_keep_their_language():
    m = langid.fit(["the cat and the dog of this house"] * 4 + ["der hund und die katze in dem haus"] * 4, ["en"] * 4 + ["de"] * 4)
    words = "the dog and the cat und der hund in dem haus".split()
    c = chain.Chains(langid._even(m.scores(langid._grams(words), m.held(words))), np.array([len(words)]), np.exp(m.start), np.exp(m.move))
    c.forward()
    assert [m.labels[i] for i in c.backward().argmax(1)] == ["en"] * 5 + ["de"] * 6


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    assert langid.identify(docs).first().lang_pred == "und" and langid.identify(docs.limit(0)).count() == 0
    assert pii.find_pii(docs.limit(0)).count() == 0


KINDS = ["email", "ip", "card", "phone"]


def base(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for k, p in enumerate([r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if (True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(d) <= 19 and luhn(d), 9 <= len(d) <= 15)[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@pytest.fixture(scope="module")
def private(spark, sf):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab@.+-_%1234567890 .-() é😀") for _ in range(rng.randrange(300))) for _ in range(300)]
    texts += ["a@b.co+c@d.ef x@y..z q@w.e.r-t_u", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.00255", "4111 1111-1111 1111 41111111111111112", "é +1 (743) 555-3824 or (743) 555-3824", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "a" * 50_000 + "@b.c", "1 " * 30_000, "1.2.3.4 " * 2000, ""]
    return spark.createDataFrame([*((i + 90_000, t) for i, t in enumerate(texts)), (99_999, None), (None, "a@b.cd"), (None, "a@b.cd")], "doc_id long, text string").unionByName(read(spark, sf, "documents").select("doc_id", "text")).withColumn("spans", F.lit("clash"))


def test_base_spans_and_digest(private, spark, tmp_path):
    private.write.parquet(f"{tmp_path}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in private.collect()}
    got = queries.op4_pii(spark, str(tmp_path)).collect()
    assert len(got) == private.count()
    for r in got:
        want = base(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in want).encode()).hexdigest()
        assert {f"{KINDS[k]}:{a}:{b}" for a, k, b in want} <= set(r.spans.split(",")) | {""}


def test_more_spans_and_redaction(private):
    model = pii.train(private)
    one = {r.doc_id: r.j for r in pii.find_pii(private.where("doc_id between 90303 and 90304"), model).select("doc_id", pii.joined(F.col("spans")).alias("j")).collect()}
    assert one[90303] == "phone:2:19,phone:23:37" and one[90304] == "secret:9:49"
    clean = {r.doc_id: r.text for r in pii.redact(private.where("doc_id is null or doc_id in (90303, 90304, 99999)"), model).collect()}
    assert clean == {90303: "é [PHONE] or [PHONE]", 90304: 'token = "[SECRET]"', 99999: None, None: "[EMAIL]"}


def test_secrets_of_any_length_go_as_a_whole(private, spark):
    model = pii.train(private)
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    docs = spark.createDataFrame([(n, f"api_key = {(key * n)[: 40 * n - n]} end") for n in (1, 3, 4, 7, 11, 5000)], "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.redact(docs.where("doc_id > 0"), model).collect()}
    assert clean == dict.fromkeys((1, 3, 4, 7, 11, 5000), "api_key = [SECRET] end")


def test_languages_never_learned_are_rejected_and_the_learned_kept(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    foreign = ["La casa è molto bella e il giardino è pieno di fiori profumati", "O rapaz não gosta de comer feijão porque acha que não é saboroso", "De kinderen spelen graag buiten in de tuin wanneer het mooi weer is", "AAAA BBBB CCCC", "Dom jest bardzo piękny a ogród pełen jest kwiatów", "Привет мир", "xqzj wvkp zzzq"]
    model, least = langid.learn(docs.select("text", "lang", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).alias("held")))
    assert langid.keep(spark.createDataFrame([(-i, t, "en") for i, t in enumerate(foreign)], "doc_id long, text string, lang string"), model, least).count() == 0
    labelled = docs.where("lang is not null and text is not null")
    assert langid.keep(labelled, model, least).count() >= 0.99 * labelled.count()


def test_a_text_of_many_matches_takes_seconds(private, spark):
    import time

    model = pii.train(private)
    n = 40_000
    docs = spark.createDataFrame([(1, "é a@b.co " * n), (2, "123-45-6789 a@b.co " * (n // 2)), (3, "x" * 300_000)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in pii.find_pii(docs, model).select("doc_id", F.size("spans").alias("n"), F.element_at("spans", -1).alias("last")).where("doc_id < 3").collect()}
    assert got[1].n == n and (got[1].last.start, got[1].last.end) == (9 * n - 7, 9 * n - 1) and got[2].n >= n // 2
    assert pii.redact(docs.where("doc_id = 1"), model).first().text == "é [EMAIL] " * n
    assert time.time() - began < 100


def test_copies_take_one_place_of_the_sample(spark):
    rows = [(i, f"the cat and the dog number {chr(97 + i % 26)}{chr(97 + i // 26)} went out", "en") for i in range(400)] + [(1000 + i, "der hund und die katze gehen aus dem haus", "de") for i in range(4000)]
    assert langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string")).labels == ["de", "en"]


def test_every_labelled_text_teaches(spark):
    """200 texts a language, each with a word of its own: a sample of them leaves words that nothing is known of."""
    rng = random.Random(7)
    own = [["".join(rng.choice(letters) for _ in range(7)) for _ in range(200)] for letters in ("abcdefgh", "pqrstuvw")]
    rows = [(f"{w} {w}", lang, False) for lang, words in zip(("xx", "yy"), own, strict=True) for w in words]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string, held boolean").select("text", "lang"))
    assert set(model.lexicon) == {*own[0], *own[1]}
    asked = spark.createDataFrame([(i, w) for i, w in enumerate(own[0] + own[1])], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(asked, model).collect()}
    assert all(got[i].lang_pred == ("xx" if i < 200 else "yy") and got[i].familiarity > 0.9 for i in range(400))


def test_thresholds_come_from_all_held_out_texts(spark):
    """One in 50 held-out texts is half foreign to its language, too few for a sample of 150 to hold them all."""
    rows = [(f"the cat and the dog {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} went out", "en", i % 2 == 1) for i in range(3000)] + [("der hund und die katze gehen aus", "de", False)] * 20
    odd = [(f"the cat and the dog żółć{chr(97 + i % 26)} źdźbło gęś", "en", True) for i in range(60)]
    with_odd, without = (langid.learn(spark.createDataFrame(x, "text string, lang string, held boolean"))[1] for x in (rows + odd, rows))
    assert with_odd[1] < without[1]
