"""Phrase collocations of each language by best-first branch-and-bound growth of phrases.

A phrase a times seen, cut into parts l and r times seen, scores a*n/(l*r); as a is at
most l and at most r, no phrase that begins or ends with a word seen f times can score
more than n/f.  So the frontier of each language is its words in ascending order of f,
best bound first.  A round expands the next of them: all phrases that have their rarer
end among them are grown word by word, through adjacent pairs that are frequent
themselves.  What has both ends expanded is scored exactly; a language is settled once
the last score of its list is above the bound of the first word not expanded.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordweave.llm.common import LOWER, SET_BITS, UPPER, bit_set, cut, has_bit, place_of

#: What parts pieces becomes a byte that UTF-8 does not have, and a word of its own.
END = b"\xff"
_TABLE = bytes.maketrans(UPPER.encode() + b".,;:!?\n\x0b\x0c\r\t", LOWER.encode() + END * 10 + b" ")
#: Tokens that a task combines at once, and words it keeps the hashes of.
TOKENS, WORDS = 500_000, 200_000
LONGEST = 5


def tokens(text: str) -> list[bytes]:
    """The words of a text in order, END between pieces."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).replace(END, b" \xff ").split()


def word_hash(lang: str, word: bytes) -> int:
    """64 bits, never 0; words of different languages are different words."""
    return xxhash.xxh64_intdigest(lang.encode() + b"\0" + word, 12) or 1


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - SET_BITS)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str]]:
    for b in batches:
        for lang, text in zip(b.column("lang"), b.column("text"), strict=True):
            yield lang.as_py(), text.as_py()


def word_counts(docs: DataFrame, least: int) -> DataFrame:
    """lang, word, f: words seen that often, and for each language a null word with all its occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def out():
            for lang, c in counts.items():
                total = sum(c.values())
                words = list(c)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(words) + 1)), pa.array([*words, None], pa.binary()), pa.array([*c.values(), total], pa.int64())], ["lang", "word", "n"])

        for lang, text in _texts(batches):
            words = counts.setdefault(lang, Counter())
            words.update(tokens(text))
            del words[END]
            if sum(map(len, counts.values())) > WORDS:
                yield from out()
                counts = {}
        yield from out()

    counted = _rows(docs).mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("f"))
    return counted.where((F.col("f") >= least) | F.col("word").isNull())


def with_hashes(words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [word_hash(x, w) for x, w in zip(b.column("lang").to_pylist(), b.column("word").to_pylist(), strict=True)]
            yield b.append_column("h", pa.array(np.array(h, np.uint64).view(np.int64)))

    return words.mapInArrow(run, "lang string, word binary, f long, h long")


def _streams(batches: Iterator[pa.RecordBatch], frequent: np.ndarray) -> Iterator[np.ndarray]:
    """The hashes of the words of many texts at a time, 0 for words that are not frequent and between pieces."""
    known: dict[str, dict[bytes, int]] = {}
    parts, held = [np.zeros(1, np.uint64)], 0

    class Words(dict):
        def __init__(self, lang: str):
            self.lang = lang
            self[END] = 0

        def __missing__(self, word: bytes) -> int:
            h = word_hash(self.lang, word)
            place = h >> (64 - SET_BITS)
            if not (int(frequent[place >> 6]) >> (place & 63)) & 1:
                h = 0
            if len(word) < 64:
                self[word] = h
            return h

    for lang, text in _texts(batches):
        words = tokens(text)
        words.append(END)
        table = known.get(lang)
        if table is None:
            table = known[lang] = Words(lang)
        parts.append(np.fromiter(map(table.__getitem__, words), np.uint64, len(words)))
        held += len(words)
        if held > TOKENS:
            yield np.concatenate(parts)
            parts, held = parts[:1], 0
            if sum(map(len, known.values())) > WORDS:
                known = {}
    if held:
        yield np.concatenate(parts)


def _signed(*columns: np.ndarray) -> list[pa.Array]:
    return [pa.array(c.view(np.int64)) for c in columns]


def pair_counts(docs: DataFrame, frequent, least: int) -> DataFrame:
    """w1, w2, n of the pairs of adjacent frequent words that are seen that often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h in _streams(batches, frequent.value):
            u, code = np.unique(h, return_inverse=True)
            both = (h[1:] != 0) & (h[:-1] != 0)
            pairs, n = np.unique(code[:-1][both].astype(np.int64) * len(u) + code[1:][both], return_counts=True)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([*_signed(u[pairs // len(u)], u[pairs % len(u)]), pa.array(n.astype(np.int64))], ["w1", "w2", "n"])

    return _rows(docs).mapInArrow(run, "w1 long, w2 long, n long").groupBy("w1", "w2").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _grown(h: np.ndarray, pairs: np.ndarray, now: np.ndarray) -> Iterator[list[np.ndarray]]:
    """w1 to w5 (0: none), n, before, after: the phrases of h through frequent pairs, an end among the words expanded now.

    before and after are the one word that always stands next to the phrase, 0 if there is none such.
    """
    u, code = np.unique(h, return_inverse=True)
    code, size = code.astype(np.int64), len(u)
    expanded = has_bit(now, place_of(u))[code] & (h != 0)
    linked = (h[1:] != 0) & (h[:-1] != 0)
    at = np.flatnonzero(linked)
    linked[at] = has_bit(pairs, pair_hash(h[at], h[at + 1]))
    at = np.flatnonzero(linked)
    rank = code[at]
    for length in range(2, LONGEST + 1):
        if length > 2:
            on = linked[at + length - 2]
            at, rank = at[on], rank[on]
        if not len(at):
            return
        keys, first, rank, n = np.unique(rank * size + code[at + length - 1], return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(rank, kind="stable")
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])

        def common(x: np.ndarray, order=order, starts=starts) -> np.ndarray:
            x = x[order]
            low = np.minimum.reduceat(x, starts)
            return np.where(low == np.maximum.reduceat(x, starts), low, np.uint64(0))

        i = at[first]
        wanted = expanded[i] | expanded[i + length - 1]
        if wanted.any():
            before, after = common(h[at - 1]), common(h[at + length])
            words = [h[i + k] if k < length else np.zeros(len(i), np.uint64) for k in range(LONGEST)]
            yield [*(w[wanted] for w in words), n[wanted].astype(np.int64), before[wanted], after[wanted]]


_W = [f"w{k}" for k in range(1, LONGEST + 1)]


def phrase_counts(docs: DataFrame, frequent, pairs, now, least: int) -> DataFrame:
    """w (the words' hashes), a, held (whether a longer phrase of at most LONGEST words is seen as often), of phrases with an end in now."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h in _streams(batches, frequent.value):
            for columns in _grown(h, pairs.value, now.value):
                yield pa.RecordBatch.from_arrays(_signed(*columns), [*_W, "n", "before", "after"])

    schema = ", ".join(f"{c} long" for c in [*_W, "n", "before", "after"])
    always = lambda c: (F.min(c) == F.max(c)) & (F.min(c) != 0)
    counted = _rows(docs).mapInArrow(run, schema).groupBy(*_W).agg(F.sum("n").alias("a"), (always("before") | always("after")).alias("always"))
    words = F.filter(F.array(*_W), lambda x: x != 0)
    return counted.where(F.col("a") >= least).select(words.alias("w"), "a", (F.col("always") & (F.size(words) < LONGEST)).alias("held"))


def _floor_score(a: str, n: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(1000 * a * n / (l * r)) in decimals of 38 digits, as the products may pass 64 bits."""
    d = lambda x: f"cast({x} as decimal(19, 0))"
    return F.expr(f"(cast(1000 as decimal(4, 0)) * {d(a)} * {d(n)}) div ({d(l)} * {d(r)})")


def _scored(phrases: DataFrame, words: DataFrame, ends: DataFrame) -> DataFrame:
    """lang, n, w, a, l, r, score of the phrases that survive and have both ends expanded; ends has lang, n, upto (words seen so often at most are expanded)."""
    seen = words.select(F.array("h").alias("w"), F.col("f")).unionByName(phrases.select("w", F.col("a").alias("f")))
    ready = phrases.where("not held").join(ends, "lang").where("greatest(first_f, last_f) <= upto")
    cuts = ready.select("lang", "n", "w", "a", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.slice("w", 1, F.col("k"))).withColumn("right", F.expr("slice(w, k + 1, size(w) - k)"))
    both = cuts.join(seen.toDF("left", "l"), "left").join(seen.toDF("right", "r"), "right")
    worst = both.withColumn("score", _floor_score("a", "n", "l", "r")).groupBy("w", "lang", "n", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    return worst.select("lang", "n", "w", "a", "c.l", "c.r", "c.score")


def _nth(scored: DataFrame, top: int) -> dict[str, int]:
    """The score of the last of each language's list, of the languages that have so many."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score")))
    return {r.lang: r.score for r in scored.select("lang", "score").withColumn("rank", rank).where(F.col("rank") <= top).where(F.col("rank") == top).collect()}


def _named(scored: DataFrame, words: DataFrame) -> DataFrame:
    """scored with the phrases' words, joined by spaces."""
    single = scored.select("w", F.posexplode("w").alias("at", "h")).join(words.select("h", F.col("word").cast("string").alias("word")), "h")
    text = single.groupBy("w").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda s: s["word"]), " ").alias("phrase"))
    return scored.join(text, "w")


def collocations(docs: DataFrame, top: int = 2000, least: int = 100, beam: int = 4096) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's phrases of two to five words by score, a, phrase.

    A null lang counts as und, a null text as empty; texts without words add nothing, and a
    language without a phrase that qualifies has no row, as has an empty table.  Equal rows
    count as often as they come.  Columns other than lang and text are not read.  Ties in the
    score go by a, then by the phrase's UTF-8 bytes; ties between cuts to the shorter first
    part.  beam sets how many words a language's first round expands, not what comes out.

    Each round is one pass over the texts; counts are combined in tasks before they are
    shuffled by phrase, so a word or language that holds most rows makes no large group.
    What tasks get are sets of 2**26 bits; the driver sees a few numbers a language.  Words
    are told apart by 64 bits of a hash; that those of frequent words differ is checked.
    """
    counted = cut(word_counts(docs, least))
    total = counted.where("word is null").select("lang", F.col("f").alias("n"))
    words = cut(with_hashes(counted.where("word is not null")))
    if words.groupBy("h").count().where("count > 1").count():
        raise ValueError("two frequent words share a hash")
    sc = docs.sparkSession.sparkContext
    frequent = sc.broadcast(bit_set(words.select("h"), place_of))
    pairs = sc.broadcast(bit_set(pair_counts(docs, frequent, least).select("w1", "w2"), pair_hash))
    # Words of about the same f are expanded together, so a language has some hundred steps at most.
    steps: dict[str, list] = {}
    bands = words.groupBy("lang", F.floor(F.log2("f") * 8).alias("band")).agg(F.count("*").alias("words"), F.min("f").alias("low"), F.max("f").alias("high")).join(total, "lang")
    for r in bands.orderBy("lang", "band").collect():
        steps.setdefault(r.lang, []).append(r)
    upto, wanted, phrases = dict.fromkeys(steps, 0), beam, None
    settled: set[str] = set()

    def reach(lang: str, last: int | None) -> int:
        """The f up to which the next round expands: what can reach the last score of a full list, else so many words at least."""
        bands, many = steps[lang], 0
        if last is not None:
            return max([b.high for b in bands if 1000 * b.n // b.low >= last], default=0)
        for b in bands:
            many += b.words
            if many >= wanted:
                break
        return b.high

    last: dict[str, int] = {}
    while len(settled) < len(steps):
        before = dict(upto)
        for lang in steps.keys() - settled:
            upto[lang] = max(reach(lang, last.get(lang)), before[lang])
        frame = docs.sparkSession.createDataFrame([(x, before[x], upto[x]) for x in sorted(steps)], "lang string, done long, upto long").join(total, "lang")
        now = sc.broadcast(bit_set(words.join(frame, "lang").where("f > done and f <= upto").select("h"), place_of))
        f_of = lambda end: words.select(F.col("h").alias(end), F.col("f").alias(f"{end}_f"))
        new = phrase_counts(docs, frequent, pairs, now, least).withColumn("first", F.get("w", F.lit(0))).withColumn("last", F.element_at("w", -1))
        new = new.join(f_of("first"), "first").join(words.select("lang", F.col("h").alias("last"), F.col("f").alias("last_f")), "last").join(frame.select("lang", "done", F.col("upto").alias("until")), "lang")
        new = cut(new.where("least(first_f, last_f) > done and least(first_f, last_f) <= until").select("lang", "w", "a", "held", "first_f", "last_f"))
        phrases = new if phrases is None else phrases.unionByName(new)
        now.unpersist()
        scored = cut(_scored(phrases, words, frame.select("lang", "n", "upto")))
        last = _nth(scored, top)
        for lang in steps.keys() - settled:
            rest = [b for b in steps[lang] if b.high > upto[lang]]
            if not rest or lang in last and last[lang] > 1000 * rest[0].n // rest[0].low:
                settled.add(lang)
        wanted *= 8
    if not steps:
        phrases = words.select("lang", F.array("h").alias("w"), F.col("f").alias("a"), F.lit(False).alias("held"), F.col("f").alias("first_f"), F.col("f").alias("last_f")).where("false")
        scored = _scored(phrases, words, total.withColumn("upto", F.lit(0)))
    floor = docs.sparkSession.createDataFrame(sorted(last.items()), "lang string, floor long")
    listed = _named(scored.join(floor, "lang", "left").where("floor is null or score >= floor").drop("floor"), words)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    return listed.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
