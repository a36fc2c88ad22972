"""Language of texts by a linear-chain conditional random field over their words.

Words are labelled with languages: affixes, character n-grams and lexicon membership give
each word a weight for each language, learned transitions tie neighbours, and forward-
backward gives every word's probabilities, so that a text may switch language.  A text's
language is that of the largest share of its words.  How familiar a text is in its
language, the share of its words' features that the training words have, tells texts of
languages that were never learned, whose probabilities mean nothing.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordweave.llm.chain import Chains, batches
from recordweave.llm.chunks import Known, letters
from recordweave.llm.common import crc_mod, cut, fresh, give_back

WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 18
LEXICON = 2000
UNKNOWN = "und"
#: The fineness of gradients, which are summed as whole numbers; a word or feature is frequent if one in so many words is or has it.
FINE, OFTEN = 1024, 1 << 17
#: Words and texts that a task labels at once; words of the segments that chains are cut into: most texts are one.
AT_ONCE, TEXTS, SEGMENT = 300_000, 2000, 1024


def words_of(text: str) -> list[str]:
    """The runs of letters, in lower case; a run of number signs such as fractions is found too and has no letter."""
    return WORD.findall(text.lower())


def _real(chunk: str) -> list[str]:
    """The words of a chunk that have a letter."""
    low = chunk.lower()
    return [low] if low.isalpha() else [w for w in WORD.findall(low) if any(map(str.isalpha, w))]


def _reals(chunks: list[str]) -> tuple[list[str], np.ndarray]:
    """The words of _real() of chunks (without line ends), one chunk after the other, and how many came before each and in all."""
    low = "\n".join(chunks).lower().split("\n") if chunks else []
    plain = np.fromiter(map(str.isalpha, low), bool, len(low))
    if plain.all():
        return low, np.arange(len(low) + 1)
    lists = [[w] if p else _real(c) for c, w, p in zip(chunks, low, plain.tolist(), strict=True)]
    return [w for x in lists for w in x], _places(lists)


def _places(lists: list[list[str]]) -> np.ndarray:
    """How many words came before each list, and in all."""
    return np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))])


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each feature, its word): all character pairs and triples of ^word$, and its affixes of three letters."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    code = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    of = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(code))  # characters from here to the word's end
    begin = left == size[of]
    out = []
    for n in (2, 3, 4):
        h = np.full(len(code), n, np.uint64)
        for i in range(n):
            h = (h ^ np.roll(code, -i)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        keep = left >= n
        if n == 4:  # the affixes: at the word's begin, or up to its end
            keep &= begin | (left == n)
        out.append(((h % np.uint64(BUCKETS)).astype(np.int64)[keep], of[keep]))
    bucket, word = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(word, kind="stable")
    return bucket[order], word[order]


@dataclass
class Model:
    """labels: the languages, sorted; weights: (BUCKETS, labels); lexicon: word -> labels of the lexicons that hold it; seen: (BUCKETS, labels), whether training words of the label have the feature, one in OFTEN of them at least; the rest are log weights."""

    labels: list[str]
    weights: np.ndarray
    lexicon: dict[str, list[int]]
    listed: np.ndarray
    start: np.ndarray
    move: np.ndarray
    seen: np.ndarray

    def __getstate__(self) -> dict:
        """Only the features that have something: a model goes to every task, in training once a step."""
        at = np.flatnonzero(self.weights.any(1) | self.seen.any(1))
        return vars(self) | {"at": at, "weights": self.weights[at], "seen": self.seen[at]}

    def __setstate__(self, state: dict) -> None:
        at = state.pop("at")
        for name in ("weights", "seen"):
            some, state[name] = state[name], np.zeros((BUCKETS, len(state["labels"])), state[name].dtype)
            state[name][at] = some
        vars(self).update(state)

    def scores(self, grams: tuple[np.ndarray, np.ndarray], held: np.ndarray) -> np.ndarray:
        """The log weights of each word's labels, from its features and the lexicons that hold it."""
        at = np.searchsorted(grams[1], np.arange(len(held)))
        return np.add.reduceat(self.weights[grams[0]], at) + held @ self.listed

    def familiar(self, grams: tuple[np.ndarray, np.ndarray], words: int) -> np.ndarray:
        """(words, labels): the share of each word's features that training words of the label have."""
        at = np.searchsorted(grams[1], np.arange(words))
        return np.add.reduceat(self.seen[grams[0]].astype(np.float64), at) / np.bincount(grams[1], minlength=words)[:, None]

    def both(self, grams: tuple[np.ndarray, np.ndarray], held: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What scores() and familiar() give, with the features' rows of table (weights, and seen if it has them) added up once."""
        k = len(self.labels)
        many = np.bincount(grams[1], minlength=len(held))
        out = np.add.reduceat(table.take(grams[0], axis=0), np.cumsum(many) - many)
        return out[:, :k] + held @ self.listed, out[:, k:].astype(np.float64) / many[:, None]

    def held(self, words: list[str]) -> np.ndarray:
        """Which lexicons hold each word, as 0 and 1."""
        out = np.zeros((len(words), len(self.labels)))
        at = [(i, c) for i, found in enumerate(map(self.lexicon.get, words)) if found for c in found]
        out[tuple(np.array(at, np.int64).reshape(-1, 2).T)] = 1
        return out


def _even(x: np.ndarray) -> np.ndarray:
    return np.exp(x - x.max(1, keepdims=True))


def _slopes(words: list[str], n: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """What n (words, labels), the occurrences of each word under each label, say on weights and listed: gold minus expected, in whole 1 / FINE, so that sums are the same in any order."""
    grams, held = _grams(words), m.held(words)
    e = _even(m.scores(grams, held))
    r = np.rint((n - n.sum(1, keepdims=True) * (e / e.sum(1, keepdims=True))) * FINE)
    return np.stack([np.bincount(grams[0], r[grams[1], c], BUCKETS) for c in range(len(m.labels))], 1), held.T @ r


def _adam(parts: list[np.ndarray], gradients: Callable[[int], list[np.ndarray]], steps: int) -> None:
    mean, power = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for step in range(1, steps + 1):
        for p, g, a, b in zip(parts, gradients(step), mean, power, strict=True):
            g = g - 0.05 * p
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p += 0.3 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)


def _having(words: list[str], n: np.ndarray) -> np.ndarray:
    """(BUCKETS, labels): of n (words, labels) those that have each feature."""
    grams = _grams(words)
    return np.stack([np.bincount(grams[0], n[grams[1], c], BUCKETS) for c in range(n.shape[1])], 1)


def _often(found: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Which features at least one in OFTEN of a label's words has."""
    return (found > 0) & (found * OFTEN >= total)


def _empty(labels: list[str]) -> Model:
    k = len(labels)
    return Model(labels, np.zeros((BUCKETS, k)), {}, np.zeros((k, k)), np.zeros(k), np.zeros((k, k)), np.zeros((BUCKETS, k), bool))


def _moved(m: Model, starts: np.ndarray, moves: np.ndarray, steps: int) -> None:
    """The weights of starts and moves from how often each was made."""

    def gradients(_: int) -> list[np.ndarray]:
        first, each = _even(m.start[None])[0], _even(m.move)
        return [starts - starts.sum() * first / first.sum(), moves - moves.sum(1, keepdims=True) * each / each.sum(1, keepdims=True)]

    _adam([m.start, m.move], gradients, steps)


def _weighed(texts: pa.Array, known: Known, width: int, at_once: int) -> Iterator[tuple[int, list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of texts that have words: the texts' numbers, the chunks and the part of them that each word is of, each word's row of known, which has so many values, and the words of each text."""
    for lo in range(0, len(texts), TEXTS):
        chunks, at, before = letters(texts.slice(lo, TEXTS))
        look = known.look(chunks)
        made = list(map(look, chunks))
        size = np.fromiter(map(len, made), np.int64, len(made)) // max(4 * width, 1)
        flat, slots = np.frombuffer(b"".join(made), f"V{4 * width}") if width else np.zeros(0), np.cumsum(size) - size
        words = np.concatenate([[0], np.cumsum(size[at])])[before]
        for i, j in batches(np.diff(words), at_once):
            n = np.diff(words[i : j + 1])
            full = np.flatnonzero(n)
            if len(full):
                part = at[before[i] : before[j]]
                many = size[part]
                slot = np.repeat(slots[part] - (np.cumsum(many) - many), many)
                slot += np.arange(len(slot))
                yield lo + i + full, chunks, slot, flat[slot].view("<f4").reshape(-1, width), n[full]


def _relabelled(m: Model, texts: pa.Array, known: Known, stay: float, at_once: int) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """words, (words, labels) how often each has each label, and how often each label begins a text and follows each: the likeliest labels, by the words' own weights and one of `stay` for staying."""
    k = len(m.labels)
    for lo in range(0, len(texts), TEXTS):
        held, n, starts, moves = None, 0, np.zeros(k, np.int64), np.zeros((k, k), np.int64)
        for _, chunks, slot, e, sizes in _weighed(texts.slice(lo, TEXTS), known, k, at_once):
            if held is None:
                held, _ = _reals(chunks)
            c = Chains(e.astype(np.float64), sizes, np.ones(k), np.exp(stay * np.eye(k)), SEGMENT)
            c.forward()
            gold = c.backward().argmax(1)
            n = n + np.bincount(slot * k + gold, minlength=len(held) * k).reshape(-1, k)
            starts, moves = (a + b for a, b in zip((starts, moves), _moves(gold, c.first, k), strict=True))
        if held:
            yield held, n, starts, moves


def _moves(gold: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each label begins a text, and follows each."""
    later = np.ones(len(gold), bool)
    later[first] = False
    at = np.flatnonzero(later)
    return np.bincount(gold[first], minlength=k), np.bincount(gold[at - 1] * k + gold[at], minlength=k * k).reshape(k, k)


class _Counted:
    """The words of all training texts with their occurrences under each label, a row a word, in Spark.

    In a step of a gradient the frequent words take part, which are few, and of the rest
    each word in one step of every so many, with that weight: so all words count, and a
    round reads the rare ones once.
    """

    def __init__(self, rows: DataFrame, labels: list[str], steps: int):
        """rows: label (index), word, n."""
        self.labels, self.steps, k = labels, steps, len(labels)
        self.names = [f"n{c}" for c in range(k)]
        by = rows.groupBy("word").agg(*(F.sum(F.when(F.col("label") == c, F.col("n")).otherwise(0)).alias(n) for c, n in enumerate(self.names)))
        self.kept = fresh(by, rows.sparkSession.sparkContext.defaultParallelism)
        # A word has no space, so these rows are none of words.
        self.words = self.kept.where(~F.col("word").startswith(" "))
        total = self.words.agg(*(F.coalesce(F.sum(n), F.lit(0)) for n in self.names)).first()
        self.total = np.array(list(total), np.int64)

    def lexicon(self) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        for c, n in enumerate(self.names):
            for r in self.words.where(F.col(n) > 0).orderBy(F.desc(n), "word").limit(LEXICON).select("word").collect():
                out.setdefault(r.word, []).append(c)
        return out

    def _summed(self, words: DataFrame, of: Callable[[list[str], np.ndarray], np.ndarray], rows: int) -> np.ndarray:
        """(rows, labels): the sum of of(words, n), whole numbers, over all words."""
        k, names = len(self.labels), self.names

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((rows, k))
            for b in parts:
                for lo in range(0, b.num_rows, 5_000):  # features take some hundred bytes a letter
                    part = b.slice(lo, 5_000)
                    out += of(part.column("word").to_pylist(), np.stack([part.column(n).to_numpy() for n in names], 1))
            at = np.flatnonzero(out.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(out[at, c].astype(np.int64)) for c in range(k))], ["at", *names])

        got = words.select("word", *names).mapInArrow(run, ", ".join(f"{n} long" for n in ("at", *names))).groupBy("at").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
        out = np.zeros((rows, k))
        for c, n in enumerate(names):
            out[got.column("at").to_numpy(), c] = got.column(n).to_numpy()
        return out

    def fit(self, m: Model) -> None:
        """Takes steps with the weights of features and lexicons."""
        n, turn = sum(F.col(x) for x in self.names), F.pmod(F.xxhash64("word"), F.lit(self.steps)) + 1
        often = n * OFTEN >= int(self.total.sum())

        def gradients(step: int) -> list[np.ndarray]:
            now = self.words.where(often | (turn == step)).select("word", *(F.when(often, F.col(x)).otherwise(F.col(x) * self.steps).alias(x) for x in self.names))
            both = self._summed(now, lambda words, n: np.vstack(_slopes(words, n, m)), BUCKETS + len(self.labels)) / FINE
            return [both[:BUCKETS], both[BUCKETS:]]

        _adam([m.weights, m.listed], gradients, self.steps)

    def seen(self) -> np.ndarray:
        return _often(self._summed(self.words, _having, BUCKETS), self.total)


def fit(texts: list[str], langs: list[str], steps: int = 12, stay: float = 3.0) -> Model:
    """What train() learns, of a few texts at hand: every word takes part in every step."""
    labels = sorted(set(langs))
    k, lists = len(labels), [[w for w in words_of(t) if any(map(str.isalpha, w))] for t in texts]
    at = {w: i for i, w in enumerate(dict.fromkeys(w for x in lists for w in x))}
    m, n = _empty(labels), np.zeros((len(at), k), np.int64)
    if not at:
        return m
    for x, lang in zip(lists, langs, strict=True):
        np.add.at(n, ([at[w] for w in x], labels.index(lang)), 1)
    names = list(at)
    for c in range(k):
        for i in sorted(np.flatnonzero(n[:, c]).tolist(), key=lambda i: (-n[i, c], names[i]))[:LEXICON]:
            m.lexicon.setdefault(names[i], []).append(c)
    _adam([m.weights, m.listed], lambda _: [x / FINE for x in _slopes(names, n, m)], steps)
    n, starts, moves = np.zeros_like(n), np.zeros(k, np.int64), np.zeros((k, k), np.int64)
    for words, some, first, then in _relabelled(m, pa.array(texts, pa.string()), _table(m, familiar=False), stay, AT_ONCE):
        np.add.at(n, [at[w] for w in words], some)
        starts, moves = starts + first, moves + then
    _adam([m.weights, m.listed], lambda _: [x / FINE for x in _slopes(names, n, m)], steps)
    _moved(m, starts, moves, steps)
    m.seen, m.weights = _often(_having(names, n), n.sum(0)), m.weights.astype(np.float32)
    return m


def train(docs: DataFrame, steps: int = 12, stay: float = 3.0) -> Model:
    """The field from all texts of docs(text, lang), in two rounds.

    First every word takes its text's label, without transitions.  That model, with a
    transition weight of `stay` for staying, labels the words of all texts anew, foreign
    passages included, and the parts of the field (features and lexicons, starts, moves)
    are each fitted to those labels, piece by piece, so that counts suffice.  Each round
    takes `steps` gradient steps (Adam) with a small quadratic penalty.  The texts are read
    twice; counts of words stay in Spark, and sums of fixed size come to the driver.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")

    def words(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for lo in range(0, b.num_rows, TEXTS):
                chunks, at, before = letters(b.column("text").slice(lo, TEXTS))
                langs = b.column("lang").slice(lo, TEXTS).dictionary_encode()
                of = np.repeat(langs.indices.to_numpy(), np.diff(before))
                n = np.bincount(at * len(langs.dictionary) + of, minlength=len(chunks) * len(langs.dictionary)).reshape(-1, len(langs.dictionary))
                real, places = _reals(chunks)
                yield _tallied(real, np.repeat(n, np.diff(places), axis=0), langs.dictionary)

    told = cut(known.mapInArrow(words, "word string, label string, n long").groupBy("word", "label").agg(F.sum("n").alias("n")))
    m = _empty(sorted(r.label for r in told.select("label").distinct().collect()))
    if not m.labels:
        return m
    index = F.create_map(*(F.lit(x) for pair in zip(m.labels, range(len(m.labels)), strict=True) for x in pair))
    counted = _Counted(told.withColumn("label", index[F.col("label")]), m.labels, steps)
    m.lexicon = counted.lexicon()
    counted.fit(m)
    k = len(m.labels)

    def again(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(m, familiar=False)

        for b in parts:
            for words, n, starts, moves in _relabelled(m, b.column("text"), table, stay, AT_ONCE):
                yield _tallied(words, n, pa.array(range(k), pa.int32()))
                made = {**{f" start {c}": n for c, n in enumerate(starts)}, **{f" move {i} {j}": moves[i, j] for i in range(k) for j in range(k)}}
                yield _tallied(list(made), np.array(list(made.values()))[:, None], pa.array([0], pa.int32()))
        table.table.clear()
        give_back()

    counted = _Counted(known.select("text").mapInArrow(again, "word string, label int, n long"), m.labels, steps)
    counted.fit(m)
    made = {r.word: r.n0 for r in counted.kept.where(F.col("word").startswith(" ")).collect()}
    _moved(m, np.array([made.get(f" start {c}", 0) for c in range(k)]), np.array([[made.get(f" move {i} {j}", 0) for j in range(k)] for i in range(k)]), steps)
    m.seen, m.weights = counted.seen(), m.weights.astype(np.float32)
    return m


def _tallied(words: list[str], n: np.ndarray, labels: pa.Array) -> pa.RecordBatch:
    """word, label, n of n (words, labels), where there are any."""
    i, c = np.nonzero(n)
    return pa.RecordBatch.from_arrays([pa.array(words, pa.string()).take(pa.array(i)), labels.take(pa.array(c)), pa.array(n[i, c].astype(np.int64))], ["word", "label", "n"])


def learn(docs: DataFrame, low: float = 0.01, margin: tuple[float, float] = (0.5, 0.8)) -> tuple[Model, tuple[float, float]]:
    """The field, and the least score and familiarity of a text that is accepted, from docs(text, lang, held).

    The field is fitted on all labelled texts of those not held out.  Each threshold is its
    margin of the value that a share `low` of all rightly labelled held-out texts falls
    short of, by as many of them (ranks are exact up to one in a million).  Without labels
    nothing is known to reject by, and both are 0.
    """
    model = train(docs.where(~F.col("held")))
    if not model.labels:
        return model, (0.0, 0.0)
    known = docs.where(F.col("held") & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text")

    def right(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(model)
        for b in parts:
            name, score, familiar = _labelled(model, b.column("text"), table, AT_ONCE)
            yield pa.RecordBatch.from_arrays([pa.array(score), pa.array(familiar)], ["score", "familiarity"]).filter(pc.equal(b.column("lang"), pa.array([*model.labels, None], pa.string()).take(pa.array(name))))
        table.table.clear()
        give_back()

    least = known.mapInArrow(right, "score double, familiarity double").agg(*(F.percentile_approx(x, low, 1_000_000) for x in ("score", "familiarity"))).first()
    return model, tuple(m * (x or 0.0) for m, x in zip(margin, least, strict=True))


def _labelled(model: Model, texts: pa.Array, known: Known, at_once: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the label, score, familiarity) of each text; the index after the last is UNKNOWN."""
    k = len(model.labels)
    name, score, familiar = np.full(len(texts), k), np.zeros(len(texts)), np.zeros(len(texts))
    for at, _, _, both, n in _weighed(texts, known, 2 * k, at_once):
        c = Chains(both[:, :k].astype(np.float64), n, np.exp(model.start), np.exp(model.move), SEGMENT)
        c.forward()
        p = c.backward()
        share = np.add.reduceat(p, c.first) / n[:, None]
        name[at], score[at] = share.argmax(1), np.clip(share.max(1), 0, 1)
        familiar[at] = np.add.reduceat((p * both[:, k:]).sum(1), c.first) / n
    return name, score, familiar


def _table(model: Model, familiar: bool = True) -> Known:
    """The bounded table of the weights and, if asked for, familiarity of chunks' words, 4 bytes a label each; a word without a letter has none."""
    rows_of = np.hstack([model.weights, model.seen.astype(model.weights.dtype)]) if familiar else model.weights
    size = 4 * rows_of.shape[1]

    def made(new: list[str]) -> list[bytes]:
        (real, places), out = _reals(new if size else []), []
        for lo in range(0, len(real), 5_000):  # features take some hundred bytes a letter
            part = real[lo : lo + 5_000]
            weights, share = model.both(_grams(part), model.held(part), rows_of)
            out.append(np.hstack([_even(weights), share]).astype("<f4").tobytes())
        rows, ends = b"".join(out), (places * size if size else np.zeros(len(new) + 1, np.int64)).tolist()
        return [rows[a:b] for a, b in itertools.pairwise(ends)]

    return Known(made, 200_000)


_PREDICTED = "doc_id long, lang_pred string, score double, familiarity double"


def predict(docs: DataFrame, model: Model, at_once: int = AT_ONCE) -> DataFrame:
    """doc_id, lang_pred, score, familiarity: a row for each row of docs(doc_id, text), from the whole text alone.

    score is the share of the words' probability that the language has; familiarity the
    mean share of a word's features that training words have, of the languages the word
    may be of.  A null text, one
    without a letter, and any text if the model knows no language, is `und` with 0 for
    both.  Equal shares go to the language that sorts first.  Columns other than doc_id
    and text are not read; the order of rows, repeated rows and null doc_ids are kept as
    they are; an empty table gives no rows.
    """

    def label(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _table(model)
        for b in parts:
            name, score, familiar = _labelled(model, b.column("text"), known, at_once)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([*model.labels, UNKNOWN]).take(pa.array(name)), pa.array(score), pa.array(familiar)], ["doc_id", "lang_pred", "score", "familiarity"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(label, _PREDICTED)


def keep(docs: DataFrame, model: Model, least: tuple[float, float], at_once: int = AT_ONCE) -> DataFrame:
    """The rows of docs(text) whose text has a letter and whose leading language has at least that score and familiarity.

    All columns stay, whatever their names; nothing is shuffled; null texts go; equal rows
    stay or go together; an empty table gives no rows.  A model without languages gives
    every text 0 for both.
    """

    def kept(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _table(model)
        for whole in parts:
            for lo in range(0, whole.num_rows, TEXTS):
                b = whole.slice(lo, TEXTS)
                _, score, familiar = _labelled(model, b.column("text"), known, at_once)
                yield b.filter(pa.array((score >= least[0]) & (familiar >= least[1])))
        known.table.clear()
        give_back()

    return docs.where(F.col("text").rlike(r"\p{L}")).mapInArrow(kept, docs.schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, familiarity of every row of docs(doc_id, text, lang).

    Learned from all labelled documents whose crc32(doc_id as text) mod 3 is not 1 (a null
    doc_id counts as empty text).  Nulls, empty texts and tables, repeated rows and other
    columns as in predict; a null lang teaches nothing.
    """
    held = crc_mod(F.col("doc_id"), 3) == 1
    return predict(docs, train(docs.where(~held))).withColumn("held_out", held).select("doc_id", "held_out", "lang_pred", "score", "familiarity")
