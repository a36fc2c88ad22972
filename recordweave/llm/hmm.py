"""Hidden Markov language model: Baum-Welch over all partitions, exact scores by the forward recursion.

Every text is its words, lower-cased, and one end.  The corpus is counted in full; the most
frequent words are symbols of their own and the rest share one symbol, under which a word
has the probability its own count gives it.  Each round of Baum-Welch turns every partition
into expected counts, which a grouped sum adds up.  Texts are encoded once, to the shared
folder; words outside the symbols meet their counts in one join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log, log10

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordweave.llm.chain import Chains, batches
from recordweave.llm.common import crc_mod, cut

#: A word can't be empty: the empty string stands for the end.
END = ""
RARE = 0


def tokens(text: str) -> list[bytes]:
    """The words of a text, A-Z lower-cased; of bytes, split() parts at \\x20 and \\x09-\\x0D alone."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c: how often each token occurs in docs(text), the end of each text included.  Counted in each batch before the shuffle."""

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            n: Counter = Counter()
            for t in b.column("text").to_pylist():
                n.update(tokens(t))
            n[b""] += b.num_rows
            words = pa.array(list(n), pa.binary()).cast(pa.string())
            for x in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([words[x : x + 50_000], pa.array(list(n.values())[x : x + 50_000], pa.int64())], ["word", "c"])

    return docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(counted, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _encode(docs: DataFrame, symbols: dict[bytes, int]) -> DataFrame:
    """row, doc_id, held_out, n_tokens, ids (2 bytes a token), rare (the words that have no symbol, space-joined)."""

    def encoded(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for whole in parts:
            for lo in range(0, whole.num_rows, 2000):
                b = whole.slice(lo, 2000)
                ids, rare, n = [], [], []
                for t in b.column("text").to_pylist():
                    w = tokens(t)
                    w.append(b"")
                    x = np.array([symbols.get(v, RARE) for v in w], "<u2")
                    ids.append(x.tobytes())
                    rare.append(b" ".join([v for v in w if v not in symbols]))
                    n.append(len(w))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(n))), b.column("doc_id"), b.column("held_out"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(rare, pa.binary()).cast(pa.string())], ["row", "doc_id", "held_out", "n_tokens", "ids", "rare"])
                row += len(n)

    return cut(docs.select(F.col("doc_id").cast("long"), (crc_mod(F.col("doc_id"), 7) == 2).alias("held_out"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(encoded, "row long, doc_id long, held_out boolean, n_tokens long, ids binary, rare string"))


def _chains(b: pa.RecordBatch, emit: np.ndarray, start: np.ndarray, move: np.ndarray, at_once: int):
    n = b.column("n_tokens").to_numpy()
    for lo, hi in batches(n, at_once):
        ids = np.frombuffer(b"".join(b.column("ids").slice(lo, hi - lo).to_pylist()), "<u2")
        yield lo, hi, ids, Chains(emit[ids], n[lo:hi], start, move)


def baum_welch(encoded: DataFrame, unigram: np.ndarray, states: int = 4, rounds: int = 4, at_once: int = 500_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, move, emit) after so many rounds over all rows of encoded; emit is (symbols, states).

    The first emissions are the unigram distribution, weighted by a fixed random factor for
    each state.  What reaches the driver in a round is the sum over all partitions: states
    * (symbols + states + 1) numbers.  A tenth of a count is added to each.
    """
    rng, m = np.random.default_rng(7), len(unigram)
    emit = unigram[:, None] * (rng.gamma(1.0, 1.0, (m, states)) + 0.01)
    emit, start = emit / emit.sum(0), np.full(states, 1 / states)
    move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    for _ in range(rounds):

        def expected(parts: Iterator[pa.RecordBatch], emit=emit, start=start, move=move) -> Iterator[pa.RecordBatch]:
            total = np.zeros((states + m + 1, states))
            for b in parts:
                for _, _, ids, c in _chains(b, emit, start, move, at_once):
                    c.forward()
                    p = c.backward()
                    total[0] += p[c.first].sum(0)
                    total[1 : states + 1] += c.pairs()
                    for k in range(states):
                        total[states + 1 :, k] += np.bincount(ids, p[:, k], m)
            cell = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total.ravel()[cell])], ["cell", "n"])

        sums = encoded.select("n_tokens", "ids").mapInArrow(expected, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        total = np.full((states + m + 1) * states, 0.1)
        total[sums["cell"].to_numpy()] += sums["n"].to_numpy()
        total = total.reshape(-1, states)
        start, move, emit = total[0] / total[0].sum(), total[1 : states + 1], total[states + 1 :]
        move, emit = move / move.sum(1, keepdims=True), emit / emit.sum(0)
    return start, move, emit


def score_texts(docs: DataFrame, vocabulary: int = 16_384, states: int = 4, rounds: int = 4, at_once: int = 1_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each row of docs(doc_id, text).

    Learns from the rows whose crc32(doc_id as text) mod 7 is not 2.  vocabulary: at most
    so many words (below 65,536), those of at least one in 16 * vocabulary tokens, are
    symbols of their own.  score is the log10 probability
    of the words and the end under the model: a word outside the symbols has, given their
    common symbol, (c + 1) / (its kind's tokens + types + 1), c 0 for a new one.  A null
    text counts as empty: its end alone.  Repeated rows are learned and scored as often as
    they come; a null doc_id is a training row; without training rows c, N and V are 0.
    Columns other than doc_id and text are not read.
    """
    counts = cut(word_counts(docs.where(crc_mod(F.col("doc_id"), 7) != 2)))
    size, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # At most 16 * vocabulary words are that frequent, however many there are: what tasks send to the driver has this bound.
    top = counts.where((F.col("word") != END) & (F.col("c") * (16 * vocabulary) >= size)).orderBy(F.desc("c"), "word").limit(vocabulary).collect()
    ends = counts.where(F.col("word") == END).select("c").first()
    c = np.array([0, ends.c if ends else 0, *(r.c for r in top)], np.float64)
    c[RARE] = size - c.sum()
    symbols = {b"": 1} | {r.word.encode(): i for i, r in enumerate(top, 2)}
    rare_total = c[RARE] + (types - len(top) - (ends is not None)) + 1
    encoded = _encode(docs, symbols)
    start, move, emit = baum_welch(encoded.where("not held_out"), (c + 0.1) / (c + 0.1).sum(), states, rounds)
    logs, known = np.log10(c + 1), (c > 0)
    logs[RARE], known[RARE] = 0, False

    def scored(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            path, base, seen, rare = (np.zeros(b.num_rows) for _ in range(4))
            for lo, hi, ids, x in _chains(b, emit, start, move, at_once):
                path[lo:hi] = x.forward() / log(10)
                base[lo:hi], seen[lo:hi] = np.add.reduceat(logs[ids], x.first), np.add.reduceat(known[ids].astype(np.int64), x.first)
                rare[lo:hi] = np.add.reduceat((ids == RARE).astype(np.int64), x.first)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("row", "doc_id", "held_out", "n_tokens")), pa.array(path), pa.array(base), pa.array(seen.astype(np.int64)), pa.array(rare.astype(np.int64))], ["row", "doc_id", "held_out", "n_tokens", "path", "base", "seen", "rare"])

    walked = encoded.select("row", "doc_id", "held_out", "n_tokens", "ids").mapInArrow(scored, "row long, doc_id long, held_out boolean, n_tokens long, path double, base double, seen long, rare long")
    words = encoded.where("rare <> ''").select("row", F.explode(F.split("rare", " ")).alias("word"))
    rare = words.join(counts, "word").groupBy("row").agg(F.sum(F.log10(F.col("c") + 1)).alias("more"), F.count("*").alias("met"))
    more, n = F.coalesce("more", F.lit(0.0)), F.col("n_tokens")
    return walked.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("seen") + F.coalesce("met", F.lit(0))).alias("n_known"), F.lit(size).cast("long").alias("train_tokens"),
        (F.col("base") + more - n * F.lit(log10(size + types + 1))).alias("base_score"), (F.col("path") + more - F.col("rare") * F.lit(log10(rare_total))).alias("score"),
    )
