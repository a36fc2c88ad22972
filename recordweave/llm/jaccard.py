"""N-gram Jaccard join: texts whose sets of word shingles are similar, by prefix filtering.

In one order of all shingles, the rarest first, two sets at or above the similarity share
one of their first few shingles, their prefixes.  So sets meet at the shingles of their
prefixes.  Where they meet, their sizes, the places of the shingle in both and sketches
from which a least number of differing shingles follows drop what cannot be similar; each
pair left is verified once by the sets.  What matters is who is connected: first each
group so far is linked to a neighbour by chance, again and again, until little joins, and
then all pairs that are left between different groups decide.  No link is lost.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordweave.llm.chain import batches as in_parts
from recordweave.llm.chunks import LOWER, SPACE, bytes_of
from recordweave.llm.common import bit_set, cut, fresh, has_bit, lean, place_of
from recordweave.llm.components import components
from recordweave.llm.simhash import FEW, links, majority, within

#: The least similarity, as a fraction, so that comparing is exact.
LEAST = (4, 5)
#: Shingles are counted in 2**COUNTS buckets, sent in blocks of BLOCK: a table of fixed size for any corpus.
COUNTS, BLOCK = 20, 4096
#: Bytes of text that a task cuts at once; bytes of the longest word that is hashed side by side with others; texts a task knows to have seen.
BYTES, LONG, SEEN = 1 << 20, 512, 50_000
#: Texts that meet at one shingle in one task; parts that more are dealt into.
CROWD, SALTS = 4096, 1024
#: Differing bits, of 512, up to which chance neighbours are tried; all other pairs are left to the comparison in full.
NEAR = 150
#: Of the shingles at which sets meet, the share by which neighbours are sought in a turn: one in so many.
PARTS = 8
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(29), np.uint64(32))


def _mixed(x: np.ndarray) -> np.ndarray:
    """x, mixed in place, each value to another one."""
    x ^= x >> _MIX[2]
    x *= _MIX[1]
    x ^= x >> _MIX[3]
    return x


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of the words of texts (none null), in order, and how many came before each text and in all.

    Words are of bytes: A-Z alone are lower-cased, and only \\x20 and \\x09-\\x0D part them.
    """
    ends, data = bytes_of(texts)
    data = np.concatenate([LOWER[data], np.zeros(8, np.uint8)])
    word = ~SPACE[data[:-8]]
    begin, stop = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    first = ends[:-1][ends[:-1] < len(word)]
    begin[first] = word[first]
    stop[:-1] &= ~word[1:] | begin[1:]
    at = np.flatnonzero(begin)
    size = np.flatnonzero(stop) + 1 - at
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # the eight bytes from each place on
    h = size.astype(np.uint64) * _MIX[0]
    left, done = np.flatnonzero(size <= LONG), 0
    while len(left):
        x = eight[at[left] + done] & _FIRST[np.minimum(size[left] - done, 8)]
        x ^= h[left]
        x *= _MIX[0]
        h[left] = _mixed(x)
        done += 8
        left = left[size[left] > done]
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = xxhash.xxh64_intdigest(data[at[i] : at[i] + size[i]], 42)
    return h, np.searchsorted(at, ends)


class Shingles:
    """Sets of shingles of texts: 64-bit hashes of so many words in a row, or of all words where there are fewer."""

    def __init__(self, width: int):
        self.width = width

    def all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of texts (none null) in order, repeats included, and how many came before each text and in all; none without words."""
        words, before = _words(texts)
        first, n, out, short = before[:-1], np.diff(before), words.copy(), []
        for k in range(1, self.width):
            at = first[n == k]
            short.append((at, out[at]))
            x = out[: max(len(out) - k, 0)]
            x *= _MIX[0]
            x += words[k:]
            x ^= x >> _MIX[2]
            x *= _MIX[1]
        for at, x in short:
            out[at] = x
        return _taken(out, first, np.where(n < self.width, np.minimum(n, 1), n - self.width + 1), lambda x: x ^ (x >> _MIX[3]))

    def sets(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As all(), each text's hashes sorted and without repeats."""
        return distinct(*self.all(texts))

    def set(self, text: str) -> np.ndarray:
        return self.sets(pa.array([text], pa.string()))[0]


def _taken(x: np.ndarray, first: np.ndarray, many: np.ndarray, made: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """made of the values of x at so many places from each first one on, and how many came before each first one and in all."""
    before = np.concatenate([[0], np.cumsum(many)])
    return made(x[np.repeat(first - before[:-1], many) + np.arange(before[-1])]), before


def distinct(h: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's hashes sorted and without repeats, and how many came before each text and in all; h is sorted in place by text."""
    for a, b in itertools.pairwise(before.tolist()):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[before[:-1][before[:-1] < len(h)]] = True
    return h[new], np.concatenate([[0], np.cumsum(new)])[before]


def digest(s: np.ndarray) -> int:
    """The name of a set of shingles, a signed long; texts of equal sets are one node."""
    return (xxhash.xxh64_intdigest(s, 7) ^ 1 << 63) - (1 << 63)


def _digests(s: np.ndarray, before: np.ndarray) -> list[int]:
    return [digest(s[a:b]) for a, b in itertools.pairwise(before.tolist())]


def sketches(s: np.ndarray, before: np.ndarray) -> list[bytes]:
    """512 bits for each set, each the parity of the shingles that fall on it: two differ in no more bits than the sets in shingles."""
    rows = len(before) - 1
    at = (s & np.uint64(511)).astype(np.int64) + (np.repeat(np.arange(rows), np.diff(before)) << 9)
    bits = np.packbits(np.bincount(at, minlength=rows << 9).astype(np.uint8) & 1).tobytes()
    return [bits[i : i + 64] for i in range(0, len(bits), 64)]


def mark(s: np.ndarray) -> bytes:
    """As a sketch, of at least as many bits as there are shingles, a power of two, so that those of large sets tell as much."""
    bits = max(512, 1 << (len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def apart(x: bytes, y: bytes) -> int:
    """In how many shingles the sets of these marks differ at least: the longer mark is folded to the shorter one's bits."""
    size = min(len(x), len(y)) * 8

    def folded(m: bytes) -> int:
        v, bits = int.from_bytes(m, "little"), len(m) * 8
        while bits > size:
            bits >>= 1
            v = (v >> bits) ^ (v & ((1 << bits) - 1))
        return v

    return (folded(x) ^ folded(y)).bit_count()


def _bucket(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - COUNTS)).astype(np.int64)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """doc_id and text, in slices of about so many BYTES, or one text."""
    for b in batches:
        size = pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False)
        for i, j in in_parts(size, BYTES):
            yield b.column("doc_id").slice(i, j - i), b.column("text").slice(i, j - i)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))


def _named(docs: DataFrame, width: int, simhash: bool) -> DataFrame:
    """doc_id, node, n, data (the sketch), fp for each row; and, with block set, what a task counted of a block of buckets in data."""
    names = ["doc_id", "node", "n", "data", "fp", "block"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, held, many = Shingles(width), [], 0
        counts = np.zeros(1 << COUNTS, np.uint32)

        def batch(*columns):
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for ids, texts in _texts(batches):
            h, before = shingles.all(texts)
            rows = len(texts)
            fp = [int(np.uint64(majority(h[a:b])).astype(np.int64)) for a, b in itertools.pairwise(before.tolist())] if simhash else [None] * rows
            s, before = distinct(h, before)
            n = np.diff(before).tolist()
            named, marks = _digests(s, before), sketches(s, before)
            yield batch(ids, [x if k else None for x, k in zip(named, n, strict=True)], n, [x if k else None for x, k in zip(marks, n, strict=True)], fp, [None] * rows)
            held.append(_bucket(s))
            many += len(s)
            if many > 500_000:
                counts += np.bincount(np.concatenate(held), minlength=1 << COUNTS).astype(np.uint32)
                held, many = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=1 << COUNTS).astype(np.uint32)
        for k, block in enumerate(counts.reshape(-1, BLOCK)):
            if block.any():
                yield batch([None], [None], [None], [zlib.compress(block.tobytes(), 1)], [None], [k])

    return _rows(docs).mapInArrow(lean(run), "doc_id long, node long, n long, data binary, fp long, block int")


def frequencies(named: DataFrame) -> np.ndarray:
    """In how many documents, of all, the shingles of each bucket are; so no shingle is in more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, data in zip(b.column("block").to_pylist(), b.column("data"), strict=True):
                block = np.frombuffer(zlib.decompress(data.as_py()), np.uint32)
                total[k] = total.get(k, np.zeros(BLOCK, np.int64)) + block
        for k, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes()])], ["block", "data"])

    found = named.where("block is not null").select("block", "data").repartition("block").mapInArrow(lean(run), "block int, data binary").toArrow()
    out = np.zeros((1 << COUNTS) // BLOCK * BLOCK, np.uint32).reshape(-1, BLOCK)
    for k, data in zip(found.column("block").to_pylist(), found.column("data").to_pylist(), strict=True):
        out[k] = np.frombuffer(data, np.uint32)
    return out.ravel()


def _new(node: np.ndarray, wanted: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which nodes (or rows' names) are wanted and not seen before; SEEN of them are kept."""
    out = wanted > 0
    for i in np.flatnonzero(out).tolist():
        name = int(node[i])
        if name in seen:
            out[i] = False
        elif len(seen) < SEEN:
            seen.add(name)
    return out


def prefixes(docs: DataFrame, width: int, least: tuple[int, int], counts: np.ndarray, crowd: int) -> DataFrame:
    """h, node, na, salt: the shingles by which a set can meet those at or above the similarity, the rarest first.

    na holds the size of the set and the place of the shingle (n << 32 | at).  salt is -1,
    or a part by chance of those shingles that more than so many documents may have.
    """
    num, den = least
    crowded = min(max(crowd, 8 * int(counts.sum(dtype=np.int64)) >> COUNTS), 16 * crowd)
    known = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen = Shingles(width), set()
        for _, texts in _texts(batches):
            s, before = shingles.sets(texts)
            n, node = np.diff(before), np.array(_digests(s, before), np.int64)
            first = np.flatnonzero(_new(node, n, seen))
            k = n[first] - -(-num * n[first] // den) + 1
            # By count, then by hash: a text's hashes are sorted, so their places tell.
            order = (known.value[_bucket(s)].astype(np.uint64) << np.uint64(32)) | (np.arange(len(s)) - np.repeat(before[:-1], n)).astype(np.uint64)
            for i in first.tolist():
                order[before[i] : before[i + 1]].sort()
            count, places = _taken(order, before[first], k, lambda x: x)
            s = s[(count & np.uint64(0xFFFFFFFF)).astype(np.int64) + np.repeat(before[first], k)]
            salt = np.where(count >> np.uint64(32) > crowded, np.repeat((node[first] >> 7) % SALTS, k), -1).astype(np.int32)
            at = np.arange(len(s)) - np.repeat(places[:-1], k)
            yield pa.RecordBatch.from_arrays([*map(pa.array, (s.view(np.int64), np.repeat(node[first], k), at + np.repeat(n[first] << 32, k), salt))], ["h", "node", "na", "salt"])

    return _rows(docs).mapInArrow(lean(run), "h long, node long, na long, salt int")


def _row_name(node: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    """64 bits for a row, of one node another for each doc_id."""
    return _mixed(node * _MIX[0] + doc_id)


def _row_place(node: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    return place_of(_row_name(node, doc_id))


def sets(docs: DataFrame, width: int, wanted: DataFrame) -> DataFrame:
    """node, s (the sorted shingles), mark, once for each of the wanted nodes, made of the row that rep (a doc_id, or null) names."""
    named = wanted.select("node", F.coalesce("rep", F.lit(0)).alias("rep"))
    bits = docs.sparkSession.sparkContext.broadcast(bit_set(named, _row_place))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen, at = Shingles(width), set(), TaskContext.get().partitionId() << 40
        for ids, texts in _texts(batches):
            s, before = shingles.sets(texts)
            n, node, rep = np.diff(before), np.array(_digests(s, before), np.int64), ids.fill_null(0).to_numpy()
            row = _row_name(node.view(np.uint64), rep.view(np.uint64))
            first = np.flatnonzero(_new(row, n * has_bit(bits.value, place_of(row)), seen))
            s, ends = _taken(s, before[first], n[first], lambda x: x)
            marks = [mark(s[a:b]) for a, b in itertools.pairwise(ends.tolist())]
            places = at + np.arange(len(first))
            at += len(first)
            yield pa.RecordBatch.from_arrays([*map(pa.array, (node[first], rep[first], places)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(s.view(np.int64))), pa.array(marks, pa.binary())], ["node", "rep", "at", "s", "mark"])

    wanted = cut(named)
    many = wanted.count()
    made = _rows(docs).mapInArrow(lean(run), "node long, rep long, at long, s array<long>, mark binary")
    # Bits of other rows may be set as well, so of copies the row that rep names is taken, and no set is shuffled for them.
    found = fresh(made.join(F.broadcast(wanted) if many <= FEW else wanted, ["node", "rep"], "left_semi"))
    if found.count() > many:
        # Equal rows in several tasks: the names tell which to take.
        first = cut(found.groupBy("node").agg(F.min("at").alias("at")))
        found = found.join(F.broadcast(first) if many <= FEW else first, ["node", "at"], "left_semi")
    return found.select("node", "s", "mark")


def _columns(b: pa.RecordBatch) -> dict[str, np.ndarray]:
    def one(name: str) -> np.ndarray:
        c = b.column(name)
        return np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(-1, 8) if name == "data" else c.to_numpy()

    return {name: one(name) for name in b.schema.names}


def _starts(x: dict[str, np.ndarray], keys: tuple[str, ...]) -> np.ndarray:
    new = np.zeros(len(x["node"]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= x[k][1:] != x[k][:-1]
    return np.flatnonzero(new)


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[dict[str, np.ndarray]]:
    """The rows, sorted by the keys, in batches of whole groups."""
    held: dict[str, np.ndarray] = {}
    for b in batches:
        if not b.num_rows:
            continue
        x = _columns(b)
        x = {k: np.concatenate([held[k], v]) for k, v in x.items()} if held else x
        last = int(_starts(x, keys)[-1])
        held = {k: v[last:] for k, v in x.items()}
        if last:
            yield {k: v[:last] for k, v in x.items()}
    if held:
        yield held


def _once(x: dict[str, np.ndarray], keys: tuple[str, ...]) -> dict[str, np.ndarray]:
    """Of equal keys and nodes, which follow each other, the first row."""
    first = _starts(x, (*keys, "node"))
    return {k: v[first] for k, v in x.items()} if len(first) < len(x["node"]) else x


def _pairs(x: dict[str, np.ndarray], keys: tuple[str, ...], least: tuple[int, int], reach: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows i, j of one group that may be similar as far as sizes, places, sketches (data) and groups so far (c) tell; never left out where they are.

    Without reach, rows are in order of na, so the sizes and the smaller set's place bound
    how far a partner may be; with it, partners are at most so many rows apart.
    """
    num, den = least
    n, at = x["na"] >> 32, x["na"] & 0xFFFFFFFF
    start = _starts(x, keys)
    size = np.diff(np.append(start, len(n)))
    end = np.repeat(start + size, size)
    if not reach:
        # The larger set has at most den/num of the smaller one's size, and the smaller one's rest must hold what both share.
        most = np.minimum(den * n // num, (num + den) * (n - at) // num - n)
        group = np.repeat(np.arange(len(start)), size) << 33
        end = np.minimum(end, np.searchsorted(group + n, group + np.maximum(most, 0), side="right"))
    i, step = np.arange(len(n)), 0
    while len(i) and (not reach or step < reach):
        step += 1
        i = i[i + step < end[i]]
        for lo in range(0, len(i), 50_000):
            p = i[lo : lo + 50_000]
            q = p + step
            both = n[p] + n[q]
            ok = (den * np.minimum(n[p], n[q]) >= num * np.maximum(n[p], n[q])) & ((num + den) * np.minimum(n[p] - at[p], n[q] - at[q]) >= num * both) & (x["node"][p] != x["node"][q])
            if "c" in x:
                ok &= x["c"][p] != x["c"][q]
            if "part" in x:
                ok &= (x["part"][p] != x["part"][q]) | (x["i"][p] == x["j"][p])
            p, q, both = p[ok], q[ok], both[ok]
            if "data" in x and len(p):
                differ = np.bitwise_count(x["data"][p] ^ x["data"][q]).sum(1, dtype=np.int64)
                ok = (num + den) * differ <= (den - num) * both
                if reach:
                    # A sketch of a large set is full and tells little: neighbours by chance are those that it shows to be near.
                    ok &= differ <= NEAR
                p, q = p[ok], q[ok]
            if len(p):
                yield p, q


def _some(x: dict[str, np.ndarray], keys: tuple[str, ...], least: tuple[int, int]) -> dict[str, np.ndarray]:
    """The rows that may be similar to another of their group."""
    order = np.lexsort((x["na"], *(x[k] for k in reversed(keys))))
    x = {k: v[order] for k, v in x.items()}
    some = np.zeros(len(order), bool)
    for i, j in _pairs(x, keys, least):
        some[i] = some[j] = True
    return {k: v[some] for k, v in x.items()}


def _batch(x: dict[str, np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x[c]], pa.binary()) if c == "data" else pa.array(x[c]) for c in names], names)


def meeting(entries: DataFrame, least: tuple[int, int], names: list[str], schema: str) -> DataFrame:
    """The entries that may be similar to another of their shingle; of crowded shingles all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for x in _groups(batches, ("h", "salt", "node")):
            x = _once(x, ("h", "salt"))
            # Of crowded shingles no group is held.
            hot = x["salt"] >= 0
            if hot.any():
                yield _batch({k: v[hot] for k, v in x.items()}, names)
                x = {k: v[~hot] for k, v in x.items()}
            if not len(x["h"]):
                continue
            x = {k: np.concatenate([held[k], v]) for k, v in x.items()} if held else x
            last = int(_starts(x, ("h",))[-1])
            held = {k: v[last:] for k, v in x.items()}
            done = _some({k: v[:last] for k, v in x.items()}, ("h",), least)
            if len(done["h"]):
                yield _batch(done, names)
        if held:
            done = _some(held, ("h",), least)
            if len(done["h"]):
                yield _batch(done, names)

    return entries.repartition("h", "salt").sortWithinPartitions("h", "salt", "node").select(*names).mapInArrow(lean(run), schema)


_PLAIN, _MARKED = ["h", "node", "na", "salt"], ["h", "node", "na", "salt", "data"]


def _nearest(x: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs i, j of rows, of each two groups (c) the one whose sketches differ least; j's group is made the larger."""
    i, j = np.where(x["c"][i] < x["c"][j], (i, j), (j, i))
    order = np.lexsort((np.bitwise_count(x["data"][i] ^ x["data"][j]).sum(1, dtype=np.int64), x["c"][j], x["c"][i]))
    i, j = i[order], j[order]
    first = np.ones(len(i), bool)
    first[1:] = (x["c"][i[1:]] != x["c"][i[:-1]]) | (x["c"][j[1:]] != x["c"][j[:-1]])
    return i[first], j[first]


def _linked(rows: DataFrame, names: list[str], keys: tuple[str, ...], least: tuple[int, int], reach: int, nearest: bool = False) -> DataFrame:
    """a, b, ca, cb: pairs of nodes of different groups (ca, cb) that may be similar, of sorted rows; with nearest, for two groups and up to 50,000 pairs one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _groups(batches, keys):
            out, some = [], []
            for i, j in _pairs(x, keys, least, reach):
                if nearest:
                    some.append((i, j))
                    if sum(len(o[0]) for o in some) <= 50_000:
                        continue
                    i, j = _nearest(x, *map(np.concatenate, zip(*some, strict=True)))
                    some = [(i, j)] if len(i) <= 25_000 else []
                    if some:
                        continue
                i, j = np.where(x["node"][i] < x["node"][j], (i, j), (j, i))
                out.append((x["node"][i], x["node"][j], x["c"][i], x["c"][j]))
                if sum(len(o[0]) for o in out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["a", "b", "ca", "cb"])
                    out = []
            if some:
                i, j = _nearest(x, *map(np.concatenate, zip(*some, strict=True)))
                i, j = np.where(x["node"][i] < x["node"][j], (i, j), (j, i))
                out.append((x["node"][i], x["node"][j], x["c"][i], x["c"][j]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["a", "b", "ca", "cb"])

    return rows.select(*names).mapInArrow(lean(run), "a long, b long, ca long, cb long")


def _one_each(pairs: DataFrame) -> DataFrame:
    """Of the pairs of each group one, by chance."""
    side = lambda c: pairs.select(F.col(c).alias("c"), F.struct(F.xxhash64("a", "b").alias("h"), *pairs.columns).alias("p"))
    return side("ca").unionByName(side("cb")).groupBy("c").agg(F.min("p").alias("p")).select(*(f"p.{c}" for c in pairs.columns)).distinct()


class _Sets:
    """The sets that are compared, node, s and mark, which is kept apart as well, being small."""

    def __init__(self, of: DataFrame):
        self.of, self.marks = of.select("node", "s"), fresh(of.select("node", F.size("s").alias("n"), "mark"))

    def near(self, pairs: DataFrame, least: tuple[int, int]) -> DataFrame:
        """The pairs(a, b, ca, cb) whose marks leave open that they are similar."""
        num, den = least
        at = lambda side: self.marks.toDF(side, f"n{side}", f"m{side}")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                na, nb, ma, mb = (b.column(c).to_pylist() for c in ("na", "nb", "ma", "mb"))
                ok = [(num + den) * apart(x, y) <= (den - num) * (i + j) for i, j, x, y in zip(na, nb, ma, mb, strict=True)]
                yield b.select(["a", "b", "ca", "cb"]).filter(pa.array(ok, pa.bool_()))

        return pairs.join(at("a"), "a").join(at("b"), "b").select("a", "b", "ca", "cb", "na", "nb", "ma", "mb").mapInArrow(lean(run), "a long, b long, ca long, cb long")

    def similar(self, pairs: DataFrame, least: tuple[int, int]) -> DataFrame:
        """a, b: the groups ca and cb of the pairs(a, b, ca, cb) whose sets are at or above the similarity."""
        num, den = least
        pairs = fresh(self.near(pairs, least))
        # Of the sets only those asked for are shuffled: their names are broadcast if they are few, as in within().
        some = lambda side: within(self.of.toDF("doc_id", "s"), pairs.select(F.col(side).alias("doc_id")).distinct())
        both = pairs.join(some("a").toDF("a", "x"), "a").join(some("b").toDF("b", "y"), "b")
        shared = F.size(F.array_intersect("x", "y"))
        return fresh(both.where(shared * (num + den) >= (F.size("x") + F.size("y")) * num).select(F.col("ca").alias("a"), F.col("cb").alias("b")))


class _Labels:
    """node, c: the group of each node so far; broadcast if they are few, so that no row moves for its group."""

    def __init__(self, rows: DataFrame, many: int):
        self.rows, self.many = rows, many

    def of(self, rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(self.rows) if self.many <= FEW else self.rows, "node")

    def merged(self, joined: DataFrame) -> _Labels:
        """With groups that joined(a, b) connects made one."""
        to = components(joined).toDF("c", "to")
        return _Labels(fresh(self.rows.join(to, "c", "left").select("node", F.coalesce("to", "c").alias("c"))), self.many)


def _spread(salt: Column, node: Column, turn: int) -> Column:
    """Another part by chance for each turn, of crowded shingles."""
    return F.when(salt >= 0, F.pmod(F.xxhash64(node, F.lit(turn)), F.lit(SALTS)).cast("int")).otherwise(-1)


def _joined(rows: DataFrame, of: _Sets, labels: _Labels, least: tuple[int, int], crowd: int, turns: int = 12) -> _Labels:
    """labels, with groups made one between which rows lead to sets that are similar."""
    first = None
    for turn in range(turns):
        # A pair meets at many shingles, so a part of them does, another in each turn.
        part = rows.where(F.pmod(F.xxhash64("h", F.lit(turn)), F.lit(PARTS)) == 0)
        near = labels.of(part).withColumn("salt", _spread(F.col("salt"), F.col("node"), turn)).withColumn("place", F.xxhash64("node", F.lit(-turn)))
        near = near.repartition("h", "salt").sortWithinPartitions("h", "salt", "place")
        new = of.similar(_one_each(_linked(near, [*_MARKED, "c"], ("h", "salt"), least, 3)), least)
        many = new.count()
        if many:
            labels = labels.merged(new)
        first = first or many
        # Which links come from chance is of no account: what they leave is compared in full below.
        if many <= max(100, first // 50):
            break
    rows = fresh(_live(rows, labels).drop("c"))
    # Of each two groups the nearest pair first: what it joins leaves no pairs of all their sets.
    for _ in range(3):
        pairs = _met(rows, labels, least, crowd, True)
        lower, upper = F.least("ca", "cb"), F.greatest("ca", "cb")
        new = of.similar(pairs.groupBy(lower.alias("c"), upper.alias("d")).agg(F.min_by(F.struct("a", "b", "ca", "cb"), F.xxhash64("a", "b")).alias("p")).select("p.*"), least)
        many = new.count()
        if many:
            labels = labels.merged(new)
        if many <= max(100, first // 50):
            break
    return labels.merged(of.similar(_met(rows, labels, least, crowd, False).distinct(), least))


def _live(rows: DataFrame, labels: _Labels) -> DataFrame:
    """rows with c, and size, how many rows have the shingle; a shingle all of whose sets are one group has nothing to add."""
    marked = labels.of(rows)
    live = marked.groupBy("h").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("size")).where("low <> high")
    return marked.join(live.select("h", "size"), "h")


def _met(rows: DataFrame, labels: _Labels, least: tuple[int, int], crowd: int, nearest: bool) -> DataFrame:
    """The pairs of sets of different groups that meet at a shingle and may be similar, all or the nearest of two groups."""
    parts = F.when(F.col("size") <= 2 * crowd, 1).otherwise(F.ceil(F.col("size") / crowd)).cast("int")
    left = labels.of(rows).withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # The sets of a crowded shingle are compared part by part, each two parts in a task of their own.
    met = left.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("i", F.least("part", "with")).withColumn("j", F.greatest("part", "with"))
    met = met.select(*_MARKED, "c", "part", "i", "j").repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "na")
    return _linked(met, [*_MARKED, "c", "part", "i", "j"], ("h", "i", "j"), least, 0, nearest)


def near_copies(docs: DataFrame, width: int = 5, least: tuple[int, int] = LEAST, bits: int | None = None, crowd: int = CROWD) -> DataFrame:
    """doc_id, n (shingles), node, component, component_id, a row for each row of docs.

    node names a text's set of shingles; component is the same for all rows that links at
    or above the similarity connect, component_id the smallest doc_id among them.  With
    bits, what SimHash fingerprints of that width within so many bits propose is verified
    first, so that fewer texts are left to meet at shingles; the links are the same.

    A null text counts as empty.  Texts without words have no node, and are linked with
    nothing: their component_id is their own doc_id.  Texts of fewer words than width have
    one shingle.  Rows of a null doc_id are linked like others, but a null id is no smallest
    id: a component of such rows alone has none.  Rows of one doc_id are linked by their own
    texts, each on its own.  Equal sets are one node, however often they come.  An empty
    table gives no rows; columns other than doc_id and text are not read.

    Shingles and sets are told apart by 64-bit hashes.  Their counts cover all documents, in
    2**20 buckets; only the order of shingles hangs on them.  No more than so many sets
    (crowd, and up to 16 times that where all buckets are full) meet in one task; sets that
    more share are dealt out by chance, and compared part by part.
    """
    named = fresh(_named(docs, width, bits is not None))
    counts = frequencies(named)
    named = named.where("block is null").select("doc_id", "node", "n", "data", "fp")
    nodes = fresh(named.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("data").alias("data"), F.first("fp").alias("fp")))
    entries = meeting(prefixes(docs, width, least, counts, crowd), least, _PLAIN, "h long, node long, na long, salt int")
    marked = entries.join(nodes.select("node", "data"), "node")
    rows = fresh(meeting(marked, least, _MARKED, "h long, node long, na long, salt int, data binary"))
    wanted = rows.select("node")
    if bits is not None:
        codes = fresh(nodes.groupBy("fp").agg(F.min("node").alias("rep")))
        same = nodes.join(codes.select("fp", F.col("rep").alias("a")), "fp").where("node <> a").select("a", F.col("node").alias("b"))
        proposed = fresh(links(codes, bits).unionByName(same).distinct())
        wanted = wanted.unionByName(proposed.select(F.explode(F.array("a", "b")).alias("node")))
    wanted = fresh(nodes.join(wanted.distinct(), "node", "left_semi").select("node", "rep"))
    of = _Sets(sets(docs, width, wanted))
    labels = _Labels(wanted.select("node", F.col("node").alias("c")), wanted.count())
    if bits is not None:
        labels = labels.merged(of.similar(proposed.withColumn("ca", F.col("a")).withColumn("cb", F.col("b")), least))
    labels = _joined(rows, of, labels, least, crowd).rows
    grouped = nodes.join(labels, "node", "left").select("node", "rep", F.coalesce("c", "node").alias("component"))
    smallest = grouped.groupBy("component").agg(F.min("rep").alias("component_id"))
    groups = grouped.join(smallest, "component").select("node", "component", "component_id")
    known = F.col("node").isNotNull()
    return named.join(groups, "node", "left").select("doc_id", "n", "node", "component", F.when(known, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
