"""SentencePiece encoding and decoding by a Viterbi recursion over a shared-prefix trie.

A text is marked (white space becomes the mark, one in front) and cut before each run of
marks; pieces never cross such a cut.  The distinct marked words, sorted, are the leaves of
a trie in depth-first order, and the forward table of a word keeps what it shares with the
one before: each prefix is scored once.

For a unigram model an entry is the best score of the prefix and its last piece.  For a BPE
model scores are merge ranks, whose largest sum is not what the library gives; there the
recursion admits a last piece if merging leaves it and the piece before it apart, which
holds for exactly one, so an entry is again one last piece, and ids equal the library's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordweave.llm.chunks import Known

MARK = "▁"
_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_models: dict[str, Model] = {}


class Model:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        n = spec.normalizer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"{path} rewrites text before it is cut; only models that take it as it is are supported")
        self.prefix, self.bpe, self.by_byte = n.add_dummy_prefix, spec.trainer_spec.model_type == 2, spec.trainer_spec.byte_fallback
        kinds = {"normal": 1, "unknown": 2, "byte": 6}
        self.name = [p.piece for p in spec.pieces]
        self.kind = [p.type for p in spec.pieces]
        self.id = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == kinds["normal"]}
        self.score = {p.piece: p.score for p in spec.pieces if p.type == kinds["normal"]}
        self.unknown = next(i for i, p in enumerate(spec.pieces) if p.type == kinds["unknown"])
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == kinds["byte"]}
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError(f"{path} has pieces that cross words")
        self.longest = max(map(len, self.id))
        self.ends = self._ends()
        self.code = {p: i.to_bytes(4, "little") for p, i in self.id.items()}
        self.bytes = [self._spelt(i) for i in range(len(self.name))]
        self.penalty = min(self.score.values()) - 10  # fixed value: the library's score of an unknown character
        self.apart: dict[int, bool] = {}  # by the numbers of the left and the right piece
        self.known = Known(self.words, 300_000)

    def _ends(self) -> dict[str, tuple[int, ...]]:
        """The lengths, longest first, that a piece with these last four characters may have; all may have 3 and 2."""
        found: dict[str, set[int]] = {}
        for p in self.id:
            if len(p) > 3:
                found.setdefault(p[-4:], set()).add(len(p))
        return {end: (*sorted(lengths, reverse=True), 3, 2) for end, lengths in found.items()}

    def _spelt(self, i: int) -> bytes:
        """What id i decodes to."""
        if self.kind[i] == 6:
            return bytes([int(self.name[i][3:5], 16)])
        if self.kind[i] == 2:
            return " ⁇ ".encode()
        return b"" if self.kind[i] == 3 else self.name[i].replace(MARK, " ").encode("utf-8", "surrogatepass")

    def merged(self, text: str) -> list[str]:
        """The pieces of a word by merging: the best-scored neighbours first, then the leftmost."""
        part, size, score = list(text), len(text), self.score
        heap = [(-s, i) for i in range(size - 1) if (s := score.get(part[i] + part[i + 1])) is not None]
        if not heap:
            return part
        heapify(heap)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        while heap:
            s, i = heappop(heap)
            j = after[i]
            if part[i] == "" or j >= size or score.get(part[i] + part[j]) != -s:
                continue
            part[i] += part[j]
            part[j] = ""
            after[i] = k = after[j]
            if k < size:
                before[k] = i
                if (s := score.get(part[i] + part[k])) is not None:
                    heappush(heap, (-s, i))
            if (h := before[i]) >= 0 and (s := score.get(part[h] + part[i])) is not None:
                heappush(heap, (-s, h))
        return [p for p in part if p]

    def _number(self, piece: str) -> int:
        """The id of a piece; a character that is none counts from after them."""
        i = self.id.get(piece)
        return len(self.name) + ord(piece) if i is None else i

    def _apart(self, key: int, left: str, right: str) -> bool:
        """Whether merging leaves these neighbours as they are; an empty left asks whether it makes the piece at all."""
        if len(self.apart) >= 400_000:
            self.apart.clear()
        known = self.apart[key] = self.merged(left + right) == ([left, right] if left else [right])
        return known

    def words(self, new: list[str]) -> list[bytes]:
        """The ids of these distinct marked words, as little-endian 32-bit numbers, in their order."""
        walk = self._walk_bpe if self.bpe else self._walk
        done = dict(walk(sorted(new)))
        return [done[w] for w in new]

    def _walk_bpe(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each word with its ids, depth-first: the lists hold what is known of each prefix of the word before."""
        number, code, ends, apart, base = self.id, self.code, self.ends, self.apart, len(self.name) + 0x110000
        held = ""
        last, piece_of, ids = [base - 1], [""], [b""]  # the last piece's number (before the first: one that no character has), the piece, all ids
        for word in words:
            if word.startswith(MARK * 2):  # pieces of marks alone tie in score, so the last piece is not settled by the prefix
                yield word, self.ids(self.merged(word))
                continue
            shared = 0
            for a, b in zip(held, word, strict=False):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :], piece_of[shared + 1 :], ids[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for n in ends.get(word[end - 4 : end], (3, 2)) if end > 3 else (3, 2):
                    if (at := end - n) >= 0 and (right := number.get(piece := word[at:end])) is not None:
                        key = last[at] * base + right
                        fits = apart.get(key)
                        if self._apart(key, piece_of[at], piece) if fits is None else fits:
                            coded = code[piece]
                            break
                else:  # what no longer piece ends ends in a piece of its own
                    at, piece = end - 1, word[end - 1]
                    right, coded = self._number(piece), self.ids([piece])
                    if not self.by_byte and right >= len(self.name) and last[at] >= len(self.name) and at:
                        coded = b""  # the library joins unknown characters in a row
                last.append(right)
                piece_of.append(piece)
                ids.append(ids[at] + coded)
            held = word
            yield word, ids[-1]

    def _walk(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        held, length, best = "", [0], [0.0]  # of each prefix of held: the last piece's length, the best score
        for word in words:
            shared = 0
            for a, b in zip(held, word, strict=False):
                if a != b:
                    break
                shared += 1
            del length[shared + 1 :], best[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                self._step(word, end, length, best)
            held, out, end = word, [], len(word)
            while end:
                out.append(word[end - length[end] : end])
                end -= length[end]
            yield word, self.ids(out[::-1])

    def _step(self, word: str, end: int, length: list, best: list) -> None:
        take, high = 1, best[end - 1] + self.score.get(word[end - 1], self.penalty)
        for n in range(2, min(end, self.longest) + 1):
            s = self.score.get(word[end - n : end])
            if s is not None and best[end - n] + s >= high:  # among equals the library takes the longer last piece
                take, high = n, best[end - n] + s
        length.append(take)
        best.append(high)

    def ids(self, parts: list[str]) -> bytes:
        codes = [self.code.get(p) for p in parts]
        if None not in codes:
            return b"".join(codes)
        out: list[int] = []
        for p in parts:
            i = self.id.get(p)
            if i is not None:
                out.append(i)
            elif self.by_byte:
                out += [self.byte[b] for b in p.encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unknown:  # the library joins unknown characters in a row
                out.append(self.unknown)
        return np.array(out, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        units = [_UNIT.findall((MARK if self.prefix else "") + t.replace(" ", MARK)) if t else [] for t in texts]
        look = self.known.of(units)
        return [b"".join(map(look, u)) for u in units]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def model(path: str) -> Model:
    """The model of a file, once for each Python worker."""
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def encode(docs: DataFrame, path: str, carry: tuple[str, ...] = (), batch: int = 500) -> DataFrame:
    """doc_id, n_pieces, ids (little-endian unsigned 32-bit), and the columns to carry: a row for each row of docs(doc_id, text).

    Equal to the library's encoding of the whole text.  A null text counts as empty and
    has no pieces; repeated rows and null doc_ids stay as they are; other columns are not
    read.  No shuffle; tables of bounded size, and a batch of `batch` texts at a time.
    """
    rows = docs.select(F.col("doc_id").cast("long"), *carry, F.coalesce("text", F.lit("")).alias("text"))
    kept = [c for c in rows.columns if c != "text"]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, batch):
                b = whole.slice(lo, batch)
                ids = model(path).encode(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], [*kept, "n_pieces", "ids"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(kept).schema)
    return rows.mapInArrow(encoded, f"{schema}, n_pieces long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded(..., ids) with the column text that the ids spell; null ids spell null."""
    kept = encoded.columns

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if x is None else model(path).decode(np.frombuffer(x, "<u4")) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(decoded, f"{schema}, text string")
