"""Token counts: byte-pair merging on a heap and a linked list, without identifiers.

The symbols of a pre-token form a doubly linked list; a heap holds the ranks of its
adjacent pairs, the leftmost first among equals.  The lowest is popped and merged until no
pair has a rank: the count is the number of first symbols less the number of merges.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordweave.llm.chunks import Known, split

#: Fixed value: the pattern of byte-level BPE before the merges.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_models: dict[str, Model] = {}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or from U+0100 on, in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Model:
    """The merges of a vocabulary file and the counts of the chunks seen so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or spec.get("normalizer") or pre.get("add_prefix_space"):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        vocab = spec["model"]["vocab"]
        self.byte = [vocab[c] for c in byte_symbols()]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.merge = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.pre_token = regex.compile(PRE_TOKEN)
        self.words: dict[str, int] = {}
        self.known = Known(lambda new: [sum(map(self.word, self.pre_token.findall(c))) for c in new])

    def word(self, text: str) -> int:
        """The count of one pre-token; those of up to 32 characters are kept, 200,000 at most."""
        n = self.words.get(text)
        if n is None:
            n = self.count([self.byte[b] for b in text.encode()])
            if len(text) <= 32:
                if len(self.words) >= 200_000:
                    self.words.clear()
                self.words[text] = n
        return n

    def count(self, symbols: list[int]) -> int:
        """First symbols minus merges; `symbols` is used up."""
        size, merge = len(symbols), self.merge
        if size < 2:
            return size
        # An entry is rank * size + position: the lowest rank, then the leftmost.
        heap = [m[0] * size + i for i in range(size - 1) if (m := merge.get((symbols[i], symbols[i + 1])))]
        if not heap:
            return size
        heapify(heap)
        after, before, merges = list(range(1, size + 1)), list(range(-1, size - 1)), 0
        while heap:
            rank, i = divmod(heappop(heap), size)
            j = after[i]
            if j >= size or symbols[i] < 0:
                continue
            m = merge.get((symbols[i], symbols[j]))
            if m is None or m[0] != rank:  # an entry of a pair that has changed since
                continue
            merges += 1
            symbols[i], symbols[j] = m[1], -1
            after[i] = k = after[j]
            if k < size:
                before[k] = i
                if m := merge.get((symbols[i], symbols[k])):
                    heappush(heap, m[0] * size + i)
            if (h := before[i]) >= 0 and (m := merge.get((symbols[h], symbols[i]))):
                heappush(heap, m[0] * size + h)
        return size - merges

    def texts(self, texts: list[str]) -> list[int]:
        """The count of each text; a special string counts as one and parts its neighbours."""
        parts, specials = [], []
        for t in texts:
            if self.special and self.special.search(t):
                between = self.special.split(t)
                parts.append([c for x in between for c in split(x)])
                specials.append(len(between) - 1)
            else:
                parts.append(split(t))
                specials.append(0)
        look = self.known.of(parts)
        return [sum(map(look, p)) + s for p, s in zip(parts, specials, strict=True)]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, batch: int = 1000) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit, one row for each row of docs.

    A null text counts as empty: no bytes, no tokens.  Repeated rows and null doc_ids give
    a row each; columns other than doc_id and text are not read.  No shuffle; a task's
    memory is its largest batch of `batch` texts and tables of bounded size.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _models:
            _models[tokenizer] = Model(tokenizer)
        for whole in batches:
            for lo in range(0, whole.num_rows, batch):
                b = whole.slice(lo, batch)
                n = _models[tokenizer].texts(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(counts, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
