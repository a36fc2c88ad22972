"""Packing: concatenate and cut.

All documents are one stream of ids, each document closed by an end id, and the stream is
cut into fixed windows.  Pass one writes, for every input partition, its documents with
their offsets inside the partition, once, to the shared folder; the partition totals are
summed to the global offset of each partition.  Pass two cuts every document at the
multiples of the window length.  No document is shuffled.  Windows that begin in one
partition and end in another are assembled from boundary records.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordweave.llm.chunks import Known, at_chunks, gathered, parted
from recordweave.llm.common import cut, give_back, lean

_TOKENS = "part int, at long, doc_id long, n long, ids binary"
_PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
#: Pieces that a task makes at once, some kilobytes each.
AT_ONCE = 2000
_encoders: dict[str, tuple] = {}


def _encoder(path: str):
    """(tokenizer, table of chunks or None, special strings, width of an id in bytes), once for each Python worker."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        wide = "<u2" if tok.get_vocab_size() <= 1 << 16 else "<u4"
        pre = spec.get("pre_tokenizer") or {}
        apart = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")

        def encode(texts):
            return (np.array(e.ids, wide).tobytes() for e in tok.encode_batch_fast(texts, add_special_tokens=False))

        _encoders[path] = encode, Known(encode) if apart else None, [t["content"] for t in spec.get("added_tokens", [])], np.dtype(wide)
    return _encoders[path]


def _ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids, in the narrowest width, equal to encoding whole texts; and how many came before each text and in all."""
    encode, known, special, wide = _encoder(path)
    if known is None:
        return gathered(list(encode(texts.to_pylist())), np.arange(len(texts)), wide)
    whole = np.zeros(len(texts), bool)
    for s in special:
        whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
    chunks, at, before = parted(texts, at_chunks, whole)
    ids, n = gathered(list(map(known.look(chunks), chunks)), at, wide)
    return ids, n[before]


def _binary(ids: np.ndarray, n: np.ndarray) -> pa.Array:
    """ids, n[i] of them in the i-th value."""
    ends = np.concatenate([[0], np.cumsum(n)]) * ids.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(ids)]).cast(pa.binary())


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = 0, batch: int = 1000) -> DataFrame:
    """doc_id, ids (little-endian, as wide as the vocabulary needs), n, and the place: part and at, the tokens before it there.

    Computed once, in the order of the input's partitions, and kept in the shared folder.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        _, known, _, wide = _encoder(tokenizer)
        for whole in batches:
            for lo in range(0, whole.num_rows, batch):
                b = whole.slice(lo, batch)
                ids, ends = _ids(b.column("text"), tokenizer)
                ids, n = np.insert(ids, ends[1:], end_id), np.diff(ends) + 1
                before = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), pa.array(before), b.column("doc_id"), pa.array(n), _binary(ids, n)], ["part", "at", "doc_id", "n", "ids"])
        # The worker waits on while the ids are cut and written, and most chunks of a task are its own.
        if known:
            known.table.clear()
        give_back()

    return cut(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(encode, _TOKENS))


def concat_and_cut(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 0) -> DataFrame:
    """One row for each piece of a document: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    ids are little-endian unsigned 32-bit.  Pieces fill the windows without a gap, so only
    the last window of all has padding.  A null or empty text is the end id alone, in one
    piece; repeated rows are packed as often as they come; a null doc_id stays null; an
    empty table gives no piece; columns other than doc_id and text are not read.  The
    order is that of the input's partitions and rows.
    """
    tokens = tokenize(docs, tokenizer, end_id)
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row of 12 bytes for each input partition, so its size is bounded by the number of tasks of one stage.
    bases = F.broadcast(totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")))
    placed = tokens.join(bases, "part").select("doc_id", "ids", "n", (F.col("base") + F.col("at")).alias("at"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = _encoder(tokenizer)[3]
        for b in batches:
            n, at = b.column("n").to_numpy(), b.column("at").to_numpy()
            first, last = at // length, (at + n - 1) // length
            many = last - first + 1
            row = np.repeat(np.arange(len(n)), many)
            window = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + first[row]
            lo = np.maximum(window * length, at[row])
            hi = np.minimum((window + 1) * length, (at + n)[row])
            start = lo - at[row]
            for x in range(0, len(row), AT_ONCE):
                s = slice(x, x + AT_ONCE)
                held, ids = -1, []
                for r, a, k in zip(row[s].tolist(), start[s].tolist(), (hi - lo)[s].tolist(), strict=True):
                    if r != held:
                        held, all_ids = r, np.frombuffer(b.column("ids")[r].as_buffer(), wide)
                    ids.append(all_ids[a : a + k].astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row[s])), *map(pa.array, (start[s], (hi - lo)[s], n[row[s]], window[s], (lo - window * length)[s])), pa.array(ids, pa.binary())], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return placed.mapInArrow(lean(pieces), _PIECES)


def sequences(pieces: DataFrame, length: int = 1024) -> DataFrame:
    """The packed windows: sequence_id, n_tokens, ids (n_tokens little-endian 32-bit ids).

    A window whose pieces follow each other in one task is put together there; the rest,
    at most two for each task and partition, are boundary records and meet by a shuffle.
    n_tokens is length except for the last window, which the reader pads to length, or
    leaves as it is where n_tokens is a power of two.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # sequence_id, offset, and the ids so far

        def row(x):
            return {"sequence_id": x[0], "offset": x[1], "ids": b"".join(x[2])}

        for b in batches:
            out = []
            for q, o, n, ids in zip(*(b.column(c).to_pylist() for c in ("sequence_id", "offset", "length", "ids")), strict=True):
                if held and held[0] == q and held[3] == o:
                    held[2].append(ids)
                    held[3] += n
                else:
                    if held:
                        out.append(row(held))
                    held = [q, o, [ids], o + n]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if held:
            yield pa.RecordBatch.from_pylist([row(held)], schema)

    schema = pa.schema([("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
    run = pieces.select("sequence_id", "offset", "length", "ids").mapInArrow(lean(runs), "sequence_id long, offset long, ids binary")
    whole = F.octet_length("ids") == 4 * length
    split_up = run.where(~whole).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    joined = split_up.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
    return run.where(whole).select("sequence_id", "ids").unionByName(joined).select("sequence_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")
