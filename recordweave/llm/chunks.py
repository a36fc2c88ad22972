"""White-space chunks of a text that a byte-level BPE encodes independently of each other.

The pre-tokenizer of byte-level BPE never joins a letter, digit or symbol run with what
follows the next white space, and gives a word at most one space before it.  So the text
splits into chunks, each one optional space and a run without white space, or white space
alone, and the encoding of a text is that of its chunks in order.  Chunks repeat very
often, texts do not: what is known of a chunk is kept, in a table of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa

#: One space and a run, or white space as the pre-tokenizer takes it: a run of it leaves its last character to what follows.
CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Python counts these as white space and the pre-tokenizer does not: a text with one is not split.
ODD = re.compile("[\x1c-\x1f]")
#: Characters of the longest chunk, and number of chunks, that a task keeps.
LONGEST, BOUND = 64, 600_000


def split(text: str) -> list[str]:
    """The chunks of a text; joined, they are the text.  A text with an ODD character is one chunk."""
    return CHUNK.findall(text) if not ODD.search(text) else [text]


def _table(some: Iterable[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(some)] = True
    return out


SPACE = _table((0x20, *range(0x09, 0x0E)))
#: Bytes with A-Z lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_LETTER = _table((*range(0x41, 0x5B), *range(0x61, 0x7B)))
_WIDE = _LETTER | _table(range(0x80, 0x100))
_SIGN = _table((*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)))
# Of white space beyond ASCII: bytes that one may begin with, end with, and have before the last.
_LEAD, _LAST, _LATE = _table((0xC2, 0xE1, 0xE2, 0xE3)), _table((*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF)), _table((0xC2, 0x9A, 0x80, 0x81))


def at_chunks(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where chunks begin, from the bytes of texts that begin at first; next to white space beyond ASCII some are left out.

    A run of white space leaves its last character to what follows, which joins it if it is a space.
    A run of letters ends where a sign follows.
    """
    space = SPACE[data]
    w = np.flatnonzero(space)
    begin = w[~space[w - 1] & ~(_LAST[data[w - 1]] & _LATE[data[w - 2]])]
    begins = np.zeros(len(data) + 1, bool)
    begins[first] = begins[-1] = True
    w = w[~begins[w + 1]]
    last = w[~space[w + 1] & ~_LEAD[data[w + 1]]]
    sign = np.flatnonzero(_SIGN[data])
    before = data[sign - 1]
    # U+00C0 to U+00FF are letters but for two.
    latin = (data[sign - 2] == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)
    signs = sign[_LETTER[before] | latin]
    return np.concatenate([begin, last, last[data[last] != 0x20] + 1, signs])


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where texts (none null) begin, and the end of the last, and their bytes."""
    texts = texts.cast(pa.string())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    return ends - ends[0], np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)


def letters(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """As parted(), of the runs of ASCII letters and of all characters beyond ASCII alone.

    How a capital sigma is lower-cased hangs on what stands around it, up to white space:
    where there is one, the runs are those without white space.
    """
    ends, data = bytes_of(texts)
    in_run = ~SPACE[data] if b"\xce\xa3" in data.tobytes() else _WIDE[data]
    begin, stop = in_run.copy(), in_run.copy()
    begin[1:] &= ~in_run[:-1]
    first = ends[:-1][ends[:-1] < len(data)]
    begin[first] = in_run[first]
    stop[:-1] &= ~in_run[1:] | begin[1:]
    at = np.flatnonzero(begin)
    if not len(at):
        return [], np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    offsets = np.zeros(len(at) + 1, np.int32)
    np.cumsum(np.flatnonzero(stop) + 1 - at, out=offsets[1:])
    found = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data[in_run])).dictionary_encode()
    return found.dictionary.to_pylist(), found.indices.to_numpy(), np.searchsorted(at, ends)


def parted(texts: pa.Array, places: Callable[[np.ndarray, np.ndarray], np.ndarray], whole: np.ndarray | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct parts of texts (none null), the number of each part in order, and how many parts came before each text and in all.

    places gives where parts begin, besides texts, from all bytes and the texts' first ones;
    texts marked in whole are one part.
    """
    ends, data = bytes_of(texts)
    if not len(data):
        return [], np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    mark = np.zeros(ends[-1] + 1, bool)
    mark[places(data, ends[:-1][ends[:-1] < ends[-1]])] = True
    for i in np.flatnonzero(whole) if whole is not None else ():
        mark[ends[i] : ends[i + 1]] = False
    mark[ends] = True
    at = np.flatnonzero(mark).astype(np.int32)
    found = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data)).dictionary_encode()
    return found.dictionary.to_pylist(), found.indices.to_numpy(), np.searchsorted(at, ends)


def gathered(made: list[bytes], at: np.ndarray, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The values of made[i] for each i of at, one after the other, and how many came before each and in all."""
    size = np.fromiter(map(len, made), np.int64, len(made)) // np.dtype(dtype).itemsize
    begin, n = np.cumsum(size) - size, size[at]
    before = np.concatenate([[0], np.cumsum(n)])
    place = np.repeat(begin[at] - before[:-1], n)
    place += np.arange(len(place))
    return np.frombuffer(b"".join(made), dtype)[place], before


class Known:
    """A bounded table from chunks to what `make` gives for a list of new ones."""

    def __init__(self, make: Callable[[list[str]], Iterable], bound: int = BOUND):
        self.make, self.bound, self.table = make, bound, {}

    def of(self, texts: list[list[str]]) -> Callable:
        """Learns the chunks of these texts and returns the look-up.

        A full table starts again with the chunks of these texts; chunks over LONGEST
        characters are looked up for these texts alone.
        """
        return self.look(set().union(*texts))

    def look(self, now: Iterable[str]) -> Callable:
        """As of(), for distinct chunks."""
        new = [c for c in now if c not in self.table]
        if len(self.table) + len(new) > self.bound:
            self.table = {c: self.table[c] for c in now if c in self.table}
        made = dict(zip(new, self.make(new), strict=True)) if new else {}
        long = {c: made.pop(c) for c in new if len(c) > LONGEST}
        self.table.update(made)
        return (self.table | long).__getitem__ if long else self.table.__getitem__
