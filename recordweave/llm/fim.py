"""Fill-in-middle transformation: texts cut at two chosen tokens and put together in another order.

One match of the regex library cuts a text: of a repeated group every repetition is kept,
so the ends of the group's captures are the ends of all tokens.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
#: White space and the word after it, or white space that no word follows; possessive, so nothing is tried twice.
TOKENS = regex.compile(r"([\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)*+")
_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
#: Characters of output that a task holds before it passes them on.
HELD = 4_000_000


def draws(doc_id: int | None, seed: int = 42) -> tuple[int, int, int, int]:
    """Four unsigned numbers of 32 bits from the seed and the id; a null id counts as empty text."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))


def cut_text(text: str, doc_id: int | None, fim_percent: int = 50, spm_percent: int = 80, seed: int = 42) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix and middle lengths in code points (null if plain), output."""
    ends = TOKENS.fullmatch(text).ends(1)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= fim_percent or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (low, high))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_percent:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, fim_percent: int = 50, spm_percent: int = 80, seed: int = 42) -> DataFrame:
    """doc_id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars, output: a row for each row of docs.

    A null text counts as empty, has no token and is plain; so is a text that holds one of
    the marks.  A text of white space alone is one token.  Where both cuts fall together the
    middle is empty; prefix and suffix may be empty as well.  A null doc_id draws as empty
    text, repeated ids draw alike.  Whole texts of any length are cut, in one pass; an empty
    table gives no rows; columns other than doc_id and text are not read.  Every row is made
    in its own task, so nothing is shuffled.
    """
    names = [c.split()[0] for c in _SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for b in batches:
            for i, t in zip(b.column("doc_id"), b.column("text"), strict=True):
                i, t = i.as_py(), t.as_py()
                rows.append((i, *cut_text(t, i, fim_percent, spm_percent, seed)))
                held += len(t) + 100
                if held > HELD:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, _SCHEMA)


def restored(form: Column, output: Column) -> Column:
    """The exact text, from form and output alone: no part holds a mark, and no mark can arise where two meet."""
    part = F.split(output, "<[PSM]>", -1)
    at = lambda k: F.get(part, F.lit(k))
    return F.when(form == "psm", F.concat(at(1), at(3), at(2))).when(form == "spm", F.concat(at(2), at(3), at(1))).otherwise(output)
