"""Arrow functions in small parts: a task holds Python objects of few rows at a time, however many rows a batch has."""

from __future__ import annotations

import ctypes
from collections.abc import Callable
from functools import cache

import pyarrow as pa

#: Rows of which a task holds Python objects at once; what is made of them goes to Arrow before the next.
ROWS = 250


@cache
def _trim() -> Callable | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def by_slices(made: Callable[..., pa.Array], *columns: pa.Array) -> pa.Array:
    """made(*columns), slice by slice; what was freed goes back to the system, as workers live on."""
    parts = [made(*(c.slice(lo, ROWS) for c in columns)) for lo in range(0, max(len(columns[0]), 1), ROWS)]
    out = pa.concat_arrays(parts) if len(parts) > 1 else parts[0]
    del parts
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)
    return out
