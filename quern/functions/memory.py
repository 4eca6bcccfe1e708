"""Memory of a Python worker that is free already: what is kept for later is given back, as workers live on between tasks."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def give_back() -> None:
    """Arrow's spare pages, and the C library's where it can: else a worker grows with each segment or block that it has held."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
