"""Memory of Python workers, which Spark keeps for later tasks."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def give_back() -> None:
    """Return what the allocators hold but don't use to the system, so that an idle worker is small."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
