"""Memory of Python workers, which Spark keeps for later tasks."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def release() -> None:
    """Give freed memory back to the system. Arrays of a few MB come and go with every slice of texts, and the allocator keeps them."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)
