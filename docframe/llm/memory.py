"""Memory of Python workers, which live on between tasks."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa

Batches = Iterator[pa.RecordBatch]


def release() -> None:
    """Gives freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def released(work: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """The same work on batches; afterwards the worker keeps no memory of it."""

    @functools.wraps(work)
    def run(batches: Batches) -> Batches:
        yield from work(batches)
        release()

    return run
