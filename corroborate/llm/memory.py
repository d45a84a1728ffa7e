"""Memory of Python workers, which outlive their tasks and share the executor with its JVM."""

from __future__ import annotations

import ctypes
import functools
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def give_back() -> None:
    """Return freed memory to the system, which allocators otherwise keep for later."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def frugal(step: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``step`` over the batches of a task; at its end the worker keeps only what is in use."""

    @functools.wraps(step)
    def run(batches):
        try:
            yield from step(batches)
        finally:
            give_back()

    return run
