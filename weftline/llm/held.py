"""One large table for each worker process.

Workers live on from one operator to the next. What an operator keeps between tasks (vocabularies,
hashes of words, powers) is held here, and goes as soon as another operator asks for its own.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable
from typing import Any

_held: dict[Any, Any] = {}


def held(key, make: Callable[[], Any]):
    """What make() gave the last time, if nothing else was asked for since."""
    if key not in _held:
        if _held:
            _held.clear()
            gc.collect()
            trimmed()
        _held[key] = make()
    return _held[key]


def trimmed() -> None:
    """Give freed memory back, where the C library can."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidied(run: Callable) -> Callable:
    """run, a function of Arrow batches, and then trimmed(): a worker that waits holds little beside its table."""

    @functools.wraps(run, assigned=())
    def run_and_trim(batches):
        try:
            yield from run(batches)
        finally:
            trimmed()

    return run_and_trim
