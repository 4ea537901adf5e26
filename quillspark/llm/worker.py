"""What a Python worker keeps from one task to the next.

Spark runs the tasks of all stages in the same workers. A worker holds the models of
one operator at a time, and gives freed memory back when a task starts and when it ends.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa

_held: dict[str, Callable[[], None]] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def hold(name: str, clear: Callable[[], None]) -> None:
    """From now on the models of operator ``name`` are kept here, which ``clear`` drops; those of another one are dropped."""
    if name not in _held:
        while _held:
            _held.popitem()[1]()
        _held[name] = clear


def release() -> None:
    """Give memory that nothing uses any longer back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)
