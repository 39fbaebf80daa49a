"""What a worker process remembers between tasks: one operator's memo at a time."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable

_memos: dict[tuple[str, object], object] = {}


def memo(owner: str, key: object, make: Callable[[], object]) -> object:
    """The worker's object for (owner, key); what it had for others goes, so memory doesn't add up over stages."""
    if (owner, key) not in _memos:
        forget()
        _memos[owner, key] = make()
    return _memos[owner, key]


def forget() -> None:
    """Called by tasks that need the memory for themselves; what is freed goes back to the system."""
    if _memos:
        _memos.clear()
        gc.collect()
    trim()


def trim() -> None:
    """What this worker has freed, by Arrow or by the C library, goes back to the system; else it stays with the worker over stages."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)
