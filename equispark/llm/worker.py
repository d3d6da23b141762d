"""What a Python worker holds from one task to the next."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa

_held: dict[Hashable, Any] = {}


def alone(key: Hashable, make: Callable[[], Any] = lambda: None) -> Any:
    """The one large helper a worker keeps; the one of an earlier stage is let go and its memory given back.

    Idle workers of all stages count as an executor's memory, and any of them may run
    any stage's task. Stages without a helper ask for none by a name of their own.
    """
    if key not in _held:
        _held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
        if trim:
            trim(0)
        _held[key] = make()
    return _held[key]
