"""What a Python worker no longer uses goes back to the system.

Workers stay for later tasks beside the JVM, some to a task where Python steps
follow each other; what their allocators keep would count against the executor.
"""

from __future__ import annotations

import ctypes
from functools import cache

import pyarrow as pa


@cache
def _malloc_trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library has no such call, and needs none
        return lambda pad: 0


def trim() -> None:
    pa.default_memory_pool().release_unused()
    _malloc_trim()(0)
