"""Python workers that give memory back.

Workers serve many tasks, one after the other.  The allocator would keep what a task
has freed, because arrays of some megabytes share its heap with what lives on; large
arrays are therefore mapped on their own, and the rest is trimmed when a task ends.
What an operator remembers from task to task goes when a worker turns to other work.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

#: Arrays from this size on are mapped on their own.
MAPPED = 1 << 20
_M_MMAP_THRESHOLD = -3  # fixed value of the C library


#: owner -> how to forget what it remembers in this worker.
FORGET: dict[str, Callable[[], None]] = {}


def tidy(run: Run, owner: str | None = None) -> Run:
    """``run`` for mapInArrow, leaving nothing behind in the worker but what its ``owner`` remembers."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from gridmill.llm.workers import FORGET

        for name in [k for k in FORGET if k != owner]:
            FORGET.pop(name)()
        libc = ctypes.CDLL(None)
        if hasattr(libc, "mallopt"):
            libc.mallopt(_M_MMAP_THRESHOLD, MAPPED)
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

    return inner
