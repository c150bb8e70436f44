"""Memory of Python workers."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import pyarrow as pa


def give_back() -> None:
    """Return freed memory to the system: Arrow's pool and, where the C library can (glibc), its heap keep it otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):
        ctypes.CDLL(None).malloc_trim(0)


@contextlib.contextmanager
def tidy() -> Iterator[None]:
    """For the work of a task: a worker that waits, or serves another stage next, does not hold what this one has freed."""
    try:
        yield
    finally:
        give_back()
