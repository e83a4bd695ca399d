"""What a Python worker keeps between tasks.

Spark reuses workers, and idle ones of an earlier operator share the
executor's memory with busy ones. A worker therefore keeps the cache of one
operator only and gives freed memory back to the system.
"""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Callable, Iterator

import pyarrow as pa

_KEPT: dict[str, object] = {}


def worker_cache[T](kind: str, make: Callable[[], T]) -> T:
    """The cache of this kind, made when first asked for; caches of other kinds go then."""
    if kind not in _KEPT:
        if _KEPT:
            _KEPT.clear()
            give_back()
        _KEPT[kind] = make()
    return _KEPT[kind]


def give_back() -> None:
    """Return what the allocators hold but don't use."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(ctypes.util.find_library("c") or "libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


#: Bytes of a slice, if it has more than one row.
SLICE_BYTES = 2 << 20


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES, keep: str = "word hashes") -> Iterator[pa.RecordBatch]:
    """Smaller batches by bytes, so that a worker holds few texts as objects; a cache other than ``keep`` goes."""
    if _KEPT and keep not in _KEPT:
        _KEPT.clear()
        give_back()
    for batch in batches:
        yield from parts_of(batch, most)
        del batch
    give_back()


def parts_of(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Halves of halves, until each has ``most`` bytes at most or one row."""
    if len(batch) <= 1 or batch.nbytes <= most:
        yield batch
    else:
        half = len(batch) // 2
        yield from parts_of(batch.slice(0, half), most)
        yield from parts_of(batch.slice(half), most)
