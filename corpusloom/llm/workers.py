"""What Python workers keep. They outlive their tasks and stages, and an executor may have more of them than cores.

In a pipeline each worker runs every operator in turn, so what one of them leaves there is added to the need of the next.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa

#: The cache of words whose turn it is in this worker.
_TURN: list[dict] = []
#: Gives free memory of C's heap back; only glibc has it.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def take_turn(cache: dict) -> None:
    """Empty the cache that another operator filled in this worker before."""
    if not (_TURN and _TURN[0] is cache):
        for other in _TURN:
            other.clear()
        _TURN[:] = [cache]


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, for operators that work on whole texts: what became free while one was worked on goes back before the next comes, and after the last."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
        if _TRIM:
            _TRIM(0)
