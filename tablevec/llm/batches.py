"""Small helpers for work inside tasks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

BATCH_BYTES = 8_000_000
LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


# large buffers go back to the system at once, so that a worker does not keep its peak while others run
pa.set_memory_pool(pa.system_memory_pool())
_libc = ctypes.CDLL(None)
if hasattr(_libc, "mallopt"):
    _libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, else it grows with what was allocated


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; from now on its session hands Python no more than about ``BATCH_BYTES`` at once, whatever the length of a row.

    A lower limit of the session stays.
    """
    conf = df.sparkSession.conf
    now = conf.get(LIMIT).removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(LIMIT, f"{BATCH_BYTES}b")
    return df


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Record batches cut to at most ``rows`` rows, so that what a task holds beside them stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def release() -> None:
    """Drop the caches that this worker keeps and give free memory back to the system."""
    if _live:
        _live.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def lean(work: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` without the caches of earlier operators beside it; nothing of its own stays in the worker, which idles on for a while."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        yield from work(batches)
        release()

    return run


class Cache(dict):
    """A dict that forgets everything once it holds ``most`` entries; only used to save work."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def missing(self, items: set) -> set:
        """Those of ``items`` that are not held (a set's own difference would walk through the whole dict)."""
        return {x for x in items if x not in self}

    def make_room(self, coming: int) -> None:
        if len(self) + coming > self.most:
            self.clear()


_live: dict[Hashable, Any] = {}


def kept(name: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept in this worker until something of another name is asked for.

    Workers serve one operator after another; so the caches of the earlier ones are not held beside its own.
    """
    if name not in _live:
        _live.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _live[name] = make()
    return _live[name]
