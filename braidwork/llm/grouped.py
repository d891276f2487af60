"""Groups of rows out of Arrow batches that are sorted by key."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterable[pa.RecordBatch], n_keys: int, least_bytes: int = 0) -> Iterator[pa.Table]:
    """Tables of whole groups (equal first `n_keys` columns), of at least `least_bytes` together where rows allow."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)]
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        change[0] = bool(held) and any(held[-1].column(i)[-1] != batch.column(i)[0] for i in range(n_keys))
        weight = batch.nbytes / batch.num_rows
        at = 0
        for cut in np.flatnonzero(change):
            if size + (cut - at) * weight < max(1, least_bytes) and not (least_bytes == 0 and (held or cut > at)):
                continue
            if cut > at:
                held.append(batch.slice(at, cut - at))
            if held:
                yield pa.Table.from_batches(held)
            held, size, at = [], 0, int(cut)
        held.append(batch.slice(at))
        size += (batch.num_rows - at) * weight
    if held:
        yield pa.Table.from_batches(held)


def released(work):
    """An Arrow function that hands its memory back when it ends: workers are reused and would keep it while idle."""

    @functools.wraps(work)
    def run(batches, *more):
        try:
            yield from work(batches, *more)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run
