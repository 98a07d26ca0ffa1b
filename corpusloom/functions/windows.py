"""Hashed windows of texts, made in blocks inside the tasks that read the texts."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# sent by value, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Signs of a phrase that its key in a dictionary holds, and signs of a text that a task looks at at a time.
KEY_SIGNS, SLICE_SIGNS = 8, 1 << 20


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _window_bits(codes: np.ndarray, sizes: list[int], bits: int):
    """For each size the number, below 2 ** ``bits``, of each window of that many signs."""
    h = np.zeros(len(codes), np.uint64)
    for k in range(1, max(sizes, default=0) + 1):
        if k > len(codes):
            return
        h = h[:len(codes) - k + 1] * np.uint64(0x100000001B3) + codes[k - 1:]
        if k in sizes:
            x = (h + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            yield k, ((x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - bits)).astype(np.int64)


def key_bits(bits: int):
    def run(batches):
        for batch in batches:
            found = [int(x[0]) for key in batch.column("_key").to_pylist() for _, x in _window_bits(_codes(key), [len(key)], bits)]
            yield pa.RecordBatch.from_pydict({"b": pa.array(found, pa.int64())})

    return run


def candidates(table: np.ndarray, sizes: list[int], longest: int, bits: int, keys: str):
    """Places of the texts whose windows hit the table of key bits, with the signs from there on and the end marks and blank lines before."""
    def places(low):
        for a in range(0, len(low), SLICE_SIGNS):
            codes = _codes(low[a:a + SLICE_SIGNS + KEY_SIGNS - 1])
            for k, at in _window_bits(codes, sizes, bits):
                at = at[:SLICE_SIGNS]
                hit = np.flatnonzero(table[at >> 3] >> (at & 7).astype(np.uint8) & 1)
                if len(hit):
                    yield k, hit + a

    def run(batches):
        for batch in batches:
            ids = batch.column("_id")
            for row, (text, low) in enumerate(zip(batch.column("_t"), batch.column("_l"))):
                if not low.is_valid:
                    continue
                text, low, counted = text.as_py(), low.as_py(), None
                for k, at in places(low):
                    if counted is None:  # once for each text that has a candidate
                        codes = _codes(low)
                        lines = np.flatnonzero(codes == 10)
                        first = np.maximum.accumulate(np.where(np.diff(lines, prepend=-2) != 1, np.arange(len(lines)), 0))
                        counted = np.flatnonzero((codes == 46) | (codes == 33) | (codes == 63)), lines[(np.arange(len(lines)) - first) % 2 == 1] + 1
                    step = max(1, min(1 << 16, (1 << 24) // longest))  # rows of a batch, by the signs they hold
                    for j in range(0, len(at), step):
                        part = at[j:j + step]
                        starts = part.tolist()
                        columns = [pa.array([low[i:i + k] for i in starts], pa.string()), pa.array([low[i:i + longest] for i in starts], pa.string()),
                                   pa.array([text[i:i + longest] for i in starts], pa.string()), *(pa.array(x.astype(np.int32)) for x in (
                                       part, np.searchsorted(counted[0], part, "left"), np.searchsorted(counted[1], part, "right")))]
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array([row] * len(part))), *columns], names=keys.split(","))

    return run
