"""Static range asymmetric numeral system over token ids, in interleaved lanes (the codec of operator 2).

All blocks share one frequency table with frequencies that sum to 2**SCALE.  A block is cut into rows of LANES ids; lane k codes
the k-th id of every row with a state of its own, so a row is coded with array operations.  States are 64 bits and give off
32-bit words.  The encoder runs from the last row to the first, the decoder forwards.

Every CHECKPOINT rows the decoder's state is kept (lane states, place in the words, crc32 of the ids that follow up to the next one),
so parts of a block can be decoded and verified in parallel, and an id can be found without decoding what precedes its part.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

SCALE, LANES, CHECKPOINT = 20, 2048, 256
LOW = np.uint64(1 << 31)
WORD, MASK = np.uint64(32), np.uint64((1 << SCALE) - 1)


@dataclass
class Table:
    """Frequencies of ids, scaled to 2**SCALE, for ids 0 to len - 1; ids that never occur have 0."""

    freq: np.ndarray

    def __post_init__(self):
        self.start = np.cumsum(self.freq) - self.freq
        self.freq64, self.start64 = self.freq.astype(np.uint64), self.start.astype(np.uint64)
        self._symbol: np.ndarray | None = None

    @property
    def symbol(self) -> np.ndarray:
        """Id by place in the scale."""
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq)
        return self._symbol

    @staticmethod
    def scaled(count: np.ndarray) -> Table:
        """From counts; every id that occurs gets at least 1."""
        count = np.asarray(count, np.int64)
        used = np.flatnonzero(count)
        if len(used) > 1 << SCALE:
            raise ValueError("more ids occur than the scale has places")
        freq = np.zeros(max(1, len(count)), np.int64)
        if not len(used):
            freq[0] = 1 << SCALE
            return Table(freq)
        share = count[used] / count[used].sum() * (1 << SCALE)
        f = np.maximum(1, np.floor(share)).astype(np.int64)
        over = int(f.sum()) - (1 << SCALE)
        while over > 0:  # too many ones: take from the frequent ids
            big = np.argsort(-f, kind="stable")[: max(1, min(over, int((f > 1).sum())))]
            big = big[f[big] > 1]
            f[big] -= 1
            over -= len(big)
        f[np.argmax(share)] -= over
        freq[used] = f
        return Table(freq)


@dataclass
class Part:
    """A stretch of a block that can be decoded by itself."""

    row: int
    word: int
    crc32: int
    states: np.ndarray


def encode(ids: np.ndarray, table: Table) -> tuple[bytes, list[Part]]:
    """Words of a block and its parts in order; the last row is filled up with the block's first id."""
    rows = -(-len(ids) // LANES)
    if not rows:
        return b"", []
    full = np.full(rows * LANES, ids[0], np.uint32)
    full[:len(ids)] = ids
    full = full.reshape(rows, LANES)
    x = np.full(LANES, LOW, np.uint64)
    out, sizes, parts = [], [0] * rows, []
    room = table.freq64 << np.uint64(63 - SCALE)
    for r in range(rows - 1, -1, -1):
        s = full[r]
        f = table.freq64[s]
        spill = x >= room[s]
        if spill.any():
            out.append(x[spill].astype(np.uint32))
            sizes[r] = len(out[-1])
            x[spill] >>= WORD
        q = x // f
        x = (q << np.uint64(SCALE)) + (x - q * f) + table.start64[s]
        if r % CHECKPOINT == 0:
            parts.append(Part(r, 0, zlib.crc32(ids[r * LANES:(r + CHECKPOINT) * LANES].astype("<u4").tobytes()), x.copy()))
    before = np.concatenate([[0], np.cumsum(sizes)])
    parts.reverse()
    for p in parts:
        p.word = int(before[p.row])
    return b"".join([w.astype("<u4").tobytes() for w in reversed(out)]), parts


def decode_part(words: np.ndarray, part: Part, n_ids: int, table: Table) -> np.ndarray:
    """The ids of one part of a block of ``n_ids``; raises on a wrong checksum."""
    rows = min(CHECKPOINT, -(-n_ids // LANES) - part.row)
    x, at, symbol = part.states.astype(np.uint64), part.word, table.symbol
    out = np.empty((rows, LANES), np.uint32)
    for r in range(rows):
        low = x & MASK
        s = symbol[low]
        out[r] = s
        x = table.freq64[s] * (x >> np.uint64(SCALE)) + low - table.start64[s]
        need = x < LOW
        n = int(np.count_nonzero(need))
        if n:
            x[need] = (x[need] << WORD) | words[at:at + n]
            at += n
    ids = out.reshape(-1)[: n_ids - part.row * LANES]
    if zlib.crc32(ids.astype("<u4").tobytes()) != part.crc32:
        raise ValueError("checksum of decoded ids differs: damaged block or wrong table")
    return ids


def pack_parts(parts: list[Part]) -> bytes:
    return b"".join(np.array([p.row, p.word, p.crc32], "<u4").tobytes() + p.states.astype("<u8").tobytes() for p in parts)


def unpack_parts(data: bytes) -> list[Part]:
    size = 12 + 8 * LANES
    return [Part(*np.frombuffer(data, "<u4", 3, k).tolist(), np.frombuffer(data, "<u8", LANES, k + 12)) for k in range(0, len(data), size)]
