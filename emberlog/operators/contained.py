"""Which of many values each line holds, in one pass over the bytes of a batch of lines.

For each length that values have, the hash of the bytes from every position on is a difference of two running sums; hashes that are in the
values' sorted table are looked at byte by byte. So a batch costs as much as its bytes times the number of lengths, however many values there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BATCH = 1 << 19  # bytes of lines that are looked at together, about
BITS = 20  # of the table that tells most hashes that no value has
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def _powers(n: int) -> np.ndarray:
    out = np.full(n + 1, _STEP)
    out[0] = 1
    return np.multiply.accumulate(out)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_string())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[off[0] : off[-1]]), off - off[0]


class Values:
    """Distinct values that are not empty, by length: their hashes in order, their bytes, and their places in the list."""

    def __init__(self, values: list[str]):
        self.by_length: list[tuple] = []
        raw = [v.encode() for v in values]
        lengths = np.array([len(r) for r in raw])
        for n in np.unique(lengths):
            place = np.flatnonzero(lengths == n)
            data = np.frombuffer(b"".join(raw[i] for i in place), np.uint8).reshape(len(place), n)
            h = (_BYTE[data] * _powers(int(n))[:-1]).sum(1, dtype=np.uint64)
            order = np.argsort(h, kind="stable")
            seen = np.zeros(1 << BITS, bool)
            seen[self._few(h)] = True
            self.by_length.append((int(n), h[order], data[order], place[order], seen))

    @staticmethod
    def _few(h: np.ndarray) -> np.ndarray:
        return ((h * _STEP) >> np.uint64(64 - BITS)).astype(np.int64)

    def found_in(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Row and place of each value that a row of a column without nulls holds, each pair once."""
        data, off = _bytes_of(column)
        row_of = np.repeat(np.arange(len(column)), np.diff(off))
        left = np.repeat(off[1:], np.diff(off)) - np.arange(len(data))  # bytes to the end of the row
        powers = _powers(len(data))
        # hashes are told at the power of their position: dividing (a product with the inverse) brings them to that of the first
        inverse = np.full(len(data) + 1, np.uint64(pow(int(_STEP), -1, 1 << 64)))
        inverse[0] = 1
        inverse = np.multiply.accumulate(inverse)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * powers[:-1], out=sums[1:])
        pairs = []
        for n, hashes, own, place, seen in self.by_length:
            if n > len(data):
                continue
            at = np.flatnonzero(left[: len(data) - n + 1] >= n)
            h = (sums[at + n] - sums[at]) * inverse[at]
            maybe = seen[self._few(h)]
            at, h = at[maybe], h[maybe]
            k = np.searchsorted(hashes, h)
            # values of one hash stand side by side
            while len(at):
                live = k < len(hashes)
                live[live] = hashes[k[live]] == h[live]
                at, h, k = at[live], h[live], k[live]
                same = np.ones(len(at), bool)
                for i in range(n):
                    same[same] = data[at[same] + i] == own[k[same], i]
                pairs.append(np.unique(row_of[at[same]] * np.int64(1 << 32) + place[k[same]]))
                k = k + 1
        both = np.concatenate(pairs) if pairs else np.zeros(0, np.int64)
        return both >> 32, both & 0xFFFFFFFF


def slices(column: pa.Array, limit: int = BATCH):
    """From which to which row a column is cut, so that the lines of each part have about so many bytes."""
    lengths = np.cumsum(np.append(0, pc.binary_length(column).to_numpy(zero_copy_only=False)))
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(lengths, lengths[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi
