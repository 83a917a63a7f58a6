"""Vectorised work on the bytes of Arrow string columns.

Everything here runs inside ``mapInArrow`` tasks, on chunks of about a
megabyte of whole texts, so that memory does not follow the batch size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_MULT = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_classes(pattern: str) -> np.ndarray:
    """Which bytes belong to words: ``space`` splits at ASCII white space,
    ``alnum`` keeps ASCII letters, digits and all bytes of longer code points."""
    b = np.arange(256)
    if pattern == "space":
        return ~((b == 32) | ((b >= 9) & (b <= 13)))
    return ((b >= 48) & (b <= 57)) | ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122)) | (b >= 128)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _byte_values() -> np.ndarray:
    return _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULT))


class Powers:
    """Powers of an odd multiplier and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            m = max(n + 1, 2 * len(self.up))
            for name, p in (("up", _MULT), ("down", pow(_MULT, -1, 1 << 64))):
                a = np.full(m, p & _MASK, np.uint64)
                a[0] = 1
                setattr(self, name, np.cumprod(a, dtype=np.uint64))
        return self.up, self.down


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets, data


def chunks(offsets: np.ndarray, size: int = CHUNK):
    """(first row, end row) of runs of whole texts of about ``size`` bytes."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end
        at = end


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and first-word numbers (one more than rows) of the words of
    consecutive texts; ``offsets`` are relative to ``data``."""
    n = len(data)
    inside = is_word[data]
    left = np.zeros(n + 1, bool)
    left[1:] = inside
    cuts = offsets[offsets < n]
    left[cuts] = False
    starts = np.flatnonzero(inside & ~left[:n])
    right = np.zeros(n + 1, bool)
    right[:n] = inside
    right[cuts] = False
    ends = np.flatnonzero(inside & ~right[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers, values: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans: a polynomial over random byte values,
    finished with the length."""
    up, down = powers.get(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def lower_values() -> np.ndarray:
    """Byte values under which A-Z and a-z hash alike."""
    return _byte_values()[LOWER]


def chain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return _mix(a * np.uint64(0xC2B2AE3D27D4EB4F) + b + np.uint64(0x165667B19E3779F9))
