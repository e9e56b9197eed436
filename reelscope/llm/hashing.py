"""Word and n-gram hashes over Arrow text buffers, in numpy, a bounded chunk at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at once; a chunk grows only to hold a single longer word.
CHUNK = 1 << 18
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection that spreads every input bit over all output bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _odd(seed: int) -> int:
    return int(mix(np.array([seed * 0x9E3779B97F4A7C15 % 2**64], dtype=_U))[0]) | 1


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, extended as needed."""

    def __init__(self, seed: int) -> None:
        self.base = _odd(seed)
        self.inverse = pow(self.base, -1, 2**64)
        self.up = self.down = np.ones(0, dtype=_U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            out = []
            for b in (self.base, self.inverse):
                x = np.full(size, b, dtype=_U)
                x[0] = 1
                out.append(np.cumprod(x, dtype=_U))
            self.up, self.down = out
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = Powers(1), Powers(2)
_VALUE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))


def separators(allowed) -> np.ndarray:
    """A table of 256 flags: true where a byte parts words."""
    return np.array([not allowed(b) for b in range(256)])


#: Words are runs of anything but space and the controls 9 to 13.
BLANK = separators(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)


def bounds(buf: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the byte after it."""
    inside = np.zeros(len(buf) + 2, dtype=np.int8)
    inside[1:-1] = ~sep[buf]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _chunks(buf: np.ndarray, sep: np.ndarray) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(buf):
        end = min(at + CHUNK, len(buf))
        while end < len(buf):  # back to a separator, or on to the next
            gap = np.flatnonzero(sep[buf[max(at, end - 4096) : end]])
            if len(gap):
                end = max(at, end - 4096) + int(gap[-1]) + 1
                break
            end = min(end + 4096, len(buf))
        yield at, end
        at = end


def words(buf: np.ndarray, sep: np.ndarray, fold: np.ndarray = SAME) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, 64-bit hash) of each word of a byte buffer; ``fold`` maps bytes before hashing."""
    starts, ends, hashes = [], [], []
    for at, end in _chunks(buf, sep):
        part = buf[at:end]
        s, e = bounds(part, sep)
        up, down = _BYTES.get(len(part) + 1)
        total = np.zeros(len(part) + 1, dtype=_U)
        np.cumsum(_VALUE[fold[part]] * up[:-1], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(_U)))
        starts.append(s + at)
        ends.append(e + at)
    if not starts:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(0, dtype=_U)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def ngrams(h: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hash of each k consecutive items of ``h``; shorter input has none."""
    if len(h) < k:
        return np.zeros(0, dtype=_U)
    up, down = _WORDS.get(len(h) + 1)
    total = np.zeros(len(h) + 1, dtype=_U)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: len(h) - k + 1])


def spans(h: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """Hash of each span [start, end) of the items ``h``, of any lengths."""
    up, down = _WORDS.get(len(h) + 1)
    total = np.zeros(len(h) + 1, dtype=_U)
    np.cumsum(mix(h + _U(seed)) * up[: len(h)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(_U) * _U(_odd(seed)))


def minimum(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the first smallest of each ``w`` consecutive values, by doubling: log2(w) passes."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    at = np.arange(len(h), dtype=np.int64)
    size = 1
    while size * 2 <= w:
        a, b = at[: len(at) - size], at[size:]
        at = np.where(h[a] <= h[b], a, b)
        size *= 2
    if size < w:
        a, b = at[:n], at[w - size : w - size + n]
        at = np.where(h[a] <= h[b], a, b)
    return at[:n]


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column, each row followed by one space; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.binary_join_element_wise(pc.fill_null(column, "").cast(pa.large_string()), *(pa.scalar(x, pa.large_string()) for x in ("", " ")))
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``most`` bytes of text each, one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    total = np.concatenate([[0], np.cumsum(size.to_numpy(zero_copy_only=False), dtype=np.int64)])
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(total, total[at] + most, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def by_row(start: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index of the first word of each row, and the number of words at last."""
    return np.searchsorted(start, offsets)
