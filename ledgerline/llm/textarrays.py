"""Texts of an Arrow batch as byte arrays, and 64-bit hashes of their words and windows, vectorized."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_STEP = U(0x9E3779B97F4A7C15)
_TABLES: dict[str, np.ndarray] = {}

#: Bytes of white space in all contracts: 0x09-0x0D and 0x20.
BLANK = np.zeros(256, bool)
BLANK[9:14] = BLANK[32] = True
#: A-Z to a-z, everything else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: every input bit changes every output bit."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x = x ^ (x >> U(27))
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if len(_TABLES.get("up", ())) < n:
        size = max(n, 1 << 16)
        inverse = pow(int(_STEP), -1, 1 << 64)
        for name, base in (("up", int(_STEP)), ("down", inverse)):
            one = np.full(size, U(base))
            one[0] = 1
            _TABLES[name] = np.multiply.accumulate(one)
    return _TABLES["up"][:n], _TABLES["down"][:n]


#: Longest run that is one polynomial. Over longer runs there are byte strings that agree modulo 2**64 whatever the base is.
PIECE = 64


class Prefix:
    """Hashes of byte runs by differences of a prefix sum.

    A run of more than `PIECE` bytes is hashed piece by piece, and the mixed values of its pieces by place.
    """

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * up[:-1], out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - start
        value = self.raw(start, end)
        long = np.flatnonzero(size > PIECE)
        if len(long):
            value[long] = self._pieces(start[long], end[long])
        return mix(value + size.astype(U) * U(0xD6E8FEB86659FD93))

    def _pieces(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        many = -((start - end) // PIECE)
        first = np.cumsum(many) - many
        k = np.arange(many.sum()) - np.repeat(first, many)
        a = np.repeat(start, many) + k * PIECE
        b = np.minimum(a + PIECE, np.repeat(end, many))
        place = (k + 1).astype(U) * _STEP
        return np.add.reduceat(mix(mix(self.raw(a, b)) ^ place), first)

    def windows(self, width: int) -> np.ndarray:
        """Hash of every run of `width` bytes."""
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, U)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets; null is empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of whole documents with about `most` bytes; a longer document is alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of the first word of each document (n + 1 values)."""
    full = ~BLANK[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    if len(data):
        before[1:], after[:-1] = full[:-1], full[1:]
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < len(data))]
        before[edge] = False
        after[edge - 1] = False
    start, end = np.flatnonzero(full & ~before), np.flatnonzero(full & ~after) + 1
    return start, end, np.searchsorted(start, offsets)


def _place(k: int) -> np.uint64:
    return U((k + 1) * int(_STEP) % (1 << 64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the `width`-word shingles of each document; fewer words make one shingle, none make none.

    Letters A-Z count as lower case.
    """
    data = LOWER[data]
    start, end, first = words(data, offsets)
    word = Prefix(data).of(start, end)
    full = max(0, len(word) - width + 1)
    run = np.zeros(full, U)
    for k in range(width):
        run += mix(word[k : k + full] + _place(k))
    run = mix(run + U(width))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            s = np.sort(run[a : b - width + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            parts = [mix(word[a + k : a + k + 1] + _place(k)) for k in range(b - a)]
            out.append(mix(np.sum(parts, axis=0, dtype=U) + U(b - a)))
        else:
            out.append(np.zeros(0, U))
    return out


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value. Sorted 64-bit arrays shrink by differences first: see `sorted_part`."""
    import zstandard

    head = np.array([len(arrays), *[x for a in arrays for x in (a.dtype.num, len(a))]], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpacked(value: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(value)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 1 + 2 * count)[1:].reshape(-1, 2)
    at, out = 8 * (1 + 2 * count), []
    kinds = {np.dtype(x).num: np.dtype(x) for x in ("u1", "u2", "u4", "u8", "i4", "i8", "f4", "f8")}
    kinds |= {np.dtype(t).num: np.dtype(t) for t in (np.longlong, np.ulonglong, np.int_, np.uint)}
    for kind, n in head.tolist():
        out.append(np.frombuffer(raw, kinds[kind], n, at))
        at += n * kinds[kind].itemsize
    return out


def deltas(ordered: np.ndarray) -> np.ndarray:
    """Differences of a sorted array, bytes of equal weight together, which compresses well."""
    d = np.diff(ordered, prepend=U(0))
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).reshape(-1)


def undeltas(planes: np.ndarray) -> np.ndarray:
    d = np.ascontiguousarray(planes.reshape(8, -1).T).reshape(-1).view(U)
    return np.cumsum(d, dtype=U)
