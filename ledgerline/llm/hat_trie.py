"""A counting trie over word numbers with burstable hash containers, and the words of text blocks as exact numbers.

Near the root a node leads from one word to the next. Below, a container holds the rest of a phrase, packed into one integer,
and its count in a hash table; a container that grows too large bursts into a node of smaller ones. When the trie is full,
whole subtrees leave it, largest first, each as a run sorted by phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ledgerline.llm.textarrays import LOWER

#: Bits of a word number; three fit into a key of 63 bits.
BITS = 21
MASK = (1 << BITS) - 1
#: Entries at which a container bursts, and entries of a whole trie at which subtrees leave it.
BURST, FULL = 4096, 400_000

#: Bytes that end a piece, bytes between words.
BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?"]] = BREAK[10:14] = True
GAP = BREAK.copy()
GAP[[9, 32]] = True


class Node(dict):
    """Word number to Node or Container."""


class Container(dict):
    """Packed rest of a phrase to its count."""


class Trie:
    """Counts of phrases of `width` >= 2 words. `add` takes many at a time; `full` tells when to `spill`."""

    def __init__(self, width: int, burst: int = BURST, most: int = FULL) -> None:
        self.width, self.burst, self.most = width, burst, most
        #: Words that a node spells out before a container's key can hold the rest.
        self.depth = max(1, width - 3)
        self.clear()

    def clear(self) -> None:
        self.root, self.sizes, self.entries = Node(), {}, 0

    def full(self) -> bool:
        return self.entries >= self.most

    def add(self, phrases: np.ndarray, counts: np.ndarray) -> None:
        """Phrases as rows of word numbers, distinct and sorted, and how often each was seen."""
        lead = phrases[:, : self.depth]
        key = np.zeros(len(phrases), np.int64)
        for k in range(self.depth, self.width):
            key = (key << BITS) | phrases[:, k]
        new = np.ones(len(phrases), bool)
        new[1:] = (lead[1:] != lead[:-1]).any(axis=1)
        head = np.flatnonzero(new).tolist()
        keys, counts, leads = key.tolist(), counts.tolist(), lead[new].tolist()
        rest = self.width - self.depth
        for path, a, b in zip(leads, head, [*head[1:], len(keys)], strict=True):
            node = self.root
            for word in path[:-1]:
                node = node.setdefault(word, Node())
            below = node.get(path[-1])
            node[path[-1]] = self._grow(Container() if below is None else below, path[0], keys[a:b], counts[a:b], rest)

    def _grow(self, below: Node | Container, first: int, keys: list[int], counts: list[int], rest: int) -> Node | Container:
        """Count the keys, each `rest` words long, below a node; returns what stands there afterwards."""
        if isinstance(below, Node):
            shift = BITS * (rest - 1)
            for word, a, b in _groups([k >> shift for k in keys]):
                low = below.get(word)
                below[word] = self._grow(Container() if low is None else low, first, [k & ((1 << shift) - 1) for k in keys[a:b]], counts[a:b], rest - 1)
            return below
        before = len(below)
        for k, n in zip(keys, counts, strict=True):
            below[k] = below.get(k, 0) + n
        self.sizes[first] = self.sizes.get(first, 0) + len(below) - before
        self.entries += len(below) - before
        return burst(below, rest) if len(below) > self.burst and rest > 1 else below

    def spill(self, keep: int = 0, rows: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Whole subtrees, largest first, until at most `keep` entries stay: phrases and counts, about `rows` at a time."""
        parts, waiting = _Unfolded(), 0
        for word in sorted(self.sizes, key=self.sizes.get, reverse=True):
            if self.entries <= keep:
                break
            size = self.sizes.pop(word)
            self.entries, waiting = self.entries - size, waiting + size
            parts.take(self.root.pop(word), self.width - 1, [word])
            if waiting >= rows:
                yield parts.rows()
                parts, waiting = _Unfolded(), 0
        if waiting:
            yield parts.rows()


class _Unfolded:
    """Phrases of subtrees, collected container by container and unpacked together."""

    def __init__(self) -> None:
        self.by_rest: dict[int, tuple[list, list, list, list]] = {}

    def take(self, below: Node | Container, rest: int, path: list[int]) -> None:
        if isinstance(below, Node):
            for word, low in below.items():
                self.take(low, rest - 1, [*path, word])
            return
        paths, sizes, keys, counts = self.by_rest.setdefault(rest, ([], [], [], []))
        paths.append(path)
        sizes.append(len(below))
        keys.extend(below)
        counts.extend(below.values())

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        phrases, counts = [], []
        for rest, (paths, sizes, keys, n) in self.by_rest.items():
            keys = np.array(keys, np.int64)
            tail = [(keys >> (BITS * k)) & MASK for k in range(rest - 1, -1, -1)]
            phrases.append(np.concatenate((np.repeat(np.array(paths, np.int64), sizes, axis=0), np.stack(tail, axis=1)), axis=1))
            counts.append(np.array(n, np.int64))
        return np.concatenate(phrases), np.concatenate(counts)


def burst(full: Container, rest: int) -> Node:
    """A container as a node over smaller ones, each without the leading word."""
    shift, node = BITS * (rest - 1), Node()
    for k, n in full.items():
        node.setdefault(k >> shift, Container())[k & ((1 << shift) - 1)] = n
    return node


def _groups(values: list[int]) -> Iterator[tuple[int, int, int]]:
    """Runs of equal neighbours as (value, start, end)."""
    a = 0
    for b in range(1, len(values) + 1):
        if b == len(values) or values[b] != values[a]:
            yield values[a], a, b
            a = b


def pieced_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Words of lower-cased texts: number of each in the sorted-by-arrival list of distinct words, text of each, that list,
    and whether a word and the next one stand in one piece of one text."""
    data = LOWER[data]
    inside, ends = ~GAP[data], BREAK[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    if len(data):
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < len(data))]
        before[edge], after[edge - 1] = False, False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    owner = np.searchsorted(offsets, start, "right") - 1
    breaks = np.concatenate(([0], np.cumsum(ends)))[start]
    linked = np.zeros(len(start), bool)
    if len(start):
        linked[:-1] = (owner[1:] == owner[:-1]) & (breaks[1:] == breaks[:-1])
    letters, places = data[inside], np.concatenate(([0], np.cumsum(end - start)))
    column = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(letters)])
    coded = pc.dictionary_encode(column)
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), owner, coded.dictionary, linked
