"""Byte-level BPE encoding and decoding (operator 7).

Frequent words of the corpus, counted by Spark, are compiled with their ids into a minimal acyclic transducer: words share
prefixes and suffixes, edges carry how many words come before, so a walk adds up to the number of the word, which points at
its ids. The arrays go to the executors as one file and are memory-mapped there. Words the lexicon lacks are merged pair
by pair, exactly, all words of a batch at once. Words follow the usual byte-level pattern (contractions; letters, digits or
other marks with one space before; white space), found from character classes without a regular expression.
"""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import unicodedata
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm.shared import stored, tidy
from ledgerline.llm.textarrays import Prefix, blocks, buffers

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
#: White space characters (fixed values of the pattern's \s).
SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Letters and numbers that Unicode 16 added, for interpreters with older tables (fixed values).
NEWER = {
    LETTER: [
        (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
        (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
        (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
        (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
    ],
    NUMBER: [
        (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9),
        (0x1E5F1, 0x1E5FA),
    ],
}
#: Contractions that are words of their own after an apostrophe (fixed values of the pattern).
SHORT = ("s", "t", "m", "d", "re", "ve", "ll")
#: Words of the lexicon stand at least once in so many words of the corpus, so there are at most so many of them.
LEXICON_SHARE = 1 << 17
MEMO_WORDS = 300_000
#: Bytes of text that are cut into words at a time; the arrays over them are some 100 times as large.
BLOCK_BYTES = 1 << 19
#: Longest of them.
MEMO_BYTES = 1024
NO_RANK = np.int32(2**31 - 1)


@cache
def char_classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        table[c] = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER)
    for value, ranges in NEWER.items():
        for a, b in ranges:
            table[a : b + 1] = value
    table[SPACES] = SPACE
    return table


@cache
def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    out.update({chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))})
    return out


class Vocabulary:
    """Ids, merges and bytes of a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, letters = file["model"]["vocab"], byte_letters()
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        words: dict[int, bytes] = {i: bytes(letters[c] for c in w) for w, i in vocab.items()}
        words.update({i: w.encode() for w, i in self.special.items()})
        self.bytes_of = [words.get(i, b"") for i in range(max(words) + 1)]
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.first = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        pairs = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], np.int64)
        self.order = np.argsort(pairs, kind="stable")
        self.pairs = pairs[self.order]
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.decimal = [str(i) for i in range(len(self.bytes_of))]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.order[at], NO_RANK).astype(np.int32)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word: in every round each word merges its lowest-ranked pair, everywhere it stands."""
        done: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        ids = self.first[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        rank = np.full(len(ids), NO_RANK, np.int32)
        if len(ids) > 1:
            same = owner[1:] == owner[:-1]
            rank[:-1] = np.where(same, self.ranks(ids[:-1], ids[1:]), NO_RANK)
        while len(ids):
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(ids)))
            over = best == NO_RANK
            if over.any():
                for s, n in zip(starts[over].tolist(), sizes[over].tolist(), strict=True):
                    done[owner[s]] = ids[s : s + n]
                stay = np.repeat(~over, sizes)
                ids, owner, rank = ids[stay], owner[stay], rank[stay]
                best, sizes = best[~over], sizes[~over]
                if not len(ids):
                    break
            hit = rank == np.repeat(best, sizes)
            place = np.flatnonzero(hit)
            run = np.flatnonzero(np.concatenate(([True], np.diff(place) != 1)))
            nth = np.arange(len(place)) - np.repeat(run, np.diff(np.append(run, len(place))))
            place = place[nth % 2 == 0]
            ids = ids.copy()
            ids[place] = self.merged[rank[place]]
            stay = np.ones(len(ids), bool)
            stay[place + 1] = False
            place = place - np.arange(len(place))
            ids, owner, rank = ids[stay], owner[stay], rank[stay]
            for at in (place, place[place > 0] - 1):
                inner = at[at < len(ids) - 1]
                rank[at[at == len(ids) - 1]] = NO_RANK
                rank[inner] = np.where(owner[inner] == owner[inner + 1], self.ranks(ids[inner], ids[inner + 1]), NO_RANK)
        return done


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lexicon:
    """Minimal acyclic transducer from words to their numbers, on flat arrays that a file can hold."""

    def __init__(self, arrays: list[np.ndarray]) -> None:
        self.edges, self.targets, self.before, self.final, self.id_starts, self.ids = arrays

    @staticmethod
    def build(words: list[bytes], ids: list[np.ndarray]) -> Lexicon:
        """From sorted distinct words. The states of the last word stay open; closed ones are replaced by an equal one."""
        nodes: list[list] = [[False, {}]]
        register: dict[tuple, int] = {}
        path = [0]

        def close(depth: int) -> None:
            while len(path) - 1 > depth:
                child = path.pop()
                key = (nodes[child][0], tuple(nodes[child][1].items()))
                same = register.setdefault(key, child)
                parent = nodes[path[-1]][1]
                parent[next(reversed(parent))] = same

        last = b""
        for word in words:
            shared = os.path.commonprefix([last, word])
            close(len(shared))
            for b in word[len(shared):]:
                nodes.append([False, {}])
                nodes[path[-1]][1][b] = len(nodes) - 1
                path.append(len(nodes) - 1)
            nodes[path[-1]][0] = True
            last = word
        close(0)
        live, below = [0], {}
        for n in live:
            live.extend(t for t in nodes[n][1].values() if t not in below and not below.setdefault(t, 0))
        name = {n: i for i, n in enumerate(dict.fromkeys(live))}
        count: dict[int, int] = {}
        stack = [0]
        while stack:
            n = stack[-1]
            open_ = [t for t in nodes[n][1].values() if t not in count]
            if open_:
                stack.extend(open_)
            else:
                count[n] = int(nodes[n][0]) + sum(count[t] for t in nodes[n][1].values())
                stack.pop()
        rows = []
        for n, i in name.items():
            skipped = int(nodes[n][0])
            for b, t in nodes[n][1].items():
                rows.append((i * 256 + b, name[t], skipped))
                skipped += count[t]
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 3)
        final = np.zeros(len(name), np.int64)
        final[[i for n, i in name.items() if nodes[n][0]]] = 1
        starts = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        return Lexicon([table[:, 0], table[:, 1], table[:, 2], final, starts, flat.astype(np.int64)])

    def save(self, path: str) -> None:
        arrays = [self.edges, self.targets, self.before, self.final, self.id_starts, self.ids]
        head = np.array([len(a) for a in arrays], np.int64)
        with open(path, "wb") as f:
            f.write(head.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))

    @staticmethod
    def load(path: str) -> Lexicon:
        file = np.memmap(path, np.int64, "r")
        cuts = np.cumsum(file[:6]) + 6
        return Lexicon([file[a:b] for a, b in zip(np.append(6, cuts[:-1]), cuts, strict=True)])

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Number of each word data[start:end], -1 where the lexicon lacks it; all words walk together."""
        out = np.full(len(start), -1, np.int64)
        if not len(self.edges):
            return out
        alive, state, number, at = np.arange(len(start)), np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), start.copy()
        while len(alive):
            ended = at == end[alive]
            accept = ended & (self.final[state] == 1)
            out[alive[accept]] = number[accept]
            go = ~ended
            alive, state, number, at = alive[go], state[go], number[go], at[go]
            key = state * 256 + data[at]
            edge = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            go = self.edges[edge] == key
            edge, alive, number, at = edge[go], alive[go], number[go], at[go]
            state, number, at = self.targets[edge], number + self.before[edge], at + 1
        return out

    def ids_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the numbered words one after the other, and how many each has."""
        start = self.id_starts[numbers]
        sizes = self.id_starts[numbers + 1] - start
        return self.ids[ragged(start, sizes)], sizes


@cache
def lexicon(name: str) -> Lexicon:
    return Lexicon.load(SparkFiles.get(name))


def segments(data: np.ndarray, offsets: np.ndarray, special: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where words may not cross: ends of documents and of special tokens; and the special id of each piece or -1."""
    raw = data.tobytes()
    cuts: dict[int, int] = {}
    for text, number in special.items():
        mark, at = text.encode(), raw.find(text.encode())
        while at >= 0:
            doc = int(np.searchsorted(offsets, at, "right"))
            if doc < len(offsets) and at + len(mark) <= offsets[doc]:
                cuts[at] = number
                cuts.setdefault(at + len(mark), -1)
                at = raw.find(mark, at + len(mark))
            else:
                at = raw.find(mark, at + 1)
    edges = np.unique(np.concatenate((offsets, np.array(sorted(cuts), np.int64))))
    kind = np.full(len(edges), -1, np.int64)
    for at, number in cuts.items():
        if number >= 0:
            kind[np.searchsorted(edges, at)] = number
    return edges, kind


def word_starts(data: np.ndarray, edges: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Byte offset of the start of each word of the pattern; a special token is one word."""
    chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(chars)
    if not n:
        return np.zeros(0, np.int64)
    width = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
    byte_at = np.concatenate(([0], np.cumsum(width)))
    cut = np.zeros(n + 1, bool)
    cut[np.searchsorted(byte_at, edges)] = True
    cls = char_classes()[chars]
    blank = cls == SPACE
    before_blank = np.concatenate(([False], blank[:-1])) & ~cut[:-1]
    same = np.concatenate(([False], cls[1:] == cls[:-1])) & ~cut[:-1]
    plain = np.concatenate(([False], chars[:-1] == 32))
    start = np.where(blank, ~before_blank, ~same & ~(before_blank & plain))
    last_blank = blank.copy()
    last_blank[:-1] &= ~blank[1:]
    last_blank &= ~cut[1:]
    start |= last_blank
    quote = np.flatnonzero((chars == 39) & start)
    for tail in SHORT:
        at = quote[quote + len(tail) < n]
        for k, c in enumerate(tail):
            at = at[(chars[at + 1 + k] == ord(c)) & ~cut[at + 1 + k]]
        start[at + 1] = False
        after = at + 1 + len(tail)
        start[after[after < n]] = True
    start |= cut[:-1]
    special = np.flatnonzero(kind >= 0)
    for i in special.tolist():
        a, b = np.searchsorted(byte_at, edges[i]), np.searchsorted(byte_at, edges[i + 1])
        start[a + 1 : b] = False
    return byte_at[:-1][start]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i] + lengths[i] - 1, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def unlike(data: np.ndarray, start: np.ndarray, end: np.ndarray, start2: np.ndarray, end2: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """Numbers of the runs whose bytes differ from those of their partner; about `most` bytes are compared at a time."""
    size = end - start
    bad = size != end2 - start2
    check = np.flatnonzero(~bad & (start != start2))
    ends = np.cumsum(size[check])
    i = 0
    while i < len(check):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        part = check[i:j]
        n = size[part]
        differ = data[ragged(start[part], n)] != data[ragged(start2[part], n)]
        bad[part] = np.add.reduceat(differ.astype(np.int64), np.cumsum(n) - n) > 0
        i = j
    return np.flatnonzero(bad)


def _flat(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(ids), np.array([len(x) for x in ids], np.int64)


class Memo:
    """Ids of words, all in one flat array: a word costs its bytes, a place in the dict and four bytes per id."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.starts, self.ids, self.used = np.zeros(1 << 10, np.int32), np.zeros(1 << 12, np.int32), 0

    def add(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        """New words; `ids` holds the ids of all of them one after the other."""
        n = len(self.place)
        self.starts, self.ids = _room(self.starts, n + len(words) + 1), _room(self.ids, self.used + len(ids))
        self.place.update(zip(words, range(n, n + len(words)), strict=True))
        self.starts[n + 1 : n + len(words) + 1] = self.used + np.cumsum(sizes)
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def ids_of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = self.starts[places].astype(np.int64)
        sizes = self.starts[places + 1] - start
        return self.ids[ragged(start, sizes)].astype(np.int64), sizes


def _room(a: np.ndarray, size: int) -> np.ndarray:
    return a if size <= len(a) else np.concatenate((a, np.zeros(max(size, 2 * len(a)) - len(a), a.dtype)))


class Encoder:
    """Ids of the words of blocks of texts; remembers words it has met."""

    def __init__(self, vocab: Vocabulary, words: Lexicon | None) -> None:
        self.vocab, self.lexicon, self.memo = vocab, words, Memo()

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of the first id of each document (n + 1 values)."""
        edges, kind = segments(data, offsets, self.vocab.special)
        start = word_starts(data, edges, kind)
        end = np.append(start[1:], len(data)) if len(start) else start
        name = Prefix(data).of(start, end)
        names, at, back = np.unique(name, return_index=True, return_inverse=True)
        other = unlike(data, start, end, start[at][back], end[at][back])
        fixed = {int(s): int(k) for s, k in zip(edges, kind, strict=True) if k >= 0}
        if len(self.memo.place) > MEMO_WORDS:
            self.memo.clear()
        raw = data.tobytes()
        keys = [raw[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
        found = np.array([self.memo.place.get(x, -1) for x in keys], np.int64)
        old, new = np.flatnonzero(found >= 0), np.flatnonzero(found < 0)
        parts, places = [self.memo.ids_of(found[old])], [old]
        if len(new):
            s, e = start[at[new]], end[at[new]]
            number = self.lexicon.find(data, s, e) if self.lexicon else np.full(len(new), -1)
            if (listed := np.flatnonzero(number >= 0)).size:
                parts.append(self.lexicon.ids_of(number[listed]))
                places.append(new[listed])
            if (unseen := new[number < 0]).size:
                parts.append(_flat(self.vocab.merge([keys[i] for i in unseen.tolist()])))
                places.append(unseen)
            for (ids, sizes), place in zip(parts[1:], places[1:], strict=True):
                short = np.array([len(keys[i]) <= MEMO_BYTES for i in place.tolist()])
                self.memo.add([keys[i] for i in place[short].tolist()], ids[np.repeat(short, sizes)], sizes[short])
        extra: list[np.ndarray] = []
        if len(other):  # words that share a hash with another word of the block
            extra += self.vocab.merge([raw[start[i] : end[i]] for i in other.tolist()])
            back[other] = len(keys) + np.arange(len(other))
        if fixed:
            where = sorted(fixed)
            back[np.searchsorted(start, np.array(where, np.int64))] = len(keys) + len(extra) + np.arange(len(where))
            extra += [np.array([fixed[s]], np.int64) for s in where]
        if extra:
            parts.append(_flat(extra))
            places.append(len(keys) + np.arange(len(extra)))
        flat, size = (np.concatenate([part[k] for part in parts]) for k in (0, 1))
        begin, sizes = np.zeros(len(keys) + len(extra), np.int64), np.zeros(len(keys) + len(extra), np.int64)
        order = np.concatenate(places)
        begin[order], sizes[order] = np.cumsum(size) - size, size
        ids = flat[ragged(begin[back], sizes[back])]
        first = np.concatenate(([0], np.cumsum(sizes[back])))
        return ids, first[np.searchsorted(start, offsets)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, and where each id's bytes end."""
        sizes = self.vocab.lengths[ids]
        return self.vocab.flat[ragged(self.vocab.offsets[ids], sizes)], np.cumsum(sizes)


def frequent_words(docs: DataFrame, path: str, share: int) -> list[bytes]:
    """The words of the pattern that stand at least once in `share` words, counted over all texts. There can't be more
    than `share` of them, so the list is bounded without a sort."""
    special = vocabulary(path).special

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            names, words, counts = [], [], []
            for _, _, d, o in blocks(data, offsets, BLOCK_BYTES):
                edges, kind = segments(d, o, special)
                start = word_starts(d, edges, kind)
                end = np.append(start[1:], len(d)) if len(start) else start
                n, at, c = np.unique(Prefix(d).of(start, end), return_index=True, return_counts=True)
                raw = d.tobytes()
                names.append(n)
                counts.append(c)
                words.extend(raw[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True))
            if words:
                _, at, back = np.unique(np.concatenate(names), return_index=True, return_inverse=True)
                total = np.bincount(back, np.concatenate(counts).astype(float)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in at.tolist()], pa.binary()), pa.array(total)], names=["word", "n"])

    counts = docs.select("text").mapInArrow(tidy(count), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = stored(counts, "bpe-words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return sorted(bytes(r["word"]) for r in counts.where(F.col("n") * share >= total).where("n > 1").select("word").collect())


def ship_lexicon(spark: SparkSession, words: list[bytes], path: str) -> str:
    """Compile the words, hand the file to Spark for all executors, return its name."""
    vocab = vocabulary(path)
    words = [w for w in words if w and w.decode("utf-8", "replace") not in vocab.special]
    name = f"bpe-lexicon-{uuid.uuid4().hex}"
    file = os.path.join(tempfile.mkdtemp(prefix="ledgerline-"), name)
    Lexicon.build(words, vocab.merge(words)).save(file)
    spark.sparkContext.addFile(file)
    return name


def encode_documents(docs: DataFrame, path: str, share: int = LEXICON_SHARE) -> DataFrame:
    """doc_id, ids (array of int), decoded (binary: bytes of the ids one after the other), text_ok (they are the text's bytes).

    `path` names a byte-level BPE file that every executor has. Null and empty texts have no ids. Repeated rows are
    encoded each. A special token in a text is the special id.
    """
    spark = docs.sparkSession
    name = ship_lexicon(spark, frequent_words(docs, path, share), path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, first, raw, ends, ok in encoded(batches, path, name):
            cuts = np.concatenate(([0], ends))[first]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32())),
                 pa.array([raw[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()), pa.array(ok, pa.bool_())],
                names=["doc_id", "ids", "decoded", "text_ok"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, ids array<int>, decoded binary, text_ok boolean")


def encoded(batches: Iterator[pa.RecordBatch], path: str, name: str) -> Iterator[tuple]:
    """For runs of documents: the rows, their ids, decoded bytes, and whether each document decodes to its text."""
    encoder = Encoder(vocabulary(path), lexicon(name))
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        for i, j, d, o in blocks(data, offsets, BLOCK_BYTES):
            ids, first = encoder.encode(d, o)
            raw, ends = encoder.decode(ids)
            cuts = np.concatenate(([0], ends))[first]
            same = len(raw) == len(d) and np.array_equal(raw, d) and np.array_equal(cuts, o)
            ok = [True] * (j - i) if same else [
                np.array_equal(raw[a:b], d[s:e]) for a, b, s, e in zip(cuts[:-1], cuts[1:], o[:-1], o[1:], strict=True)]
            yield batch.slice(i, j - i), ids, first, raw, ends, ok


def token_digests(docs: DataFrame, path: str, share: int = LEXICON_SHARE) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 of the decimal ids joined by commas, decoded_sha256 of the decoded text."""
    spark = docs.sparkSession
    name = ship_lexicon(spark, frequent_words(docs, path, share), path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decimal = vocabulary(path).decimal
        for batch, ids, first, raw, ends, _ in encoded(batches, path, name):
            cuts = np.concatenate(([0], ends))[first].tolist()
            text, at = [decimal[i] for i in ids.tolist()], first.tolist()
            digest = [hashlib.sha256(",".join(text[a:b]).encode()).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
            back = [hashlib.sha256(raw[a:b].tobytes().decode("utf-8", "replace").encode()).hexdigest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(first)), pa.array(digest), pa.array(back)],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path())
