"""Fill-in-middle transformation with memoized content-defined chunks (operator 11).

A text is cut at places that its own bytes choose: a hash rolls over windows, and where its low bits vanish a chunk ends.
Passages that documents share therefore fall into the same chunks wherever they stand. A task remembers, for each chunk,
its line boundaries, its code points and whether a marker stands in it; a hit is a hit only if the whole chunk is equal.
The summaries of a document's chunks add up to its number of lines and code points, and running counts of lines lead from
the number of a line to its chunk and, through the summary, to the byte at which the document is cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from ledgerline.llm.shared import private
from ledgerline.llm.textarrays import U, Prefix, blocks, buffers

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
#: Bytes that decide on a cut, bytes between cuts on average, at least and at most.
ROLL, AVERAGE, LEAST, MOST = 24, 512, 64, 4096
#: Bytes of chunks that one generation of a task's cache holds; two generations live at a time.
CACHE_BYTES = 16 << 20


class Summary(NamedTuple):
    """What a cut needs to know of a chunk: byte offsets behind its line feeds, its code points, a marker inside."""

    content: bytes
    ends: np.ndarray
    chars: int
    marked: bool


def code_points(chunk: bytes) -> int:
    """Code points that begin in these bytes; a chunk may start or end inside one."""
    return int(np.count_nonzero((np.frombuffer(chunk, np.uint8) & 0xC0) != 0x80))


def summarize(chunk: bytes) -> Summary:
    return Summary(chunk, np.flatnonzero(np.frombuffer(chunk, np.uint8) == 10) + 1, code_points(chunk), any(m in chunk for m in MARKS))


class ChunkCache:
    """Summaries by chunk hash, verified by content. The older of two generations goes when the younger one is full."""

    def __init__(self, size: int = CACHE_BYTES) -> None:
        self.size, self.used, self.young, self.old = size, 0, {}, {}

    def of(self, name: int, chunk: bytes) -> Summary:
        known = self.young.get(name)
        if known is not None:
            return known if known.content == chunk else summarize(chunk)
        known = self.old.get(name)
        if known is None or known.content != chunk:
            known = summarize(chunk)
        if self.used + len(chunk) > self.size:
            self.old, self.young, self.used = self.young, {}, 0
        self.young[name] = known
        self.used += len(chunk)
        return known


def chunk_ends(start: int, end: int, low: np.ndarray, least: int, most: int) -> list[int]:
    """Ends of the chunks of the bytes from start to end; `low` are the places behind windows whose hash calls for a cut."""
    places = low[np.searchsorted(low, start + ROLL) : np.searchsorted(low, end, "right")].tolist()
    out, at, i = [], start, 0
    while at < end:
        while i < len(places) and places[i] < at + least:
            i += 1
        last = places[i] if i < len(places) and places[i] <= at + most else min(at + most, end)
        out.append(last)
        at = last
    return out


def wanted_cuts(prefix: Prefix, average: int) -> np.ndarray:
    return np.flatnonzero((prefix.windows(ROLL) & U(average - 1)) == 0) + ROLL


class Lines:
    """Counts and boundaries of one text, combined from its chunk summaries."""

    def __init__(self, text: bytes, ends: list[int], names: list[int], start: int, cache: ChunkCache) -> None:
        self.text, self.summaries, carry, at = text, [], b"", 0
        self.marked = False
        for name, end in zip(names, ends, strict=True):
            chunk = text[at : end - start]
            known = cache.of(name, chunk)
            self.summaries.append(known)
            joint = carry + chunk[:2]
            self.marked = self.marked or known.marked or any(m in joint for m in MARKS)
            carry, at = (carry + chunk[-2:])[-2:], end - start
        self.bounds = [0, *(e - start for e in ends)]
        self.lines = np.cumsum([0, *(len(s.ends) for s in self.summaries)])
        self.chars = np.cumsum([0, *(s.chars for s in self.summaries)])
        self.count = int(self.lines[-1]) + (bool(text) and not text.endswith(b"\n"))

    def place(self, line: int) -> tuple[int, int]:
        """Byte and code point at which `line` lines have ended."""
        if line == self.count:
            return len(self.text), int(self.chars[-1])
        if line == 0:
            return 0, 0
        k = int(np.searchsorted(self.lines, line)) - 1
        inside = int(self.summaries[k].ends[line - int(self.lines[k]) - 1])
        return self.bounds[k] + inside, int(self.chars[k]) + code_points(self.summaries[k].content[:inside])


def _transformer(percent: int, spm: int, average: int, least: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = ChunkCache()
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            draws = [batch.column(f"h{k}").to_pylist() for k in (1, 2, 3, 4)]
            for i, j, d, o in blocks(data, offsets):
                prefix, whole, rows = Prefix(d), d.tobytes(), []
                low = wanted_cuts(prefix, average)
                for r in range(j - i):
                    start, end = int(o[r]), int(o[r + 1])
                    ends = chunk_ends(start, end, low, least, most)
                    at = np.array([start, *ends], np.int64)
                    text = Lines(whole[start:end], ends, prefix.of(at[:-1], at[1:]).tolist(), start, cache)
                    rows.append(_form(text, *(x[i + r] for x in draws), percent, spm))
                n, form, first, middle, out = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(n, pa.int64()), pa.array(form), pa.array(first, pa.int64()),
                     pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def _form(text: Lines, h1: int, h2: int, h3: int, h4: int, percent: int, spm: int) -> tuple:
    n, body = text.count, text.text
    if not body or text.marked or h3 % 100 >= percent:
        return n, "plain", None, None, body
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    (a, before), (b, until) = text.place(a), text.place(b)
    p, m, s = body[:a], body[a:b], body[b:]
    one, two, three = MARKS
    if h4 % 100 < spm:
        return n, "spm", before, until - before, two + s + one + p + three + m
    return n, "psm", before, until - before, one + p + two + s + three + m


def draws(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of `seed:key`; a null key counts as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long").alias(f"h{k}") for k in (1, 2, 3, 4)]


def fill_in_middle(docs: DataFrame, seed: int = 7, percent: int = 100, spm: int = 50, average: int = AVERAGE, least: int = LEAST, most: int = MOST) -> DataFrame:
    """One row per document: doc_id, n (lines), form (plain, psm, spm), prefix_chars, middle_chars (null if plain), output.

    `percent` of the documents are transformed, `spm` percent of those with the suffix in front. Null and empty texts and
    texts that hold a marker stay as they are. A null id has draws of its own; rows with one id and one text come out alike.
    The chunk sizes (`average`, a power of two, `least`, `most`, in bytes) change no result. No documents: no rows.
    """
    run = _transformer(percent, spm, average, least, most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *draws(F.col("doc_id").cast("long"), seed))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. Neither part holds a marker, so the first of each kind is the one set here."""
    at = lambda mark: F.instr(output, F.lit(mark))
    between = lambda a, b: F.substr(output, at(a) + len(a), at(b) - at(a) - len(a))
    rest = F.substr(output, at(MIDDLE) + len(MIDDLE))
    return (F.when(form == "psm", F.concat(between(PREFIX, SUFFIX), rest, between(SUFFIX, MIDDLE)))
            .when(form == "spm", F.concat(between(PREFIX, MIDDLE), rest, between(SUFFIX, PREFIX))).otherwise(output))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = private("back")
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn(back, restored(F.col("output"), F.col("form")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.encode("output", "UTF-8"), 256).alias("output_sha256"),
                       F.sha2(F.encode(back, "UTF-8"), 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
draws AS (
  SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM units),
parts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM draws),
texts AS (
  SELECT doc_id, n, form, text, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM parts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM texts
"""
