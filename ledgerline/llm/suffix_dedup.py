"""Removal of byte strings that stand in a document with a smaller id (operator 6), by suffix buckets.

Every suffix falls into the bucket of the smallest hash among the k-byte strings of its first `length` bytes, its anchor;
equal prefixes of that length have equal anchors, so a match never crosses buckets, and one bucket shard at a time is
grouped. Anchors are also the cover sample: any window holds one. A sampled place is named by the hash of everything that
a window around it can reach (its context); names are compared for equality only, no suffix is sorted by its bytes. Windows
around equal contexts are equal, and all but those of the smallest document are removed. Only anchors that stand in different
contexts need bytes; their contexts, of bounded length, are fetched in a second pass and their windows grouped by hash, offset by offset.
The sample is chosen by content and not by residues of the position, which halves it; see README.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm.shared import stored
from ledgerline.llm.textarrays import U, Prefix, blocks, buffers, deltas, mix, packed, undeltas, unpacked

LENGTH, ANCHOR = 50, 20
#: Text bytes of one group of the last step.
BUCKET_BYTES = 4 << 20
#: Text bytes looked at together, and anchors held before a task sends them on: some 100 MB at most.
BLOCK_BYTES, TASK_ANCHORS = 1 << 19, 800_000
#: Contexts hashed together.
CONTEXT_ROWS = 4096
#: Slots of the filter for anchors in several contexts: 2**27 bits are 16 MB, however many anchors there are.
SLOT_BITS = 27
NO_ID = (1 << 63) - 1


def sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best() of every run of `width` values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = best(out[:-step], out[step:])
        have += step
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """place, anchor name, context name, document, context start and end, for all anchors of a block.

    A place is an anchor if its k bytes have the smallest hash of some window that lies in one document.
    """
    n, span = len(data), length - k + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none.astype(U), none.astype(U), none, none, none
    prefix = Prefix(data)
    name = prefix.windows(k) | U(1)
    low = sliding(name, span, np.minimum)[: n - length + 1]
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    low = np.where(owner[: n - length + 1] == owner[length - 1 :], low, U(0))
    padded = np.concatenate((np.zeros(span - 1, U), low, np.zeros(span - 1, U)))
    place = np.flatnonzero(sliding(padded, span, np.maximum)[: len(name)] == name)
    doc = owner[place]
    start = np.maximum(place - span + 1, offsets[doc])
    end = np.minimum(place + length, offsets[doc + 1])
    context = mix(prefix.raw(start, end) + (place - start).astype(U) * U(0x9FB21C651E98DF25) + (end - place).astype(U) * U(0xD6E8FEB86659FD93))
    return place, name[place], context, doc, start, end


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
    return ids, batch.column("name").to_numpy(zero_copy_only=False).astype(np.int64)


def smallest_first(anchor: np.ndarray, context: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by anchor, context, document; the first of each (anchor, context); places whose document is not the smallest of it."""
    order = np.lexsort((doc, context, anchor))
    a, c, d = anchor[order], context[order], doc[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
    least = d[new][np.cumsum(new) - 1] if len(order) else d
    return order, order[new], order[d > least]


def smallest_runs(anchor: np.ndarray, context: np.ndarray, doc: np.ndarray, name: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the smallest document of each (anchor, context): the first of each run, and from there to its last.

    Places of one run stand at most `size` apart, so that what is removed around them is one piece.
    """
    order = np.lexsort((start, name, doc, context, anchor))
    a, c, d = anchor[order], context[order], doc[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
    keep = d == d[new][np.cumsum(new) - 1] if len(order) else new
    order, new = order[keep], new[keep]
    n, s = name[order], start[order]
    new[1:] |= (n[1:] != n[:-1]) | (s[1:] - s[:-1] > size[order[:-1]])
    first = np.flatnonzero(new)
    return order[first], s[np.append(first[1:], len(s)) - 1] - s[first] if len(s) else s


def first_pass(length: int, k: int, shards: int):
    """Anchors of a task: what is decided here already, and for each (anchor, context) all runs of the smallest document, by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        for batch in batches:
            ids, names = _columns(batch)
            data, offsets = buffers(batch.column("text"))
            for i, _, d, o in blocks(data, offsets, BLOCK_BYTES):
                _, anchor, context, doc, start, end = anchors(d, o, length, k)
                parts.append((anchor, context, ids[i + doc], names[i + doc], (start - o[doc]).astype(np.int64), (end - start).astype(np.uint8)))
            if sum(len(x[0]) for x in parts) > TASK_ANCHORS:
                yield _shard_rows(parts, shards)
                parts = []
        if parts:
            yield _shard_rows(parts, shards)

    return run


def _shard_rows(parts: list[tuple], shards: int) -> pa.RecordBatch:
    anchor, context, doc, name, start, size = (np.concatenate(x) for x in zip(*parts, strict=True))
    _, _, covered = smallest_first(anchor, context, doc)
    first, more = smallest_runs(anchor, context, doc, name, start, size)
    out = []
    for s, at in _by_shard(anchor[first] % U(shards), shards):
        run = more[at] + size[first[at]]
        at = first[at]
        docs, local = np.unique(np.stack((doc[at], name[at])), axis=1, return_inverse=True)
        out.append((s, packed(deltas(anchor[at]), _planes(context[at]), docs[0], docs[1], local.reshape(-1).astype(np.uint32),
                              start[at].astype(np.uint32) if start[at].max(initial=0) < 1 << 32 else start[at],
                              run.astype(np.uint8) if run.max(initial=0) < 1 << 8 else run)))
    done = covered
    for s, at in _by_shard(mix(name[done].view(U)) % U(shards), shards):
        at = done[at]
        out.append((-1 - s, _verdict(name[at], start[at], size[at].astype(np.int64))))
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["shard", "payload"])


def _by_shard(shard: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1, dtype=shard.dtype))
    for s in range(shards):
        if cuts[s + 1] > cuts[s]:
            yield s, order[cuts[s] : cuts[s + 1]]


def _planes(x: np.ndarray) -> np.ndarray:
    """The low 48 bits of each value."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :6]).reshape(-1)


def _from_planes(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x) // 6, 8), np.uint8)
    out[:, :6] = x.reshape(-1, 6)
    return out.reshape(-1).view(U)


def _verdict(name: np.ndarray, start: np.ndarray, size: np.ndarray) -> bytes:
    """Runs to remove, by document name; overlapping runs of one document merge."""
    order = np.lexsort((start, name))
    name, start, end = name[order], start[order], start[order] + size[order]
    if not len(name):
        return packed(name, start, end)
    new = np.concatenate(([True], name[1:] != name[:-1]))
    group = np.cumsum(new) - 1
    width = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * width) - group * width
    new[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return packed(name[first], start[first], reach[np.append(first[1:], len(name)) - 1])


def shard_verdicts(buckets: int):
    """One shard: anchors of all tasks together. Rows (bucket, payload) of runs to remove; bucket -1: anchors in several contexts."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        runs: list[tuple] = []
        out: list[tuple] = []
        if key[0] < 0:
            runs = [tuple(unpacked(x)) for x in rows["payload"]]
            name, start, end = (np.concatenate(x) for x in zip(*runs, strict=True))
        else:
            parts = []
            for value in rows["payload"]:
                planes, context, doc, names, local, start, size = unpacked(value)
                parts.append((undeltas(planes), _from_planes(context), doc[local], names[local], start.astype(np.int64), size.astype(np.int64)))
            anchor, context, doc, name, start, size = (np.concatenate(x) for x in zip(*parts, strict=True))
            _, first, covered = smallest_first(anchor, context, doc)
            a, d = anchor[first], doc[first]
            new = np.concatenate(([True], a[1:] != a[:-1]))
            begin = np.flatnonzero(new)
            several = np.minimum.reduceat(d, begin) < np.maximum.reduceat(d, begin)
            out.append((-1, packed(deltas(a[begin[several]]))))
            name, start, end = name[covered], start[covered], start[covered] + size[covered]
        for b, at in _by_shard(name.view(U) % U(buckets), buckets):
            out.append((b, _verdict(name[at], start[at], end[at] - start[at])))
        return pd.DataFrame(out, columns=["bucket", "payload"])

    return run


def slot_words(rows: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for value in batch.column("payload").to_pylist():
            slot = np.sort(undeltas(unpacked(value)[0]) % U(1 << bits))
            word, start = np.unique(slot >> U(6), return_index=True)
            value = np.bitwise_or.reduceat(U(1) << (slot & U(63)), start) if len(slot) else slot
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(value.view(np.int64))], names=["word", "bits"])


def second_pass(slots, length: int, k: int, shards: int, bits: int):
    """Contexts of anchors that may stand in several, with their bytes, by shard; of equal contexts all runs of the smallest document."""
    span = length - k + 1
    width = span - 1 + length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        parts: list[tuple] = []
        for batch in batches:
            ids, names = _columns(batch)
            data, offsets = buffers(batch.column("text"))
            for i, _, d, o in blocks(data, offsets, BLOCK_BYTES):
                place, anchor, context, doc, start, end = anchors(d, o, length, k)
                slot = anchor % U(1 << bits)
                hit = np.flatnonzero((table[(slot >> U(6)).astype(np.int64)] >> (slot & U(63))) & U(1))
                wide = np.concatenate((np.zeros(span, np.uint8), d, np.zeros(length, np.uint8)))
                at = place[hit][:, None] + np.arange(1, width + 1)
                body = wide[at]
                parts.append((anchor[hit], context[hit], ids[i + doc[hit]], names[i + doc[hit]], place[hit] - o[doc[hit]],
                              (place - start)[hit].astype(np.uint8), (end - place)[hit].astype(np.uint8), body))
            if sum(len(x[0]) for x in parts) > TASK_ANCHORS // 4:
                yield _context_rows(parts, shards, length)
                parts = []
        if parts:
            yield _context_rows(parts, shards, length)

    return run


def _context_rows(parts: list[tuple], shards: int, length: int) -> pa.RecordBatch:
    anchor, context, doc, name, place, left, right, body = (np.concatenate(x) for x in zip(*parts, strict=True))
    runs, more = smallest_runs(anchor, context, doc, name, place, np.full(len(place), length))
    out = []
    for s, every in _by_shard(anchor[runs] % U(shards), shards):
        run = runs[every]
        new = np.ones(len(run), bool)
        new[1:] = (anchor[run[1:]] != anchor[run[:-1]]) | (context[run[1:]] != context[run[:-1]])
        at = run[new]
        times = np.diff(np.append(np.flatnonzero(new), len(run)))
        out.append((s, packed(deltas(anchor[at]), doc[at], times, name[run], place[run], more[every], left[at], right[at], body[at].reshape(-1))))
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["shard", "payload"])


def resolve(length: int, k: int, buckets: int):
    """One shard of contexts: the windows at each offset grouped by hash, all but those of the smallest document removed."""
    span = length - k + 1
    width = span - 1 + length

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parts, runs = [], []
        for value in rows["payload"]:
            planes, doc, times, name, place, more, left, right, body = unpacked(value)
            parts.append((undeltas(planes), doc, times, left.astype(np.int64), right.astype(np.int64), body.reshape(-1, width)))
            runs.append((name, place, more))
        anchor, doc, times, left, right, body = (np.concatenate(x) for x in zip(*parts, strict=True))
        name, place, more = (np.concatenate(x) for x in zip(*runs, strict=True))
        begin = np.cumsum(times) - times
        gone: list[tuple] = []
        windows = np.empty((span, len(body)), np.uint64)
        for i in range(0, len(body), CONTEXT_ROWS):
            part = body[i : i + CONTEXT_ROWS]
            prefix, row = Prefix(part.reshape(-1)), np.arange(len(part)) * width
            for offset in range(span):
                windows[offset, i : i + len(part)] = mix(prefix.raw(row + offset, row + offset + length))
        for offset in range(span):
            fits = np.flatnonzero((offset >= span - 1 - left) & (offset + length <= span - 1 + right))
            window = windows[offset][fits]
            order = np.lexsort((doc[fits], window, anchor[fits]))
            a, w, d = anchor[fits][order], window[order], doc[fits][order]
            new = np.ones(len(order), bool)
            new[1:] = (a[1:] != a[:-1]) | (w[1:] != w[:-1])
            if not len(order):
                continue
            late = fits[order[d > d[new][np.cumsum(new) - 1]]]
            many = times[late]
            at = np.repeat(begin[late] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            gone.append((name[at], place[at] - (span - 1) + offset, more[at] + length))
        if not gone:
            return pd.DataFrame({"bucket": pd.Series([], dtype="int32"), "payload": pd.Series([], dtype=object)})
        name, start, size = (np.concatenate(x) for x in zip(*gone, strict=True))
        out = [(b, _verdict(name[at], start[at], size[at])) for b, at in _by_shard(name.view(U) % U(buckets), buckets)]
        return pd.DataFrame(out, columns=["bucket", "payload"])

    return run


def strip(key: tuple, docs: pd.DataFrame, verdicts: pd.DataFrame) -> pd.DataFrame:
    """Documents of one bucket without the runs to remove."""
    if len(verdicts):
        name, start, end = (np.concatenate(x) for x in zip(*(unpacked(v) for v in verdicts["payload"]), strict=True))
        order = np.argsort(name, kind="stable")
        name, start, end = name[order], start[order], end[order]
    else:
        name = start = end = np.zeros(0, np.int64)
    first, last = np.searchsorted(name, docs["name"], "left"), np.searchsorted(name, docs["name"], "right")
    out = []
    for doc_id, text, a, b in zip(docs["doc_id"], docs["text"], first.tolist(), last.tolist(), strict=True):
        raw = np.frombuffer(text.encode(), np.uint8)
        edge = np.zeros(len(raw) + 1, np.int64)
        np.add.at(edge, start[a:b], 1)
        np.add.at(edge, end[a:b], -1)
        gone = np.cumsum(edge)[:-1] > 0
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
        kept = raw[~gone].tobytes()
        out.append((None if pd.isna(doc_id) else int(doc_id), len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]).astype({"doc_id": "Int64"})


def strip_without_text(key: tuple, docs: pd.DataFrame, verdicts: pd.DataFrame) -> pd.DataFrame:
    return strip(key, docs, verdicts).drop(columns="kept")


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR, with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with `with_text` the kept bytes.

    Null text counts as empty. Texts shorter than `length` bytes lose nothing. Rows that share an id don't remove each
    other's bytes; a null id counts as larger than all others. 2 * length - k may be 255 at most. No documents: no rows.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("name"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = 4 * partitions
    buckets = max(1, math.ceil(total / BUCKET_BYTES))
    messages = rows.mapInArrow(first_pass(length, k, shards), "shard int, payload binary")
    verdicts = stored(messages.groupBy("shard").applyInPandas(shard_verdicts(buckets), "bucket int, payload binary"), "repeats")
    words = verdicts.where("bucket = -1").select("payload").mapInArrow(lambda it: slot_words(it, SLOT_BITS), "word long, bits long")
    words = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << (SLOT_BITS - 6), np.uint64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    slots = spark.sparkContext.broadcast(table)
    contexts = rows.mapInArrow(second_pass(slots, length, k, shards, SLOT_BITS), "shard int, payload binary")
    partial = contexts.groupBy("shard").applyInPandas(resolve(length, k, buckets), "bucket int, payload binary")
    every = verdicts.where("bucket >= 0").unionByName(partial)
    bucketed = rows.withColumn("bucket", F.expr(f"cast(pmod(pmod(name, {buckets}) + if(name < 0, {(1 << 64) % buckets}, 0), {buckets}) as int)"))
    both = bucketed.groupBy("bucket").cogroup(every.groupBy("bucket"))
    return both.applyInPandas(strip, RESULT + ", kept binary") if with_text else both.applyInPandas(strip_without_text, RESULT)


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
