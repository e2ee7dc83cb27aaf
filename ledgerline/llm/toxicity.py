"""Toxicity by a bidirectional gated recurrent network over overlapping windows (operator 12).

The network of `gru` is trained in one task from a bounded sample of labelled texts; the driver only hands its parameters
on, whose size is fixed. Executors score every window of every whole text; the worst window decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from ledgerline.llm.gru import PLAIN, Network, encode, logits, train, window_places
from ledgerline.llm.textarrays import blocks, buffers, words

#: Words in a window, and between the first words of two windows.
WIDTH, STRIDE = 64, 32
#: Training sample: texts of each label at most, windows of a text at most, bytes of a word at most. Scoring has no such bounds.
MAX_TOXIC, MAX_CLEAN, MAX_WINDOWS, MAX_WORD = 1500, 3000, 16, 64
#: Bytes of text scored at a time; distinct words of a block are held with their vectors.
BLOCK_BYTES = 1 << 20


def _window_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to MAX_WINDOWS windows of each text, evenly spread, as words joined by spaces."""
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        for i, j, d, o in blocks(data, offsets):
            plain = PLAIN[d]
            start, end, first = words(plain, o)
            text, at, length = window_places(first, WIDTH, STRIDE)
            edge, out = np.searchsorted(text, np.arange(j - i + 1)), []
            raw, end = plain.tobytes(), np.minimum(end, start + MAX_WORD)
            for k in range(j - i):
                some = np.unique(np.linspace(edge[k], edge[k + 1] - 1, MAX_WINDOWS).astype(np.int64)) if edge[k + 1] > edge[k] else []
                out.append([b" ".join(raw[start[w] : end[w]] for w in range(at[x], at[x] + length[x])) for x in some])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in ("doc_id", "label")), pa.array(out, pa.list_(pa.binary()))],
                                             names=["doc_id", "label", "windows"])


def training_sample(docs: DataFrame, labels: DataFrame, most_toxic: int = MAX_TOXIC, most_clean: int = MAX_CLEAN) -> DataFrame:
    """doc_id, label, windows of at most about so many labelled texts of each kind, picked by a hash of the id.

    Contradictory labels of one id: the more frequent one, ties to 0. Rows without id or label are left out.
    """
    votes = labels.where("doc_id is not null and label in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("label").alias("label"))
    votes = votes.withColumn("label", (F.col("label") > 0.5).cast("int"))
    found = {r["label"]: r["n"] for r in votes.groupBy("label").agg(F.count("*").alias("n")).collect()}
    cut = lambda k, most: int(min(1.0, most / max(1, found.get(k, 0))) * (1 << 30))
    limit = F.when(F.col("label") == 1, cut(1, most_toxic)).otherwise(cut(0, most_clean))
    picked = votes.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < limit)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    return rows.select("doc_id", "label", "text").mapInArrow(_window_texts, "doc_id long, label int, windows array<binary>")


def _trainer(seed: int):
    """Rows of a training sample, all in one task, to the parameters of the network and the separating logit; no rows
    without windows of both labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["doc_id"], r["label"], r["windows"]) for b in batches for r in b.to_pylist() if r["windows"])
        label = np.array([r[1] for r in rows], np.int64)
        if len(set(label.tolist())) < 2:
            return
        pieces = [w for r in rows for w in r[2]]
        offsets = np.concatenate(([0], np.cumsum([len(p) for p in pieces])))
        net = Network.new(seed=seed)
        vocabulary, back, first = encode(np.frombuffer(b"".join(pieces), np.uint8), offsets, len(net.word), len(net.char))
        text = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
        net, cut, _ = train(net, vocabulary, back, text, first[:-1], np.diff(first), label, WIDTH, seed=seed)
        found = [*net.arrays(), np.array([cut], np.float32)]
        yield pa.RecordBatch.from_arrays([pa.array([list(a.shape) for a in found], pa.list_(pa.int64())), pa.array([a.tobytes() for a in found], pa.binary())],
                                         names=["shape", "data"])

    return run


def fit(sample: DataFrame, seed: int = 1) -> tuple[Network, float] | None:
    """The network and the logit that separates the labels; none without windows of both labels."""
    rows = sample.repartition(1).mapInArrow(_trainer(seed), "shape array<long>, data binary").collect()
    if not rows:
        return None
    *arrays, cut = (np.frombuffer(bytes(r["data"]), np.float32).reshape(r["shape"]) for r in rows)
    return Network(*arrays), float(cut[0])


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, cut = shared.value
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j, d, o in blocks(data, offsets, BLOCK_BYTES):
                vocabulary, back, first = encode(d, o, len(net.word), len(net.char))
                text, start, length = window_places(first, WIDTH, STRIDE)
                logit = logits(net, vocabulary, back, start, length, WIDTH)
                order = np.lexsort((-start, logit, text))
                top = order[np.concatenate((text[order][1:] != text[order][:-1], [True]))] if len(order) else order
                worst, place, count = np.full(j - i, float(net.out_bias[0])), np.full(j - i, -1), np.bincount(text, minlength=j - i)
                worst[text[top]], place[text[top]] = logit[top], start[top] - first[text[top]]
                score = 1 / (1 + np.exp(-np.clip(worst - cut, -500, 500)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(score), pa.array(count), pa.array(place, mask=place < 0)],
                    names=["doc_id", "score", "n_windows", "worst_window"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, most_toxic: int = MAX_TOXIC, most_clean: int = MAX_CLEAN, seed: int = 1) -> DataFrame:
    """One row per document: doc_id, score (0 to 1), predicted (1 if score >= 0.5), n_windows, worst_window (its first word).

    `labels` has doc_id and label and holds only rows to learn from. Null and empty texts and texts without a letter or
    digit have no window and the score of the output's bias. Repeated rows are scored each. No documents: no rows; no
    labels of either kind: every score is 0.5.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fitted = fit(training_sample(docs, labels, most_toxic, most_clean), seed)
    if fitted is None:
        return rows.select("doc_id", F.lit(0.5).alias("score"), F.lit(1).alias("predicted"), F.lit(0).cast("long").alias("n_windows"), F.lit(None).cast("long").alias("worst_window"))
    scored = rows.mapInArrow(_scorer(spark.sparkContext.broadcast(fitted)), "doc_id long, score double, n_windows long, worst_window long")
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_windows", "worst_window")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out()).select("doc_id", F.col("toxic").alias("label"))
    return score_toxicity(docs, labels).select("doc_id", held_out().alias("held_out"), "score", "predicted", "n_windows", "worst_window")
