"""Quality classifier by Bradley-Terry pairwise ranking (operator 1).

A text of label 1 is preferred to one of label 0. The chance of a preference is a logistic function of the difference of two
scores, and a score is linear in features of the whole text, so the weights come from logistic regression without intercept
on feature differences. Texts meet in hashed slots, a few rounds each, so pairs grow with the labelled rows and not with
their product. A quantile of the scores of the labelled texts is the threshold; the score that is returned is the
chance of being preferred to a text at the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession

from ledgerline.llm.perplexity import base_features
from ledgerline.llm.shared import stored
from ledgerline.llm.textarrays import U, Prefix, blocks, buffers, mix, words

FEATURES = [
    "log_words", "short", "word_length", "symbols_per_word", "repeated_lines", "repeated_words", "upper_share", "digit_share", "marks_per_word",
    "shouts_per_word", "distinct_share", "line_length", "sentence_ends", "other_bytes", "longest_word", "bare_lines",
]
#: Labelled rows to fit on, at most; beyond, a hash of the id picks them.
MAX_LABELLED = 500_000
ROUNDS = 8
QUANTILES = 400


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each document; zeros for a text without words."""
    n_words, word_chars, symbols, dup_lines, repeated = (x.astype(np.float64) for x in base_features(data, offsets))
    start, end, first = words(data, offsets)
    docs = len(offsets) - 1
    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)

    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    digit, newline = (data >= 48) & (data <= 57), data == 10
    mark = (data > 32) & (data < 127) & ~upper & ~lower & ~digit
    stop = (data == 46) | (data == 63)
    stops = np.zeros(len(data), bool)
    stops[:-1] = stop[:-1] & ((data[1:] == 32) | (data[1:] == 10)) if len(data) else stops[:-1]
    who = np.repeat(np.arange(docs), np.diff(first))
    name = mix(Prefix(data).of(start, end) + who.astype(U) * U(0xA24BAED4963EE407))
    _, at = np.unique(name, return_index=True)
    distinct = np.bincount(who[at], minlength=docs).astype(np.float64)
    longest = np.zeros(docs)
    np.maximum.at(longest, who, (end - start).astype(np.float64))
    per, lines = np.maximum(n_words, 1), count(newline) + 1
    chars = np.maximum(word_chars, 1)
    closed = np.zeros(len(data), bool)
    closed[1:] = newline[1:] & ~stop[:-1] if len(data) else closed[1:]
    out = np.stack([
        np.log1p(n_words), (n_words < 50).astype(float), word_chars / per, symbols / per, dup_lines / lines, repeated / per, count(upper) / chars,
        count(digit) / chars, count(mark) / per, count((data == 33) | (data == 63)) / per, distinct / per, np.log1p(n_words / lines), count(stops) / per,
        count(data >= 128) / chars, np.log1p(longest), count(closed) / lines,
    ], axis=1)
    out[n_words == 0] = 0
    return out


def featured(docs: DataFrame) -> DataFrame:
    """doc_id, features."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j, d, o in blocks(data, offsets):
                rows = text_features(d, o)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32()), pa.array(rows.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), flat], names=["doc_id", "features"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, features array<double>")


def training_rows(features: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """features and label (0 or 1) of at most about `most` labelled documents. Contradictory labels of one id average out to
    the more frequent one, ties to 0; rows without id or label are left out."""
    votes = labels.where("doc_id is not null and label in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("label").alias("label"))
    votes = votes.withColumn("label", (F.col("label") > 0.5).cast("int"))
    share = min(1.0, most / max(1, votes.count()))
    picked = votes.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    return features.join(picked, "doc_id").select("doc_id", "features", "label")


def pairs(rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(x, label): feature differences preferred minus not preferred, and their negatives.

    In each round a text of either label gets a random slot; as many slots as texts of the rarer label, so a slot holds few.
    """
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    slots = max(1, min(counts.get(0, 0), counts.get(1, 0)))
    dealt = rows.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    dealt = dealt.withColumn("slot", F.pmod(F.xxhash64("doc_id", "round"), F.lit(slots)))
    good = dealt.where("label = 1").select("round", "slot", F.col("features").alias("a"))
    bad = dealt.where("label = 0").select("round", "slot", F.col("features").alias("b"))
    met = good.join(bad, ["round", "slot"]).select(F.zip_with("a", "b", lambda a, b: a - b).alias("x"))
    return met.select("x", F.lit(1.0).alias("label")).unionByName(met.select(F.transform("x", lambda v: -v).alias("x"), F.lit(0.0).alias("label")))


def fit(rows: DataFrame) -> tuple[list[float], float]:
    """Weights of the features and the threshold. Without texts of both labels: zero weights, threshold 0 (every score 0.5)."""
    rows = stored(rows, "pairwise-rows")
    if rows.select("label").distinct().count() < 2:
        return [0.0] * len(FEATURES), 0.0
    data = stored(pairs(rows), "pairwise-pairs").select(array_to_vector("x").alias("features"), "label")
    weights = [float(w) for w in LogisticRegression(fitIntercept=False, regParam=1e-4, maxIter=100).fit(data).coefficients]
    scored = rows.select(linear(weights).alias("s"), "label")
    grid = [i / QUANTILES for i in range(1, QUANTILES)]
    cuts = sorted(set(scored.agg(F.percentile_approx("s", grid, 100_000)).first()[0]))
    found = scored.agg(*[F.sum(((F.col("s") >= c) & (F.col("label") == k)).cast("long")) for k in (0, 1) for c in cuts],
                       *[F.sum((F.col("label") == k).cast("long")) for k in (0, 1)]).first()
    n0, n1 = found[-2], found[-1]
    quality = [found[len(cuts) + i] / n1 - found[i] / n0 for i in range(len(cuts))]
    best = max(quality)
    flat = [c for c, q in zip(cuts, quality, strict=True) if q >= best - 1e-12]
    return weights, (flat[0] + flat[-1]) / 2


def linear(weights: list[float]):
    return sum((F.element_at("features", i + 1) * F.lit(w) for i, w in enumerate(weights)), F.lit(0.0))


def score_quality(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """One row per document: doc_id, score (0 to 1), predicted (1 if score >= 0.5).

    `labels` has doc_id and label and holds only rows to learn from. Null and empty texts get the score of zero features.
    Repeated rows are scored each. No documents: no rows; no labels of either kind: every score is 0.5.
    """
    table = stored(featured(docs), "pairwise-features")
    weights, threshold = fit(training_rows(table, labels, most))
    score = 1 / (1 + F.exp(F.greatest(F.lit(-500.0), F.least(F.lit(500.0), F.lit(threshold) - linear(weights)))))
    return table.select("doc_id", score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def op1_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out()).select("doc_id", F.col("quality").alias("label"))
    return score_quality(docs, labels).select("doc_id", held_out().alias("held_out"), "score", "predicted")
