"""Quality rules with an n-gram perplexity (operator 2).

The model is a modified Kneser-Ney model of character n-grams (order 5 by default: it needs no word list of a language, and
its table grows far slower than the corpus). Spark counts the n-grams of all texts, and every later step is a join or an
aggregation over the table of distinct n-grams: continuation counts of the lower orders, discounts from counts of counts,
back-off weights, interpolated probabilities. Texts with few symbols for their words count as examples of the language;
n-grams of the other texts only are in the table with a count of 0 and get the probability of their back-off, or junk that
fills a tenth of a corpus would vouch for itself. So all scored n-grams have an entry, and a score needs one lookup for
each character. N-grams of two and more characters that stand once are pruned (their mass goes to the shorter one), so
a text that is like no other is not held likely for having been counted. The table becomes sorted arrays of hashes and log probabilities; arrays above a stated size are cut by hash
range, and each range scores the texts on its own, because log probabilities add up.

A language's perplexity band reaches from its quartiles by a multiple of their distance; texts outside are rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W

from ledgerline.llm.shared import stored, without
from ledgerline.llm.textarrays import U, Prefix, blocks, buffers, mix, words

ORDER = 5
#: Entries of one broadcast array: 12 bytes each, so 200 MB at most.
ARRAY_ENTRIES = 1 << 24
#: Distinct n-grams that a counting task holds; their sorted copies take several times as much for a moment.
TASK_GRAMS = 1_000_000
#: Quartile distances that a band reaches below and above the quartiles, and the least half width in nats.
REACH, LEAST = 3.0, 0.2
#: Symbols per word up to which a text is an example for the model.
EXAMPLE_SYMBOLS = 0.1
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
#: Stands before the first character of a text, `order - 1` times.
START = 2
#: Histogram cells of one nat.
CELLS = 1000

BASE_COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _per_document(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[offsets[1:]] - total[offsets[:-1]]


def base_features(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Words, code points in words, symbols, repeated lines, and words in repeated 3-word windows of each document."""
    start, end, first = words(data, offsets)
    n, docs = len(data), len(offsets) - 1
    inside = np.zeros(n + 1, np.int64)
    np.add.at(inside, start, 1)
    np.add.at(inside, end, -1)
    letters = (np.cumsum(inside)[:n] > 0) & ((data & 0xC0) != 0x80)
    prefix = Prefix(data)
    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate((offsets[:-1], breaks + 1)))
    line_start = line_start[line_start < n]
    after = np.append(line_start[1:], n)
    line_end = np.where((after > line_start) & (data[np.maximum(after - 1, 0)] == 10), after - 1, after) if n else after
    has_word = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end = line_start[has_word], line_end[has_word]
    owner = np.searchsorted(offsets, line_start, "right") - 1
    _, lines = np.unique(mix(prefix.of(line_start, line_end) + owner.astype(U) * U(0xA24BAED4963EE407)), return_index=True)
    dup = np.bincount(owner, minlength=docs) - np.bincount(owner[lines], minlength=docs)
    word, who = prefix.of(start, end), np.repeat(np.arange(docs), np.diff(first))
    covered = np.zeros(len(word), bool)
    if len(word) > 2:
        window = mix(mix(mix(word[:-2]) + word[1:-1]) + word[2:] + who[:-2].astype(U) * U(0x9FB21C651E98DF25))
        whole = np.flatnonzero(who[:-2] == who[2:])
        _, back, count = np.unique(window[whole], return_inverse=True, return_counts=True)
        again = whole[count[back] > 1]
        for k in range(3):
            covered[again + k] = True
    return [np.diff(first), _per_document(letters, offsets), _per_document(SYMBOLS[data], offsets), dup, _per_document(covered, first)]


def characters(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Characters with `order - 1` start marks before each text, the hashes of the n-grams that end at them, the places of
    the texts' own characters, and the number of the first such character of each document.

    Letters A-Z count as lower case, a run of white space as one space.
    """
    chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).copy()
    lead = (data & 0xC0) != 0x80
    at = np.concatenate(([0], np.cumsum(lead)))[offsets]
    chars[(chars >= 65) & (chars <= 90)] += 32
    blank = ((chars >= 9) & (chars <= 13)) | (chars == 32)
    chars[blank] = 32
    stay = np.ones(len(chars), bool)
    if len(chars):
        stay[1:] = ~(blank[1:] & blank[:-1])
        stay[at[:-1][at[:-1] < len(chars)]] = True
    kept = np.concatenate(([0], np.cumsum(stay)))[at]
    chars, sizes = chars[stay], np.diff(kept)
    pad = order - 1
    out = np.full(len(chars) + pad * len(sizes), START, np.uint32)
    place = np.arange(len(chars)) + pad * np.repeat(np.arange(1, len(sizes) + 1), sizes)
    out[place] = chars
    h = np.zeros(len(out), U)
    for k in range(order):
        h[pad:] = mix(h[pad:] + out[k : len(out) - pad + k].astype(U) + U(0x9E3779B97F4A7C15)) if len(out) > pad else h[pad:]
    return out, h, place, kept


def examples(data: np.ndarray, offsets: np.ndarray, most: float) -> np.ndarray:
    """Whether each document has at most `most` symbols per word."""
    blank = ((data >= 9) & (data <= 13)) | (data == 32)
    first = ~blank
    first[1:] &= blank[:-1]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begins] = ~blank[begins]
    return _per_document(SYMBOLS[data], offsets) <= most * _per_document(first, offsets)


def _tally(names: np.ndarray, counts: np.ndarray, kind: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct names in order, a place of each, and the sum of its counts."""
    if not len(names):
        return names, np.zeros(0, np.int64), counts
    by_name = np.argsort(names, kind=kind)
    ordered = names[by_name]
    at = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return ordered[at], by_name[at], np.add.reduceat(counts[by_name], at)


def count_ngrams(order: int, most: float = EXAMPLE_SYMBOLS):
    """Every n-gram of the texts with its count in the example texts, which may be 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, grams, counts = np.zeros(0, U), np.zeros((0, order), np.uint32), np.zeros(0, np.int64)
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for _, _, d, o in blocks(data, offsets):
                chars, h, place, kept = characters(d, o, order)
                names, at, n = _tally(h[place], np.repeat(examples(d, o, most).astype(np.int64), np.diff(kept)))
                spans = place[at][:, None] + np.arange(1 - order, 1)
                seen, first, counts = _tally(np.concatenate((seen, names)), np.concatenate((counts, n)), "stable")  # two sorted runs
                grams = np.concatenate((grams, chars[spans]))[first]
            if len(seen) > TASK_GRAMS:
                yield _gram_rows(grams, seen, counts)
                seen, grams, counts = seen[:0], grams[:0], counts[:0]
        if len(seen):
            yield _gram_rows(grams, seen, counts)

    return run


def _gram_rows(grams: np.ndarray, names: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    text = grams.astype("<u4").tobytes().decode("utf-32-le")
    order = grams.shape[1]
    parts = [text[i : i + order] for i in range(0, len(text), order)]
    return pa.RecordBatch.from_arrays([pa.array(parts), pa.array(names.view(np.int64)), pa.array(counts)], names=["gram", "name", "n"])


def _discounts(table: DataFrame) -> list[float]:
    """Discounts of counts 1, 2 and above, from the numbers of n-grams with counts 1 to 4."""
    found = {r["n"]: r["k"] for r in table.where("n BETWEEN 1 AND 4").groupBy("n").agg(F.count("*").alias("k")).collect()}
    n1, n2, n3, n4 = (found.get(i, 0) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), k * 0.95) for k, d in enumerate(raw, 1)]


def model(docs: DataFrame, order: int = ORDER, most: float = EXAMPLE_SYMBOLS) -> DataFrame:
    """name (64-bit hash of the n-gram), logp (natural log of the probability of its last character).

    A context that no example text has says nothing, so the shorter one decides; without any example text all characters
    are equally likely.
    """
    grams = docs.select("text").mapInArrow(count_ngrams(order, most), "gram string, name long, n long")
    top = stored(grams.groupBy("gram", "name").agg(F.sum("n").alias("n")), "ngrams")
    tables = {order: top.select("gram", "n")}
    for m in range(order - 1, 0, -1):
        tables[m] = stored(tables[m + 1].groupBy(F.substring("gram", 2, m).alias("gram")).agg(F.count_if(F.col("n") > 0).alias("n")), "ngrams")
    probability = None
    for m in range(1, order + 1):
        table = tables[m].withColumn("context", F.substring("gram", 1, m - 1)).withColumn("rest", F.substring("gram", 2, m - 1))
        d = _discounts(tables[m])
        if m > 1:
            d[0] = 1.0  # singletons are pruned: their whole mass backs off, or a text would vouch for itself
        discount = F.when(F.col("n") == 0, 0.0).when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        sums = table.groupBy("context").agg(F.sum("n").alias("total"), F.sum(discount).alias("freed"), F.count("*").alias("kinds"))
        joined = table.join(sums, "context")
        lower = 1.0 / F.col("kinds") if probability is None else F.col("lower")
        if probability is not None:
            joined = joined.join(probability.select(F.col("gram").alias("rest"), F.col("p").alias("lower")), "rest")
        p = F.when(F.col("total") > 0, F.try_divide(F.col("n") - discount + F.col("freed") * lower, F.col("total"))).otherwise(lower)
        probability = stored(joined.select("gram", p.alias("p")), "ngram-probabilities")
    return top.join(probability, "gram").select("name", F.log("p").cast("float").alias("logp"))


def array_ranges(table: DataFrame, entries: int = ARRAY_ENTRIES) -> list[tuple[int, int]]:
    """Hash ranges with about `entries` n-grams each; hashes are even, so equal ranges hold equal shares."""
    parts = max(1, math.ceil(table.count() / (entries * 0.9)))
    edges = [-(1 << 63) + (i * (1 << 64)) // parts for i in range(parts + 1)]
    return [(a, b - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def score(docs: DataFrame, order: int = ORDER, entries: int = ARRAY_ENTRIES, most: float = EXAMPLE_SYMBOLS) -> DataFrame:
    """row, doc_id, lang, the base columns, n_scored (characters), log_sum (of their probabilities)."""
    spark = docs.sparkSession
    table = stored(model(docs, order, most), "ngram-model")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    ranges = array_ranges(table, entries)
    parts = None
    for low, high in ranges:
        rows = table.where(F.col("name").between(low, high)).toArrow()
        names, logp = rows["name"].to_numpy(), rows["logp"].to_numpy()
        order_ = np.argsort(names, kind="stable")
        arrays = spark.sparkContext.broadcast((names[order_], logp[order_]))
        scored = keyed.mapInArrow(_scorer(arrays, order), f"doc_id long, lang string, row string, {BASE_COLUMNS}, n_scored long, log_sum double")
        parts = scored if parts is None else parts.unionByName(scored)
    if len(ranges) == 1:
        return parts.drop("row")
    same = ["doc_id", "lang", "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return parts.groupBy(*same).agg((F.count("*") / len(ranges)).cast("long").alias("times"), F.first("n_scored").alias("n_scored"),
                                    F.sum("log_sum").alias("log_sum")).withColumn("log_sum", F.col("log_sum") / F.col("times")).select(
        "doc_id", "lang", *same[3:], "n_scored", "log_sum", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_")).drop("_")


def _scorer(arrays, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logp = arrays.value
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j, d, o in blocks(data, offsets):
                _, h, place, chars = characters(d, o, order)
                ends, back = np.unique(h[place].view(np.int64), return_inverse=True)
                at = np.minimum(np.searchsorted(names, ends), max(len(names) - 1, 0))
                found = np.where(names[at] == ends, logp[at], 0.0)[back] if len(names) else np.zeros(len(back))
                text = Prefix(d).of(o[:-1], o[1:])
                part = batch.slice(i, j - i)
                columns = base_features(d, o)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("lang"), pa.array([f"{x:x}" for x in text.tolist()]), *map(pa.array, columns),
                     pa.array(np.diff(chars)), pa.array(np.array([found[a:b].sum(dtype=np.float64) for a, b in zip(chars[:-1], chars[1:], strict=True)]))],
                    names=["doc_id", "lang", "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_scored", "log_sum"])

    return run


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def bands(scored: DataFrame, reach: float = REACH, least: float = LEAST) -> DataFrame:
    """lang, low, high: from the quartiles of the log perplexity of texts that pass the base rules.

    Quartiles are exact to a thousandth: counts of cells of that width, summed in order. The table has one row per language.
    """
    cells = scored.where(~F.col("base_failed") & F.col("log_ppl").isNotNull()).groupBy("lang", F.floor(F.col("log_ppl") * CELLS).alias("cell")).agg(F.count("*").alias("n"))
    order = W.partitionBy("lang").orderBy("cell")
    run = cells.withColumn("run", F.sum("n").over(order)).withColumn("all", F.sum("n").over(W.partitionBy("lang")))
    quartile = lambda q: F.min(F.when(F.col("run") >= q * F.col("all"), F.col("cell") / CELLS))
    ends = run.groupBy("lang").agg(quartile(0.25).alias("a"), quartile(0.75).alias("b"))
    return ends.select("lang", (F.col("a") - F.greatest(reach * (F.col("b") - F.col("a")), F.lit(least))).alias("low"),
                       (F.col("b") + F.greatest(reach * (F.col("b") - F.col("a")), F.lit(least))).alias("high"))


def judge(docs: DataFrame, order: int = ORDER, reach: float = REACH, least: float = LEAST, entries: int = ARRAY_ENTRIES,
          most: float = EXAMPLE_SYMBOLS) -> DataFrame:
    """One row per document: doc_id, lang, the base columns, base_failed, log_ppl, low, high, kept.

    Null and empty texts have no words and fail. A null language is a language of its own. Languages whose texts all fail
    the base rules have no band and reject nothing further. Texts with more than `most` symbols per word are scored like all
    others, but teach the model nothing. Repeated rows are judged each. No documents: no rows.
    """
    scored = score(docs, order, entries, most).withColumn("base_failed", base_failed())
    scored = stored(scored.withColumn("log_ppl", F.when(F.col("n_scored") > 0, -F.col("log_sum") / F.col("n_scored"))), "perplexity")
    limits = bands(scored, reach, least).withColumnRenamed("lang", "_lang")
    judged = scored.join(F.broadcast(limits) if limits.count() <= 10_000 else limits, F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")
    inside = F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(True))
    return judged.withColumn("kept", ~F.col("base_failed") & inside).drop("n_scored", "log_sum")


def op2_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ppl", "low", "high")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their columns as they were.

    Rows that share id and language stay or go together: they stay if one of them passes.
    """
    bad = judge(docs).groupBy("doc_id", "lang").agg(F.max("kept").alias("kept")).where("not kept").select("doc_id", "lang")
    return without(docs, [F.col("doc_id").cast("long"), F.col("lang").cast("string")], stored(bad, "rejected"))
