"""Phrases that say more than their parts: collocations from exact counts (operator 13).

One pass over all texts for each phrase length. A task counts in a trie (`hat_trie`) and lets whole subtrees go as sorted
runs when it is full; runs of one prefix meet in one partition and are merged there. A phrase can only be frequent if both
phrases that miss its first or last word are, so a pass counts a phrase only if those may be among the frequent ones of the
pass before: they are known by a bit filter of fixed size, whose false hits cost time and change no count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W

from ledgerline.llm.hat_trie import BITS, BURST, FULL, MASK, Trie, pieced_words
from ledgerline.llm.shared import stored
from ledgerline.llm.textarrays import U, Prefix, blocks, buffers, mix, packed, unpacked

#: Bits of the filter, as a power of two: 16 MB at any size of the corpus.
FILTER_BITS = 27
#: Bytes of text, and places in it, looked at together; their words fit into the numbers of a trie.
BLOCK_BYTES, SLICE = 1 << 20, 1 << 18
#: Words of the corpus for each prefix partition of a language: phrases of one partition are merged in one task's memory.
WORDS_PER_SHARD = 2_000_000
#: A two-word prefix is dealt to so many partitions; frequent phrases are copied so often for the lookup of parts.
SPREAD, COPIES = 16, 8
NO_LANGUAGE = "und"


def _lang_hash(lang: str) -> np.uint64:
    data = np.frombuffer(lang.encode(), np.uint8)
    return Prefix(data).of(np.array([0]), np.array([len(data)]))[0]


def _word_hashes(words: pa.Array) -> np.ndarray:
    data, offsets = buffers(words.cast(pa.large_string()))
    return Prefix(data).of(offsets[:-1], offsets[1:])


def phrase_hashes(lang: np.ndarray, words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the phrase of `width` words at each place, from hashes of language and word."""
    n = max(0, len(words) - width + 1)
    h = lang[:n]
    for k in range(width):
        h = mix(h * U(0x9E3779B97F4A7C15) + words[k : n + k])
    return h


class Filter:
    """Bits of phrases; may answer yes for others, never no for one of them."""

    def __init__(self, cells: np.ndarray, bits: int) -> None:
        self.cells, self.shift = cells, U(64 - bits)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return (self.cells[at >> U(6)] >> (at & U(63)) & U(1)).astype(bool)


def frequent_filter(frequent: DataFrame, width: int, bits: int = FILTER_BITS) -> Filter:
    """Filter of the phrases of (lang, phrase); at most 2**bits / 64 numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, _, words, _ = pieced_words(*buffers(batch.column("phrase")))
            coded = pc.dictionary_encode(batch.column("lang"))
            lang = np.array([_lang_hash(x) for x in coded.dictionary.to_pylist()], U)[coded.indices.to_numpy(zero_copy_only=False)]
            h = phrase_hashes(np.repeat(lang, width), _word_hashes(words)[code], width)[::width] >> U(64 - bits)
            yield pa.RecordBatch.from_arrays([pa.array((h >> U(6)).astype(np.int64)), pa.array((U(1) << (h & U(63))).view(np.int64))], names=["cell", "mask"])

    rows = frequent.select("lang", "phrase").mapInArrow(run, "cell long, mask long").groupBy("cell").agg(F.bit_or("mask").alias("mask")).toArrow()
    cells = np.zeros(1 << (bits - 6), U)
    cells[rows["cell"].to_numpy()] = rows["mask"].to_numpy().view(U)
    return Filter(cells, bits)


def _runs(trie: Trie, names: list[bytes], langs: list[str], keep: int, shards: int) -> Iterator[pa.RecordBatch]:
    """Subtrees that leave the trie as runs sorted by phrase, one packed row for each language and prefix partition.

    A prefix is the first two words; what follows it is dealt to SPREAD partitions, so that a hot pair is not in one.
    """
    if not names:
        return
    words, languages = pa.array(names, pa.binary()).cast(pa.string()), pa.array(langs, pa.string())
    hashes, tongues = _word_hashes(words), np.array([_lang_hash(x) for x in langs], U)
    for phrases, counts in trie.spill(keep):
        lang, codes = phrases[:, 0] >> BITS, phrases.copy()
        codes[:, 0] &= MASK
        prefix = mix(mix(tongues[lang] + hashes[codes[:, 0]]) + hashes[codes[:, 1]])
        rest = np.zeros(len(codes), U)
        for k in range(2, codes.shape[1]):
            rest = mix(rest + hashes[codes[:, k]])
        shard = (mix(prefix + rest % U(SPREAD)) % U(shards)).astype(np.int64)
        text = pc.binary_join_element_wise(*(words.take(pa.array(codes[:, k])) for k in range(codes.shape[1])), " ")
        order = pc.sort_indices(pa.table({"part": lang * shards + shard, "phrase": text}), [("part", "ascending"), ("phrase", "ascending")]).to_numpy()
        part, text = (lang * shards + shard)[order], text.take(pa.array(order))
        data, offsets = buffers(text)
        head = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        counts, size = counts[order], np.diff(offsets)
        rows = [packed(data[offsets[x] : offsets[y]], size[x:y].astype(np.uint32), counts[x:y]) for x, y in zip(head, [*head[1:], len(part)], strict=True)]
        yield pa.RecordBatch.from_arrays([languages.take(pa.array(part[head] // shards)), pa.array(part[head] % shards), pa.array(rows, pa.binary())],
                                         names=["lang", "shard", "run"])


def _merger(least: int, fold: int = 1 << 21):
    """Runs of one language and prefix partition to the phrases that stand at least so often."""

    def summed(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by(["phrase"]).aggregate([("n", "sum")]).rename_columns(["phrase", "n"])

    def merge(key: tuple, runs: pa.Table) -> pa.Table:
        parts, rows = [], 0
        for run in runs["run"]:
            data, size, n = unpacked(run.as_py())
            offsets = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
            text = pa.Array.from_buffers(pa.large_string(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
            parts.append(pa.table({"phrase": text, "n": n.copy()}))
            rows += len(n)
            if rows > fold:
                parts = [summed(parts)]
                rows = len(parts[0]) // 2
        whole = summed(parts)
        whole = whole.filter(pc.greater_equal(whole["n"], least))
        return pa.table({"lang": pa.array([key[0].as_py()] * len(whole), pa.string()), "phrase": whole["phrase"].cast(pa.string()), "n": whole["n"]})

    return merge


def _word_counter(most: int):
    """Counts of single words: the root of the trie, one hash table, as Arrow keeps it."""
    def summed(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by(["lang", "phrase"]).aggregate([("n", "sum")]).rename_columns(["lang", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows, totals = [], 0, {}
        for batch in batches:
            coded = pc.dictionary_encode(batch.column("lang"))
            lang_of = coded.indices.to_numpy(zero_copy_only=False)
            data, offsets = buffers(batch.column("text"))
            for i, _, d, o in blocks(data, offsets):
                code, owner, distinct, _ = pieced_words(d, o)
                lang = lang_of[i + owner] if len(owner) else np.zeros(0, np.int64)
                for k, n in zip(*np.unique(lang, return_counts=True), strict=True):
                    totals[coded.dictionary[k].as_py()] = totals.get(coded.dictionary[k].as_py(), 0) + int(n)
                key, n = np.unique(lang.astype(np.int64) * (len(distinct) + 1) + code, return_counts=True)
                parts.append(pa.table({"lang": coded.dictionary.take(pa.array(key // (len(distinct) + 1))), "n": pa.array(n),
                                       "phrase": distinct.take(pa.array(key % (len(distinct) + 1))).cast(pa.string())}).select(["lang", "phrase", "n"]))
                rows += len(key)
                if rows > most:
                    parts = [summed(parts)]
                    rows = len(parts[0])
                    if rows > most // 2:
                        yield from parts[0].sort_by("phrase").to_batches(max_chunksize=1 << 16)
                        parts, rows = [], 0
        if parts:
            yield from summed(parts).sort_by("phrase").to_batches(max_chunksize=1 << 16)
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array([""] * len(totals)), pa.array(list(totals.values()), pa.int64())], names=["lang", "phrase", "n"])

    return run


def _counter(width: int, known, burst: int, most: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, number, names, langs = Trie(width, burst, most), {}, [], {}
        held = known.value if known is not None else None
        for batch in batches:
            coded = pc.dictionary_encode(batch.column("lang"))
            dictionary = coded.dictionary.to_pylist()
            lang_of = coded.indices.to_numpy(zero_copy_only=False)
            data, offsets = buffers(batch.column("text"))
            for i, _, d, o in blocks(data, offsets, BLOCK_BYTES):
                code, owner, distinct, linked = pieced_words(d, o)
                lang = lang_of[i + owner] if len(owner) else np.zeros(0, np.int64)
                places = _places(code, lang, distinct, linked, width, dictionary, held)
                for a in range(0, len(places), SLICE):
                    at = places[a : a + SLICE]
                    if len(names) > most or len(names) + width * len(at) > MASK:
                        yield from _runs(trie, names, list(langs), 0, shards)
                        number, names, langs = {}, [], {}
                    phrases, counts = _counted(code, lang, at, width)
                    used, local = np.unique(phrases[:, 1:], return_inverse=True)
                    ids = []
                    for word in distinct.take(pa.array(used)).to_pylist():
                        if word not in number:
                            number[word] = len(names)
                            names.append(word)
                        ids.append(number[word])
                    tongue = np.array([langs.setdefault(x, len(langs)) for x in dictionary], np.int64)
                    phrases[:, 1:] = np.array(ids, np.int64)[local.reshape(len(phrases), width)]
                    phrases[:, 1] |= tongue[phrases[:, 0]] << BITS
                    order = np.lexsort(phrases[:, :0:-1].T)
                    trie.add(phrases[order, 1:], counts[order])
                    if trie.full():
                        yield from _runs(trie, names, list(langs), most // 4, shards)
        yield from _runs(trie, names, list(langs), 0, shards)

    return run


def _places(code, lang, distinct, linked, width: int, dictionary: list[str], held: Filter | None) -> np.ndarray:
    """Places at which a phrase of `width` words begins that has to be counted."""
    n = max(0, len(code) - width + 1)
    good = np.ones(n, bool)
    for k in range(width - 1):
        good &= linked[k : n + k]
    if held is not None and n:
        tongue = np.array([_lang_hash(x) for x in dictionary], U)[lang]
        may = held.may_hold(phrase_hashes(tongue, _word_hashes(distinct)[code], width - 1))
        good &= may[:n] & may[1 : n + 1]
    return np.flatnonzero(good)


def _counted(code: np.ndarray, lang: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct phrases at the places as rows (language, words), and how often each stands there: level by level, a prefix
    gets a number and the next word splits it."""
    size = int(code.max(initial=0)) + 1
    level = lang[at].astype(np.int64)
    for k in range(width):
        _, first, level, counts = np.unique(level * size + code[at + k], return_index=True, return_inverse=True, return_counts=True)
    starts = at[first]
    return np.stack([lang[starts], *(code[starts + k] for k in range(width))], axis=1).astype(np.int64), counts


def word_counts(texts: DataFrame, least: int, most: int = FULL) -> DataFrame:
    """lang, phrase, n of the words that stand at least `least` times in (lang, text), and an empty phrase that counts all words."""
    runs = texts.mapInArrow(_word_counter(2 * most), "lang string, phrase string, n long")
    merged = runs.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return stored(merged.where((F.col("n") >= least) | (F.col("phrase") == "")), "phrases-1")


def phrase_counts(texts: DataFrame, width: int, least: int, known: Filter | None, shards: int, burst: int = BURST, most: int = FULL) -> DataFrame:
    """lang, phrase, n of the phrases of `width` >= 2 words that stand at least `least` times in (lang, text)."""
    shared = texts.sparkSession.sparkContext.broadcast(known) if known is not None else None
    runs = texts.mapInArrow(_counter(width, shared, burst, most, shards), "lang string, shard long, run binary")
    out = stored(runs.groupBy("lang", "shard").applyInArrow(_merger(least), "lang string, phrase string, n long"), f"phrases-{width}")
    if shared is not None:
        shared.unpersist()
    return out


def _parts(candidates: DataFrame, frequent: DataFrame) -> DataFrame:
    """Each candidate with k, l and r of each of its cuts. Frequent phrases are copied and cuts dealt over the copies, so a
    word that begins many candidates is looked up in several tasks."""
    words = F.split("phrase", " ", -1)
    cuts = candidates.select("lang", "phrase", "a", words.alias("w"), F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("head"),
                       F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("tail"), F.pmod(F.xxhash64("phrase", "k"), F.lit(COPIES)).alias("copy"))
    copied = frequent.withColumn("copy", F.explode(F.array(*(F.lit(i).cast("long") for i in range(COPIES)))))
    left = copied.select("lang", "copy", F.col("phrase").alias("head"), F.col("n").alias("l"))
    right = copied.select("lang", "copy", F.col("phrase").alias("tail"), F.col("n").alias("r"))
    return cuts.join(left, ["lang", "copy", "head"]).join(right, ["lang", "copy", "tail"]).select("lang", "phrase", "a", "k", "l", "r")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, scale: int = 1000, cover: int = 100,
                 burst: int = BURST, most: int = FULL, bits: int = FILTER_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each language.

    A phrase has 2 to `longest` words of one piece and stands `a` >= `least` times. Its score is the lowest, over its cuts in
    two, of floor(scale * a * n / (l * r)); ties go to the shorter first part. A phrase goes if a longer one of at least
    `least` holds it and stands in `cover` percent of its places. Each language's first `top` by score, a and phrase stay.
    A null language is `und`, a null text has no words; repeated rows count each; no documents: no rows. `burst`, `most`
    and `bits` change no result.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = word_counts(texts, least, most)
    shards = max(16, (words.where("phrase = ''").agg(F.sum("n")).first()[0] or 0) // WORDS_PER_SHARD)
    totals, levels = words.where("phrase = ''").select("lang", F.col("n").alias("n")), [words.where("phrase <> ''")]
    for width in range(2, longest + 1):
        known = frequent_filter(levels[-1], width - 1, bits)
        levels.append(phrase_counts(texts, width, least, known, shards, burst, most))
        if levels[-1].isEmpty():
            break
    frequent = reduce(DataFrame.unionByName, levels)
    phrases = reduce(DataFrame.unionByName, levels[1:]).withColumnRenamed("n", "a")
    split = F.split("phrase", " ", -1)
    shorter = [F.array_join(F.slice(split, start, F.size(split) - 1), " ") for start in (1, 2)]
    inside = reduce(DataFrame.unionByName, levels[2:], levels[1]).where(F.size(split) > 2).select("lang", F.explode(F.array(*shorter)).alias("phrase"), F.col("n").alias("b"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("b").alias("b"))
    alone = phrases.join(inside, ["lang", "phrase"], "left").where(f"b is null or 100 * b < {cover} * a").select("lang", "phrase", "a")
    number = "decimal(20,0)"
    counted = _parts(alone, frequent).join(totals, "lang")
    score = F.expr(f"(cast({scale} as decimal(18,0)) * (cast(a as {number}) * cast(n as {number}))) div (cast(l as {number}) * cast(r as {number}))")
    lowest = counted.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    rows = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    best = [F.desc("score"), F.desc("a"), F.col("phrase")]
    rows = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists WHERE len(w) > 0),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM placed, range(1, 6) AS t(k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k AS size, phrase, count(*) AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
candidates AS (SELECT * FROM f WHERE size > 1 AND a >= 100),
kept AS (
  SELECT * FROM candidates c WHERE NOT EXISTS (
    SELECT 1 FROM candidates o WHERE o.lang = c.lang AND o.size > c.size AND 100 * o.a >= 100 * c.a AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, array_to_string(string_split(c.phrase, ' ')[1:k], ' ') AS head, array_to_string(string_split(c.phrase, ' ')[k + 1:], ' ') AS tail
  FROM kept c, range(1, 5) AS t(k) WHERE k < c.size),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, k, l.a AS l, r.a AS r, n, (1000::HUGEINT * cuts.a * n // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = head JOIN f r ON r.lang = cuts.lang AND r.phrase = tail JOIN totals ON totals.lang = cuts.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest QUALIFY rank <= 2000
"""
