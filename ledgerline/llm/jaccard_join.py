"""Set-similarity self-join on word shingles (operator 5): links, classes, and the representatives near duplicates leave.

Sets fall into bands of size, each at least `1 / threshold` times the one below, so linked sets lie in one band or in neighbours.
In a band with largest size U, two linked sets differ in at most D = 2 U (1 - t) / (1 + t) elements. The hash range is cut
into D + 1 + E tiles; linked sets agree in at least 1 + E whole tiles, so a key for each non-empty tile (band, tile, sum of
its hashes) finds every link, and a set with more than E empty tiles adds keys for the empty ones. Keys meet in shards,
where each key's sets are tied to the smallest (a star, never pairs). Texts that quote the same passages agree in a tile now and
then and grow into one family, so large families are tied once more, by the rare shingles of their sets: in any order of all
shingles, linked sets of n elements share one of their first n - ceil(t n) + 1. The order puts shingles that stand in few sets first.
Families are then searched in blocks: hashed bitmaps bound the overlap from above by bit counts, what passes is intersected exactly.
Equal sets are one node throughout. Hashes have 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W

from ledgerline.llm.components import components
from ledgerline.llm.shared import give_back, may_hold, stored, tidy, tidy_groups, without
from ledgerline.llm.textarrays import U, blocks, buffers, deltas, mix, packed, shingle_sets, undeltas, unpacked

#: Sets and shingles of a block; larger families are cut into blocks.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 2_000_000
#: Tile keys that a task holds before it sends them on.
KEYS_AT_ONCE = 1_000_000
PIVOTS = 4
#: The table that orders shingles has 2**24 slots of two bytes.
SLOT_BITS = 24


def node_of(s: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int(mix(np.array([mix(s).sum(dtype=U) + U(len(s))], U)).view(np.int64)[0])


@cache
def bands(percent: int, largest: int) -> list[tuple[int, int, int]]:
    """(smallest size, tiles, spare tiles) of each band up to the one above `largest`; no tiles where only equal sets link."""
    def above(size: int) -> int:
        for _ in range(2 if percent >= 85 else 1):  # bands of two steps send fewer keys where few elements may differ
            size = size * 100 // percent + 1
        return size

    edges = [1]
    while edges[-1] <= largest or len(edges) < 3:
        edges.append(above(edges[-1]))
    edges.append(above(edges[-1]))
    out = []
    for b in range(len(edges) - 1):
        d = 2 * (edges[b + 1] - 1) * (100 - percent) // (100 + percent)
        least, spare = max(1, -(-edges[b] * percent // 100)), 0
        for _ in range(20):
            empty = (d + 1 + spare) * math.exp(-least / (d + 1 + spare))
            spare = min(d + 1, max(spare, math.ceil(empty + 4 * math.sqrt(empty))))
        out.append((edges[b], d + 1 + spare if d else 0, spare))
    return out


def keys_of(s: np.ndarray, percent: int) -> np.ndarray:
    """Tile keys of one set, for its own band and the one above."""
    grown = 1 << max(4, int(len(s)).bit_length())
    table = bands(percent, grown)
    own = int(np.searchsorted([x[0] for x in table], len(s), "right")) - 1
    sums = np.concatenate((np.zeros(1, U), np.cumsum(mix(s + U(0x5851F42D4C957F2D)), dtype=U)))
    out = []
    for b in (own, own + 1):
        edge, tiles, spare = table[b]
        if not tiles or edge > len(s) * 100 // percent:
            continue
        cuts = np.array([(i << 64) // tiles for i in range(1, tiles)], U)
        at = np.concatenate(([0], np.searchsorted(s, cuts), [len(s)]))
        name = mix((np.arange(tiles, dtype=U) + U(1)) * U(0x9FB21C651E98DF25) + U(b * 0xD1342543DE82EF95 % (1 << 64)))
        full = at[1:] > at[:-1]
        out.append(mix((sums[at[1:]] - sums[at[:-1]]) ^ name)[full])
        if tiles - int(full.sum()) > spare:
            out.append(mix(name + U(0x2545F4914F6CDD1D))[~full])
    return np.concatenate(out) if out else np.zeros(0, U)


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    data, offsets = buffers(batch.column("text"))
    for _, _, d, o in blocks(data, offsets):
        yield from shingle_sets(d, o, width)


def describe(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(_sets(batch, width))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) for s in sets], pa.int64())],
                names=["doc_id", "n_shingles", "node"])

    return run


def star_ties(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys with the smallest node of each; (node, smallest node) where they differ, each once."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    hub = node[new][np.cumsum(new) - 1] if len(key) else node
    ties = np.unique(np.stack((node[node != hub], hub[node != hub])), axis=1) if (node != hub).any() else np.zeros((2, 0), node.dtype)
    return key[new], node[new], ties[0], ties[1]


def tile_keys(width: int, percent: int, shards: int, bits: int):
    """Per task: sets to tile keys of `bits` bits, stars inside the task, then one packed row for each shard."""
    return _sent(width, shards, bits, lambda s: keys_of(s, percent))


def _sent(width: int, shards: int, bits: int, keys_in):
    mask = U((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        keys, nodes, held = [], [], 0
        for batch in batches:
            for s in _sets(batch, width):
                if len(s) and (n := node_of(s)) not in seen:
                    seen.add(n)
                    k = keys_in(s) & mask
                    keys.append(k)
                    nodes.append(np.full(len(k), n, np.int64))
                    held += len(k)
                if held > KEYS_AT_ONCE:
                    yield _rows(keys, nodes, shards)
                    keys, nodes, seen, held = [], [], set(), 0
                    give_back(0.25)
        if keys:
            yield _rows(keys, nodes, shards)

    return run


def _rows(keys: list[np.ndarray], nodes: list[np.ndarray], shards: int) -> pa.RecordBatch:
    key, hub, u, v = star_ties(np.concatenate(keys), np.concatenate(nodes))
    names, place = np.unique(hub, return_inverse=True)
    shard, tie_shard = key % U(shards), mix(u.view(U)) % U(shards)
    out = []
    for s in range(shards):
        at, tie = shard == s, tie_shard == s
        if at.any() or tie.any():
            used, local = np.unique(place[at], return_inverse=True)
            small = np.uint16 if len(used) <= 1 << 16 else np.uint32
            out.append((s, packed(deltas(key[at] // U(shards)), names[used], local.astype(small), u[tie], v[tie])))
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["shard", "payload"])


def ties_of_shard(rows: pd.DataFrame) -> pd.DataFrame:
    keys, hubs, us, vs = [], [], [], []
    for value in rows["payload"]:
        planes, names, place, u, v = unpacked(value)
        keys.append(undeltas(planes))
        hubs.append(names[place] if len(place) else np.zeros(0, np.int64))
        us.append(u)
        vs.append(v)
    _, _, u, v = star_ties(np.concatenate(keys), np.concatenate(hubs))
    return pd.DataFrame({"u": np.concatenate([u, *us]), "v": np.concatenate([v, *vs])}).drop_duplicates()


def _ranges(shards: int) -> list[int]:
    """First slot of each shard, a range of hashes, and the end of the last one."""
    return [(i << SLOT_BITS) // shards for i in range(shards + 1)]


def shingle_counts(width: int, shards: int, bits: int):
    """Per task: in how many sets each shingle stands, by the upper `bits` bits of its hash; one packed row for each shard."""
    cuts = np.array([x << (bits - SLOT_BITS) for x in _ranges(shards)[:-1]], U)

    def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
        key = np.sort(np.concatenate(sets))
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        times, key = np.diff(np.append(first, len(key))).astype(np.uint32), key[first]
        at = np.append(np.searchsorted(key, cuts), len(key)).tolist()
        full = [i for i in range(shards) if at[i + 1] > at[i]]
        parts = [packed(deltas(key[at[i] : at[i + 1]] - cuts[i]), times[at[i] : at[i + 1]]) for i in full]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(parts, pa.binary())], names=["shard", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, held = [], 0
        for batch in batches:
            for s in _sets(batch, width):
                if len(s):
                    sets.append(s >> U(64 - bits))
                    held += len(s)
                if held > KEYS_AT_ONCE:
                    yield counted(sets)
                    sets, held = [], 0
                    give_back(0.25)
        if sets:
            yield counted(sets)

    return run


def _least(values: np.ndarray, places: int) -> int:
    """The smallest value above 0 that at most half of the places reach; places not named have 0."""
    reach = np.cumsum(np.bincount(np.minimum(values, 255), minlength=257)[::-1])[::-1]
    return int(np.flatnonzero(reach[1:] * 2 <= places)[0]) + 1


def shard_order(shards: int, bits: int):
    """Counted shingles of one shard to its slots of the table that orders shingles: a byte with a mark for each eighth of the slot that holds a shingle
    of several sets, and the binary logarithm of the largest number of sets. Of each, as many as half of the places can hold; the rarer ones count as rare."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["shard"].iloc[0])
        low, high = _ranges(shards)[shard : shard + 2]
        parts = [unpacked(v) for v in rows["payload"]]
        key, times = np.concatenate([undeltas(p) for p, _ in parts]), np.concatenate([t for _, t in parts]).astype(np.int64)
        order = np.argsort(key, kind="stable")
        key, times = key[order], times[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sets, eighth = np.add.reduceat(times, first), key[first] >> U(bits - SLOT_BITS - 3)
        first = np.flatnonzero(np.concatenate(([True], eighth[1:] != eighth[:-1])))
        sets, eighth = np.maximum.reduceat(sets, first), eighth[first].astype(np.int64)
        marks = np.zeros((high - low) * 8, np.uint8)
        marks[eighth] = sets >= max(2, _least(sets, len(marks)))
        level = np.zeros(high - low, np.uint8)
        np.maximum.at(level, eighth >> 3, (np.frexp(sets.astype(float))[1] - 1).astype(np.uint8))
        level[level < _least(level, len(level))] = 0
        return pd.DataFrame({"low": [low], "slots": [packed(np.packbits(marks, bitorder="little"), level)]})

    return run


def rare_keys_of(s: np.ndarray, percent: int, marks: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The first elements of a set, rare ones first: so many that linked sets share one of them, whatever the table says."""
    slot, eighth = (s >> U(64 - SLOT_BITS)).astype(np.int64), (s >> U(61 - SLOT_BITS)).astype(np.uint8) & 7
    place = (marks[slot] >> eighth & 1) * (levels[slot] + 1)
    return mix(s[np.argsort(place, kind="stable")[: len(s) + percent * -len(s) // 100 + 1]])


def rare_keys(width: int, percent: int, shards: int, bits: int, shared):
    """As `tile_keys`, with the keys of rare shingles; `shared` is the broadcast table of `shard_order`."""
    return _sent(width, shards, bits, lambda s: rare_keys_of(s, percent, *shared.value))


def bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    out = np.zeros((len(sets), bits // 8), np.uint8)
    for row, s in zip(out, sets, strict=True):
        hot = np.zeros(bits, np.uint8)
        hot[(s % U(bits)).astype(np.int64)] = 1
        row[:] = np.packbits(hot)
    return out.view(U)


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Component label of each set (index of the smallest member), exactly as all pairs would give it.

    Sets come in order of size. A set looks only at later ones that are not yet in its component and small enough; those
    whose bit counts allow the overlap are intersected.
    """
    n = np.array([len(s) for s in sets], np.int64)
    label = np.arange(len(sets))
    bits = min(1 << 14, max(64, 1 << int(2 * n.max(initial=1)).bit_length()))
    maps = bitmaps(sets, bits)
    for i in range(len(sets) - 1):
        last = int(np.searchsorted(n, n[i] * 100 // percent, "right"))
        j = np.arange(i + 1, last)
        j = j[label[j] != label[i]]
        if not n[i] or not len(j):
            continue
        need = -(-percent * (n[i] + n[j]) // (100 + percent))
        bound = np.minimum(n[i] - np.bitwise_count(maps[i] & ~maps[j]).sum(axis=1, dtype=np.int64),
                           n[j] - np.bitwise_count(maps[j] & ~maps[i]).sum(axis=1, dtype=np.int64))
        j, need = j[bound >= need], need[bound >= need]
        if not len(j):
            continue
        together = np.concatenate([sets[k] for k in j])
        at = np.minimum(np.searchsorted(sets[i], together), len(sets[i]) - 1)
        starts = np.concatenate(([0], np.cumsum(n[j])[:-1]))
        common = np.add.reduceat((sets[i][at] == together).astype(np.int64), starts)
        for k in np.unique(label[j[common >= need]]):
            a, b = min(label[i], k), max(label[i], k)
            label[label == b] = a
    return label


def links_in(width: int, percent: int):
    """Texts of one block to (node, smallest linked node of the block)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("node").reset_index(drop=True)
        data, offsets = buffers(pa.array(rows["text"], pa.large_string()))
        sets = [s for _, _, d, o in blocks(data, offsets) for s in shingle_sets(d, o, width)]
        order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
        node = rows["node"].to_numpy()[order]
        label = linked([sets[i] for i in order], percent)
        return pd.DataFrame({"u": node, "v": node[label]})

    return run


def with_node(width: int):
    """doc_id, node and what else of a text is asked for: the text itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j, d, o in blocks(data, offsets):
                names = [node_of(s) for s in shingle_sets(d, o, width)]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.int64()), part.column("text")], names=["doc_id", "node", "text"])

    return run


def folded(s: np.ndarray) -> bytes:
    """Bitmap of a set, with at least two bits per element and a power of two bits."""
    return bitmaps([s], max(64, 1 << int(2 * len(s) - 1).bit_length()))[0].tobytes()


def with_bitmap(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j, d, o in blocks(data, offsets):
                sets = shingle_sets(d, o, width)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([folded(s) for s in sets], pa.binary())], names=["doc_id", "node", "size", "bitmap"])

    return run


def _brought(placed: DataFrame, texts: DataFrame, run, schema: str) -> DataFrame:
    """Rows of `placed` (doc_id, node, ...) with columns made from the text of that node; null ids meet null ids."""
    made = may_hold(texts, "doc_id", placed).mapInArrow(tidy(run), schema).withColumnsRenamed({"doc_id": "_id", "node": "_node"})
    return placed.join(made, (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id", "_node")


def hopeful(percent: int):
    """Sets of a tile that may link with one of another component there, by sizes and bit counts alone."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("node").sort_values("size", kind="stable").reset_index(drop=True)
        n, of = rows["size"].to_numpy(), rows["component"].to_numpy()
        stay = np.zeros(len(rows), bool)
        width = np.array([len(b) // 8 for b in rows["bitmap"]])
        for words in np.unique(width).tolist():
            # sets with bitmaps of this size, and larger ones folded to it, as far as linked sets can be larger
            at = np.flatnonzero((width >= words) & (width <= words * 2 * (100 // percent)))
            maps = np.stack([_fold(np.frombuffer(rows["bitmap"][k], U), words) for k in at])
            size, group = n[at], of[at]
            for i in np.flatnonzero(width[at] == words).tolist():
                j = np.arange(i + 1, int(np.searchsorted(size, size[i] * 100 // percent, "right")))
                j = j[group[j] != group[i]]
                if not size[i] or not len(j):
                    continue
                need = -(-percent * (size[i] + size[j]) // (100 + percent))
                both = np.minimum(size[i] - np.bitwise_count(maps[i] & ~maps[j]).sum(axis=1, dtype=np.int64), size[j] - np.bitwise_count(maps[j] & ~maps[i]).sum(axis=1, dtype=np.int64))
                j = j[both >= need]
                if len(j):
                    stay[at[i]] = stay[at[j]] = True
        return rows.loc[stay, ["family", "a", "b", "node"]]

    return run


def _fold(bitmap: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_or.reduce(bitmap.reshape(-1, words), axis=0)


def _search(placed: DataFrame, docs: DataFrame, by: list[str], width: int, percent: int) -> DataFrame:
    """Links found in groups `by` of `placed` (doc_id, node, ...), with the texts brought to them."""
    rows = _brought(placed, docs.select("doc_id", "text"), with_node(width), "doc_id long, node long, text string").select(*by, "node", "text")
    return rows.groupBy(*by).applyInPandas(tidy_groups(links_in(width, percent)), "u long, v long").where("u <> v")


def _ties(messages: DataFrame) -> DataFrame:
    return stored(messages.groupBy("shard").applyInPandas(tidy_groups(ties_of_shard), "u long, v long").distinct(), "jaccard-ties")


def _cut(members: DataFrame) -> DataFrame:
    """The members with the number of blocks of their family."""
    sizes = members.groupBy("family").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    cut = F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    return members.join(sizes.select("family", cut.alias("blocks")), "family")


def _parted(wide: DataFrame, docs: DataFrame, width: int, percent: int, shards: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """Large families parted by the ties of their sets' rare shingles, sets without one left out; and these ties."""
    spark = docs.sparkSession
    texts = may_hold(docs, "doc_id", wide).select("text")
    exact = min(64, max(SLOT_BITS + 3, 5 + int(wide.agg(F.sum("n")).first()[0]).bit_length()))
    counts = texts.mapInArrow(tidy(shingle_counts(width, shards, exact)), "shard int, payload binary")
    table = np.zeros((2, 1 << SLOT_BITS), np.uint8)
    for r in counts.groupBy("shard").applyInPandas(tidy_groups(shard_order(shards, exact)), "low int, slots binary").toLocalIterator():
        for row, part in zip(table, unpacked(bytes(r["slots"])), strict=True):
            row[r["low"] : r["low"] + len(part)] = part
    shared = spark.sparkContext.broadcast(table)
    ties = _ties(texts.mapInArrow(tidy(rare_keys(width, percent, shards, bits, shared)), "shard int, payload binary"))
    shared.unpersist()
    sub = components(ties).withColumnRenamed("component", "sub")
    marked = stored(wide.join(sub, "node"), "jaccard-parts")
    parts = marked.groupBy("family", "sub").agg(F.count("*").alias("sets"), F.min("node").alias("least")).where("sets > 1")
    return stored(marked.join(parts, ["family", "sub"]).select(F.col("least").alias("family"), "node", "doc_id", "n"), "jaccard-families"), ties


def _classes(nodes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, component) of the nodes that link with another one."""
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # false meetings of keys cost time only; 17 bits beyond the number of shingles keep them rare at any size
    bits = min(64, 17 + int(nodes.agg(F.sum("n_shingles")).first()[0] or 1).bit_length())
    messages = docs.select("text").mapInArrow(tidy(tile_keys(width, percent, shards, bits)), "shard int, payload binary")
    ties = _ties(messages)
    if ties.isEmpty():
        return spark.createDataFrame([], "node long, component long")
    families = components(ties).withColumnRenamed("component", "family")
    one = nodes.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"))
    small = _cut(stored(families.join(one, "node"), "jaccard-families"))
    wide = small.where("blocks > 1")
    if not wide.isEmpty():
        parts, rare = _parted(stored(wide.drop("blocks"), "jaccard-wide"), docs, width, percent, shards, bits)
        small, ties = stored(small.where("blocks = 1").unionByName(_cut(parts)), "jaccard-families"), ties.unionByName(rare)
    members = small.drop("blocks")
    # families of one block meet others in a bucket only in the shuffle; large ones get their best tied sets in each block
    degree = ties.groupBy("v").agg(F.count("*").alias("ties")).select(F.col("v").alias("node"), "ties")
    ranked = small.where("blocks > 1").join(degree, "node")
    first = F.row_number().over(W.partitionBy("family").orderBy(F.col("ties").desc(), "node"))
    pivots = ranked.withColumn("rank", first).where(F.col("rank") <= PIVOTS).drop("rank", "ties")
    placed = small.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).unionByName(
        pivots.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    links = stored(_search(placed.select("family", "block", "node", "doc_id"), docs, ["family", "block"], width, percent), "jaccard-links")
    found = components(links)
    large = small.where("blocks > 1")
    if large.isEmpty():
        return found
    rest = stored(_tiles(large, found, percent), "jaccard-tiles")
    if rest.isEmpty():
        return found
    # a family that only shared passages hold together has many tiles and few links: bitmaps go first, texts only where they may link
    sketched = _brought(rest, docs.select("doc_id", "text"), with_bitmap(width), "doc_id long, node long, size long, bitmap binary")
    sketched = sketched.select("family", "a", "b", "node", "component", "size", "bitmap")
    some = sketched.groupBy("family", "a", "b").applyInPandas(tidy_groups(hopeful(percent)), "family long, a string, b string, node long")
    rest = stored(some.join(members.select("node", "doc_id"), "node"), "jaccard-hopeful")
    if rest.isEmpty():
        return found
    more = stored(_search(rest, docs, ["family", "a", "b"], width, percent), "jaccard-links")
    return components(links.unionByName(more))


def _tiles(large: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Tiles that bring the sets outside a family's largest component together with all others of the family that are not
    too small or too large for them: blocks of one size class meet those of the same class and its neighbours."""
    marked = large.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    counts = marked.groupBy("family", "component").agg(F.count("*").alias("c"))
    main = counts.groupBy("family").agg(F.max(F.struct("c", "component")).alias("m"), F.count("*").alias("parts")).where("parts > 1")
    marked = marked.join(main.select("family", F.col("m.component").alias("main")), "family").withColumn("inside", F.col("component") == F.col("main"))
    step = math.log(100 / percent) * 1.001  # linked sets are less than one step apart
    marked = marked.withColumn("class", F.floor(F.log("n") / step).cast("int"))
    half, block = BLOCK_SETS // 2, ["family", "class", "inside"]
    counts = marked.groupBy(*block).agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    cut = F.greatest(F.ceil(F.col("c") / half), F.ceil(F.col("s") / (BLOCK_SHINGLES // 2))).cast("int")
    blocks_ = stored(counts.select(*block, cut.alias("cut")), "jaccard-blocks")
    label = lambda kind, inside, part: F.concat_ws(":", kind, inside.cast("string"), part)
    own = marked.join(blocks_, block).withColumn("own", label(F.col("class"), F.col("inside"), F.pmod(F.xxhash64("node"), F.col("cut"))))
    near = own.select("family", "node", "doc_id", "component", "inside", "own", F.explode(F.array(*[F.col("class") + d for d in (-1, 0, 1)])).alias("class"))
    other = blocks_.select("family", "class", F.col("inside").alias("other_inside"), "cut")
    met = near.join(other, ["family", "class"]).where(~(F.col("inside") & F.col("other_inside")))
    met = met.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    met = met.withColumn("other", label(F.col("class"), F.col("other_inside"), F.col("part")))
    return met.select("family", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "node", "doc_id", "component")


def jaccard_classes(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Documents without words (null and empty texts too) have no shingles and link with nothing. Repeated rows give
    repeated results; rows with a null id are compared like all others and count as larger than any id. No documents: no
    rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    nodes = stored(rows.mapInArrow(tidy(describe(width)), "doc_id long, n_shingles long, node long"), "jaccard-nodes")
    classes = _classes(nodes.where("n_shingles > 0"), rows, width, percent)
    least = nodes.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first"))
    named = least.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = named.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = named.join(ids, "component").select("node", "component_id")
    return (nodes.where("n_shingles > 0").join(ids, "node").select("doc_id", "n_shingles", "component_id")
            .unionByName(nodes.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, percent=90)


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each class stays: the one with the smallest id (all its rows, if they repeat). Columns as they were."""
    ids = jaccard_classes(docs, width, percent).groupBy("doc_id").agg(F.max(F.expr("doc_id <=> component_id")).alias("kept"))
    return without(docs, [F.col("doc_id").cast("long")], stored(ids.where("not kept").select("doc_id"), "near-copies"))
