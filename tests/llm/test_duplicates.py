"""Exact copies, similarity classes and repeated byte strings against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyspark.sql.functions as F

from ledgerline.llm import exact_dedup, jaccard_join, suffix_dedup
from tests.llm.conftest import prose
from ledgerline.llm.components import components


def rows(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


def low(i):
    return -1 if i is None else i


def test_exact_groups(hostile, nothing):
    got = exact_dedup.deduplicate(hostile).collect()
    groups = defaultdict(list)
    for i, t in rows(hostile):
        groups[t].append(i)
    want = Counter((i, max(groups[t], key=low), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows(hostile))
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["digest"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)
    assert exact_dedup.deduplicate(nothing).count() == 0


def test_colliding_digests_are_told_apart_by_their_bytes(hostile):
    got = exact_dedup.deduplicate(hostile, digest=lambda t: F.substring(exact_dedup.sha256_hex(t), 1, 1)).collect()
    groups = defaultdict(list)
    for i, t in rows(hostile):
        groups[t].append(i)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == Counter((i, max(groups[t], key=low), len(groups[t])) for i, t in rows(hostile))


def test_state_goes_on_where_it_stopped(spark, hostile, tmp_path):
    landed, state, groups = (f"{tmp_path}/{x}" for x in ("landed", "state", "groups"))
    text = F.coalesce("text", F.lit(""))
    for part in (hostile.where("doc_id < 10"), hostile.where("doc_id >= 10 or doc_id is null")):
        exact_dedup.arrivals(part).write.mode("append").parquet(landed)
        exact_dedup.run_state(spark, landed, state, groups)
    got = {r["digest"]: r["group_size"] for r in exact_dedup.entries(spark, groups).collect()}
    assert got == {r["d"]: r["count"] for r in hostile.groupBy(F.sha2(text, 256).alias("d")).count().collect()}


def test_copies_dropped_keep_columns(hostile, nothing):
    out = exact_dedup.drop_copies(hostile)
    assert out.columns == hostile.columns and Counter(r["text"] or "" for r in out.collect()) == Counter({t for _, t in rows(hostile)})
    assert exact_dedup.drop_copies(nothing).count() == 0


def classes(docs, width, percent):
    sets = []
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets.append((i, frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if both and 100 * both >= percent * len(sets[a][1] | sets[b][1]):
                parent[find(a)] = find(b)
    ids = defaultdict(list)
    for k, (i, s) in enumerate(sets):
        ids[find(k)].append(i)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    return Counter((i, len(s), least[find(k)] if s else i) for k, (i, s) in enumerate(sets))


def test_similarity_classes(hostile, nothing):
    for width, percent in ((3, 90), (5, 80)):
        got = Counter(tuple(r) for r in jaccard_join.jaccard_classes(hostile, width, percent).select("doc_id", "n_shingles", "component_id").collect())
        assert got == classes(rows(hostile), width, percent)
    assert jaccard_join.jaccard_classes(nothing).count() == 0
    kept = jaccard_join.drop_near_copies(hostile)
    assert kept.columns == hostile.columns and kept.where("doc_id in (1, 2, 3)").count() == 0


def test_links_through_null_ids_and_ids_with_two_texts(spark):
    words = prose(7, 200).split()
    near = [" ".join(w + "x" if k in some else w for k, w in enumerate(words)) for some in ((), (20,), (20, 120), (20, 120, 70))]
    rows = [(5, near[0]), (None, near[2]), (6, near[3]), (1, prose(8, 90)), (1, prose(9, 90)), (2, prose(9, 90)), (3, prose(8, 90) + " tail")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = Counter(tuple(r) for r in jaccard_join.jaccard_classes(df, 5, 90).select("doc_id", "component_id").collect())
    assert got == Counter([(5, 5), (None, 5), (6, 5), (1, 1), (1, 1), (2, 1), (3, 1)])


def test_large_families_are_cut_into_blocks(spark, monkeypatch):
    """A chain of near copies and some strays, with blocks of four sets."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 4)
    words = [f"w{k}" for k in range(200)]
    docs = []
    for i in range(40):
        w = list(words)
        w[5 * (i // 2) : 5 * (i // 2) + 2] = [f"a{i}", f"b{i}"]
        docs.append((i, " ".join(w)))
    docs += [(100 + i, " ".join(words[:150] + [f"z{i}_{k}" for k in range(12 * i)])) for i in range(6)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for width, percent in ((3, 90), (5, 80)):
        got = Counter(tuple(r) for r in jaccard_join.jaccard_classes(df, width, percent).select("doc_id", "n_shingles", "component_id").collect())
        assert got == classes(docs, width, percent)


def test_tile_keys_find_every_link():
    """Sets that differ as much as the threshold allows share a key, whatever their sizes."""
    rng = np.random.default_rng(1)
    for percent in (80, 90):
        for n in (1, 5, 9, 10, 12, 19, 20, 33, 60, 150, 700):
            for _ in range(15):
                a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
                m = len(a)
                drop = int(rng.integers(0, m * (100 - percent) // 100 + 1))
                kept = rng.permutation(a)[drop:]
                room = (100 * len(kept) - percent * m) // percent
                b = np.unique(np.concatenate((kept, rng.integers(0, 2**63, max(0, room)).astype(np.uint64) * np.uint64(2) + np.uint64(1))))
                assert 100 * len(kept) >= percent * (m + len(b) - len(kept))
                if len(kept) < m or len(b) > len(kept):
                    assert set(jaccard_join.keys_of(a, percent).tolist()) & set(jaccard_join.keys_of(b, percent).tolist())


def test_rare_keys_find_every_link():
    """Sets that differ as much as the threshold allows share a rare key, whatever the table of common shingles says."""
    rng = np.random.default_rng(3)
    marks, levels = rng.integers(0, 256, (2, 1 << jaccard_join.SLOT_BITS), np.uint8)
    for percent in (80, 90):
        for n in (1, 5, 9, 10, 19, 33, 150, 700):
            for _ in range(15):
                a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
                kept = rng.permutation(a)[int(rng.integers(0, len(a) * (100 - percent) // 100 + 1)) :]
                room = (100 * len(kept) - percent * len(a)) // percent
                b = np.unique(np.concatenate((kept, rng.integers(0, 2**63, max(0, room)).astype(np.uint64) * np.uint64(2) + np.uint64(1))))
                assert set(jaccard_join.rare_keys_of(a, percent, marks, levels).tolist()) & set(jaccard_join.rare_keys_of(b, percent, marks, levels).tolist())


def test_families_of_shared_passages_fall_apart(spark, monkeypatch):
    """Texts that quote the same passages and are no near copies make no blocks that meet each other, and links among them are found."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 8)
    met, tiles = [], jaccard_join._tiles
    monkeypatch.setattr(jaccard_join, "_tiles", lambda *a: met.append((out := tiles(*a)).count()) or out)
    passages = [[f"p{k}_{j}" for j in range(30)] for k in range(4)]
    docs = [(i, " ".join([f"d{i}_{j}" for j in range(40)] + [w for k in range(4) if k != i % 4 for w in passages[k]])) for i in range(240)]
    docs += [(1000 + i, docs[i][1] + f" tail{i}") for i in range(0, 240, 30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = Counter(tuple(r) for r in jaccard_join.jaccard_classes(df, 5, 80).select("doc_id", "n_shingles", "component_id").collect())
    assert got == classes(docs, 5, 80)
    assert sum(met) < len(docs)


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 12), (20, 20), (4, 5), (30, 2)]
    got = {(r["node"], r["component"]) for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {(k, 1) for k in (1, 2, 3, 4, 5, 30)} | {(k, 10) for k in (10, 11, 12)}


def stripped(docs, length):
    first = {}
    order = sorted(docs, key=lambda d: 1 << 62 if d[0] is None else d[0])
    for i, t in order:
        for k in range(len(t) - length + 1):
            first.setdefault(t[k : k + length], i)
    out = Counter()
    for i, t in docs:
        edge = np.zeros(len(t) + 1, int)
        for k in range(len(t) - length + 1):
            f = first[t[k : k + length]]
            if f is not None and (i is None or f < i):
                edge[k] += 1
                edge[k + length] -= 1
        gone = np.cumsum(edge)[:-1] > 0
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[i, len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    return out


def test_repeated_byte_strings(hostile, nothing):
    docs = [(i, t.encode()) for i, t in rows(hostile)]
    got = Counter(tuple(r) for r in suffix_dedup.remove_repeats(hostile, with_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == stripped(docs, 50)
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_repeats_around_many_boundaries(spark):
    """Strings of few letters, so that anchors stand in many contexts and matches end everywhere."""
    rng = np.random.default_rng(2)
    pool = ["".join(rng.choice(list("ab"), 70)) for _ in range(6)]
    docs = []
    for i in range(60):
        parts = [p[int(rng.integers(0, 10)) : int(rng.integers(45, 70))] for p in rng.choice(pool, 4)]
        docs.append((i, "".join(parts)))
    got = Counter(tuple(r) for r in suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), with_text=False).collect())
    assert got == stripped([(i, t.encode()) for i, t in docs], 50)


def test_passages_repeated_inside_documents_of_other_tasks(spark):
    """One document per partition, so that places of one document meet the smaller one only in a shard."""
    rng = np.random.default_rng(5)
    text = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    shared, other = text(130), text(75)
    docs = [(0, "a" * 1000), (1, text(40) + "a" * 1000 + text(30) + "a" * 700), (3, text(60) + shared + text(20) + other),
            (5, shared + text(90) + shared + text(10) + shared[:80] + text(15) + other + text(25) + shared[20:100]),
            (7, text(33) + shared[30:] + text(70) + shared[:70] + text(50) + shared[30:]), (9, ("line of 60 bytes " + other[:43] + "\n") * 40)]
    split = spark.createDataFrame(docs, "doc_id long, text string").repartition(12, "doc_id")
    apart = spark.createDataFrame(spark.sparkContext.parallelize(docs, len(docs)), "doc_id long, text string")
    want = stripped([(i, t.encode()) for i, t in docs], 50)
    for part in (apart, split):
        assert Counter(tuple(r) for r in suffix_dedup.remove_repeats(part, with_text=False).collect()) == want


def test_words_with_equal_polynomials_make_other_sets(spark):
    word = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, f"{word} {word} {word}"), (2, f"{other} {other} {other}"), (3, f"{word} {word} {word}")], "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard_join.jaccard_classes(df).select("doc_id", "component_id").collect())
    assert got == [(1, 1), (2, 2), (3, 1)]


def test_tables_of_a_few_short_texts(spark):
    for texts in (["one"], ["one two", "one two"], ["", "a"], ["a b", "b"]):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
        for width in (3, 5):
            got = Counter(tuple(r) for r in jaccard_join.jaccard_classes(df, width).select("doc_id", "n_shingles", "component_id").collect())
            assert got == classes(rows(df), width, 90)


def test_near_copy_tasks_give_their_memory_back():
    """A worker that has made tile keys of 20 MB of text holds little more than before; keys are sent on in bounded parts."""
    import subprocess
    import sys
    from pathlib import Path

    code = """
import numpy as np, pyarrow as pa
from ledgerline.llm import jaccard_join as J
from ledgerline.llm.shared import tidy
def held():
    return int(open('/proc/self/statm').read().split()[1]) * 4096 / 1e6
def batches(docs):
    rng = np.random.default_rng(1)
    for _ in range(2):
        yield pa.RecordBatch.from_arrays([pa.array([' '.join(map(str, rng.integers(0, 1 << 40, 180))) for _ in range(docs)])], names=['text'])
for _ in tidy(J.tile_keys(5, 80, 8, 40))(batches(10)):
    pass
before, parts = held(), 0
for _ in tidy(J.tile_keys(5, 80, 8, 40))(batches(9000)):
    parts += 1
print(int(held() - before), parts)
"""
    root = Path(__file__).resolve().parents[2]
    done = subprocess.run([sys.executable, "-c", code], cwd=root, env={"PYTHONPATH": str(root), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True)
    more, parts = map(int, done.stdout.split())
    assert more < 60 and parts > 1
