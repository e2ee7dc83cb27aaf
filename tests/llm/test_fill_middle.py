"""Fill-in-middle outputs against a regular expression on the whole text."""

import hashlib
import re

import pyspark.sql.functions as F
import pytest

from ledgerline.llm.fill_middle import ChunkCache, fill_in_middle, restored
from tests.llm.conftest import prose

LINE = re.compile(r"[^\n]*\n|[^\n]+")


def plainly(doc_id, text, percent=100, spm=50):
    text = text or ""
    units = LINE.findall(text)
    n = len(units)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(docs, **sizes):
    made = fill_in_middle(docs, **sizes).withColumn("back", restored(F.col("output"), F.col("form")))
    got = sorted(map(repr, (tuple(r) for r in made.collect())))
    options = {k: v for k, v in sizes.items() if k in ("percent", "spm")}
    want = sorted(repr((d, *plainly(d, t, **options), t or "")) for d, t in docs.select("doc_id", "text").collect())
    assert got == want


def test_hostile_texts_match_whole_text_rule(hostile, nothing):
    check(hostile)
    check(hostile, average=64, least=1, most=96)
    check(hostile, percent=40, spm=0)
    assert fill_in_middle(nothing).collect() == []


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_markers_and_characters_across_chunk_ends(spark, size):
    texts = ["<P>", "a<P", "<P\n>", "x" * 50 + "<S>" + "y" * 50, "<<M>", "<<P<S", "日本語\n😀é\n" * 9, "\n\n\n", "\r\n", "tail\nno end", "<\nP>", "P>\n<S"]
    rows = [(i * 31 + k, t) for i, t in enumerate(texts) for k in range(6)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), average=64, least=1, most=size)


def test_shared_passages_fall_into_the_same_chunks(spark):
    shared = prose(5, 3000)
    docs = spark.createDataFrame([(i, prose(i, 40) + "\n" + shared + "\n" + prose(50 + i, 30)) for i in range(20)], "doc_id long, text string")
    check(docs.coalesce(1))


def test_a_cache_hit_needs_equal_content():
    cache = ChunkCache(100)
    assert cache.of(1, b"ab\n").ends.tolist() == [3]
    assert cache.of(1, b"a\nb\n").ends.tolist() == [2, 4]
    for k in range(50):
        assert cache.of(k, b"%d\n<M>" % k).marked
    assert cache.of(1, b"ab\n").ends.tolist() == [3]
