"""Collocations against a direct count over all pieces, and the trie against a dictionary."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from ledgerline.llm.hat_trie import Node, Trie
from ledgerline.llm.phrases import collocations, frequent_filter, phrase_counts, word_counts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def directly(rows, least, longest=5, top=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        drop = {p[i : i + k] for p, a in cand.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if a >= counts[p[i : i + k]]}
        scored = []
        for p, a in cand.items():
            if p not in drop:
                score, _, l, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))  # noqa: E741
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1)]  # noqa: E741
    return sorted(out)


def got(docs, **options):
    return sorted(tuple(r) for r in collocations(docs, **options).collect())


def test_hostile_texts_match_a_direct_count(hostile, nothing):
    rows = [(r["lang"], r["text"]) for r in hostile.select("lang", "text").collect()]
    assert got(hostile, least=3) == directly(rows, 3)
    assert got(hostile, least=3, burst=4, most=60, bits=8, longest=4, top=7) == directly(rows, 3, 4, 7)
    assert got(nothing) == []


@pytest.mark.parametrize("burst, most", [(2, 9), (16, 200), (4096, 10**6)])
def test_few_words_many_phrases(spark, burst, most):
    r = random.Random(4)
    words = ["a", "B", "c", "é", "日本", "d\tx", "the", "of", "x.y", "q\vz", "-", "&"]
    rows = [(i, r.choice(["en", "de", None]), " ".join(r.choices(words, [9, 7, 5, 5, 3, 2, 20, 15, 2, 2, 1, 1], k=r.randint(0, 400)))) for i in range(60)]
    rows += [(100 + i, "en", "San Jose de la Cruz! new york new york, new york") for i in range(15)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    want = directly([x[1:] for x in rows], 10)
    assert len(want) > 100 and got(docs, least=10, burst=burst, most=most) == want


def test_trie_bursts_spills_and_keeps_counts():
    r, trie, want, got = random.Random(1), Trie(5, burst=8, most=500), Counter(), Counter()

    def take(keep):
        for phrases, counts in trie.spill(keep):
            for p, n in zip(phrases.tolist(), counts.tolist(), strict=True):
                got[tuple(p)] += n

    for _ in range(200):
        rows = sorted({tuple(r.randint(0, 5) for _ in range(5)) for _ in range(50)})
        counts = [r.randint(1, 3) for _ in rows]
        want.update(dict(zip(rows, counts, strict=True)))
        trie.add(np.array(rows), np.array(counts))
        if trie.full():
            take(250)
            assert trie.entries <= 250
    assert any(isinstance(x, Node) for low in trie.root.values() for x in low.values())
    take(0)
    assert got == want and trie.entries == 0


def test_filter_never_misses(spark):
    texts = spark.createDataFrame([("en", "to be or not to be " * 60), ("de", "to be " * 60)], "lang string, text string")
    words = word_counts(texts, 100)
    assert {(r["lang"], r["phrase"]): r["n"] for r in words.collect()} == {("en", "to"): 120, ("en", "be"): 120, ("en", ""): 360, ("de", ""): 120}
    known = frequent_filter(words.where("phrase <> ''"), 1, 12)
    assert sorted(tuple(r) for r in phrase_counts(texts, 2, 50, known, 3).collect()) == [("en", "be to", 59), ("en", "to be", 120)]
