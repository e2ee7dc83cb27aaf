"""The recurrent network against finite differences and a plain per-window pass; the operator against planted words."""

import random

import numpy as np
import pyspark.sql.functions as F

from ledgerline.llm import gru
from ledgerline.llm.toxicity import score_toxicity
from tests.llm.conftest import prose


def tiny(kind=np.float64):
    return gru.Network.new(words_=7, chars=11, size=3, hidden=4, attention=3, seed=5, kind=kind)


def encoded(texts, net):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    return gru.encode(np.frombuffer(b"".join(raw), np.uint8), offsets, len(net.word), len(net.char))


def loss(net, vocabulary, at, length, label):
    logit = gru.forward(net, gru.word_inputs(net, vocabulary), at, length)[0]
    return np.logaddexp(0, np.where(label == 1, -logit, logit)).sum()


def test_gradients_match_finite_differences():
    net = tiny()
    vocabulary, back, first = encoded(["one two three four five", "two, six one", "a b"], net)
    length = np.diff(first)
    at, label = gru.window_words(back, first[:-1], length, 5), np.array([1, 0, 1])
    x = gru.word_inputs(net, vocabulary)
    logit, memory = gru.forward(net, x, at, length, keep=True)
    slopes = gru.backward(net, vocabulary, x, at, length, memory, 1 / (1 + np.exp(-logit)) - label)
    r = np.random.default_rng(0)
    for p, slope in zip(net.arrays(), slopes, strict=True):
        for _ in range(6):
            i = tuple(int(r.integers(n)) for n in p.shape)
            old = p[i]
            p[i] = old + 1e-5
            up = loss(net, vocabulary, at, length, label)
            p[i] = old - 1e-5
            down = loss(net, vocabulary, at, length, label)
            p[i] = old
            assert abs((up - down) / 2e-5 - slope[i]) < 1e-6


def plain_logit(net, x):
    """One window word by word, with the formulas as they are written in books."""
    sigma = lambda v: 1 / (1 + np.exp(-v))
    hidden, sides = net.state.shape[1], []
    for side, order in ((0, range(len(x))), (1, range(len(x) - 1, -1, -1))):
        h, out = np.zeros(hidden), [None] * len(x)
        for t in order:
            a, b = x[t] @ net.inputs[side] + net.bias[side], h @ net.state[side]
            z, r = sigma(a[:hidden] + b[:hidden]), sigma(a[hidden : 2 * hidden] + b[hidden : 2 * hidden])
            h = (1 - z) * np.tanh(a[2 * hidden :] + r * b[2 * hidden :]) + z * h
            out[t] = h
        sides.append(np.array(out))
    states = np.concatenate(sides, axis=1)
    weight = np.exp(np.tanh(states @ net.attend + net.attend_bias) @ net.attend_to)
    return (weight / weight.sum()) @ states @ net.out + net.out_bias[0]


def test_windows_are_scored_as_by_a_plain_pass():
    net = tiny()
    texts = [prose(1, 23), "", "word", prose(2, 8), "?!", prose(3, 9)]
    vocabulary, back, first = encoded(texts, net)
    text, start, length = gru.window_places(first, 8, 4)
    assert text.tolist() == [0] * 5 + [2, 3, 5, 5] and length.tolist() == [8, 8, 8, 8, 7, 1, 8, 8, 5]
    got = gru.logits(net, vocabulary, back, start, length, 8, batch=4)
    x = gru.word_inputs(net, vocabulary)
    assert np.allclose(got, [plain_logit(net, x[back[s : s + n]]) for s, n in zip(start, length, strict=True)])


def test_character_runs_of_words():
    net = tiny()
    vocabulary, back, _ = encoded(["Ab b AB", "b"], net)
    assert len(vocabulary.bucket) == 2 and np.bincount(back).tolist() in ([2, 2],)
    assert sorted(np.diff(vocabulary.first).tolist()) == [1, 3]  # <b>: one run of 3; <ab>: two of 3, one of 4


def planted(n):
    r, rows = random.Random(3), []
    for i in range(n):
        words, bad = prose(i, r.randint(20, 300)).split(), i % 3 == 0
        for _ in range(r.randint(2, 5) if bad else 0):
            words.insert(r.randrange(len(words)), r.choice(["grobnik", "grobnar", "grobnes", "Grobnul,", "grobna"]))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_planted_words_are_found_in_texts_not_seen(spark):
    rows = spark.createDataFrame(planted(500), "doc_id long, text string, label int")
    got = score_toxicity(rows.select("doc_id", "text"), rows.where("doc_id % 5 <> 0").select("doc_id", "label"))
    held = got.join(rows, "doc_id").where("doc_id % 5 = 0")
    right, n = held.agg(F.sum((F.col("predicted") == F.col("label")).cast("int")), F.count("*")).first()
    assert n == 100 and right >= 90
    assert got.where("n_windows < 1 or worst_window is null or score not between 0 and 1").count() == 0


def test_hostile_rows_and_missing_labels(spark, hostile, nothing):
    labels = hostile.select("doc_id", F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0).alias("label"))
    rows = {r["doc_id"]: r for r in score_toxicity(hostile, labels).collect()}
    assert sum(1 for _ in score_toxicity(hostile, labels).collect()) == hostile.count()
    assert rows[4]["score"] == rows[5]["score"] == rows[6]["score"] and rows[4]["worst_window"] is None
    assert rows[13]["n_windows"] == 1 and rows[14]["n_windows"] > 250
    assert score_toxicity(nothing, labels).collect() == []
    none = score_toxicity(hostile, labels.where("label = 0")).collect()
    assert {r["score"] for r in none} == {0.5} and len(none) == hostile.count()
