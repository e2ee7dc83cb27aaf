"""Perplexity, BPE, mixing and page extraction against brute force."""

import hashlib
import math
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import pytest

from ledgerline.llm import bpe, line_blocks, mixing, perplexity
from ledgerline.llm.textarrays import Prefix, buffers

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


def base(text):
    words, lines, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def kneser_ney(texts, order):
    """Natural log probability of each character of each text, by the textbook recursion; texts with more than a symbol in
    ten words are not counted, but their characters belong to the alphabet."""
    grams = [Counter() for _ in range(order + 1)]
    cleaned = [re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in texts]
    for t, raw in zip(cleaned, texts, strict=True):
        padded = chr(2) * (order - 1) + t
        n_words, _, n_symbols, *_ = base(raw)
        for i in range(len(t) if 10 * n_symbols <= n_words else 0):
            grams[order][padded[i : i + order]] += 1
    alphabet = len(set("".join(cleaned)))
    for m in range(order - 1, 0, -1):
        for g in grams[m + 1]:
            grams[m][g[1:]] += 1
    cut, context = [None], [None]
    for m in range(1, order + 1):
        n = Counter(grams[m].values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        raw = [1 - 2 * y * n[2] / n[1] if n[1] else 0.5, 2 - 3 * y * n[3] / n[2] if n[2] else 1.0, 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
        cut.append([min(max(d, 0.05), k * 0.95) for k, d in enumerate(raw, 1)])
        if m > 1:
            cut[m][0] = 1.0
        sums = defaultdict(lambda: [0, 0.0, 0])
        for g, c in grams[m].items():
            s = sums[g[:-1]]
            s[0] += c
            s[1] += cut[m][min(c, 3) - 1]
            s[2] += 1
        context.append(sums)

    def p(g):
        m = len(g)
        total, freed, _ = context[m][g[:-1]]
        lower = p(g[1:]) if m > 1 else 1 / alphabet
        if total == 0:
            return lower
        c = grams[m][g]
        return (c - (cut[m][min(c, 3) - 1] if c else 0) + freed * lower) / total

    return [[math.log(p((chr(2) * (order - 1) + t)[i : i + order])) for i in range(len(t))] for t in cleaned]


def test_base_columns_and_perplexity(hostile, nothing):
    docs = rows(hostile)
    logs = kneser_ney([t for _, t in docs], 5)
    got = perplexity.judge(hostile).collect()
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == Counter((i, *base(t)) for i, t in docs)
    want = sorted(-sum(x) / len(x) for x in logs if x)
    assert np.allclose(sorted(r["log_ppl"] for r in got if r["log_ppl"] is not None), want, atol=1e-5)
    for r in got:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and (r["low"] is None or r["low"] <= r["log_ppl"] <= r["high"]))
    assert perplexity.judge(nothing).count() == 0


def test_probabilities_of_a_context_sum_to_one(hostile):
    texts = hostile.select("text")
    grams = texts.mapInArrow(perplexity.count_ngrams(3), "gram string, name long, n long").select("gram", "name").distinct()
    sums = grams.join(perplexity.model(texts, 3), "name").groupBy(F.substring("gram", 1, 2)).agg(F.sum(F.exp("logp")).alias("s"))
    assert all(r["s"] <= 1.001 for r in sums.collect())


def test_slices_of_the_model_add_up(hostile):
    whole = Counter((r["doc_id"], r["n_words"], round(r["log_sum"], 3)) for r in perplexity.score(hostile).collect())
    parts = Counter((r["doc_id"], r["n_words"], round(r["log_sum"], 3)) for r in perplexity.score(hostile, entries=2000).collect())
    assert whole == parts


def test_bands_reject_strange_text(spark):
    from tests.llm.conftest import prose

    wild = np.random.default_rng(6)
    strange = " ".join("".join(chr(0x4E00 + int(c)) for c in wild.integers(0, 3000, 7)) for _ in range(80))
    docs = [(i, prose(i, 150), "en") for i in range(300)] + [(1000, strange, "en")]
    got = {r["doc_id"]: r["kept"] for r in perplexity.judge(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    assert not got[1000] and sum(got.values()) == 300


def test_symbol_junk_does_not_vouch_for_itself(spark):
    """A tenth of the corpus is words of the language with symbols or cell borders between them; none of it stays."""
    from tests.llm.conftest import prose

    docs = [(i, prose(i, 150), "en") for i in range(300)]
    docs += [(1000 + i, " ".join(w + "&%$"[i % 3] * 3 for w in prose(500 + i, 120).split()), "en") for i in range(20)]
    docs += [(2000 + i, " | ".join(prose(600 + i, 120).split()), "en") for i in range(15)]
    got = {r["doc_id"]: r["kept"] for r in perplexity.judge(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    assert all(got[i] == (i < 1000) for i in got) and len(got) == 335
    junk = spark.createDataFrame(docs[300:], "doc_id long, text string, lang string")  # no example at all: nothing to tell them by
    assert all(r["kept"] for r in perplexity.judge(junk).collect())


def test_bands_tell_labelled_junk_from_clean_text(spark):
    folder = "/root/testdata/sf0.01"
    judged = perplexity.judge(spark.read.parquet(f"{folder}/documents.parquet")).where(~F.col("base_failed"))
    found = judged.join(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality"), "doc_id").groupBy("quality").agg(
        F.count("*").alias("n"), F.count_if("kept").alias("kept")).collect()
    found = {r["quality"]: (r["n"], r["kept"]) for r in found}
    assert found[0][1] <= 0.5 * found[0][0] and found[1][1] >= 0.98 * found[1][0]


def test_good_documents_keep_columns(hostile, nothing):
    out = perplexity.keep_good(hostile)
    assert out.columns == hostile.columns and 0 < out.count() < hostile.count()
    assert perplexity.keep_good(nothing).count() == 0


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(bpe.vocabulary_path())


ODD = ["", " ", "it's we've 'll 're'd ''s '", "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|> 's", "x\n\n  y\t z  ", "é ñ 12 ½ x²", "don't'sabc 'veX 'LL",
       "aaaa" * 300, "日本語 テキスト", "😀😀 👩‍👩‍👧", "a\r\n b \r\n", "'s", " 's", "\n's", "\x00\x01", "é ​ ﻿", "<|endoftext|", "tail <|endoftext|>\n "]


def test_encoder_equals_the_library(library):
    vocab = bpe.vocabulary(bpe.vocabulary_path())
    rng = np.random.default_rng(3)
    texts = ODD + ["".join(rng.choice(list("ab's tlrevdm \n\t 12.,!?é日 '"), int(rng.integers(1, 60)))) for _ in range(1500)]
    words = sorted({b" the", b"the", b"a", b"ab", b" ab", b"'s", b" a"})
    for lexicon in (None, bpe.Lexicon.build(words, vocab.merge(words))):
        encoder = bpe.Encoder(vocab, lexicon)
        data, offsets = buffers(pa.array(texts))
        ids, first = encoder.encode(data, offsets)
        for i, t in enumerate(texts):
            assert ids[first[i] : first[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, t
        raw, _ = encoder.decode(ids)
        assert raw.tobytes() == "".join(texts).encode()


def test_lexicon_is_minimal_and_exact(tmp_path):
    words = sorted({"".join(x).encode() for x in np.random.default_rng(4).choice(list("abc"), (400, 6))} | {b"a", b"ab", b"abcabc"})
    ids = [np.array([i, i + 1]) for i in range(len(words))]
    lexicon = bpe.Lexicon.build(words, ids)
    lexicon.save(f"{tmp_path}/x")
    lexicon = bpe.Lexicon.load(f"{tmp_path}/x")
    probe = words + [b"zz", b"abca", b"", b"abcabcd"]
    data = np.frombuffer(b"".join(probe), np.uint8)
    ends = np.cumsum([len(w) for w in probe])
    assert lexicon.find(data, np.concatenate(([0], ends[:-1])), ends).tolist() == [*range(len(words)), -1, -1 if b"abca" not in words else words.index(b"abca"), -1, -1]
    tails = {frozenset(w[i:] for w in words if w.startswith(p)) for p in {w[:i] for w in words for i in range(len(w) + 1)} for i in [len(p)]}
    assert len(lexicon.final) == len(tails)


def test_documents_round_trip(hostile, nothing, library):
    path = bpe.vocabulary_path()
    got = bpe.token_digests(hostile, path, share=50).collect()
    want = Counter()
    for i, t in rows(hostile):
        ids = library.encode(t, add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in got) == want
    full = bpe.encode_documents(hostile, path).collect()
    assert all(r["text_ok"] for r in full) and Counter((r["doc_id"], bytes(r["decoded"]).decode()) for r in full) == Counter(rows(hostile))
    assert bpe.token_digests(nothing, path).count() == 0


def shares(sizes, share, weights, cap):
    """Targets by sharing and resharing until none is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed: dict = {}
    while True:
        left = share * sum(sizes.values()) - sum(fixed.values())
        open_ = [s for s in names if s not in fixed]
        part = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if part[s] > cap * sizes[s]]
        if not over:
            return fixed | part
        fixed |= {s: cap * sizes[s] for s in over}


def test_targets_and_copies(hostile, nothing):
    got = mixing.mix(hostile).collect()
    sizes = defaultdict(int)
    for r in hostile.collect():
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    want = shares(sizes, 1.5, (3, 1, 2), 2.0)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9) and 0 <= r["copies"] <= 2
        assert r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    largest = max(r["size"] for r in got)
    assert all(abs(taken[s] - want[s]) <= largest / 2 for s in want)
    for parts in (1, 3, 12):
        again = mixing.mix(hostile.repartition(parts)).collect()
        assert Counter((r["doc_id"], r["size"], r["taken"], r["copies"]) for r in again) == Counter((r["doc_id"], r["size"], r["taken"], r["copies"]) for r in got)
    assert mixing.mix(nothing).count() == 0


def test_mix_of_repeated_rows_follows_no_layout(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 4)
    rng = np.random.default_rng(8)
    docs = [(int(i), "w " * int(n), s) for i, n, s in zip(rng.integers(0, 40, 400), rng.integers(1, 30, 400), rng.choice(["p", "q"], 400), strict=True)]
    docs += [(7, "w " * 9, "p")] * 150 + [(None, "w " * int(n), "q") for n in rng.integers(1, 5, 150)]
    table = spark.createDataFrame(docs, "doc_id long, text string, source string")
    seen = []
    for parts in (1, 3, 12):
        got = mixing.mix(table.repartition(parts)).collect()
        assert len(got) == len(docs)
        seen.append(Counter((r["doc_id"], r["source"], r["size"], r["copies"]) for r in got))
    assert seen[0] == seen[1] == seen[2]
    for source in ("p", "q"):
        rows = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= 15 and max(r["copies"] for r in rows) <= 2


def test_targets_that_stay_out_of_reach_are_an_error(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 50), "pq"[i % 2]) for i in range(200)], "doc_id long, text string, source string")
    sizes = docs.select("source", mixing.words_in(F.col("text")).alias("size")).groupBy("source", "size").agg(F.count("*").alias("times"))
    with pytest.raises(RuntimeError, match="in 1 steps"):
        mixing.dual_solution(sizes, mixing.source_targets(sizes, 1.5, (3, 1), 2.0), 2.0, steps=1)


def test_rates_solve_the_dual(spark):
    rng = np.random.default_rng(5)
    docs = [(i, "w " * int(rng.integers(1, 400)), ["p", "q", "r"][int(i % 7 > 2) + int(i % 7 > 4)]) for i in range(700)]
    got = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
    for source in by.values():
        target = source[0]["target"]
        assert math.isclose(sum(r["rate"] * r["size"] for r in source), target, rel_tol=1e-5)
        assert abs(sum(r["taken"] for r in source) - target) <= 20
        free = [r for r in source if r["rate"] < 2 and r["size"]]
        tilt = [math.log(r["rate"]) / r["size"] for r in free]
        assert not tilt or max(tilt) - min(tilt) < 1e-9
    assert Counter((r["doc_id"], r["taken"]) for r in got) == Counter((r["doc_id"], r["taken"]) for r in mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect())


def test_mixed_rows(hostile, nothing):
    out = mixing.mixed(hostile)
    assert out.columns == hostile.columns and out.count() > 0 and mixing.mixed(nothing).count() == 0


LONG = "Words of an article that goes on for a while and says something. "


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("<b>", ""), ("plain &amp; simple", "plain & simple"), ("<p>tiny</p>", "tiny"),
    (f"<title>t</title><nav><a>Home</a></nav><article><h1>Head</h1><p>{LONG * 3}<p>Short.<p>a&nbsp;b &lt;c&gt;</article><footer>f</footer>", f"Head {LONG * 3}Short. a b <c>"),
    (f"<div id=header>Site</div><ul class=menu><li><a href=/>Home</a></ul><div class=content><p>{LONG * 2}</p></div><div class='sidebar'>{LONG}</div><div id=comments>{LONG * 4}</div>", (LONG * 2).strip()),
    (f"<div><a href=1>Home</a></div><div><p>{LONG * 3}</p><p>Yes.</p><p>{LONG * 2}</p></div><div><a>Imprint</a></div>", f"{LONG * 3}Yes. {LONG * 2}".strip()),
    (f"<body class='has-sidebar'><main><form><p>{LONG * 2}</p></form><p>a <b>b</b>c<br>d</p><div class='cookie-notice'>{LONG}</div><script>var x='<p>';</script><p>e<!-- x -->f</p></main>", "a bc d ef"),
    ("<article><p>One.</p><section class=comments><p>Reader says</p></section></article>", "One."),
])
def test_main_text(page, text):
    assert (line_blocks.main_text(page) if page else "") == text


def test_pages(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = {r["page_id"]: r for r in line_blocks.extract(pages).collect()}
    for p in pages.collect():
        inner = p["html"][p["html"].index("<article>") + 9 : p["html"].index("</article>")]
        import html

        want = " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:h1|p|br)>", " ", inner))).split())
        assert got[p["page_id"]]["text"] == want and got[p["page_id"]]["n_chars"] == len(want)
    odd = spark.createDataFrame([(1, None, None, "x"), (2, "u", "", "x"), (2, "u", "<p>" * 5000 + "deep", "x")], "page_id long, url string, html string, text string")
    assert Counter((r["page_id"], r["text"]) for r in line_blocks.extract(odd).collect()) == Counter([(1, ""), (2, ""), (2, "deep")])
    assert line_blocks.extract(odd.limit(0)).count() == 0


def twins(n: int) -> tuple[str, str]:
    """Two words of 2**n letters that one polynomial modulo 2**64 cannot tell apart, whatever its base."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(1 << n))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_with_equal_polynomials_stay_apart(library):
    vocab = bpe.vocabulary(bpe.vocabulary_path())
    for n in (10, 11, 12):
        left, right = twins(n)
        data, offsets = buffers(pa.array([left, right, left + right, right + left]))
        whole = Prefix(data)
        names = whole.of(offsets[:-1], offsets[1:])
        assert len(set(names.tolist())) == 4
        ids, at = bpe.Encoder(vocab, None).encode(data, offsets)
        for i, text in enumerate((left, right, left + right, right + left)):
            assert ids[at[i] : at[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids
    data, offsets = buffers(pa.array(["x" + twins(11)[0] + "y" + twins(11)[0]]))
    whole = Prefix(data)
    a, b = whole.of(np.array([1, 2 + 2048]), np.array([2049, 2 + 4096]))
    assert a == b


def test_encoder_trusts_no_hash(library, monkeypatch):
    vocab = bpe.vocabulary(bpe.vocabulary_path())
    monkeypatch.setattr(bpe.Prefix, "of", lambda self, start, end: np.asarray(start % 3, np.uint64))
    encoder = bpe.Encoder(vocab, None)
    for texts in (ODD, ["some other words here", "words here, other", *ODD[::-1]]):
        data, offsets = buffers(pa.array(texts))
        ids, at = encoder.encode(data, offsets)
        for i, text in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids


def test_encoder_holds_little_of_what_it_met():
    """What a word costs once its block is done: no views that keep the arrays of a block alive."""
    encoder = bpe.Encoder(bpe.vocabulary(bpe.vocabulary_path()), None)
    encode = lambda n: encoder.encode(*buffers(pa.array([" ".join(f"w{i * 7919:x}q{i}" for i in range(n, n + 5000))])))
    encode(0)
    tracemalloc.start()
    for n in range(5000, 30_000, 5000):
        encode(n)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 300 * 25_000, held


def test_runs_that_differ():
    data = np.frombuffer(b"abcabdabcab", np.uint8)
    start, end = np.array([0, 3, 6, 9]), np.array([3, 6, 9, 11])
    assert bpe.unlike(data, start, end, np.zeros(4, int), np.full(4, 3), most=2).tolist() == [1, 3]
