"""Quality ranking, personal data, secrets and the pipeline."""

import hashlib
import re
from collections import Counter

import pytest
import pyspark.sql.functions as F

import corpus_pipeline
from ledgerline.llm import pairwise_quality, personal_data, queries, secrets_forest
from tests.llm.conftest import prose


def rows(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


@pytest.fixture(scope="module")
def labelled(spark):
    good = [(i, prose(i, 60 + i % 90), "en", 1) for i in range(200)]
    bad = [(1000 + i, " ".join(w + "&&&***"[i % 2 * 3 :] for w in prose(500 + i, 60 + i % 90).split()), "en", 0) for i in range(60)]
    return spark.createDataFrame(good + bad, "doc_id long, text string, lang string, label int")


def test_ranking_on_held_out_documents(labelled):
    seen = labelled.where("doc_id % 3 <> 1").select("doc_id", "label")
    got = pairwise_quality.score_quality(labelled, seen).join(labelled.select("doc_id", "label"), "doc_id").where("doc_id % 3 = 1").collect()
    assert sum(r["predicted"] == r["label"] for r in got) >= 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)


def test_ranking_of_odd_input(hostile, nothing, labelled):
    none = labelled.select("doc_id", "label").limit(0)
    assert {r["score"] for r in pairwise_quality.score_quality(hostile, none).collect()} == {0.5}
    got = pairwise_quality.score_quality(hostile, labelled.select("doc_id", "label")).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows(hostile)) and all(r["score"] is not None for r in got)
    assert pairwise_quality.score_quality(nothing, none).count() == 0


def test_pairs_grow_with_the_rows(labelled):
    table = pairwise_quality.training_rows(pairwise_quality.featured(labelled), labelled.select("doc_id", "label"))
    pairs = pairwise_quality.pairs(table, rounds=4)
    assert 0 < pairs.count() <= 2 * 4 * 3 * 200


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in re.sub(r"\D", "", m[0])][::-1]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return sorted(out)


PERSONAL = [
    "write a@b.c_d@e.f or x.y+z@mail-1.example.co.uk, then a@b", "é 😀 me@ex.org 10.0.0.1 and 256.1.1.1 and 1.2.3.4.5.6.7.8 or 001.002.003.0004",
    "4111 1111 1111 1111, 4111-1111-1111-1112, 4111 1111  1111 1111 5", "+1 (990) 555-1864 +44 20 7946 0958. +1 23 +123456789012345678", "5 6 7 8 9 0 1 2 3 4 5 6", "",
    "+1 (826) 555-4081 190.137.1.2 tail", "@@ a@ @b.c a@b. a@b.c.", "9" * 3000 + "@", "1." * 2000, "+" * 50 + "1 2", "a" * 5000, "a@" * 800, None,
    "call (212) 555-1234, id 123-45-6789, user [at] example [dot] com, IBAN DE89 3704 0044 0532 0130 00",
]


def test_base_spans_and_added_ones(spark, hostile, nothing):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(PERSONAL)] + [(1, PERSONAL[1], "x")], "doc_id long, text string, row string").unionByName(
        hostile.select("doc_id", "text", F.lit("x").alias("row")))
    kinds, got = personal_data.KINDS, personal_data.span_digests(docs).collect()
    want = Counter()
    for i, t in rows(docs):
        spans = base_spans(t)
        text = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)
        want[i, *(sum(k == n for _, k, _ in spans) for n in range(4)), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == want
    by_base = {hashlib.sha256(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in base_spans(t)).encode()).hexdigest(): base_spans(t) for _, t in rows(docs)}
    for r in got:
        spans = [x.split(":") for x in r["spans"].split(",") if x]
        assert spans == sorted(spans, key=lambda x: (int(x[1]), kinds.index(x[0]))) and {(int(a), kinds.index(k), int(b)) for k, a, b in spans} >= set(by_base[r["base_sha256"]])
    assert personal_data.span_digests(nothing).count() == 0


def test_reliabilities_separate_good_and_bad_labelers():
    patterns = []
    for good, noise, n in ((1, 1, 400), (1, -1, 400), (-1, 1, 390), (-1, -1, 410)):
        patterns.append({"kind": "card", "n": n, **dict.fromkeys(personal_data.VOTES, 0), "check": good, "gazetteer": good, "context": noise})
    belief, rates = personal_data.reliabilities(patterns)
    assert min(belief[:2]) > 0.9 and max(belief[2:]) < 0.1
    assert rates["check"][1, 1] > 0.9 and abs(rates["context"][1, 1] - rates["context"][1, 0]) < 0.2


def test_secrets(spark, hostile, nothing):
    import random

    r = random.Random(8)
    key = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    docs = [(i, f"{prose(i, 30)} token = \"{key(40)}\" {prose(i + 500, 30)} commit {key(40)} {prose(i + 900, 3)} internationalisation{'abc' * (i % 3)}", "src/app.py", "x") for i in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, match string")
    got = secrets_forest.scan(df).collect()
    texts = {i: t for i, t, _, _ in docs}
    hits = Counter()
    for f in got:
        assert texts[f["doc_id"]][f["start"] : f["end"]] == f["match"] and f["secret"] == (f["score"] >= 0.5)
        before = texts[f["doc_id"]][: f["start"]]
        hits[before.endswith('token = "'), f["secret"]] += 1
    assert hits[True, True] >= 78 and hits[False, True] <= 2 and hits[False, False] >= 150
    labels = spark.createDataFrame([(f["doc_id"], f["start"], int(not f["secret"])) for f in got], "doc_id long, start long, label int")
    turned = secrets_forest.scan(df, labelled=labels).collect()
    assert sum(f["secret"] for f in turned) > len(got) / 2
    assert secrets_forest.scan(nothing).count() == 0 and secrets_forest.scan(hostile).where("start is null").count() == 0


def test_a_text_is_searched_once_however_many_matches_it_has(spark, monkeypatch):
    planned, keep = [], secrets_forest.stored
    monkeypatch.setattr(secrets_forest, "stored", lambda df, name: planned.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df, name))
    lines = [f'"token": "k{i:02d}Abc" and AbCdEfGh{i:02d}0123456789 or ' for i in range(40)]
    plain = "no sign here but AbCdEfGh0123456789xy.abc stands in it"
    df = spark.createDataFrame([(1, "".join(lines), "a"), (2, plain, "a"), (3, None, "a"), (4, "nothing", None)], "doc_id long, text string, source string")
    got = {(f["doc_id"], f["start"]): f for f in secrets_forest.findings(df).collect()}
    text = "".join(lines)
    want = [(text.index(m), m) for i in range(40) for m in (f"k{i:02d}Abc", f"AbCdEfGh{i:02d}0123456789")]
    assert sorted((f["start"], f["match"]) for f in got.values() if f["doc_id"] == 1) == sorted(want)
    assert all(text[:s].endswith(f["left"]) and len(f["left"]) >= 10 and f["end"] - s == len(f["match"]) for (d, s), f in got.items() if d == 1)
    assert [(f["match"], f["left"]) for f in got.values() if f["doc_id"] == 2] == [("AbCdEfGh0123456789xy.abc", "no sign here but ")] and {d for d, _ in got} == {1, 2}
    assert planned[0].count("regexp_extract_all(") <= 2 and planned[0].count("split(") <= 2  # one of two patterns each


def test_forms_of_secrets(spark):
    """Short values, names and values without spaces, prefixes with dots, padding: each a finding of its own, with its cues."""
    import random

    r = random.Random(9)
    key = lambda n: "".join(r.choice("abcdefghjkmnpqrstuvwxyz23456789") for _ in range(n - 1)) + "7"
    forms = {"short": ('password = "', "Tr0ub4dor3xy", '"'), "joined": ("aws_access_key_id=", "AKIA" + key(16).upper(), ""), "long name": ("aws_secret_access_key=", key(40), ""),
             "quoted": ('my_service_api_key="', key(20), '"'), "dots": ("", "SG." + key(22) + "." + key(43), ""), "google": ("bearer ", "ya29." + key(30), ""),
             "padding": ("secret: ", key(22) + "==", ""), "sentence": ("", "ghp_" + key(36), ".")}
    docs = [(i, f"{prose(i, 20)} {a}{v}{z} {prose(i + 50, 20)}", "src/app.py") for i, (a, v, z) in enumerate(forms.values())]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = {(f["doc_id"], f["match"]): f for f in secrets_forest.described(secrets_forest.findings(df), ["lorem", "lo"]).collect()}
    labels = {(x["doc_id"], x["start"]): x["label"] for x in secrets_forest.seed_labels(secrets_forest.findings(df)).collect()}
    for i, (name, (before, value, _)) in enumerate(forms.items()):
        f = got[i, value]
        assert docs[i][1][f["start"] : f["end"]] == value and labels[i, f["start"]] == 1, name
        assert f["issued"] == value.startswith(("AKIA", "SG.", "ya29.", "ghp_")) and f["near_for"] == bool(before) and f["assigned"] == ("=" in before or ":" in before), name
    words = ["car", "care", "careful", "dog", "do"]
    assert re.sub(secrets_forest.any_word(words), "", "xcarefuycarefuldogdocaz") == re.sub("|".join(sorted(words, key=lambda w: (-len(w), w))), "", "xcarefuycarefuldogdocaz")


def test_queries_are_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14)) and set(queries.ORACLES) <= set(queries.QUERIES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_duplicates", "mixing", "encoding"]


def test_pipeline_stages(spark, small, hostile, nothing):
    """Every stage on what the one before kept; decisions equal those of brute force where they are stated by text."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    quality, exact, near, mixing, encoding = (f for _, f in corpus_pipeline.STAGES)
    good = quality(spark, docs, small).cache()
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in before.items()}
    assert good.columns == columns and all(words[r["doc_id"]] >= 50 for r in good.collect())
    single = exact(spark, good, small).cache()
    last: dict = {}
    for r in good.collect():
        last[r["text"]] = max(r["doc_id"], last.get(r["text"], -1))
    assert single.columns == columns and sorted(r["doc_id"] for r in single.collect()) == sorted(last.values())
    apart = near(spark, single, small).cache()
    from tests.llm.test_duplicates import classes

    want = {c for _, _, c in classes([(r["doc_id"], r["text"]) for r in single.collect()], 5, 80)}
    assert apart.columns == columns and {r["doc_id"] for r in apart.collect()} == want
    mixed = mixing(spark, apart, small).cache()
    assert mixed.columns == columns and max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 2
    assert encoding(spark, mixed, small).count() == mixed.count()
    assert corpus_pipeline.run(spark, small).count() == mixed.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, hostile, small).count() >= 0 and stage(spark, nothing, small).count() == 0
