"""Personal data by weak supervision (operator 4).

Patterns propose spans; labelers vote on each: checks (checksums, value ranges, digit counts), gazetteers (name endings,
calling codes, card prefixes, reserved networks), and context words on either side. Votes are counted by pattern,
a table of bounded size, and expectation-maximisation estimates each labeler's reliability from it without labels. The
posteriors, as weights, train a logistic span classifier whose features also hold shape. Spans of the four base rules
always stay; the classifier adds further ones. Only DataFrame functions touch the texts.
"""

from __future__ import annotations

import math

import pyspark.sql.functions as F
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession

from ledgerline.llm.matches import found, placed
from ledgerline.llm.shared import stored

#: Kinds in their listed order; the first four have base rules.
KINDS = ("email", "ip", "card", "phone", "id", "iban")
#: Proposals, written so that no text makes a match take more than linear time.
PROPOSALS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "email_spelt": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}+\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[\[(]\x20?dot\x20?[\])]\x20?)[A-Za-z0-9-]{1,63}+)++",
    "phone_local": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
KIND_OF = {"email_spelt": "email", "phone_local": "phone"}
#: Common endings of host names, and calling codes (gazetteers).
ENDINGS = "com org net edu gov mil int info biz io co me tv dev app ai uk de fr es it nl be ch at pl se no fi dk pt gr cz hu ro ru ua tr us ca mx br ar cl au nz jp cn kr in za".split()
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
NEAR = {
    "email": "e-?mail|mail|contact|write|address|correo|courriel", "ip": "ip|host|server|address|login|from|adresse", "card": "card|visa|master|amex|credit|debit|karte|carte|tarjeta|pay",
    "phone": "phone|tel|call|fax|mobile|cell|contact|telefon|movil|dial", "id": "ssn|social|security|tax|id|passport|number", "iban": "iban|account|bank|konto|compte|cuenta",
}
FAR = "version|release|isbn|issn|order|invoice|sku|token|sha|md5|hash|commit|license|revision|build|serial|ticket|figure|table|chapter|page"
VOTES = ("check", "gazetteer", "context", "against", "edge", "shape")


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    values = F.transform(F.filter(F.split(F.reverse(d), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def octets(m: Column) -> Column:
    plain = F.transform(F.split(m, r"\."), lambda x: F.regexp_replace(x, "^0+", ""))
    return F.forall(plain, lambda x: (F.length(x) <= 3) & (F.coalesce(x.try_cast("int"), F.lit(0)) <= 255))


def base_rule(family: Column, m: Column) -> Column:
    """Whether a proposal is a span of its base rule."""
    n = F.length(digits(m))
    return (F.when(family == "email", F.lit(True)).when(family == "ip", octets(m))
            .when(family == "card", n.between(12, 19) & F.when(n.between(12, 19), luhn(digits(m))).otherwise(F.lit(False)))
            .when(family == "phone", n.between(9, 15)).otherwise(F.lit(False)))


def proposals(docs: DataFrame) -> DataFrame:
    """row, doc_id, family and hits of every document and family; texts are read once and not kept."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hits = F.array(*[F.struct(F.lit(name).alias("family"), found(text, pattern).alias("hits")) for name, pattern in PROPOSALS.items()])
    kept = F.filter(hits, lambda x: F.size(x["hits"]) > 0)
    return stored(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), kept.alias("families")), "personal-proposals")


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, 1)
    return (out.when(no, -1) if no is not None else out).otherwise(0)


def voted(spans: DataFrame) -> DataFrame:
    """The labelers' votes, 1 (personal), -1 (not) or 0 (none), and shape features."""
    m, kind, d = F.col("match"), F.col("kind"), digits(F.col("match"))
    n = F.length(d)
    left, right = F.lower(F.col("left")), F.col("right")
    ending = F.lower(F.regexp_extract(m, r"([A-Za-z]+)$", 1))
    code = F.when(F.startswith(m, F.lit("+")), F.array(F.substring(d, 1, 1), F.substring(d, 1, 2), F.substring(d, 1, 3))).otherwise(F.array(F.lit("1")))
    near = F.lit(False)
    for name, words in NEAR.items():
        near = near | ((kind == name) & F.regexp_like(left, F.lit(rf"(?:{words})\W{{0,3}}(?:\w+\W{{1,2}})?$")))
    reserved = F.regexp_like(m, F.lit(r"^(?:0|127|255)\.|^[0-9]+\.0\.0\.0$"))
    same = F.regexp_like(d, F.lit(r"^([0-9])\1*$"))
    check = (F.when(kind == "card", _vote(n.between(12, 19) & luhn(F.substring(d, 1, 30)), n.isNotNull())).when(kind == "ip", _vote(octets(m), ~octets(m)))
             .when(kind == "phone", _vote(n.between(9, 15), ~n.between(9, 15))).when(kind == "email", _vote(F.length(ending) >= 2, F.length(ending) < 2))
             .when(kind == "id", _vote(~F.regexp_like(m, F.lit(r"^(?:000|666|9..)|-00-|-0000$")), F.lit(True))).otherwise(F.lit(0)))
    gazetteer = (F.when(kind == "email", _vote(ending.isin(ENDINGS), ~ending.isin(ENDINGS)))
                 .when(kind == "phone", _vote(F.arrays_overlap(code, F.array(*[F.lit(c) for c in CALLING])), F.lit(True)))
                 .when(kind == "card", _vote(F.substring(d, 1, 1).isin("3", "4", "5", "6"), F.lit(True))).when(kind == "ip", _vote(F.lit(False), reserved)).otherwise(F.lit(0)))
    edge = F.regexp_like(left, F.lit(r"[\p{L}0-9_/=#.-]$")) | F.regexp_like(right, F.lit(r"^[\p{L}0-9_/=-]"))
    return (spans.withColumn("check", check).withColumn("gazetteer", gazetteer).withColumn("context", _vote(near))
            .withColumn("against", _vote(F.lit(False), F.regexp_like(left, F.lit(rf"(?:{FAR})\W{{0,4}}$"))))
            .withColumn("edge", _vote(F.lit(False), edge)).withColumn("shape", _vote(F.lit(False), same & (n > 0)))
            .withColumn("size", F.least(F.char_length(m), F.lit(64))).withColumn("n_digits", F.least(n, F.lit(32))))


def reliabilities(patterns: list[dict], rounds: int = 60) -> tuple[list[float], dict[str, dict]]:
    """Posterior of each vote pattern, and each labeler's rates: chances of its votes on personal and on other spans.

    `patterns` has kind, the votes and n; there are at most 6 kinds times 3**6 of them.
    """
    belief = [1 / (1 + math.exp(-sum(p[v] for v in VOTES))) for p in patterns]
    rates: dict[str, dict] = {}
    for _ in range(rounds):
        prior: dict[str, float] = {}
        for kind in {p["kind"] for p in patterns}:
            rows = [(b, p["n"]) for b, p in zip(belief, patterns, strict=True) if p["kind"] == kind]
            prior[kind] = (1 + sum(b * n for b, n in rows)) / (2 + sum(n for _, n in rows))
        for v in VOTES:
            rates[v] = {}
            for y in (0, 1):
                mass = {o: 1.0 for o in (-1, 0, 1)}
                for b, p in zip(belief, patterns, strict=True):
                    mass[p[v]] += p["n"] * (b if y else 1 - b)
                total = sum(mass.values())
                rates[v].update({(o, y): m / total for o, m in mass.items()})
        fresh = []
        for p in patterns:
            odds = math.log(prior[p["kind"]] / (1 - prior[p["kind"]])) + sum(math.log(rates[v][p[v], 1] / rates[v][p[v], 0]) for v in VOTES)
            fresh.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        moved = max((abs(a - b) for a, b in zip(belief, fresh, strict=True)), default=0)
        belief = fresh
        if moved < 1e-9:
            break
    return belief, rates


def classified(spans: DataFrame) -> DataFrame:
    """Spans with `chance`, the final classifier's; it learns from vote and shape patterns weighted by their posteriors."""
    spark = spans.sparkSession
    shape = ["size", "n_digits"]
    groups = stored(spans.groupBy("kind", *VOTES, *shape).agg(F.count("*").alias("n")), "personal-patterns")
    patterns = [r.asDict() for r in groups.groupBy("kind", *VOTES).agg(F.sum("n").alias("n")).collect()]
    if not patterns:
        return spans.withColumn("chance", F.lit(0.0))
    belief, _ = reliabilities(patterns)
    weights = spark.createDataFrame([(p["kind"], *(p[v] for v in VOTES), b) for p, b in zip(patterns, belief, strict=True)],
                                    "kind string, " + ", ".join(f"{v} int" for v in VOTES) + ", belief double")
    names = [*[f"is_{k}" for k in KINDS], *[f"{v}_{o}" for v in VOTES for o in ("for", "not")], "size", "n_digits"]

    def features(df: DataFrame) -> DataFrame:
        flags = {f"is_{k}": (F.col("kind") == k).cast("double") for k in KINDS}
        flags |= {f"{v}_{o}": (F.col(v) == s).cast("double") for v in VOTES for o, s in (("for", 1), ("not", -1))}
        flags |= {c: F.col(c).cast("double") / 16 for c in shape}
        return VectorAssembler(inputCols=[f"_{n}" for n in names], outputCol="_features").transform(df.withColumns({f"_{n}": flags[n] for n in names}))

    rows = groups.join(weights, ["kind", *VOTES])
    rows = rows.withColumn("side", F.explode(F.array(F.lit(0.0), F.lit(1.0)))).withColumn(
        "weight", F.col("n") * F.when(F.col("side") == 1, F.col("belief")).otherwise(1 - F.col("belief"))).where("weight > 0")
    if rows.select("side").distinct().count() < 2:
        return spans.withColumn("chance", F.lit(0.0))
    fitted = LogisticRegression(featuresCol="_features", labelCol="side", weightCol="weight", probabilityCol="_chance", rawPredictionCol="_raw",
                                predictionCol="_side", regParam=1e-3, maxIter=60).fit(features(rows))
    return fitted.transform(features(spans)).withColumn("chance", vector_to_array("_chance")[1]).select(*spans.columns, "chance")


def personal_spans(docs: DataFrame, accept: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Documents (row, doc_id) and spans (row, kind, start, end, base, chance) of all that are personal data.

    Null text counts as empty; repeated rows are searched each. Added spans don't overlap a base span.
    """
    table = proposals(docs)
    each = table.select("row", F.explode("families").alias("f")).select("row", "f.family", "f.hits")
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in KIND_OF.items() for x in kv])[F.col("family")], F.col("family"))
    spans = placed(each, ["row"]).withColumn("kind", kind)
    spans = spans.where((F.col("family") != "card") | (F.length(digits(F.col("match"))) >= 12))
    spans = stored(voted(spans.withColumn("base", base_rule(F.col("family"), F.col("match")))), "personal-spans")
    judged = classified(spans)
    extra = judged.where(~F.col("base") & (F.col("chance") >= accept)).select("row", "family", "kind", "start", "end", "base", "chance")
    base = judged.where("base").select("row", "family", "kind", "start", "end", "base", "chance")
    taken = base.select(F.col("row").alias("_row"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    free = extra.join(taken, (F.col("row") == F.col("_row")) & (F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end")), "left_anti")
    free = free.groupBy("row", "kind", "start").agg(F.max("end").alias("end"), F.max("chance").alias("chance")).withColumn("base", F.lit(False))
    return table.select("row", "doc_id"), base.select("row", "kind", "start", "end", "base", "chance").unionByName(free.select("row", "kind", "start", "end", "base", "chance"))


def span_digests(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, base counts, base_sha256, spans."""
    rows, spans = personal_spans(docs)
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])[F.col("kind")]
    entry = F.struct("start", rank.alias("rank"), "end", "kind", "base")
    per = spans.groupBy("row").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    written = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,base:boolean>>")
    joined = rows.join(per, "row", "left").withColumn("all", F.coalesce("all", none))
    base = F.filter("all", lambda x: x["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS[:4]]
    return joined.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("all")).alias("spans"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
