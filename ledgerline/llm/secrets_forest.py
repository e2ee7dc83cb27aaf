"""Secret scan with a random forest that removes false positives (operator 9).

A pattern proposes tokens that are long enough for a key, and shorter values of words for secrets. A forest of decision trees, trained on labelled findings, scores
each by its length, its entropy, how often it changes between classes of characters, how much of it words of the corpus
cover, the path (or source) it comes from, and the words beside it. Only DataFrame functions and Spark ML run.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession

from ledgerline.llm.matches import ends, joined, placed
from ledgerline.llm.shared import stored

#: Words beside a token that speak for a secret and against one.
FOR = r"(?:token|secret|password|passwd|pwd|api[_-]?key|apikey|access[_-]?key|private[_-]?key|auth|credential|bearer)"
AGAINST = r"(?:sha[0-9]*|md5|hash|checksum|digest|commit|revision|uuid|guid|etag|example|sample|dummy|placeholder|license|isbn)"
ASSIGNED = r"(?:=|:|:=|=>)\W{0,3}$"
#: A token is a run of 16 or more characters that keys are written with; '=' stands only at its end, as padding.
TOKEN = r"""(?<![A-Za-z0-9_+/-]|[A-Za-z0-9_+/-]\.)[A-Za-z0-9_+/-][A-Za-z0-9_+/.-]{14,}[A-Za-z0-9_+/-](?:={1,2}(?![A-Za-z0-9_+/.=-]|["'`][A-Za-z0-9]))?"""
#: Or the shorter value, of 6 or more characters, that a word for a secret is given.
VALUE = rf"""(?<=[=:>"'`\s])(?<=[=:>]["'`\s]{{0,4}})(?<=(?i:{FOR})["'`]?\s{{0,3}}(?::=|=>|=|:)\s{{0,3}}["'`]?)[^\s"'`=:>][^\s"'`]{{4,}}[^\s"'`,;.)]"""
#: Prefixes that issuers give their keys (fixed values).
ISSUED = r"^(?:AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abprs]-|sk_live_|rk_live_|AIza|ya29\.|SG\.|eyJ)"
QUIET_PATH = r"(?i)(?:test|example|sample|doc|mock|fixture|vendor|lock|min\.)"
FEATURES = ["length", "entropy", "changes", "digit_share", "upper_share", "other_share", "hex", "distinct_share", "coverage", "issued", "near_for",
            "near_against", "assigned", "quoted", "quiet_path"]
#: Dictionary: words of 3 to 12 letters in at least one of so many words of the corpus; there are at most so many.
DICTIONARY_SHARE = 1 << 14
#: Labelled findings to fit on, at most.
MAX_LABELLED = 200_000
TREES, DEPTH, SEED = 40, 8, 7


def dictionary(docs: DataFrame, share: int = DICTIONARY_SHARE) -> list[str]:
    """Lower-case words that stand at least once in `share` words, counted over all texts; at most `share` of them."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,12}"), F.lit(0))).alias("w"))
    counts = stored(words.groupBy("w").agg(F.count("*").alias("n")), "secret-words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return sorted(r["w"] for r in counts.where(F.col("n") * share >= total).select("w").collect())


def any_word(words: list[str]) -> str:
    """A pattern for the longest of the words at a place. Common beginnings are written once, or each place would try all words."""
    tree: dict = {}
    for w in words:
        node = tree
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        rest = [c + pattern(child) for c, child in sorted(node.items()) if c]
        return "(?:" + "|".join(rest) + ")" + "?" * ("" in node) if rest else ""

    return pattern(tree)


def findings(docs: DataFrame, path: str = "source") -> DataFrame:
    """row, doc_id, path, start, end, match, left, right of each proposed token."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path in docs.columns else F.lit("")
    # each text is searched once for its matches and split once; only one with a sign can have values
    signs, value, token = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")), f"{TOKEN}|{VALUE}", TOKEN
    matches = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), where.alias("path"), text.alias("text"),
                       F.when(signs, matches(value)).otherwise(matches(token)).alias("matches")).where(F.size("matches") > 0)
    rows = rows.select("row", "doc_id", "path", "matches", ends(F.when(signs, F.split("text", value, -1)).otherwise(F.split("text", token, -1))).alias("ends"))
    rows = rows.select("row", "doc_id", "path", F.lit("token").alias("family"), joined(F.col("matches"), F.col("ends"), across=True).alias("hits"))
    return placed(stored(rows, "secret-proposals"), ["row", "doc_id", "path"]).drop("family")


def described(spans: DataFrame, words: list[str]) -> DataFrame:
    """The proposals with FEATURES."""
    m, left, right = F.col("match"), F.lower(F.col("left")), F.col("right")
    size = F.char_length(m)
    share = lambda pattern: (size - F.char_length(F.regexp_replace(m, pattern, ""))) / size
    chars = F.filter(F.split(m, ""), lambda c: c != "")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(m, "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "1"), "[^aB1]", "-")
    changes = F.char_length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1
    times = lambda c: size - F.size(F.array_remove(chars, c))
    entropy = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + times(c) / size * F.log2(size / times(c)))
    covered = F.regexp_replace(F.lower(m), any_word(words), "") if words else F.lower(m)
    flag = lambda c: c.cast("double")
    columns = {
        "length": F.log1p(size.cast("double")), "entropy": entropy, "changes": changes / size, "digit_share": share("[0-9]"), "upper_share": share("[A-Z]"),
        "other_share": share("[^A-Za-z0-9]"), "hex": flag(F.regexp_like(m, F.lit("^(?:[0-9a-f]+|[0-9A-F]+)$"))), "distinct_share": F.size(F.array_distinct(chars)) / size,
        "coverage": 1 - F.char_length(covered) / size, "issued": flag(F.regexp_like(m, F.lit(ISSUED))),
        "near_for": flag(F.regexp_like(left, F.lit(FOR))), "near_against": flag(F.regexp_like(left, F.lit(AGAINST))),
        "assigned": flag(F.regexp_like(left, F.lit(ASSIGNED))), "quoted": flag(F.regexp_like(left, F.lit("[\"'`]$")) & F.regexp_like(right, F.lit("^[\"'`]"))),
        "quiet_path": flag(F.regexp_like(F.col("path"), F.lit(QUIET_PATH))),
    }
    return spans.withColumns({k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in columns.items()})


def seed_labels(spans: DataFrame) -> DataFrame:
    """Labels for findings that a rule can tell: 1 for an issuer's prefix or an assigned word for a secret with digits
    in the token, 0 for a token of letters only, of digits only, or after a word against. Others get none."""
    left = F.lower(F.col("left"))
    plain = ~F.regexp_like("match", F.lit("[0-9]")) | ~F.regexp_like("match", F.lit("[A-Za-z]"))
    named = F.regexp_like(left, F.lit(FOR + r"\W{0,4}" + ASSIGNED))
    against = F.regexp_like(left, F.lit(AGAINST + r"\W{0,5}$"))
    label = F.when(plain | against, 0).when(F.regexp_like("match", F.lit(ISSUED)) | named, 1)
    return spans.select("doc_id", "start", label.alias("label")).where("label is not null")


def scan(docs: DataFrame, labelled: DataFrame | None = None, path: str = "source", most: int = MAX_LABELLED) -> DataFrame:
    """One row per finding: doc_id, start, end (code points, end exclusive), match, score, secret (score of 0.5 or more).

    `labelled` has doc_id, start and label (1 secret, 0 not) of known findings; without it `seed_labels` makes them. At
    most about `most` of them, picked by hash, train the forest. With labels of one kind only, all scores are that
    kind. Null and empty texts have no findings; repeated rows have theirs each; a table without `path` has empty paths.
    """
    spans = stored(described(findings(docs, path), dictionary(docs)), "secret-findings")
    labels = (seed_labels(spans) if labelled is None else labelled.where("label in (0, 1)")).groupBy(
        F.col("doc_id").cast("long").alias("_doc"), F.col("start").cast("long").alias("_start")).agg(F.max("label").cast("double").alias("label"))
    labels = stored(labels, "secret-labels")
    share = min(1.0, most / max(1, labels.count()))
    labels = labels.where(F.pmod(F.xxhash64("_doc", "_start"), F.lit(1 << 20)) < int(share * (1 << 20)))
    kinds = [r["label"] for r in labels.select("label").distinct().collect()]
    names = ["doc_id", "start", "end", "match"]
    if len(kinds) < 2:
        only = kinds[0] if kinds else 0.0
        return spans.select(*names, F.lit(only).alias("score"), F.lit(only >= 0.5).alias("secret"))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features")
    rows = spans.join(labels, (spans["doc_id"] == labels["_doc"]) & (spans["start"] == labels["_start"]))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label", featuresCol="features", probabilityCol="chance")
    fitted = forest.fit(stored(rows.select(*FEATURES, "label"), "secret-training").transform(vectors.transform))
    scored = fitted.transform(vectors.transform(spans)).withColumn("score", vector_to_array("chance")[1])
    return scored.select(*names, "score", (F.col("score") >= 0.5).alias("secret"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
