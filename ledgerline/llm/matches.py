"""Places of regular expression matches in whole texts, with DataFrame functions only."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W

#: Characters of context kept on either side of a match.
LEFT, RIGHT = 40, 12


def found(text: Column, pattern: str, across: bool = False) -> Column:
    """One struct per match: the match, the length of the text since the match before, and the context on both sides.

    The texts between matches come from splitting at the same pattern, so they alternate with the matches.
    With `across` the context on the left reaches into the match before, else it ends there.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<match:string,gap:int,left:string,right:string>>")
    return F.when(F.size(hits) > 0, joined(hits, ends(F.split(text, pattern, -1)), across)).otherwise(none)


def ends(between: Column) -> Column:
    """Of each text between matches its length and what of it is context."""
    return F.transform(between, lambda p: F.struct(F.char_length(p).alias("gap"), F.substring(p, -LEFT, LEFT).alias("left"), F.substring(p, 1, RIGHT).alias("right")))


def joined(hits: Column, ends: Column, across: bool) -> Column:
    """Matches, at least one, and the `ends` around them as `found` has them. Both are read once per match and more, so a text of many
    matches wants them as columns of a table, not as expressions."""
    left = lambda i: F.get(ends, i)["left"]
    if across:
        left = lambda i: F.substring(F.concat(F.coalesce(F.get(ends, i - 1)["left"], F.lit("")), F.coalesce(F.get(hits, i - 1), F.lit("")), F.get(ends, i)["left"]), -LEFT, LEFT)
    return F.transform(F.zip_with(hits, F.sequence(F.lit(0), F.greatest(F.size(hits) - 1, F.lit(0))), lambda m, i: F.struct(m.alias("match"), i.alias("i"))),
                       lambda x: F.struct(x["match"].alias("match"), F.get(ends, x["i"])["gap"].alias("gap"), left(x["i"]).alias("left"),
                                          F.get(ends, x["i"] + 1)["right"].alias("right")))


def placed(rows: DataFrame, keys: list[str], family: str = "family", hits: str = "hits") -> DataFrame:
    """(keys, family, hits) to one row per match with start and end in code points, end exclusive. Running lengths of one
    document and family are summed in order; only documents with matches take part."""
    each = rows.select(*keys, family, F.posexplode(hits).alias("at", "hit"))
    before = W.partitionBy(*keys, family).orderBy("at")
    size = F.char_length("hit.match")
    end = F.sum(F.col("hit.gap") + size).over(before)
    return each.select(*keys, family, "hit.match", "hit.left", "hit.right", (end - size).cast("long").alias("start"), end.cast("long").alias("end"))
