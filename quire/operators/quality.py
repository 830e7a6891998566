"""Row-level rules on pairs of a source and a target text. The first rule that holds gives the flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: Flags that are reported but accepted at once; the others are sent again.
ADVISORY = ("missing_number", "missing_term")
SHORT_SOURCE, SHORT_SHARE = 80, 0.4


def flag(src: Column, dst: Column, term_missing: Column | None = None) -> Column:
    """empty, tag_mismatch, missing_number, missing_term, too_short, or null."""
    s, d = X.visible_length(src), X.visible_length(dst)
    out = F.when(F.coalesce(X.strip(dst), F.lit("")) == "", "empty")
    out = out.when(X.opening_tags(src) != X.opening_tags(dst), "tag_mismatch")
    out = out.when(X.not_covered(X.digit_runs(X.strip_tags(src)), X.digit_runs(X.strip_tags(dst))), "missing_number")
    if term_missing is not None:
        out = out.when(F.coalesce(term_missing, F.lit(False)), "missing_term")
    return out.when((s > SHORT_SOURCE) & (d < F.lit(SHORT_SHARE) * s), "too_short")


def action(flag_col: Column) -> Column:
    """accept (no flag), advise (accepted with its flag) or retry."""
    return F.when(flag_col.isNull(), "accept").when(flag_col.isin(*ADVISORY), "advise").otherwise("retry")


def missing_terms(pairs: DataFrame, glossary: DataFrame, key: str = "id") -> DataFrame:
    """(key, term): declared terms that a source has, by whole words, and whose translation its target lacks.

    ``pairs`` has key, src and dst; ``glossary`` has term and translation. A term that starts with a capital must
    match in case. The join is on the first word of a term, so neither side is broadcast or crossed: a source meets
    only the terms whose first word it has. A term without a word character matches nothing. Pairs whose
    visible texts are the same lack nothing.
    """
    src, dst = X.strip_tags(F.col("src")), X.strip_tags(F.col("dst"))
    told = pairs.select(key, src.alias("s"), F.lower(dst).alias("d")).where(X.strip(src) != X.strip(dst))
    words = told.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("s"), F.lit(r"(?U)\w+"), F.lit(0)))).alias("word"))
    terms = glossary.select("term", F.lower("translation").alias("translation"), F.lower(F.regexp_extract("term", r"(?U)\w+", 0)).alias("word")).where("word <> ''")
    near = words.join(terms, "word").select(key, "term", "translation")  # ids and terms only: texts come back for these
    whole = F.concat(F.when(F.col("term").rlike(r"^\p{Lu}"), F.lit("(?U)")).otherwise(F.lit("(?iU)")), F.lit(r"\b\Q"), "term", F.lit(r"\E\b"))
    hit = near.join(told, key).where(F.regexp_like(F.col("s"), whole) & ~F.contains("d", "translation"))
    return hit.select(key, "term").distinct()


def check(pairs: DataFrame, glossary: DataFrame | None = None, key: str = "id") -> DataFrame:
    """``pairs`` with flag and action."""
    missing = None
    if glossary is not None:
        lacking = missing_terms(pairs, glossary, key).select(key).distinct().withColumn("_lacks", F.lit(True))
        pairs, missing = pairs.join(lacking, key, "left"), F.col("_lacks")
    out = pairs.withColumn("flag", flag(F.col("src"), F.col("dst"), missing)).withColumn("action", action(F.col("flag")))
    return out.drop("_lacks")
