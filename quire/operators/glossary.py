"""Glossaries: candidate terms of a text, the declared table, and their files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

# English function words, which capitals at the start of a sentence don't make a name.
FUNCTION_WORDS = """
the this that these those there then thus they their them and but for from with
which when where while what who whom whose however therefore because since
although though after before during until unless about above below between each
every some many most much more less other another such same both either neither
all any one two three four five six seven eight nine ten first second third his
her its our your not nor only very also just even still yet once upon under over
into onto through without within toward towards against among along around behind
beyond if it is as at by be been being are was were has have had can could should
would may might must shall will do does did done say says said see seen look
looks new old now here how why than too own per via
""".split()
# Letters a candidate has at least, and the largest share of its places at the start of a sentence.
LEAST_LETTERS, START_SHARE = 3, 0.9

WORD = rf"\b[A-Z][a-zA-Z'-]{{{LEAST_LETTERS - 1},}}\b"


def candidates(blocks: DataFrame, column: str = "src_html", top: int = 200) -> DataFrame:
    """(word, n): the most frequent capitalised words that are neither function words nor only sentence starts.

    One exchange, of words already counted in each task; the top comes from a bounded heap.
    """
    t = X.strip_tags(F.col(column))
    every = F.transform(F.regexp_extract_all(t, F.lit(f"(?U){WORD}"), F.lit(0)), lambda w: F.struct(w.alias("word"), F.lit(1).alias("n"), F.lit(0).alias("s")))
    first = F.transform(F.regexp_extract_all(t, F.lit(rf"(?U)(?:^|[.!?])\s*({WORD})"), F.lit(1)), lambda w: F.struct(w.alias("word"), F.lit(0).alias("n"), F.lit(1).alias("s")))
    words = blocks.select(F.explode(F.concat(every, first)).alias("w")).select("w.*")
    counted = words.groupBy("word").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    kept = counted.where(~F.lower("word").isin(FUNCTION_WORDS) & (F.col("s") / F.col("n") <= START_SHARE))
    return kept.select("word", "n").orderBy(F.desc("n"), "word").limit(top)


def candidate_lines(found: DataFrame) -> DataFrame:
    """The lines of a candidate file: all of them comments, so that nothing is declared by accident."""
    return found.orderBy(F.desc("n"), "word").select(F.format_string("# %s =            # %d lần", "word", "n").alias("value"))


def parse(lines: DataFrame) -> DataFrame:
    """(term, translation) of ``term = translation`` lines (seq, value): comments and broken lines are passed over, and of
    a term declared twice the last counts."""
    v = X.strip(F.col("value"))
    sides = F.split(v, "=", 2)
    rows = lines.where((v != "") & ~v.startswith("#") & v.contains("=")).select("seq", X.strip(sides[0]).alias("term"), X.strip(sides[1]).alias("translation"))
    return rows.where("term <> '' AND translation <> ''").groupBy("term").agg(F.max_by("translation", "seq").alias("translation"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The declared table of a glossary file, whatever file system holds it. The file is typed by hand: one task reads it."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("seq", "value"))
    return parse(whole)


def prompt_text(lines: DataFrame) -> DataFrame:
    """One row: ``- term -> translation`` for every declaration in order, repeated ones too; ``(none)`` without any."""
    v = X.strip(F.col("value"))
    sides = F.split(v, "=", 2)
    rows = lines.where((v != "") & ~v.startswith("#") & v.contains("=")).select("seq", X.strip(sides[0]).alias("a"), X.strip(sides[1]).alias("b")).where("a <> '' AND b <> ''")
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.concat(F.lit("- "), "a", F.lit(" -> "), "b").alias("t")))), lambda x: x["t"]), "\n")
    return rows.agg(listed.alias("t")).select(F.when(F.col("t") == "", "(none)").otherwise(F.col("t")).alias("glossary"))
