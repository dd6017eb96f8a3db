"""Quality rules, line first.

Each line is judged by rules on punctuation, navigation and boilerplate; failing lines are taken out, and a document that
thereby loses more than ``max_loss`` of its characters other than white space is rejected.  Some whole-text figures
(words, symbols, repeated lines, repeated three-word windows) reject on their own.  Only built-in functions are used, and
every step is linear in the text but for sorting its windows.

Defined results: a null or empty text has no words and fails; lines without a word are kept as they are and count nothing;
texts of any length are judged whole; windows are compared by a 64-bit hash of their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD_GAP, whole_text

# fixed values of the whole-text rules
SYMBOLS = "#*$%&|<>"
MIN_WORDS, REPEATED_PERCENT = 50, 50

# the line rules: what a line may have
SYMBOL_SHARE = 0.05     # symbols a character
SHOUT_SHARE = 0.08      # exclamation marks a character, in lines with three or more
SEPARATORS = "|»«•·›→"
SEPARATOR_SHARE = 0.02  # separators a character, in lines with three or more
BOILERPLATE = (r"(?i)(all rights reserved|licen[sc]ed under|terms of (use|service)|privacy policy|cookie (policy|settings)|"
               r"we use cookies|enable javascript|sign up for|subscribe to our|lorem ipsum|copyright (\(c\)|©|[0-9]{4}))")
BOILERPLATE_CHARS = 300  # a longer line is prose that mentions such words


def without(text: Column, chars: str) -> Column:
    """Characters of a text that are none of ``chars``."""
    return F.length(F.translate(text, chars, ""))


def has_word(line: Column) -> Column:
    return without(line, SPACES) > 0


def line_fails(line: Column) -> Column:
    """Whether a line fails a rule; a line without a word never does."""
    size = F.length(line)
    symbols, shouts, marks = (size - without(line, x) for x in (SYMBOLS.replace("|", ""), "!", SEPARATORS))
    punctuation = ((symbols >= 3) & (symbols > SYMBOL_SHARE * size)) | ((shouts >= 3) & (shouts > SHOUT_SHARE * size)) | ~line.rlike(r"[\p{L}\p{N}]")
    navigation = (marks >= 3) & (marks > SEPARATOR_SHARE * size)
    boilerplate = (size <= BOILERPLATE_CHARS) & line.rlike(BOILERPLATE)
    return has_word(line) & (punctuation | navigation | boilerplate)


def judge_quality(docs: DataFrame, max_loss: float = 0.5, col: str = "text") -> DataFrame:
    """Adds ``figures`` (a struct of the rule figures), ``cleaned`` and ``kept`` to every row, without a shuffle."""
    names = ("figures", "cleaned", "kept")
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in names]).alias("__row"), whole_text(f"`{col}`").alias("__text"))
    df = df.select("__row", "__text", F.filter(F.split("__text", WORD_GAP), lambda w: w != "").alias("__w"), F.split("__text", "\n").alias("__l"))
    df = df.withColumn("__n", F.size("__w"))
    # windows of three words as (hash, place), in order of hash: equal windows are neighbours
    df = df.withColumn("__s", F.sort_array(F.transform(
        F.slice("__w", 1, F.greatest(F.col("__n") - 2, F.lit(0))),
        lambda w, i: F.struct(F.xxhash64(w, F.get(F.col("__w"), i + 1), F.get(F.col("__w"), i + 2)).alias("h"), i.alias("p")))))
    df = df.withColumn("__p", F.sort_array(F.transform(
        F.filter(F.col("__s"), lambda x, i: F.coalesce(F.get(F.col("__s"), i + 1)["h"] == x["h"], F.lit(False))
                 | F.coalesce(F.get(F.col("__s"), i - 1)["h"] == x["h"], F.lit(False))),
        lambda x: x["p"])))
    repeats = F.aggregate(F.transform(F.col("__p"), lambda p, i: F.least(F.lit(3), F.coalesce(F.get(F.col("__p"), i + 1) - p, F.lit(3)))),
                          F.lit(0).cast("long"), lambda a, x: a + x)
    df = df.withColumn("__worded", F.filter("__l", has_word)).withColumn("__good", F.filter("__l", lambda x: ~line_fails(x)))
    chars = without(F.col("__text"), SPACES)
    df = df.select(
        "__row", "__text", "__good", (F.size("__good") == F.size("__l")).alias("__all"), F.col("__n").cast("long").alias("n_words"), chars.cast("long").alias("word_chars"),
        (F.length("__text") - without(F.col("__text"), SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("__worded") - F.size(F.array_distinct("__worded"))).cast("long").alias("n_dup_lines"), repeats.alias("n_repeat_words"))
    df = df.withColumn("cleaned", F.when(F.col("__all"), F.col("__text")).otherwise(F.array_join("__good", "\n")))
    df = df.withColumn("lost_chars", F.when(F.col("__all"), F.lit(0).cast("long")).otherwise(F.col("word_chars") - without(F.col("cleaned"), SPACES)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    figures = F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", failed.alias("base_failed"))
    # always true, but not foldable: a filter on the verdict stays above, or it would compute every step anew inside the next
    here = F.monotonically_increasing_id() >= 0
    return df.select("__row.*", figures.alias("figures"), "cleaned", (here & ~failed & (F.col("lost_chars") <= max_loss * F.col("word_chars"))).alias("kept"))
