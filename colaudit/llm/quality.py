"""Line-first cleaning by DataFrame functions only.

Each line that has a word is judged on its own: it fails as navigation (separators between
its words), as decoration (a large share of symbols, or shouted words), for lack of
punctuation (several words and no sentence mark at their end, unless a long line has one inside), or as
boilerplate (a known notice).  Failing lines go; a document is rejected if less than ``min_share`` of
its letters is left, or by the base rules on word counts and repeated five-word windows.

Repeated windows are found from 64-bit hashes of the words: if all are different, so are the
windows; only for other texts are the windows themselves sorted and compared, so the count is exact.

Defined results: a null or empty text has no words, fails the base rules and keeps an empty
text; repeated rows are judged each; nothing depends on doc_id, so null and repeated ids are returned
as they are; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, MIN_WORDS, MAX_REPEAT, MIN_SHARE = 5, 10, 20, 0.5
#: Fixed expressions, in a form that Java and RE2 read alike.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
SEPARATOR = r"(^|[\x20\x09-\x0D])[|>»•·/]+([\x20\x09-\x0D]|$)"
SHOUT = r"(^|[\x20\x09-\x0D])[^a-z\x20\x09-\x0D]*\p{Lu}{2,}[^a-z\x20\x09-\x0D]*!!+([\x20\x09-\x0D]|$)"
MARK = r"[.!?…:;][\"'”’»)\]]*[\x20\x09-\x0D]*\z"
INNER = r"[.!?…:;][\"'”’»)\]]*[\x20\x09-\x0D]"
NOTICE = r"(?i)(cookie policy|privacy policy|terms of (use|service)|all rights reserved|enable javascript|subscribe to our newsletter|click here to|share this (page|article|post)|(released|licensed) under)"


def let(value: Column, f) -> Column:
    """f(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _count(x: Column, pattern: str) -> Column:
    return F.length(x) - F.length(F.regexp_replace(x, pattern, ""))


def bad_line(x: Column) -> Column:
    """Whether a line with words fails one of the rules."""
    letters = F.length(F.regexp_replace(x, SPACE, ""))
    n = F.size(words_of(x))
    navigation = x.rlike(SEPARATOR)
    decoration = (_count(x, SYMBOL) * 10 > letters) | x.rlike(SHOUT)
    unfinished = (n >= 4) & ~x.rlike(MARK) & ~((n >= 30) & x.rlike(INNER))
    return navigation | decoration | unfinished | x.rlike(NOTICE)


def _repeat_exact(words: Column) -> Column:
    """Words inside five-word windows that occur twice or more."""
    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.struct(F.array_join(F.slice(words, i, WINDOW), " ").alias("w"), i.alias("i")))

    def twice(s):
        return F.transform(F.filter(s, lambda x, k: (x["w"] == F.get(s, k - 1)["w"]) | (x["w"] == F.get(s, k + 1)["w"])), lambda x: x["i"])

    def covered(p):
        return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1), x + WINDOW) - x)), F.lit(0), lambda a, x: a + x)

    return let(F.sort_array(let(F.sort_array(windows), twice)), covered)


def assess(docs: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """docs(doc_id, text) -> one row per row of docs with counts, verdicts and the cleaned text.

    (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, n_bad_lines, kept_share, kept, clean_text)
    """
    d = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.select("doc_id", "text", words_of(F.col("text")).alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    d = d.select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"), F.filter("lines", lambda x: ~bad_line(x)).alias("good"))
    h = F.col("hashes")
    at = F.when(F.size("words") >= WINDOW, F.sequence(F.lit(0), F.size("words") - WINDOW)).otherwise(F.array().cast("array<int>"))
    d = d.select("*", F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])).alias("windows"))
    repeat = F.when(F.size("windows") == F.size(F.array_distinct("windows")), F.lit(0)).otherwise(_repeat_exact(F.col("words")))
    chars = lambda lines: F.length(F.regexp_replace(F.array_join(lines, ""), SPACE, ""))
    d = d.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _count(F.col("text"), SYMBOL).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat.cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("good")).cast("long").alias("n_bad_lines"),
        chars(F.col("good")).cast("long").alias("kept_chars"),
        F.array_join("good", "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT) * F.col("n_words"))
    d = d.withColumn("base_failed", failed)
    share = F.when(F.col("word_chars") > 0, F.col("kept_chars") / F.col("word_chars")).otherwise(F.lit(0.0))
    d = d.withColumn("kept_share", share)
    # compared as integers, so that every engine decides alike
    enough = F.col("kept_chars") * 1000 >= F.col("word_chars") * int(min_share * 1000)
    return d.withColumn("kept", ~F.col("base_failed") & enough)
