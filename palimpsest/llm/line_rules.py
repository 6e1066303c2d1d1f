"""Line-first quality rules, in DataFrame functions alone.

Every line is judged on its own by punctuation, navigation and boilerplate rules; failing lines
are removed; a document that loses too much of its text, or that fails the whole-text rules, is
rejected. Counts are over whole texts. Nothing is shuffled: each row is judged by itself.

Whole-text counts: words are `[^\\x20\\x09-\\x0D]+`; n_symbols counts `[#*$%&|<>]`; n_dup_lines
counts lines (split at \\n) that have a word and equal an earlier line; n_repeat_words counts the
words inside 8-word windows that occur twice or more in the text, the first one included (windows
are compared by a 64-bit hash).

Edge cases: a null or empty text has no words, so all counts are 0, base_failed is true and kept
false; its cleaned text is empty. Repeated rows are judged alike. An empty table gives an empty
result. Columns of the same names as the added ones are replaced; others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import SPACE

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A document is rejected when more than so many percent of its word characters were removed.
MAX_REMOVED_PERCENT = 40
#: A line without any sentence mark passes only with so many words.
LONG_LINE_WORDS = 30
#: Phrases of page furniture and licence lines.
BOILERPLATE = (
    "all rights reserved|cookie policy|privacy policy|terms of use|terms of service|terms and conditions"
    "|javascript is disabled|enable javascript|use of cookies|licensed under|is licensed under|copyright \\(c\\)|copyright ©"
    "|subscribe to our|sign up for|click here|lorem ipsum"
)
SENTENCE_MARK = "[.!?…。！？։؟:;](?:[\"'”’»)\\]*#$%&|]*)(?:[\\x20\\x09-\\x0D]|$)"
SYMBOLS = "[^#*$%&|<>]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def let(value: Column, use) -> Column:
    """use(value) with value computed once a row, however often use refers to it."""
    return F.get(F.transform(F.array(value), use), 0)


def repeat_words(words: Column) -> Column:
    """Words covered by a window that occurs more than once. Most texts have none, which the
    count of distinct hashes tells without sorting."""
    n = F.size(words)
    windows = lambda c: F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(c, i + k) for k in range(WINDOW)]))
    hashes = let(F.transform(words, lambda w: F.xxhash64(w)), windows)

    def starts(pairs: Column) -> Column:
        twin = lambda i, step: F.coalesce(F.get(pairs, i + step)["h"] == F.get(pairs, i)["h"], F.lit(False))
        own = F.filter(pairs, lambda _, i: twin(i, -1) | twin(i, 1))
        return F.sort_array(F.transform(own, lambda p: p["i"]))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last"))
        return F.aggregate(let(pairs, starts), zero, step, lambda a: a["n"])

    some = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))
    return F.when(n < WINDOW, F.lit(0)).otherwise(let(hashes, some))


def line_fails(line: Column) -> Column:
    """True where one of the line rules removes the line; lines without words are never removed."""

    def judged(words: Column) -> Column:
        n = F.size(words)
        symbols = F.length(F.regexp_replace(line, SYMBOLS, ""))
        shouts = F.length(line) - F.length(F.replace(line, F.lit("!"), F.lit("")))
        furniture = (n <= LONG_LINE_WORDS) & F.lower(line).rlike(BOILERPLATE)
        navigation = let(symbols, lambda k: (k * 10 >= n * 3) & (k >= 1))
        punctuation = ((n < LONG_LINE_WORDS) & ~line.rlike(SENTENCE_MARK)) | ((n >= 5) & (shouts * 10 >= n * 3))
        stutter = (n >= 10) & (F.size(F.array_distinct(words)) * 10 < n * 3)
        return (n > 0) & (navigation | punctuation | furniture | stutter)

    return let(words_of(line), judged)


def apply_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts, base_failed, cleaned (the text without its failing lines),
    removed_chars and kept."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.split(body, "\n")
    rows = docs.withColumns({"_words": words_of(body), "_lines": lines})
    rows = rows.withColumn("_good", F.filter("_lines", lambda x: ~line_fails(x)))
    solid = F.filter("_lines", lambda x: x.rlike(f"[^{SPACE}]"))
    word_chars = F.length(F.array_join("_words", ""))
    rows = rows.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": word_chars.cast("long"),
            "n_symbols": F.length(F.regexp_replace(body, SYMBOLS, "")).cast("long"),
            "n_dup_lines": let(solid, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": repeat_words(F.col("_words")).cast("long"),
            "cleaned": F.array_join("_good", "\n"),
        }
    )
    left = F.length(F.regexp_replace("cleaned", f"[{SPACE}]+", ""))
    rows = rows.withColumns(
        {
            "base_failed": (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT),
            "removed_chars": F.col("word_chars") - left,
        }
    )
    few = F.col("removed_chars") * 100 <= F.col("word_chars") * MAX_REMOVED_PERCENT
    return rows.withColumn("kept", ~F.col("base_failed") & few).drop("_words", "_lines", "_good")
