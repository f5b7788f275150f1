"""Spelling variants: words one edit apart, joined by asymmetric chunks and grams.

A word of length L has two disjoint chunks, its halves. One replaced or inserted
code point leaves one of them whole: the first where it was, the second where it was or, behind
an insertion, shifted by one. The shorter word of a pair (either of two equally long ones) gives its chunks,
the other one the grams that a chunk can become within that shift: those of its own length
and those of one less. Other grams meet no chunk and are not sent.

Halves of short or regular words are frequent. Of the broken half one half is whole as well, for the
same reason, so a chunk travels together with it: a signature is the word without one of its
four quarters, and the words under one signature differ in that quarter alone. Each is verified by
its edit distance. A pair found under neighbouring quarters, as when a letter of a
run is doubled, counts under the first.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattspan.durable import durable

QUARTERS = 4
#: Latin letters beyond ASCII (with the two signs between them)
LATIN = "\u00c0-\u00ff"


def _bounds(length: Column, quarter: int) -> tuple[Column, Column]:
    """Where a quarter of a word of this length begins and ends."""
    half = F.floor(length / 2)
    cuts = [F.lit(0).cast("long"), F.floor(half / 2), half, half + F.floor((length - half) / 2), length.cast("long")]
    return cuts[quarter], cuts[quarter + 1]


def _without(word: Column, begin: Column, end: Column) -> Column:
    return F.concat(F.substring(word, F.lit(1), begin.cast("int")), F.substring(word, (end + 1).cast("int"), F.char_length(word)))


def _signatures(word: Column, longer: bool) -> Column:
    """One signature per quarter: of the chunks of ``word``, or of what the chunks of a word
    shorter by one can become in it."""
    length = F.char_length(word) - (1 if longer else 0)
    found = []
    for quarter in range(QUARTERS):
        begin, end = _bounds(length, quarter)
        rest = _without(word, begin, end + (1 if longer else 0))
        name = F.xxhash64(length, F.lit(quarter), rest)
        found.append(F.struct(name.alias("key"), F.lit(quarter).alias("quarter"), F.lit(longer).alias("longer")))
    return F.array(*found)


def _met_before(word: Column, near: Column) -> Column:
    """Whether ``near``, longer by one, meets ``word`` without the quarter before this one as well."""
    found = F.lit(False)
    for quarter in range(1, QUARTERS):
        begin, end = _bounds(F.char_length(word), quarter - 1)
        same = _without(word, begin, end) == _without(near, begin, end + 1)
        found = F.when(F.col("quarter") == quarter, same).otherwise(found)
    return found


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all ordered pairs of ``words`` (word, n; words distinct) that
    differ by exactly one inserted, deleted or replaced code point."""
    both = F.concat(_signatures(F.col("word"), False), _signatures(F.col("word"), True))
    signed = words.select("word", "n", F.inline(both))
    chunks = signed.where(~F.col("longer")).select("key", "quarter", "word", "n")
    grams = signed.select("key", "longer", F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = chunks.join(grams, "key").where(F.col("word") != F.col("near"))
    pairs = pairs.where(F.levenshtein("word", "near", 1) == 1)
    pairs = pairs.where(~(F.col("longer") & _met_before(F.col("word"), F.col("near"))))
    forward = F.struct("word", "n", "near", "near_n")
    back = F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return pairs.select(F.inline(F.when(F.col("longer"), F.array(forward, back)).otherwise(F.array(forward))))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word of ``forms`` (word, form), by doubling the steps of all pointers
    until each has met a word without a form. Counts at least double from a word to its
    form, so there is no circle and a chain of words is short. Pointers that have ended take no part
    in later rounds, so a root that many words lead to is joined with few rows."""
    steps = forms.select("word", F.col("form").alias("to"), F.lit(False).alias("ended"))
    while True:
        steps = durable(steps, "steps")
        if steps.where(~F.col("ended")).isEmpty():
            return steps.select("word", F.col("to").alias("root"))
        ahead = steps.select(F.col("word").alias("to"), F.col("to").alias("next"), F.col("ended").alias("next_ended"))
        moved = steps.where(~F.col("ended")).drop("ended").join(ahead, "to", "left")
        moved = moved.select("word", F.coalesce("next", "to").alias("to"), F.coalesce("next_ended", F.lit(True)).alias("ended"))
        steps = steps.where("ended").union(moved)


def group_variants(words: DataFrame) -> DataFrame:
    """Spelling variants of ``words`` (word string, n long; other columns are ignored).

    Returns per word: word, n, n_near (how many words are near), form (the near word of largest n, the
    smallest of those in code-point order; null unless that n is at least twice the word's), form_n,
    root (the last word that forms lead to; the word itself if it has none). Null words and words whose
    n is null have no row; rows of one word count as one with the sum of their n; an empty table gives an empty one.
    """
    words = words.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").cast("long").alias("n")).where("n IS NOT NULL")
    words = durable(words, "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    enough = -F.col("best.less") >= 2 * F.col("n")
    found = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"),
        F.when(enough, -F.col("best.less")).alias("form_n"),
    )
    found = durable(found, "variants")
    root = roots(found.where("form IS NOT NULL"))
    return found.join(root, "word", "left").withColumn("root", F.coalesce("root", "word"))


def runs(text: Column) -> Column:
    """The maximal runs of Latin letters of a text, A-Z lower-cased; null has none."""
    folded = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(folded, F.lit(f"[a-z{LATIN}]+"), F.lit(0))


def word_counts(words: DataFrame, shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n) of the words of ``words`` (word, one row per occurrence) with at least ``shortest``
    code points and ``least`` occurrences. Nulls do not count."""
    counted = words.where(F.char_length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least)
