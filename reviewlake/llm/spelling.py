"""Spelling variants of a corpus's words: PartEnum signatures, an equi-join of them, verification by edit distance.

A word's letters with their repeats are a binary vector: element (letter, k) is set if the letter occurs at least k times.
One replaced letter changes two elements, one inserted or deleted letter changes one. Elements are partitioned by hash and
signatures enumerated over subsets of the partitions, so that two vectors within the distance share one exactly:
4 partitions, any 2 of them, for two changed elements; 3 partitions, any 2, for one.

Letters of natural words collide, so a signature also holds the words' length and the part of the word that one edit leaves
alone: of any two words one edit apart, either the first halves or the last halves are equal.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.scratch import save

#: Maximal runs of these are words; only A-Z are lower-cased.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5


def vocabulary(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
    slip: int | None = None,
) -> DataFrame:
    """(word, n): words of at least `min_length` code points that occur at least `min_count` times in all texts.

    Null and empty texts have no words; repeated rows count each time. With `slip`, misspellings are planted: a run whose
    crc32 of "<id>:<run>" `slip` divides loses the code point at crc32 % length before it is counted (a null id reads as
    empty). Counts are summed per task before words are shuffled, so a very common word is one row a task.
    """
    lower = F.translate(F.col(text_col), UPPER, LOWER)
    # a shorter run can't give a word, as a slip only shortens it
    runs = F.regexp_extract_all(lower, F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))
    words = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(runs).alias("word"))
    if slip:
        hashed = F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
        at = (F.col("h") % F.length("word")).cast("int")
        shorter = F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2))
        words = words.withColumn("h", hashed).select(F.when(F.col("h") % slip == 0, shorter).otherwise(F.col("word")).alias("word"))
        words = words.where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _digests(word: Column, parts: int) -> list[Column]:
    """One hash per partition of the word's elements (letter, how many of it so far)."""

    def element(place: Column) -> Column:
        so_far, letter = F.substr(word, F.lit(1), place), F.substr(word, place, F.lit(1))
        return F.xxhash64(letter, F.length(so_far) - F.length(F.replace(so_far, letter, F.lit(""))))

    elements = F.transform(F.sequence(F.lit(1), F.length(word)), element)

    def of_part(p: int) -> Column:
        own = F.filter(elements, lambda e: F.pmod(F.shiftright(e, 33), F.lit(parts)) == p)
        return F.aggregate(own, F.lit(0).cast("long"), lambda total, e: total.bitwiseXOR(e))

    return [of_part(p) for p in range(parts)]


def _signatures(kind: str, word: str, length: Column, parts: int, digests: str) -> list[Column]:
    """Signatures of vectors within parts - 2 elements: any two partitions, with `length` and either half of that length."""
    half = F.floor(length / 2).cast("int")
    ends = {"first": F.substr(word, F.lit(1), half), "last": F.substr(word, F.length(word) - half + 1, half)}
    return [
        F.xxhash64(F.lit(f"{kind}{side}{a}{b}"), length, F.get(digests, F.lit(a)), F.get(digests, F.lit(b)), end)
        for side, end in ends.items() for a, b in combinations(range(parts), 2)
    ]


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every ordered pair of words one inserted, deleted or replaced code point apart, once.

    words: (word, n), words distinct, not null, of at least two code points. It is read twice: give a saved table. A
    signature's words are spread by Spark's sort-merge join, whose skewed partitions adaptive execution splits; pairs
    that the edit distance doesn't confirm never leave the join. The join is asked for: Spark sizes a side by the compressed
    file, without the 18 rows that a word explodes into, and would send millions of them through the driver.
    """
    made = words.select("word", "n", F.length("word").alias("len"), F.array(*_digests(F.col("word"), 4)).alias("d4"),
                        F.array(*_digests(F.col("word"), 3)).alias("d3"))
    made = save(made)
    length = F.col("len")
    replaced = _signatures("=", "word", length, 4, "d4")
    longer, shorter = _signatures("+", "word", length - 1, 3, "d3"), _signatures("+", "word", length, 3, "d3")
    left = made.select(F.explode(F.array(*replaced, *longer)).alias("key"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = made.select(F.explode(F.array(*replaced, *shorter)).alias("key"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    once = (F.length("a") > F.length("b")) | ((F.length("a") == F.length("b")) & (F.col("a") < F.col("b")))
    met = left.hint("merge").join(right.withColumnRenamed("key", "key_b"), (F.col("key") == F.col("key_b")) & once & (F.levenshtein("a", "b", 1) == 1))
    pairs = met.select("a", "a_n", "b", "b_n").distinct()
    ways = F.array(*(F.struct(F.col(x).alias("word"), F.col(f"{x}_n").alias("n"), F.col(y).alias("near"), F.col(f"{y}_n").alias("near_n"))
                     for x, y in ("ab", "ba")))
    return pairs.select(F.explode(ways).alias("way")).select("way.*")


def roots(forms: DataFrame, most: int, ratio: int = RATIO, least: int = MIN_COUNT) -> DataFrame:
    """(word, root) of every row of (word, form): the last word reached by following forms.

    A form occurs at least `ratio` times as often, so a chain from `least` to `most` occurrences has a bounded length, and
    doubling the steps reaches its end in a few joins, sorted ones as saved tables are larger than their files. Without a
    ratio above 1 chains could be rings.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    steps = 1 + math.floor(math.log(max(most, least) / least, ratio))
    found = forms.select("word", F.col("form").alias("root"))
    reach = 1
    while reach < steps:
        onward = found.select(F.col("word").alias("at"), F.col("root").alias("next"))
        found = save(found.hint("merge").join(onward, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root")))
        reach *= 2
    return found


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of (word, n), words distinct.

    n_near counts the words one edit apart. Of those, the one of largest n, ties to the smallest in code-point order, is the
    word's form if that n is at least `ratio` times the word's own; else form and form_n are null. root follows forms to
    the last; it is the word itself where there is none. An empty table gives no rows.
    """
    words = save(words.where("word is not null"))
    best = F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("best")
    near = near_words(words).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best).drop("n")
    is_form = -F.col("best.rank") >= ratio * F.col("n")
    found = save(words.join(near, "word", "left").select(
        "word", F.when(is_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, -F.col("best.rank")).alias("form_n"),
    ))
    ends = words.agg(F.max("n"), F.min("n")).first()
    chained = roots(found.where("form is not null").select("word", "form"), ends[0] or 1, ratio, ends[1] or 1)
    return found.hint("merge").join(chained, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
