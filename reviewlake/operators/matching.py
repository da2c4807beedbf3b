"""Words and phrases of lists of any size, found in texts by a join, and the sentiment around them.

Small lists live in expressions (`functions.aspects`). A list of millions of entries is a table instead: its words and
phrases are keyed by a hash, and so are a text's words and the places where phrases can stand. A phrase stands in a text
where it stands over the blank after some word: that word ends like the phrase's first word, and what follows begins like
the rest of the phrase. Key of such a place: the last and next few letters. A bitmap of fixed size rules out almost all
keys before any row moves; Spark then broadcasts the list or shuffles both sides, as the list's size asks for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from reviewlake.functions import aspects as A, sentiment as S, text as txt
from reviewlake.functions.vocabulary import Lexicon, Taxonomy

EDGE = 4  # letters on each side of a blank that key a phrase
BITMAP_WORDS = 1 << 17  # 64-bit words of the bitmap: 1 MB whatever the list's size
_WORD = -1  # shape of a single word


@dataclass(frozen=True)
class TermTable:
    """A word list as a table (name, word) with different rows; `word` may hold blanks."""

    terms: DataFrame

    @staticmethod
    def of(spark: SparkSession, lists: Taxonomy | Lexicon) -> "TermTable":
        if isinstance(lists, Taxonomy):
            rows = [(name, word) for name in lists.aspects for word in sorted(lists.keywords[name])]
        else:
            sides = {S.POSITIVE: lists.positive, S.NEGATIVE: lists.negative}
            rows = [(name, word) for name, words in sides.items() for word in sorted(words)]
        return TermTable(spark.createDataFrame(rows, "name string, word string"))


def _key(left: Column, right: Column, ends: Column, begins: Column) -> Column:
    """Hash of a word (`ends` is _WORD), or of `ends` letters before and `begins` letters after a blank."""
    place = F.xxhash64(ends, begins, F.right(left, ends), F.left(right, begins))
    return F.when(ends == _WORD, F.xxhash64(left)).otherwise(place)


def _gate(left: Column, ends: Column) -> Column:
    """Hash of a word, or of its last `ends` letters: what a word shows of a key before its neighbours are looked at."""
    return F.when(ends == _WORD, F.xxhash64(left)).otherwise(F.xxhash64(ends, F.right(left, ends)))


def _index(terms: DataFrame) -> DataFrame:
    """Terms with their key: (ends, begins) letters on both sides of the first blank, `left` and `right` of it."""
    blank = F.instr("word", " ")
    split = terms.where("word != ''").withColumns({
        "left": F.when(blank == 0, F.col("word")).otherwise(F.left("word", blank - 1)),
        "right": F.when(blank > 0, F.substr("word", blank + 1)),
    })
    shaped = split.withColumns({
        "ends": F.when(blank == 0, _WORD).otherwise(F.least(F.length("left"), F.lit(EDGE))),
        "begins": F.when(blank == 0, _WORD).otherwise(F.least(F.length("right"), F.lit(EDGE))),
    })
    return shaped.withColumn("key", _key(F.col("left"), F.col("right"), F.col("ends"), F.col("begins")))


def _bit(key: Column) -> tuple[Column, Column]:
    """Word of the bitmap and place in it."""
    return F.shiftright(key, 6).bitwiseAND(F.lit(BITMAP_WORDS - 1)).cast("int"), key.bitwiseAND(F.lit(63)).cast("int")


def _bitmap(index: DataFrame) -> Column:
    """The keys as one array of BITMAP_WORDS numbers, a scalar."""
    word, place = _bit(F.col("key"))
    # the place of a phrase is looked up twice: by the word before its blank, then by its whole key
    keys = index.select("key").unionByName(index.where(F.col("ends") != _WORD).select(_gate(F.col("left"), F.col("ends")).alias("key")))
    set_words = keys.select(word.alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), place).alias("bits"))
    set_words = set_words.groupBy("at").agg(F.bit_or("bits").alias("bits"))
    every = index.sparkSession.range(BITMAP_WORDS).select(F.col("id").cast("int").alias("at"), F.lit(0).cast("long").alias("bits"))
    whole = set_words.unionByName(every).groupBy("at").agg(F.bit_or("bits").alias("bits"))
    return whole.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "bits"))), lambda w: w["bits"])).scalar()


def find_terms(texts: DataFrame, key: str, clean: Column, terms: DataFrame) -> DataFrame:
    """Occurrences of terms in cleaned texts: (key, at, then the columns of `terms` but for `word`).

    `clean` has single blanks. A word without blanks is found where it is a whole word, `at` being the word's place; a
    phrase is found wherever the text contains it, with a null `at`, at least once. Texts never move but for the few words
    around a place whose key is in the list. Terms are matched as they are; rows of `terms` that repeat give repeated rows.
    """
    index = _index(terms)
    shapes = index.groupBy("ends", "begins").agg(F.max(F.size(F.split("right", " "))).alias("words")).collect()  # few
    if not shapes:
        shapes, reach = [{"ends": _WORD, "begins": _WORD}], 0
    else:
        reach = max((max(s["words"], EDGE) for s in shapes if s["ends"] != _WORD), default=0)
    words = txt.tokens(clean)

    bits = _bitmap(index)

    def held(hashed: Column) -> Column:
        at_word, bit = _bit(hashed)
        return F.call_function("shiftright", F.call_function("get", bits, at_word), bit).bitwiseAND(F.lit(1).cast("long")) == 1

    # Plain rows rule words out in compiled code before anything is made of them; what follows a word, and its shapes, are
    # made for the few that are left. The outer form keeps Spark from cleaning texts twice, to filter on their words first.
    may = F.lit(False)
    for ends in sorted({s["ends"] for s in shapes}):
        may = may | held(_gate(F.col("word"), F.lit(ends)))
    each = texts.select(F.col(key), words.alias("_words")).select(key, "_words", F.posexplode_outer("_words").alias("at", "word")).where(F.col("word").isNotNull() & may)
    after = F.when(F.col("at") + 1 < F.size("_words"), F.concat_ws(" ", F.slice("_words", F.col("at") + 2, reach))) if reach else F.lit(None).cast("string")
    shape = F.array(*(F.struct(F.lit(s["ends"]).alias("ends"), F.lit(s["begins"]).alias("begins")) for s in shapes))
    keyed = each.select(key, "at", "word", after.alias("after")).select("*", F.inline(shape))
    keyed = keyed.where((F.length("word") >= F.col("ends")) & (F.length("after") >= F.col("begins")) | (F.col("ends") == _WORD))
    keyed = keyed.withColumn("_key", _key(F.col("word"), F.col("after"), F.col("ends"), F.col("begins")))
    keyed = keyed.where(held(F.col("_key"))).withColumnRenamed("ends", "_ends").drop("begins")
    same = F.when(F.col("ends") == _WORD, F.col("_word") == F.col("left")).otherwise(
        F.endswith("_word", "left") & F.startswith("after", "right")
    )
    carried = [c for c in terms.columns if c != "word"]
    met = keyed.withColumnRenamed("word", "_word").join(
        index.select("key", "ends", "left", "right", *carried).withColumnRenamed("key", "_term_key"),
        (F.col("_key") == F.col("_term_key")) & (F.col("_ends") == F.col("ends")) & same,
    )
    return met.select(key, F.when(F.col("ends") == _WORD, F.col("at")).alias("at"), *carried)


def mentions(
    df: DataFrame, key: str, taxonomy: TermTable, lexicon: TermTable, text: str = "text", fold_accents: bool = False
) -> DataFrame:
    """(key, aspect, sentiment): one row per review and mentioned aspect, as `aspects.mentions` finds them.

    Keys are different. The words that carry polarity and the aspects' words come from one scan and one shuffle on the key;
    a range frame over word places sums the polarity within the window of each aspect word, so no pairs are formed. A word on
    both sides of the lexicon is positive.
    """
    sides = lexicon.terms.where(~F.contains("word", F.lit(" "))).groupBy("word").agg(
        F.max(F.when(F.col("name") == S.POSITIVE, 1).when(F.col("name") == S.NEGATIVE, -1)).alias("sign")
    ).where("sign is not null")
    listed = taxonomy.terms.select("word", F.col("name").alias("aspect"), F.lit(None).cast("int").alias("sign")).distinct()
    terms = listed.unionByName(sides.select("word", F.lit(None).cast("string").alias("aspect"), "sign"))
    found = find_terms(df, key, txt.clean_ml(F.col(text), fold_accents), terms)
    near = Window.partitionBy(key).orderBy("at").rangeBetween(-A.WINDOW, A.WINDOW)
    around = found.withColumn("around", F.when(F.col("at").isNotNull(), F.sum("sign").over(near)))
    balances = around.where("aspect is not null").groupBy(key, "aspect").agg(F.coalesce(F.sum("around"), F.lit(0)).alias("balance"))
    balance = F.col("balance")
    label = F.when(balance > 0, S.POSITIVE).when(balance < 0, S.NEGATIVE).otherwise(S.NEUTRAL)
    return balances.select(key, "aspect", label.alias("sentiment"))
