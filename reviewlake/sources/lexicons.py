"""Taxonomies and lexicons kept as JSON: name -> language -> words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewlake.functions.vocabulary import Lexicon, Taxonomy
from reviewlake.operators.matching import TermTable

_NESTED = "map<string, map<string, array<string>>>"
MAX_WORDS = 100_000  # longer word lists stay tables and are joined; shorter ones end up in expressions


def read_word_lists(spark: SparkSession, path: str) -> DataFrame:
    """Different (name, word) pairs of a nested JSON file, languages merged and words lower-cased.

    ``position`` keeps the order of the names in the file.
    """
    lists = spark.read.text(path, wholetext=True).select(F.from_json("value", _NESTED).alias("m"))
    names = lists.select(F.posexplode(F.map_entries("m")).alias("position", "entry"))
    words = names.select("position", F.col("entry.key").alias("name"), F.explode(F.map_values("entry.value")).alias("ws"))
    return words.select("position", "name", F.explode("ws").alias("word")).select(
        "position", "name", F.lower("word").alias("word")
    ).distinct()


def _collect(words: DataFrame) -> dict[str, dict[str, list[str]]] | None:
    """The lists by name, or None where they hold more than MAX_WORDS words."""
    rows = words.limit(MAX_WORDS + 1).collect()
    if len(rows) > MAX_WORDS:
        return None
    out: dict[str, dict[str, list[str]]] = {}
    for row in sorted(rows, key=lambda r: (r["position"], r["word"])):
        out.setdefault(row["name"], {"all": []})["all"].append(row["word"])
    return out


def load_taxonomy(spark: SparkSession, path: str) -> Taxonomy | TermTable:
    """Aspect keywords: for expressions while they are few, else a table for joins. Both find the same mentions."""
    words = read_word_lists(spark, path)
    lists = _collect(words)
    return TermTable(words.select("name", "word").distinct()) if lists is None else Taxonomy.of(lists)


def load_lexicon(spark: SparkSession, path: str) -> Lexicon | TermTable:
    """Polarity words, as `load_taxonomy`."""
    words = read_word_lists(spark, path)
    lists = _collect(words)
    return TermTable(words.select("name", "word").distinct()) if lists is None else Lexicon.of(lists)
