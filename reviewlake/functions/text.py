"""Text cleaning, counting and tokenizing as native column expressions; ``cleaned_stats`` counts in batches.

Whitespace means what a Python string takes for whitespace: Unicode white space and the four separators U+001C-U+001F.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from reviewlake.functions import scans
from reviewlake.functions.vocabulary import CONTRACTIONS

# The characters a Python string treats as whitespace.
WS_CHARS = (
    "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a class body for patterns with the (?U) flag. Single characters, not ranges: they share one bit set.
WS = r"\s\x1c\x1d\x1e\x1f"

URL = rf"(?U)http[^{WS}]+|www[^{WS}]+"
# A whole token with an "@" inside. The possessive form accepts exactly what "\S+@\S+" accepts but never
# backtracks, so one long unbroken token costs linear time.
EMAIL = rf"(?U)(?<![^{WS}])[^{WS}][^{WS}@]*+@[^{WS}]++"
MENTION = r"@[\p{L}\p{N}_]+"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
# Letters each language cleaner keeps.
SPANISH_LETTERS = "a-záéíóúüñ"
PORTUGUESE_LETTERS = "a-záàâãéêíóôõúç"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, also where nothing is shared between two uses."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(value: Column) -> Column:
    """The same value, which the optimizer does not write out again at every use. Structs need it."""
    return let(value, lambda v: v)


def strip(c: Column) -> Column:
    """Trim Unicode whitespace from both ends. Only a text with some there is trimmed, which looks at every character."""
    blanks = F.array(*[F.lit(w) for w in WS_CHARS])

    def trimmed(t: Column) -> Column:
        loose = F.exists(blanks, lambda w: t.startswith(w) | t.endswith(w))
        return F.when(loose, F.btrim(t, F.lit(WS_CHARS))).otherwise(t)

    return let(c, trimmed)


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)[{WS}]+", " ")


def text_length(c: Column) -> Column:
    """Length in code points; null stays null."""
    return F.char_length(c)


def space_word_count(c: Column) -> Column:
    """Pieces between single blanks: double blanks count, as in the silver tables."""
    return F.when(c.isNotNull(), F.size(F.split(c, " ")))


def word_count(c: Column) -> Column:
    """Whitespace-separated words; 0 for null or blank text."""
    stripped = strip(c)
    return F.when(F.coalesce(stripped, F.lit("")) == "", 0).otherwise(F.size(F.split(stripped, rf"(?U)[{WS}]+")))


def clean_text(c: Column) -> Column:
    """Strip, collapse whitespace, drop control characters; null becomes empty."""
    return F.coalesce(F.regexp_replace(collapse(strip(c)), CONTROL, ""), F.lit(""))


def _without_urls(c: Column) -> Column:
    """Lower-case text without URLs. Only texts that hold the beginning of one are given to the pattern."""
    return let(F.lower(c), lambda t: F.when(t.contains("http") | t.contains("www"), F.regexp_replace(t, URL, "")).otherwise(t))


def without_links(c: Column) -> Column:
    """Lower-case text without URLs and e-mail addresses.

    Every step uses its input once: inside higher-order functions nothing is shared between two uses. The test for "@"
    looks at the raw text, which spares most texts a regex pass.
    """
    plain = _without_urls(c)
    return F.when(c.contains("@"), F.regexp_replace(plain, EMAIL, "")).otherwise(plain)


def clean_basic(c: Column) -> Column:
    plain = _without_urls(c)
    base = F.when(
        c.contains("@"), F.regexp_replace(F.regexp_replace(plain, EMAIL, ""), MENTION, "")
    ).otherwise(plain)
    return F.coalesce(strip(collapse(base)), F.lit(""))


def clean_nlp(c: Column) -> Column:
    """Basic cleaning, then letters, digits and apostrophes only, with English contractions expanded."""
    out = F.regexp_replace(clean_basic(c), rf"(?U)[^a-zA-Z0-9'{WS}]", "")
    expanded = out
    for short, full in CONTRACTIONS:
        expanded = F.replace(expanded, F.lit(short), F.lit(full))
    return strip(F.when(c.contains("'"), expanded).otherwise(out))


def _clean_letters(c: Column, letters: str) -> Column:
    kept = F.regexp_replace(without_links(c), rf"(?U)[^{letters}{WS}]", "")
    return F.coalesce(strip(collapse(kept)), F.lit(""))


def clean_spanish(c: Column) -> Column:
    return _clean_letters(c, SPANISH_LETTERS)


def clean_portuguese(c: Column) -> Column:
    return _clean_letters(c, PORTUGUESE_LETTERS)


def ml_words(c: Column, fold_accents: bool = False) -> Column:
    """Words of the model input: lower case, no URLs, e-mails, bare numbers or symbols; Latin letters kept.

    One pattern parts the words; blanking the rest first would build every text anew, to split it again.

    A bare number has no word character on either side, so deleting it and blanking it give the same result once
    blanks are collapsed. The one exception is a neighbour that is kept as a letter although it is a symbol
    (U+00D7, U+00F7); only such texts take the extra pass. ``fold_accents`` maps accented letters to plain ones,
    so that they can meet keyword lists written without accents.
    """
    base = without_links(c)
    symbols = c.contains("\u00d7") | c.contains("\u00f7")
    base = F.when(symbols, F.regexp_replace(base, r"(?U)\b\d+\b", "")).otherwise(base)
    if fold_accents:
        base = F.translate(base, "áàâãäéèêëíìîïóòôõöúùûüñç", "aaaaaeeeeiiiiooooouuuunc")
    return F.array_remove(F.split(F.coalesce(base, F.lit("")), r"[^a-z\u00C0-\u017F]+"), "")


def clean_ml(c: Column, fold_accents: bool = False) -> Column:
    """Model input: the words of ``ml_words`` with single blanks; null becomes empty."""
    return F.array_join(ml_words(c, fold_accents), " ")


def clean_ml_batched(c: Column, fold_accents: bool = False) -> Column:
    """The same as ``clean_ml``, in batches of texts; only texts with something to cut out go through the patterns."""

    holds = [c.contains(x) for x in scans.PATTERNED] + [F.lower(c).contains(u) for u in scans.URL_BEGINNINGS]
    return scans.joined_words(F.when(reduce(or_, holds), clean_ml(c, fold_accents)).otherwise(c), fold_accents)


def tokens(clean: Column) -> Column:
    """Words of a text already cleaned to single blanks; the empty text has none."""
    return F.array_remove(F.split(clean, " "), "")


def bigrams(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))


def preview(c: Column, size: int) -> Column:
    """First ``size`` characters, with an ellipsis when something was cut."""
    return F.when(F.char_length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(c)


def cleaned_stats(c: Column) -> dict[str, Column]:
    """Length and words of the text that ``clean_text`` makes, counted without making it."""
    counts = scans.cleaned_counts(c)
    return {name: counts[name] for name in ("text_length", "word_count")}


def text_features(c: Column) -> dict[str, Column]:
    """Seven surface features; all are 0 for null or empty text.

    With its white space collapsed, a text has one blank between two words: words and characters other than white space
    follow from counting those, without parting the words.
    """
    text = F.coalesce(c, F.lit(""))
    chars = F.char_length(text)
    bare = lambda t: F.octet_length(F.replace(t, F.lit(" "), F.lit("")))
    counted = let(collapse(strip(text)), lambda t: F.when(t != "", F.struct(
        (F.octet_length(t) - bare(t) + 1).alias("words"), (F.char_length(t) - F.octet_length(t) + bare(t)).alias("solid")
    )))
    words, solid = (F.coalesce(counted[n], F.lit(0)) for n in ("words", "solid"))
    upper = F.regexp_count(text, F.lit(r"\p{IsUppercase}"))
    return {
        "char_count": chars,
        "word_count": words,
        "sentence_count": F.regexp_count(text, F.lit(rf"(?U)[^.!?{WS}][^.!?]*+")),
        "avg_word_length": F.round(solid / F.greatest(words, F.lit(1)) * 100) / 100,
        "exclamation_count": chars - F.char_length(F.replace(text, F.lit("!"), F.lit(""))),
        "question_count": chars - F.char_length(F.replace(text, F.lit("?"), F.lit(""))),
        "uppercase_ratio": F.round(upper / F.greatest(chars, F.lit(1)) * 10000) / 10000,
    }
