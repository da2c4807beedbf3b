"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text is the mean of the embeddings of its words' character n-grams; a linear softmax gives the language. As both are
linear, a trained model is one row of language scores per n-gram bucket. Confidence is calibrated with a temperature.

Rejection asks how familiar a text is: the share of its n-grams that the learned rows hold, in whichever language, so that
a text in two of them stays familiar. The least familiarity is calibrated on whole labelled texts that the fit didn't see:
half-way between their own and that of the same words with their letters shuffled, the level of no language at all.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlake.llm.subwords import WordTable, add_rows, chunks, gram_sums, grams

_LETTERS = re.compile(r"[^\W\d_]+")
LOW, HIGH, BUCKETS = 2, 4, 1 << 15
#: Shortest n-grams that count as familiar or not, buckets of the familiar ones, and rows that must hold such a bucket.
FAMILIAR_LOW, FAMILIAR_BUCKETS, FAMILIAR_ROWS = 3, 1 << 20, 2
#: Standard errors by which a text must fall short of the least familiarity to be rejected; they shrink with its words.
SURE = 2.0
UNKNOWN = "und"
#: Labelled rows for each language that a fit learns from, and about as many again calibrate it; all are taken whole.
ROWS_PER_LANGUAGE = 400
#: Words of the runs that a learned text is cut into, in turn.
RUN_WORDS = (40, 8, 40, 2)
CACHE_WORDS, CHUNK_CHARS = 500_000, 2_000_000


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case; none if nothing but number signs such as a superscript stands for letters."""
    words = _LETTERS.findall(text.lower())
    if words and not words[0].isalpha() and not any(c.isalpha() for w in words for c in w):
        return []
    return words


@dataclass
class LanguageModel:
    """languages; language scores of each n-gram bucket; bias; familiar buckets as bits; temperature; least familiarity."""

    languages: list[str]
    scores: np.ndarray
    bias: np.ndarray
    familiar: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def table(self) -> WordTable:
        known = np.unpackbits(self.familiar).astype(np.float32)[:, None]

        def compute(words: list[str]) -> np.ndarray:
            sums, count = gram_sums(words, self.scores, LOW, HIGH)
            held, of = gram_sums(words, known, FAMILIAR_LOW, HIGH)
            return np.c_[sums, count, held, of].astype(np.float32)

        return WordTable(compute, CACHE_WORDS)

    def logits(self, table: WordTable, texts: Iterable[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(raw language scores, share of familiar n-grams, words) of each text, given as words; 0 without words."""
        place, counts = table.places(texts)
        some, out, share = counts > 0, np.zeros((len(counts), len(self.languages))), np.zeros(len(counts))
        if some.any():
            starts = (np.cumsum(counts) - counts)[some]
            sums = np.add.reduceat(table.rows[place].astype(np.float64), starts, axis=0)
            out[some] = sums[:, :-3] / sums[:, -3:-2] + self.bias
            share[some] = sums[:, -2] / sums[:, -1]
        return out, share, counts

    def rejects(self, share: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Whether texts of so many words are surely less familiar than the least; always those without words."""
        error = np.sqrt(self.least * (1 - self.least) / np.maximum(1, counts))
        return (counts == 0) | (share + SURE * error < self.least)

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        return _softmax(logits / self.temperature)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _share(*columns: str) -> F.Column:
    return F.pmod(F.xxhash64(*columns, F.lit("sample")), F.lit(1 << 53)) / float(1 << 53)


def fold(id_col: str) -> F.Column:
    """crc32 of the id as text, modulo 5. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5


def _runs(words: list[str]) -> Iterator[list[str]]:
    """Runs of consecutive words that together are the whole text; some are short."""
    at = turn = 0
    while at < len(words):
        yield words[at : at + RUN_WORDS[turn % len(RUN_WORDS)]]
        at += RUN_WORDS[turn % len(RUN_WORDS)]
        turn += 1


def fit(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE) -> LanguageModel:
    """Fit on a bounded sample of `rows`, chosen by hash of id and text: whole texts, about `rows_per_language` for each label
    to learn from and as many of fold 1 to calibrate.

    Rows that repeat in id, text and label count once. Without a labelled row that has letters the model knows no language.
    """
    rows = rows.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label"))
    rows = rows.withColumn("fold", fold("id").cast("int"))
    counts = {(r["label"], r["held"]): r["count"] for r in rows.groupBy("label", (F.col("fold") == 1).alias("held")).count().collect()}
    rate = F.lit(0.0)
    for (label, held), n in counts.items():
        rate = F.when((F.col("label") == label) & ((F.col("fold") == 1) == held), F.lit(rows_per_language / n)).otherwise(rate)
    sample = rows.where(_share("id", "text") < rate).distinct()
    return train(sorted((words, r["label"], r["fold"]) for r in sample.collect() if (words := words_of(r["text"] or ""))))


def train(texts: list[tuple[list[str], str, int]], width: int = 12, epochs: int = 2, rate: float = 2.0, seed: int = 7) -> LanguageModel:
    """SGD over the runs of texts (words, label, fold); fold 1 is kept for calibration, unless too little would be left to learn from."""
    languages = sorted({label for _, label, _ in texts})
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), np.zeros(FAMILIAR_BUCKETS // 8, np.uint8))
    rng = np.random.default_rng(seed)
    learned = [t for t in texts if t[2] != 1]
    if len({x for _, x, _ in learned}) < len(languages):
        learned = texts
    held = [t for t in texts if t[2] == 1] or texts
    examples = [(run, languages.index(x)) for words, x, _ in learned for run in _runs(words)]
    label = np.array([k for _, k in examples])
    bags = [np.concatenate([b for *_, b in grams(run, LOW, HIGH, BUCKETS)]).astype(np.int32) for run, _ in examples]
    embed, out = rng.normal(0, 0.1, (BUCKETS, width)).astype(np.float32), rng.normal(0, 0.1, (width, len(languages))).astype(np.float32)
    bias, order, batch = np.zeros(len(languages), np.float32), np.arange(len(examples)), 32
    weight = len(order) / (len(languages) * np.maximum(1, np.bincount(label, minlength=len(languages))))
    for epoch in range(epochs):
        rng.shuffle(order)
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            sizes = np.array([len(bags[i]) for i in chosen])
            bag, starts = np.concatenate([bags[i] for i in chosen]), np.cumsum(sizes) - sizes
            mean = np.add.reduceat(embed[bag], starts, axis=0) / sizes[:, None]
            error = _softmax(mean @ out + bias).astype(np.float32)
            error[np.arange(len(chosen)), label[chosen]] -= 1
            error *= (weight[label[chosen]] / len(chosen))[:, None].astype(np.float32)
            step = rate * (1 - (epoch + at / len(order)) / epochs)
            back = (error @ out.T) * (step * len(chosen) / sizes)[:, None]
            out -= step * (mean.T @ error)
            bias -= step * error.sum(axis=0)
            add_rows(embed, bag, -np.repeat(back, sizes, axis=0))
    model = LanguageModel(languages, (embed @ out).astype(np.float32), bias.astype(np.float64), _familiar([words for words, *_ in learned]))
    calibrate(model, held, rng)
    return model


def _familiar(texts: list[list[str]]) -> np.ndarray:
    """Buckets of n-grams that enough of the texts hold, as bits."""
    rows = np.zeros(FAMILIAR_BUCKETS, np.int32)
    for words in texts:
        rows[np.unique(np.concatenate([b for *_, b in grams(words, FAMILIAR_LOW, HIGH, FAMILIAR_BUCKETS)]))] += 1
    return np.packbits(rows >= min(FAMILIAR_ROWS, len(texts)))


def calibrate(model: LanguageModel, held: list[tuple[list[str], str, int]], rng: np.random.Generator) -> None:
    """Temperature by likelihood of the labels, and the least familiarity, both on whole texts."""
    table, texts = model.table(), [words for words, *_ in held]
    label = np.array([model.languages.index(x) for _, x, _ in held])
    logits, share, _ = model.logits(table, texts)
    loss = {t: -np.log(np.maximum(1e-12, _softmax(logits / t)[np.arange(len(held)), label])).mean() for t in np.geomspace(0.1, 4, 38)}
    model.temperature = float(min(loss, key=loss.get))
    shuffled = {w: "".join(rng.permutation(list(w))) for w in sorted({w for words in texts for w in words})}
    _, none, _ = model.logits(model.table(), [[shuffled[w] for w in words] for words in texts])
    model.least = float((np.median(share) + np.median(none)) / 2)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """(id, *extra, lang_pred, score, rejected) of every row, from its whole text alone.

    Null texts and texts without letters are `und` with score 0 and rejected; so is, under its likeliest language, a text
    that is surely less familiar than the calibrated least. A model without languages rejects only texts without
    letters. Repeated rows give repeated results.
    """
    kept = [docs.schema[c] for c in (id_col, *extra)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in batches:
            names, score, rejected = [], [], []
            for _, texts in chunks(batch.column(0).to_pylist(), CHUNK_CHARS):
                logits, share, words = model.logits(table, map(words_of, texts))
                some = words > 0
                if not model.languages:
                    names += [UNKNOWN] * len(texts)
                    score.append(np.zeros(len(texts)))
                    rejected.append(~some)
                    continue
                sure = model.probabilities(logits)
                best = sure.argmax(axis=1)
                top = np.where(some, sure[np.arange(len(texts)), best], 0.0)
                names += [model.languages[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)]
                score.append(top)
                rejected.append(model.rejects(share, words))
            flat = lambda x, kind: pa.array(np.concatenate(x) if x else np.zeros(0, kind))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(names, pa.string()), flat(score, float), flat(rejected, bool)],
                [*batch.schema.names[1:], "lang_pred", "score", "rejected"],
            )

    fields = [T.StructField(f"k{i}", f.dataType) for i, f in enumerate(kept)]
    fields += [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    chosen = docs.select(F.col(text_col).alias("text"), *(F.col(f.name).alias(f"k{i}") for i, f in enumerate(kept)))
    return chosen.mapInArrow(run, T.StructType(fields)).toDF(*(f.name for f in kept), "lang_pred", "score", "rejected")


def keep_known(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all their columns, whose language isn't rejected."""
    held = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    place = f"c{docs.columns.index(text_col)}"
    found = predict(held, model, held.columns[0], place, tuple(held.columns[1:]))
    return found.where("not rejected").drop("lang_pred", "score", "rejected").toDF(*docs.columns)
