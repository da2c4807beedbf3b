"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs, in numpy.

A word's input is an embedding of its own, if the training sample has it often enough, next to the mean embedding of its
hashed character n-grams. Two gated recurrent units read a window of words forwards and backwards, attention weighs their
states, and a linear unit gives the window's score. A text's raw score is that of its highest window; a logistic curve,
fitted on rows that the network didn't see, turns it into a probability.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlake.llm.language import _share, fold, words_of
from reviewlake.llm.subwords import WordTable, add_rows, chunks, gram_sums, grams

LOW, HIGH, BUCKETS = 3, 5, 1 << 15
#: Words of a window, and from one window's start to the next: a passage of up to 21 words lies whole in some window.
WINDOW, STRIDE = 40, 20
HIDDEN, WORD_WIDTH, GRAM_WIDTH = 8, 6, 10
#: Labelled rows of either class that a fit sees, about; all their windows are taken.
ROWS_PER_CLASS = 1500
#: Rows of the sample that must have a word before it gets an embedding of its own.
LEAST_ROWS = 20
#: Steps that a fit on few rows takes at least.
LEAST_STEPS = 240
BATCH, CACHE_WORDS, CHUNK_CHARS = 4096, 200_000, 1_500_000
#: Raw score of a text without words.
WORDLESS = -12.0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start among all words, words) of the overlapping windows that cover texts of so many words each."""
    number = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE)), 0)
    text = np.repeat(np.arange(len(counts)), number)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    start = nth * STRIDE
    return text, start + (np.cumsum(counts) - counts)[text], np.minimum(WINDOW, counts[text] - start)


class Network:
    """Parameters and passes of the network. Arrays run (step, direction, window, unit)."""

    def __init__(self, vocabulary: list[str], seed: int = 11) -> None:
        rng, h, d = np.random.default_rng(seed), HIDDEN, WORD_WIDTH + GRAM_WIDTH
        small = lambda *shape: rng.normal(0, shape[-2] ** -0.5, shape).astype(np.float32)
        self.known = {w: k + 1 for k, w in enumerate(vocabulary)}
        self.p = {
            "word": np.zeros((len(vocabulary) + 1, WORD_WIDTH), np.float32), "gram": np.zeros((BUCKETS, GRAM_WIDTH), np.float32),
            "inp": small(d, 2 * 3 * h), "bias": np.zeros(2 * 3 * h, np.float32), "rec": small(2, h, 3 * h),
            "att": rng.normal(0, 0.3, 2 * h).astype(np.float32), "top": rng.normal(0, 0.5, 2 * h).astype(np.float32), "off": np.zeros(1, np.float32),
        }

    def inputs(self, words: list[str]) -> np.ndarray:
        sums, count = gram_sums(words, self.p["gram"], LOW, HIGH)
        own = self.p["word"][[self.known.get(w, 0) for w in words]]
        return np.c_[own, sums / np.maximum(1, count)[:, None]].astype(np.float32)

    def projected(self, words: list[str]) -> np.ndarray:
        """What the gates of both directions get from each word."""
        return self.inputs(words) @ self.p["inp"] + self.p["bias"]

    def forward(self, gates: np.ndarray, place: np.ndarray, live: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """Scores of windows; gates: rows by word, place: (step, window) rows in it, live: (step, window) 1 or 0."""
        p, h, (steps, n) = self.p, HIDDEN, place.shape
        halves = gates.reshape(len(gates), 2, 3 * h)
        state, kept = np.zeros((2, n, h), np.float32), []
        states = np.empty((steps, 2, n, h), np.float32)
        for t in range(steps):
            back = steps - 1 - t
            x = np.stack([halves[place[t], 0], halves[place[back], 1]])
            mask = np.stack([live[t], live[back]])[:, :, None]
            a = state @ p["rec"]
            zr = _sigmoid(x[..., : 2 * h] + a[..., : 2 * h])
            z, r = zr[..., :h], zr[..., h:]
            new = np.tanh(x[..., 2 * h :] + r * a[..., 2 * h :])
            if keep:
                kept.append((state, z, r, new, a[..., 2 * h :], mask))
            state = (new + z * (state - new)) * mask
            states[t, 0], states[back, 1] = state
        e = (states[:, 0] @ p["att"][:h] + states[:, 1] @ p["att"][h:]) + (live - 1) * 1e9
        e = np.exp(e - e.max(axis=0))
        alpha = e / e.sum(axis=0)
        value = states[:, 0] @ p["top"][:h] + states[:, 1] @ p["top"][h:]
        return (alpha * value).sum(axis=0) + p["off"][0], {"kept": kept, "states": states, "alpha": alpha, "value": value} if keep else {}

    def gradients(self, words: list[str], place: np.ndarray, live: np.ndarray, error: "callable") -> dict[str, np.ndarray]:
        """Gradients for windows over distinct `words`; error gives the loss's slope by a window's score."""
        p, h, (steps, n) = self.p, HIDDEN, place.shape
        x = self.inputs(words)
        score, c = self.forward(x @ p["inp"] + p["bias"], place, live, keep=True)
        slope = error(score).astype(np.float32)
        states, alpha = c["states"], c["alpha"]
        pooled = np.einsum("tn,tdnh->ndh", alpha, states).reshape(n, 2 * h)
        g = {"off": slope.sum(keepdims=True), "top": pooled.T @ slope}
        de = alpha * (c["value"] - (alpha * c["value"]).sum(axis=0)) * slope
        g["att"] = np.einsum("tn,tdnh->dh", de, states).reshape(2 * h)
        top, att = p["top"].reshape(2, 1, h), p["att"].reshape(2, 1, h)
        slopes = np.empty((steps, 2, n, 3 * h), np.float32)
        carry, g["rec"] = np.zeros((2, n, h), np.float32), np.zeros_like(p["rec"])
        for t in reversed(range(steps)):
            back = steps - 1 - t
            before, z, r, new, inner, mask = c["kept"][t]
            both = lambda v: np.stack([v[t], v[back]])[:, :, None]  # noqa: B023, E731
            d = (carry + both(alpha * slope) * top + both(de) * att) * mask
            dnew = d * (1 - z) * (1 - new * new)
            dz = d * (before - new) * z * (1 - z)
            dr = dnew * inner * r * (1 - r)
            da = np.concatenate([dz, dr, dnew * r], axis=2)
            g["rec"] += before.transpose(0, 2, 1) @ da
            carry = d * z + da @ p["rec"].transpose(0, 2, 1)
            dx = np.concatenate([dz, dr, dnew], axis=2)
            slopes[t, 0], slopes[back, 1] = dx
        flat = np.zeros((len(words), 6 * h), np.float32)
        add_rows(flat, place.ravel(), slopes.transpose(0, 2, 1, 3).reshape(steps * n, 6 * h))
        g["bias"], g["inp"] = flat.sum(axis=0), x.T @ flat
        dx = flat @ p["inp"].T
        g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
        np.add.at(g["word"], [self.known.get(w, 0) for w in words], dx[:, :WORD_WIDTH])
        g["word"][0] = 0  # unknown words have only their characters
        found = grams(words, LOW, HIGH, BUCKETS)
        count = np.zeros(len(words), np.int64)
        for having, starts, bucket in found:
            count[having] += np.diff(np.r_[starts, len(bucket)])
        share = dx[:, WORD_WIDTH:] / np.maximum(1, count)[:, None]
        for having, starts, bucket in found:
            add_rows(g["gram"], bucket, np.repeat(share[having], np.diff(np.r_[starts, len(bucket)]), axis=0))
        return g


@dataclass
class ToxicityModel:
    """The network, and slope and offset of the logistic curve over a text's highest window."""

    network: Network
    slope: float = 1.0
    offset: float = 0.0

    def table(self) -> WordTable:
        return WordTable(self.network.projected, CACHE_WORDS)

    def raw(self, table: WordTable, texts: list[str]) -> np.ndarray:
        """Highest window score of each whole text."""
        place, counts = table.places(map(words_of, texts))
        out = np.full(len(texts), WORDLESS)
        text, start, size = windows(counts)
        step = np.arange(WINDOW)[:, None]
        for at in range(0, len(text), BATCH):
            own = slice(at, at + BATCH)
            live = (step < size[own]).astype(np.float32)
            where = place[np.minimum(start[own] + step, len(place) - 1)]
            score, _ = self.network.forward(table.rows, where, live)
            np.maximum.at(out, text[own], score)
        return out

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return _sigmoid(np.clip(self.slope * raw + self.offset, -40, 40))


def _cut(texts: list[str]) -> Iterator[tuple[int, str]]:
    """(row, words) of all windows of each whole text."""
    for k, text in enumerate(texts):
        words = words_of(text or "")
        for start, size in zip(*windows(np.array([len(words)]))[1:], strict=True):
            yield k, " ".join(words[start : start + size])


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows_per_class: int) -> DataFrame:
    """(text, label, fold) of about `rows_per_class` labelled rows of either class, chosen by hash of the id.

    The chosen ids are broadcast: there are twice `rows_per_class`, whatever the size of the tables. Of several labels of
    an id the highest holds, of several texts the one of the least hash.
    """
    one = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    one = one.agg((F.max(label_col) > 0).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in one.groupBy("label").count().collect()}
    rate = F.lit(0.0)
    for label, n in counts.items():
        rate = F.when(F.col("label") == label, F.lit(rows_per_class / n)).otherwise(rate)
    chosen = one.where(_share("id") < rate)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("text"), F.col("text"))).alias("least"))
    return found.select("least.text", "label", fold("id").cast("int").alias("fold"))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    rows_per_class: int = ROWS_PER_CLASS,
) -> ToxicityModel:
    """Fit on a bounded sample of labelled rows; rows of fold 1 calibrate, the others train."""
    rows = sample(docs, labels, id_col, text_col, label_col, rows_per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_cut(batch.column(0).to_pylist()))
            at = pa.array([k for k, _ in found], pa.int64())
            columns = [pa.array([w for _, w in found], pa.string()), batch.column(1).take(at), batch.column(2).take(at)]
            yield pa.RecordBatch.from_arrays(columns, ["words", "label", "row"])

    learn = rows.where("fold != 1").select("text", "label", F.xxhash64("text").alias("row"))
    found = sorted(tuple(r) for r in learn.mapInArrow(run, "words string, label int, row long").collect())
    number = {row: k for k, row in enumerate(sorted({row for *_, row in found}))}
    model = ToxicityModel(train([(w.split(" "), y, number[row]) for w, y, row in found]))
    held = raw_scores(rows.where("fold = 1").select("text", "label"), model, "label", "text").collect()
    calibrate(model, np.array([r["raw"] for r in held]), np.array([r["label"] for r in held]))
    return model


def train(
    examples: list[tuple[list[str], int, int]], epochs: int = 3, rate: float = 0.01, decay: float = 1e-4, batch: int = 256, seed: int = 5
) -> Network:
    """Adam over windows (words, label of their text, number of their text).

    A toxic text marks all its windows, though few of them are toxic. The first epoch takes the marks as they are; then
    only those windows of a toxic text stay that the network holds for about as toxic as its highest one.
    """
    rows = Counter(w for own, *_ in examples for w in set(own))
    network = Network(sorted(w for w, n in rows.items() if n >= LEAST_ROWS))
    rng, order, step = np.random.default_rng(seed), np.arange(len(examples)), 0
    mean, square = ({k: np.zeros_like(v) for k, v in network.p.items()} for _ in range(2))
    if examples:
        epochs = max(epochs, LEAST_STEPS // -(-len(order) // batch))
    total = max(1, epochs * -(-len(order) // batch))
    for epoch in range(epochs):
        if epoch:
            order = _refined(network, examples)
        rng.shuffle(order)
        for at in range(0, len(order), batch):
            chosen = [examples[i] for i in order[at : at + batch]]
            words, place, live = _windowed([own for own, *_ in chosen])
            label = np.array([y for _, y, _ in chosen])
            grad = network.gradients(words, place, live, lambda score, y=label: (_sigmoid(score) - y) / len(y))
            step += 1
            for k, g in grad.items():
                if k in ("word", "gram"):
                    g += decay * network.p[k]
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.001 * (g * g - square[k])
                scale = rate * (1 - 0.9 * step / total) / (1 - 0.9**step)
                network.p[k] -= scale * mean[k] / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-6)
    return network


def _windowed(windows_of_words: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, their places by step and window, which are live)."""
    words = sorted({w for own in windows_of_words for w in own})
    number = {w: k for k, w in enumerate(words)}
    shape = (WINDOW, len(windows_of_words))
    place, live = np.zeros(shape, np.int64), np.zeros(shape, np.float32)
    for k, own in enumerate(windows_of_words):
        place[: len(own), k] = [number[w] for w in own]
        live[: len(own), k] = 1
    return words, place, live


def _refined(network: Network, examples: list[tuple[list[str], int, int]]) -> np.ndarray:
    score = np.empty(len(examples))
    for at in range(0, len(examples), BATCH):
        words, place, live = _windowed([own for own, *_ in examples[at : at + BATCH]])
        score[at : at + BATCH], _ = network.forward(network.projected(words), place, live)
    label, row = (np.array([e[k] for e in examples], np.int64) for k in (1, 2))
    highest = np.full(row.max(initial=-1) + 1, -np.inf)
    np.maximum.at(highest, row, score)
    return np.flatnonzero((label == 0) | (score >= highest[row] - 1))


def calibrate(model: ToxicityModel, raw: np.ndarray, label: np.ndarray) -> None:
    """Logistic regression of label on raw score by damped Newton steps; with one class only, the curve stays."""
    if len(set(label.tolist())) < 2:
        return
    centre, width = raw.mean(), raw.std() + 1e-9
    x, w, ridge = np.c_[(raw - centre) / width, np.ones(len(raw))], np.zeros(2), 1e-3

    def loss(v: np.ndarray) -> float:
        margin = np.where(label > 0, 1, -1) * (x @ v)
        return float(np.logaddexp(0, -margin).sum() + ridge * (v @ v))

    for _ in range(60):
        q = _sigmoid(np.clip(x @ w, -40, 40))
        slope = x.T @ (q - label) + 2 * ridge * w
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 2 * ridge * np.eye(2), slope)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step /= 2
        w = w - step
    model.slope = max(1e-3, float(w[0]) / width)
    model.offset = float(w[1]) - model.slope * centre


def raw_scores(rows: DataFrame, model: ToxicityModel, id_col: str, text_col: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """(id, *extra, raw) of every row from its whole text."""
    kept = [rows.schema[c] for c in (id_col, *extra)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in batches:
            raw = [model.raw(table, texts) for _, texts in chunks(batch.column(0).to_pylist(), CHUNK_CHARS)]
            flat = pa.array(np.concatenate(raw) if raw else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], flat], [*batch.schema.names[1:], "raw"])

    fields = [T.StructField(f"k{i}", f.dataType) for i, f in enumerate(kept)] + [T.StructField("raw", T.DoubleType())]
    chosen = rows.select(F.col(text_col).alias("text"), *(F.col(f.name).alias(f"k{i}") for i, f in enumerate(kept)))
    return chosen.mapInArrow(run, T.StructType(fields)).toDF(*(f.name for f in kept), "raw")


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """(id, *extra, score) of every row. Null, empty and wordless texts get the curve's value at a fixed low raw score.

    Equal texts get equal scores; no other column is looked at.
    """
    found = raw_scores(docs, model, id_col, text_col, extra)
    curve = F.lit(model.slope) * F.col("raw") + F.lit(model.offset)
    curve = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), curve))
    return found.select(*(c for c in found.columns if c != "raw"), (1 / (1 + F.exp(-curve))).alias("score"))


def keep_clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of `docs`, all their columns, that score below `threshold`."""
    held = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    place = f"c{docs.columns.index(text_col)}"
    found = score(held, model, held.columns[0], place, tuple(held.columns[1:]))
    return found.where(F.col("score") < threshold).drop("score").toDF(*docs.columns)
