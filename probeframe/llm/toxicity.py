"""Toxicity by subword-bag embeddings and a linear softmax (operator 6).

A word is the bag of its character n-grams and itself (hashed to buckets); the
embeddings of a window's bags are averaged into a linear softmax, and both are
trained jointly in numpy.  A window is :data:`WINDOW` words, one beginning at
every word, and a text is as toxic as its worst window: a few words among
thousands vanish in the mean of a whole text.  In folds of the training rows
recall falls as the window grows (sf0.1: 0.90 at one word, 0.81 at two, 0.67 at
four), so a window is one word's bag; training knows other widths.  Rate, weights,
softness, ridge, passes and least texts are those of the best F1 in such folds
(:func:`cross_validate`); sizes and n-grams are older (see the README).
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probeframe.llm._shared import materialize, small_batches

WORDS = re.compile(r"\w+")
#: Buckets and size of the embeddings; lengths of the n-grams; letters after which a word goes on as another.
BUCKETS, DIM, GRAMS, WORD_LETTERS = 1 << 17, 8, (3, 4, 5), 40
#: Words of a window; training texts that a bucket must occur in to be moved.
WINDOW, LEAST_TEXTS = 1, 8
#: Bounds of the training sample: rows of each label, and characters of a text that trains (all texts are scored).
TRAIN_ROWS, TRAIN_CHARS = 3000, 4_000
#: Passes over the sample, steps of embeddings and softmax, ridge, softness of a text's maximum while it trains, weight of a toxic text.
EPOCHS, RATE, SOFTMAX_RATE, RIDGE, SOFTNESS, TOXIC_WEIGHT = 80, 0.25, 0.1, 5e-6, 0.2, 4.0


def subwords(word: str) -> list[int]:
    """Buckets of a word: itself and its n-grams, with marks at both ends."""
    marked = f"<{word}>"
    found = {marked} | {marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)}
    return sorted({zlib.crc32(g.encode()) % BUCKETS for g in found})


def words_of(text: str) -> list[str]:
    """The lower-case words in order; a longer run than :data:`WORD_LETTERS` counts by pieces, so that a word's cost is bounded."""
    words = WORDS.findall(text.lower())
    if max(map(len, words), default=0) > WORD_LETTERS:
        words = [w[i : i + WORD_LETTERS] for w in words for i in range(0, len(w), WORD_LETTERS)]
    return words


def window_means(values: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Means over every ``window`` neighbours; over all of them if they are fewer."""
    sums = np.concatenate([[0.0], np.cumsum(values)])
    n = min(window, len(values))
    return (sums[n:] - sums[:-n]) / n


@dataclass
class Model:
    embeddings: np.ndarray
    softmax: np.ndarray
    bias: float

    def folded(self) -> tuple[np.ndarray, float]:
        """Each bucket's share of the log-odds: the softmax applied to its embedding."""
        return (self.embeddings @ (self.softmax[1] - self.softmax[0])).astype(np.float32), float(self.bias)


def train(
    texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 11, window: int = WINDOW,
    rate: float = RATE, ridge: float = RIDGE, softness: float = SOFTNESS, toxic_weight: float = TOXIC_WEIGHT, least_texts: int = LEAST_TEXTS,
) -> Model:
    """Fits on texts of known label, all at once in each pass.

    A text's log-odds are the soft maximum of its windows', a window's those of
    the softmax over the mean of its subwords' embeddings.  Both begin at random
    and move by the gradient with adaptive steps.  Without texts the model scores
    all alike, with one label it leans to that label; empty texts are one empty
    word; equal texts count as often as they occur.
    """
    rng = np.random.default_rng(seed)
    embeddings = rng.uniform(-1, 1, (BUCKETS, DIM)) / DIM
    softmax, bias = rng.normal(0, 0.5, (2, DIM)), -2.0
    if not texts:
        return Model(embeddings * 0, softmax, bias)
    vocabulary: dict[str, int] = {}
    flat, sizes, grams, gram_n = array("i"), array("i"), array("i"), array("i")
    for text in texts:
        words = words_of(text) or [""]
        for w in words:
            if w not in vocabulary:
                vocabulary[w] = len(vocabulary)
                found = subwords(w)
                grams.extend(found)
                gram_n.append(len(found))
        flat.extend(vocabulary[w] for w in words)
        sizes.append(len(words))
    word, n, gram, gram_n = (np.array(x, np.int32) for x in (flat, sizes, grams, gram_n))
    label = np.array(labels, float)
    word_at, gram_at = np.cumsum(n) - n, np.cumsum(gram_n) - gram_n
    # windows: where they begin and end among all words, and whose they are
    n_windows = np.maximum(1, n - window + 1)
    window_at, owner = np.cumsum(n_windows) - n_windows, np.repeat(np.arange(len(n)), n_windows)
    begin = _ranges(n_windows, np.arange(len(n))) - window_at[owner] + word_at[owner]
    width = np.minimum(window, n)[owner]
    # a bucket that only a few texts have would learn those texts by heart: it stays where it began
    seen = np.zeros(BUCKETS, np.int32)
    for t in range(len(texts)):
        seen[np.unique(gram[_ranges(gram_n, np.unique(word[word_at[t] : word_at[t] + n[t]]))])] += 1
    rare = seen < least_texts
    embeddings[rare] /= 10
    weight = np.where(label == 1, toxic_weight, 1.0)
    squares, softmax_squares = np.full(BUCKETS, 1e-6), np.full(DIM, 1e-6)
    for _ in range(epochs):
        towards = softmax[1] - softmax[0]
        folded = embeddings @ towards
        sums = np.concatenate([[0.0], np.cumsum((np.add.reduceat(folded[gram], gram_at) / gram_n)[word])])
        odds = (sums[begin + width] - sums[begin]) / width / softness
        most = np.maximum.reduceat(odds, window_at)
        shares = np.exp(odds - most[owner])
        total = np.add.reduceat(shares, window_at)
        error = (_sigmoid((most + np.log(total)) * softness + bias) - label) * weight
        by_window = shares / total[owner] * error[owner] / width
        steps = np.bincount(begin, by_window, minlength=len(word) + 1) - np.bincount(begin + width, by_window, minlength=len(word) + 1)
        by_word = np.bincount(word, np.cumsum(steps)[:-1], minlength=len(gram_n)) / gram_n
        slope = np.bincount(gram, np.repeat(by_word, gram_n), minlength=BUCKETS)
        slope[rare] = 0
        slope += ridge * len(texts) * folded * ~rare
        turn = slope @ embeddings
        squares += slope**2
        softmax_squares += turn**2
        embeddings -= rate * (slope / np.sqrt(squares))[:, None] * towards
        turn *= SOFTMAX_RATE / np.sqrt(softmax_squares)
        softmax += np.stack([turn, -turn])
        bias -= 0.02 * error.sum() / np.sqrt(weight.sum())
    return Model(embeddings.astype(np.float32), softmax.astype(np.float32), float(bias))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _ranges(sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Positions of the items of groups ``which``, the groups laid end to end with ``sizes``."""
    starts, n = (np.cumsum(sizes) - sizes)[which], sizes[which]
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> list[tuple[str, int]]:
    """A bounded sample of labelled texts, ``rows`` of each label at most, by the hash of the id.

    Rows whose ``crc32(doc_id) mod 5`` is 0 are held out and never among them.
    Rows without an id, label or document don't train.
    """
    usable = labels.filter("doc_id is not null and toxic in (0, 1)").filter(~held_out(F.col("doc_id")))
    usable = usable.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    order = [F.xxhash64("doc_id"), "doc_id", "toxic"]
    some = usable.filter("toxic = 0").orderBy(*order).limit(rows).union(usable.filter("toxic = 1").orderBy(*order).limit(rows))
    some = materialize(some.distinct(), "labels")  # at most 2 x rows, so it may be broadcast
    texts = docs.select("doc_id", "text").filter(F.length("text") <= chars)
    found = texts.join(F.broadcast(some), "doc_id").select("doc_id", "text", "toxic").distinct()
    found = found.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic", "text").limit(2 * rows)
    return [(r["text"], r["toxic"]) for r in found.toLocalIterator()]


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


class Scorer:
    """Scores texts; a word's log-odds are kept, as one word occurs in many texts."""

    MOST = 1_000_000

    def __init__(self, folded: np.ndarray, bias: float, window: int = WINDOW) -> None:
        self.folded, self.bias, self.window, self.kept = folded.tolist(), bias, window, {}

    def of_word(self, word: str) -> float:
        if (found := self.kept.get(word)) is None:
            if len(self.kept) > self.MOST:
                self.kept.clear()
            at = subwords(word)
            found = self.kept[word] = sum(map(self.folded.__getitem__, at)) / len(at)
        return found

    def score(self, text: str) -> float:
        """The highest probability of any window; the bias alone for a text without words."""
        odds = np.fromiter(map(self.of_word, words_of(text)), float)
        return float(_sigmoid((window_means(odds, self.window).max() if len(odds) else 0.0) + self.bias))


def cross_validate(rows: list[tuple[str, int]], folds: int = 3, **settings) -> dict[str, float]:
    """``log_loss, recall, false_alarms, f1`` of settings of :func:`train` over ``rows``, each scored by the model of the other folds.

    Give it :func:`training_rows`, so that no held-out label takes part in a
    choice.  Equal texts share a fold.  A share of nothing is 0.
    """
    fold = [zlib.crc32(t.encode()) % folds for t, _ in rows]
    score, label = np.zeros(len(rows)), np.array([y for _, y in rows], int)
    for k in range(folds):
        seen = [r for r, f in zip(rows, fold, strict=True) if f != k]
        model = train([t for t, _ in seen], [y for _, y in seen], **settings)
        scorer = Scorer(*model.folded(), settings.get("window", WINDOW))
        for i in (i for i, f in enumerate(fold) if f == k):
            score[i] = scorer.score(rows[i][0])
    said, share = score >= 0.5, lambda n, of: float(n / of) if of else 0.0
    hits, toxic = (said & (label == 1)).sum(), (label == 1).sum()
    loss = -np.log(np.clip(np.where(label == 1, score, 1 - score), 1e-6, 1)).sum()
    return {
        "log_loss": share(loss, len(rows)), "recall": share(hits, toxic),
        "false_alarms": share((said & (label == 0)).sum(), (label == 0).sum()), "f1": share(2 * hits, said.sum() + toxic),
    }


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Model:
    """The model that :func:`training_rows` of ``docs(doc_id, text)`` and ``labels(doc_id, toxic)`` teach.

    Null texts don't train, nor do texts beyond :data:`TRAIN_CHARS`; an empty
    text does, as one empty word.  Rows that repeat train once.  Without usable
    rows the model scores all alike.
    """
    rows = training_rows(docs, labels)
    return train([t for t, _ in rows], [y for _, y in rows])


def score(docs: DataFrame, model: Model, name: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with ``name``: the probability that a text is toxic, over the whole text.

    A null text is an empty one; an empty text has the bias's score; rows that
    repeat score alike.  The model (one number a bucket, half a megabyte) goes
    to the tasks; a column of that name in ``docs`` is replaced, all others stay
    as they are, whatever their names.
    """
    small_batches(docs.sparkSession)
    folded, bias = model.folded()
    shared = docs.sparkSession.sparkContext.broadcast((folded, bias))

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(*shared.value)
        for texts in batches:
            yield pd.Series([scorer.score(t) for t in texts], dtype=float)

    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != name], probability(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias(name))
