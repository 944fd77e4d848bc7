"""Toxicity severity by cumulative-link ordinal regression.

P(grade <= j) = sigmoid(theta_j - w . x) with rising thresholds theta and one
weight vector w that all thresholds share. x is sparse: which words of a lexicon,
and which heads of longer words (:data:`HEADS`, in code points), a text holds; heads
meet the many forms that one stem takes, and count once for each different word that
has them, up to :data:`TIMES`. The result is the expected grade, the sum of
P(grade > j).

Fitting uses a bounded sample of labelled rows (:data:`PER_CLASS` documents a
label, lowest hash first). The lexicon is every word or head whose document
frequencies in the two classes differ by :data:`Z` standard errors. Labels above 1
are grades and are taken as such. Where labels only say 0 or 1, a toxic document's
grade, 1 to 3, is the third it falls into by its log odds, and those are taken from
the other half of the sample: no document is graded by words that were chosen with it.
Scoring is one pass over whole texts: words are hashed over the bytes of a batch and
looked up, with no shuffle; memory is a few megabytes of text at a time, or one
longer text.

Defined results: null and empty texts have no word and get the grade of none;
very long texts are read whole; repeated rows are treated alike, and a document that
is repeated is learned from as often; labels without a document and null labels are
not learned from, repeated labels count as their highest; labels above the highest
grade count as that, those below 0 as 0; equal log odds get one grade; where either
class is missing, every text gets severity 0. Columns of the names that are added are
replaced, others stay. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import LETTERS, bytes_of, labelled, lean, mix, parts, table, word_hashes, word_spans

PER_CLASS, Z, GRADES, HEADS, TIMES = 3000, 6.0, 4, (4, 5, 6, 7, 8), 3
#: Expected severity from which a text counts as toxic.
TOXIC = 0.5


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, word) of every word of every text, and of the heads of longer words."""
    data, at = bytes_of(texts)
    starts, ends, upto = word_spans(data, at, LETTERS)
    row = np.repeat(np.arange(len(texts)), np.diff(upto))
    word = word_hashes(data, starts, ends)
    rows, hashes, words = [row], [word], [word]
    chars = np.flatnonzero((data & 0xC0) != 0x80)
    place = np.searchsorted(chars, starts)
    for k in HEADS:
        longer = np.flatnonzero(place + k < len(chars))
        longer = longer[chars[place[longer] + k] < ends[longer]]
        rows.append(row[longer])
        words.append(word[longer])
        with np.errstate(over="ignore"):
            hashes.append(mix(word_hashes(data, starts[longer], chars[place[longer] + k]) + np.uint64(k)))
    return np.concatenate(rows), np.concatenate(hashes), np.concatenate(words)


def counted(row: np.ndarray, feature: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature), in order, as often as different words have it, up to TIMES."""
    order = np.lexsort((word, feature, row))
    row, feature, word = row[order], feature[order], word[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (feature[1:] != feature[:-1]) | (word[1:] != word[:-1])
    row, feature = row[new], feature[new]
    few = np.ones(len(row), bool)
    few[TIMES:] = (row[TIMES:] != row[:-TIMES]) | (feature[TIMES:] != feature[:-TIMES])
    return row[few], feature[few]


@dataclass
class Ordinal:
    words: np.ndarray  # sorted hashes of the lexicon
    weights: np.ndarray
    thresholds: np.ndarray

    def severity(self, z: np.ndarray) -> np.ndarray:
        return (1 / (1 + np.exp(self.thresholds[None, :] - z[:, None]))).sum(1)

    def hits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, lexicon index) of the lexicon's words and heads in every text, as :func:`counted`."""
        rows, found = [], []
        for first, n in parts(texts):
            row, h, word = features(texts.slice(first, n))
            place = np.minimum(np.searchsorted(self.words, h), max(len(self.words) - 1, 0))
            hit = np.flatnonzero(self.words[place] == h) if len(self.words) else np.zeros(0, np.int64)
            row, h = counted(row[hit] + first, place[hit], word[hit])
            rows.append(row)
            found.append(h)
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *rows]), np.concatenate([none, *found])

    def score(self, texts: pa.Array) -> np.ndarray:
        rows, found = self.hits(texts)
        return self.severity(np.bincount(rows, self.weights[found], len(texts)))


def thresholds(t: np.ndarray) -> np.ndarray:
    """A first one and positive steps, so they stay in order."""
    return t[0] + np.concatenate([[0.0], np.cumsum(np.exp(t[1:]))])


def slopes(w: np.ndarray, t: np.ndarray, rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The penalised loss a document, and its gradient by w and t."""
    n, k, i = len(grades), len(t), np.arange(len(grades))
    z = np.bincount(rows, w[columns], n)
    cdf = 1 / (1 + np.exp(np.clip(z[:, None] - thresholds(t)[None, :], -40, 40)))
    full = np.concatenate([np.zeros((n, 1)), cdf, np.ones((n, 1))], 1)
    slope = np.concatenate([np.zeros((n, 1)), cdf * (1 - cdf), np.zeros((n, 1))], 1)
    p = np.maximum(full[i, grades + 1] - full[i, grades], 1e-9)
    dz = (slope[i, grades + 1] - slope[i, grades]) / p / n  # of the loss, by z
    upper, lower = slope[i, grades + 1] / p / n, slope[i, grades] / p / n
    dtheta = np.array([lower[grades == j + 1].sum() - upper[grades == j].sum() for j in range(k)])
    dt = np.concatenate([[dtheta.sum()], [dtheta[j:].sum() * np.exp(t[j]) for j in range(1, k)]])
    return ridge / 2 * (w @ w) - np.log(p).mean(), np.concatenate([np.bincount(columns, dz[rows], len(w)) + ridge * w, dt])


def fit(rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, width: int, steps: int = 400, rate: float = 0.05, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the penalised likelihood."""
    k = GRADES - 1
    w, t = np.zeros(width), np.concatenate([[1.0], np.zeros(k - 1)])
    state = [np.zeros(width + k), np.zeros(width + k)]
    for step in range(1, steps + 1):
        grad = slopes(w, t, rows, columns, grades, ridge)[1]
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.99 * state[1] + 0.01 * grad**2
        move = rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        w, t = w - move[:width], t - move[width:]
    return w, thresholds(t)


def lexicon(row: np.ndarray, column: np.ndarray, bad: np.ndarray, use: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """z and log odds of every feature, over the documents in use."""
    once = np.ones(len(row), bool)
    once[1:] = (row[1:] != row[:-1]) | (column[1:] != column[:-1])
    row, column = row[once], column[once]
    n_bad, n_good = (use & bad).sum(), (use & ~bad).sum()
    in_bad = np.bincount(column[(use & bad)[row]], minlength=width)
    in_good = np.bincount(column[(use & ~bad)[row]], minlength=width)
    share = (in_bad + in_good + 1) / (n_bad + n_good + 2)
    z = (in_bad / max(n_bad, 1) - in_good / max(n_good, 1)) / np.sqrt(share * (1 - share) * (1 / max(n_bad, 1) + 1 / max(n_good, 1)))
    return z, np.log((in_bad + 0.5) / (n_bad + 1)) - np.log((in_good + 0.5) / (n_good + 1))


def graded(row: np.ndarray, column: np.ndarray, bad: np.ndarray, width: int) -> np.ndarray:
    """0 for clean documents, else the third by log odds that the other half gives."""
    half = np.arange(len(bad)) % 2
    odds = np.zeros(len(bad))
    for side in (0, 1):
        z, weight = lexicon(row, column, bad, half != side, width)
        weight[z < Z / np.sqrt(2)] = 0.0  # half the documents, the same difference
        odds += np.bincount(row, weight[column], len(bad)) * (half == side)
    cuts = np.quantile(odds[bad], np.arange(1, GRADES - 1) / (GRADES - 1))
    return np.where(bad, 1 + np.searchsorted(cuts, odds), 0)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = PER_CLASS) -> Ordinal:
    got = labelled(docs, labels, key, text, label, per_class, GRADES - 1)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n in parts(batch.column(2)):
                row, h = counted(*features(batch.column(2).slice(first, n)))
                upto = np.searchsorted(row, np.arange(n + 1))
                each = [h[a:b].tobytes() for a, b in zip(upto[:-1], upto[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.array(each, pa.binary())], ["id", "y", "words"])

    rows = sorted(got.mapInArrow(lean(words), "id long, y int, words binary").collect())
    y = np.array([r["y"] for r in rows], np.int64)
    bad = y > 0
    empty = Ordinal(np.zeros(0, np.uint64), np.zeros(0), np.full(GRADES - 1, np.inf))
    if not bad.any() or bad.all():
        return empty
    each = [np.frombuffer(r["words"], np.uint64) for r in rows]
    row = np.repeat(np.arange(len(each)), [len(x) for x in each])
    vocabulary, column = np.unique(np.concatenate(each), return_inverse=True)
    z, _ = lexicon(row, column, bad, np.ones(len(y), bool), len(vocabulary))
    chosen = np.flatnonzero(np.abs(z) >= Z)
    if not len(chosen):
        return empty
    grades = y if (y > 1).any() else graded(row, column, bad, len(vocabulary))
    at = np.full(len(vocabulary), -1)
    at[chosen] = np.arange(len(chosen))
    held = at[column] >= 0
    w, theta = fit(row[held], at[column][held], grades, len(chosen))
    return Ordinal(vocabulary[chosen], w, theta)


def score(docs: DataFrame, model: Ordinal, text: str = "text") -> DataFrame:
    """Adds ``severity``, ``grade`` and ``toxic``; columns of those names are replaced."""
    new = ("severity", "grade", "toxic")
    kept = [c for c in docs.columns if c not in new]
    at = kept.index(text)
    schema = docs.select(kept).schema.add("severity", "double").add("grade", "integer").add("toxic", "boolean")
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.round(held.value.score(batch.column(at)), 9)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array(np.rint(s).astype(np.int32)), pa.array(s >= TOXIC)], [*kept, *new])

    return docs.select(kept).mapInArrow(lean(run), schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, table(spark, sf_dir, "labels"))).select("doc_id", "severity", "grade", "toxic")
