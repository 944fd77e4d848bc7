"""Quality rules by line sequence labelling.

A linear-chain conditional random field labels every line of a text as content
or boilerplate; Viterbi decoding finds the best labels, and a text is retained
if enough of its characters are in content lines. A few counts over the text
give a base rule that rejects on its own.

The field has two labels and some features a line (:data:`FEATURES`). It is
fitted on a bounded sample of labelled documents (:data:`PER_CLASS` a class) of at most
:data:`MOST_LINES` lines, whose lines take the document's label: line labels are not in
the tables, so what is learned of moves between labels is that they are rare. For fitting
alone, a text's lines are taken in runs of :data:`FIT_LINES`. Decoding covers whole texts. Counts are
made over the bytes of a batch, rows are never shuffled, and memory is a few
megabytes of text at a time, or one longer text.

Defined results: null and empty texts have no word and fail the base rule; lines
without a word have no label and no weight; repeated rows are treated alike;
with only one class of labels, or none, every line is content.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import PLAIN, bytes_of, labelled, lean, parts, table, windows, word_hashes, word_spans

PER_CLASS, FIT_LINES, MOST_LINES = 1500, 48, 1_000
FEATURES = ("one", "words", "symbols", "capitals", "bangs", "bars", "digits", "repeats", "again", "open", "short")
MIN_WORDS, MAX_REPEATED, MIN_CONTENT = 50, 0.5, 0.5


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOL = _class("#*$%&|<>")
_UPPER, _LOWER, _DIGIT, _CLOSE = np.zeros((4, 256), bool)
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_CLOSE[[ord(c) for c in ".!?:\"')]"]] = True
_START = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a character


@dataclass
class Counted:
    """Counts of the rows of a batch part, and the features of their lines."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    line_upto: np.ndarray  # offsets of each row's lines that have a word
    weight: np.ndarray  # characters of words in those lines
    x: np.ndarray


def _earlier(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whether a value came before in its row."""
    order = np.lexsort((np.arange(len(values)), values, rows))
    same = (values[order][1:] == values[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    out = np.zeros(len(values), bool)
    out[order[1:][same]] = True
    return out


def count(texts: pa.Array) -> Counted:
    data, at = bytes_of(texts)
    rows = len(at) - 1
    starts, ends, upto = word_spans(data, at)
    n = np.diff(upto)
    total = lambda flags: np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    between = lambda sums, a, b: sums[b] - sums[a]
    inside = PLAIN[data]
    chars = total(_START[data] & inside)
    symbols = total(_SYMBOL[data])
    h = word_hashes(data, starts, ends, exact=True)
    row = np.repeat(np.arange(rows), n)

    # words in three-word windows that the text holds twice or more
    w = windows(h, 3)
    repeated = np.zeros(len(h), bool)
    if len(w):
        good = row[2:] == row[:-2]
        place = np.flatnonzero(good)
        order = np.lexsort((w[place], row[place]))
        value, owner = w[place][order], row[place][order]
        same = (value[1:] == value[:-1]) & (owner[1:] == owner[:-1])
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = place[order[twice]]
        for i in range(3):
            repeated[hit + i] = True
    n_repeat = np.bincount(row[repeated], minlength=rows)

    # lines: between line feeds and row ends
    feeds = np.flatnonzero(data == 10)
    owner = np.searchsorted(at, feeds, "right") - 1
    first = np.concatenate([at[:-1], feeds + 1])
    last = np.concatenate([feeds, at[1:]])
    line_row = np.concatenate([np.arange(rows), owner])
    order = np.lexsort((first, line_row))
    first, line_row = first[order], line_row[order]
    order = np.lexsort((last, np.concatenate([owner, np.arange(rows)])))
    last = last[order]
    a, b = np.searchsorted(starts, first), np.searchsorted(starts, last)
    worded = b > a
    first, last, line_row, a, b = (v[worded] for v in (first, last, line_row, a, b))
    again = _earlier(word_hashes(data, first, last, exact=True), line_row)
    line_upto = np.searchsorted(line_row, np.arange(rows + 1))

    share = lambda table_, base: between(total(table_[data]), first, last) / np.maximum(base, 1)
    letters = between(total(_UPPER[data] | _LOWER[data]), first, last)
    weight = between(chars, first, last)
    words = b - a
    as_before = np.zeros(len(h), bool)
    as_before[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    repeats = between(total(as_before), a, b) / np.maximum(words, 1)
    x = np.stack(
        [
            np.ones(len(words)),
            np.minimum(np.log1p(words) / 5, 1.0),
            np.minimum(between(symbols, first, last) / np.maximum(words, 1), 2.0),
            share(_UPPER, letters),
            np.minimum(share(_class("!"), words), 2.0),
            np.minimum(share(_class("|"), words), 1.0),
            share(_DIGIT, weight),
            repeats,
            again.astype(float),
            1.0 - _CLOSE[data[ends[np.maximum(b - 1, 0)] - 1]] if len(words) else np.zeros(0),
            (words < 3).astype(float),
        ],
        1,
    )
    return Counted(n, between(chars, at[:-1], at[1:]), between(symbols, at[:-1], at[1:]), np.bincount(line_row[again], minlength=rows), n_repeat, line_upto, weight, x)


@dataclass
class Field:
    weights: np.ndarray  # score of content over boilerplate by feature
    moves: np.ndarray  # [from][to], label 1 is content

    def content(self, x: np.ndarray) -> np.ndarray:
        """Viterbi labels of the lines of one text."""
        gain = (x @ self.weights).tolist()
        (s00, s01), (s10, s11) = self.moves.tolist()
        low, high, back = 0.0, gain[0], []
        for g in gain[1:]:
            to_low, to_high = high + s10 > low + s00, high + s11 > low + s01
            back.append((to_low, to_high))
            low, high = (high + s10 if to_low else low + s00), (high + s11 if to_high else low + s01) + g
        label = high >= low
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return np.array(out[::-1], bool)


def slopes(theta: np.ndarray, x: np.ndarray, y: np.ndarray, mask: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """x: texts by lines by features, y: texts by lines, mask: lines there are. The
    penalised loss a line and its gradient; expectations by forward and backward sums."""
    texts, length, width = x.shape
    lines, pair = mask.sum(), mask[:, 1:] & mask[:, :-1]
    seen = np.concatenate([(x * (y * mask)[:, :, None]).sum((0, 1)), [((y[:, :-1] == i) & (y[:, 1:] == j) & pair).sum() for i in (0, 1) for j in (0, 1)]])
    gain, moves = x @ theta[:width], theta[width:].reshape(2, 2)
    alpha, beta = np.zeros((length, texts, 2)), np.zeros((length, texts, 2))
    emit = np.stack([np.zeros_like(gain), gain], 2).transpose(1, 0, 2) * mask.T[:, :, None]
    alpha[0] = emit[0]
    for t in range(1, length):
        new = np.logaddexp(alpha[t - 1][:, :1] + moves[0], alpha[t - 1][:, 1:] + moves[1]) + emit[t]
        alpha[t] = np.where(mask[:, t, None], new, alpha[t - 1])
    for t in range(length - 2, -1, -1):
        ahead = emit[t + 1] + beta[t + 1]
        new = np.logaddexp(ahead[:, :1] + moves[:, 0], ahead[:, 1:] + moves[:, 1])
        beta[t] = np.where(mask[:, t + 1, None], new, 0.0)
    z = np.logaddexp(alpha[-1][:, 0], alpha[-1][:, 1])
    high = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z) * mask.T
    expected = [np.einsum("tn,ntf->f", high, x)]
    for i in (0, 1):
        for j in (0, 1):
            p = np.exp(alpha[:-1, :, i] + moves[i, j] + emit[1:, :, j] + beta[1:, :, j] - z) * pair.T
            expected.append([p.sum()])
    return (z.sum() - seen @ theta) / lines + ridge / 2 * (theta @ theta), (np.concatenate(expected) - seen) / lines + ridge * theta


def fit(x: np.ndarray, y: np.ndarray, mask: np.ndarray, steps: int = 250, rate: float = 0.1, ridge: float = 1e-3) -> Field:
    """Adam on the penalised likelihood."""
    width = x.shape[2]
    theta = np.zeros(width + 4)
    state = np.zeros((2, width + 4))
    for step in range(1, steps + 1):
        grad = slopes(theta, x, y, mask, ridge)[1]
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.99 * state[1] + 0.01 * grad**2
        theta = theta - rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
    return Field(theta[:width], theta[width:].reshape(2, 2))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = PER_CLASS) -> Field:
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n in parts(batch.column(2)):
                got = count(batch.column(2).slice(first, n))
                each = [got.x[a : b if b - a <= MOST_LINES else a].astype(np.float32).tobytes() for a, b in zip(got.line_upto[:-1], got.line_upto[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.array(each, pa.binary())], ["id", "y", "x"])

    rows = [r for r in sorted(labelled(docs, labels, key, text, label, per_class).mapInArrow(lean(lines), "id long, y int, x binary").collect()) if r["x"]]
    if len({r["y"] for r in rows}) < 2:
        return Field(np.zeros(len(FEATURES)), np.zeros((2, 2)))
    runs = []
    for r in rows:
        own = np.frombuffer(r["x"], np.float32).reshape(-1, len(FEATURES))
        runs += [(r["y"], own[i : i + FIT_LINES]) for i in range(0, len(own), FIT_LINES)]
    x = np.zeros((len(runs), FIT_LINES, len(FEATURES)))
    mask = np.zeros(x.shape[:2], bool)
    for i, (_, own) in enumerate(runs):
        x[i, : len(own)], mask[i, : len(own)] = own, True
    y = np.repeat(np.array([y for y, _ in runs])[:, None], FIT_LINES, 1)
    return fit(x, y, mask)


NEW = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "content_share": "double", "base_failed": "boolean", "kept": "boolean"}


def judge(docs: DataFrame, field: Field, text: str = "text", least: float = MIN_CONTENT) -> DataFrame:
    """Adds the columns in :data:`NEW`; columns of those names are replaced."""
    kept = [c for c in docs.columns if c not in NEW]
    at = kept.index(text)
    schema = docs.select(kept).schema
    for name, kind in NEW.items():
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n in parts(batch.column(at)):
                piece = batch.slice(first, n)
                c = count(piece.column(at))
                share = np.zeros(n)
                for i, (a, b) in enumerate(zip(c.line_upto[:-1], c.line_upto[1:], strict=True)):
                    if b > a:
                        share[i] = c.weight[a:b][field.content(c.x[a:b])].sum() / c.weight[a:b].sum()
                failed = (c.n_words < MIN_WORDS) | (c.n_repeat_words > MAX_REPEATED * c.n_words)
                new = [c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words, share, failed, ~failed & (share >= least)]
                yield pa.RecordBatch.from_arrays([*piece.columns, *[pa.array(v) for v in new]], [*kept, *NEW])

    return docs.select(kept).mapInArrow(lean(run), schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, train(docs, table(spark, sf_dir, "labels"))).drop("text")
