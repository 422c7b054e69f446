"""Text quality by a generalised additive model with pairwise interactions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Labelled rows the model is fitted on, at most.
FIT_ROWS = 20_000
#: Ids with a label that are small enough to be broadcast.
BROADCAST_ROWS = 1_000_000
BINS = 32
PAIR_BINS = 8
ROUNDS = 150
PAIRS = 8
RATE = 0.15
THRESHOLD = 0.3

FEATURES = (
    "log_words", "word_length", "long_words", "upper", "digits", "marks", "spaces",
    "distinct_words", "top_word", "repeats", "repeated_lines", "line_words", "closing",
    "bars", "shouts", "symbol_ends", "byte_entropy", "wide_bytes",
)

_KIND = np.zeros(256, np.int64)
_KIND[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)] = 1
_KIND[np.frombuffer(b"0123456789", np.uint8)] = 2
_KIND[np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)] = 3
_KIND[np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8)] = 4
_KIND[128:] = 5
_ENDS = tuple(b"#$%&*+<=>@^_|~")


def features(text: str | None) -> list[float]:
    """The numbers of ``FEATURES``, from the whole text; zeros for one without words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_KIND, weights=counts, minlength=6) / len(raw)
    part = counts[counts > 0] / len(raw)
    lengths = np.fromiter(map(len, words), np.int64, n)
    seen = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    distinct_lines = len(set(lines))
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    closing = int(counts[ord(".")] + counts[ord("?")])
    return [
        float(np.log1p(n)),
        float(lengths.mean()),
        float((lengths > 14).mean()),
        float(kinds[1]),
        float(kinds[2]),
        float(kinds[3]),
        float(kinds[4]),
        # Grows with the root of the length in running text, so divided by it.
        len(seen) / n**0.7,
        max(seen.values()) / n,
        repeats / n,
        1 - distinct_lines / len(lines),
        float(np.log1p(n / len(lines))),
        closing / n,
        int(counts[ord("|")]) / n,
        int(counts[ord("!")]) / n,
        sum(w[-1] in _ENDS for w in words) / n,
        float(-(part * np.log2(part)).sum()),
        float(kinds[5]),
    ]


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between bins at quantiles; fewer where values repeat."""
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


@dataclass
class Model:
    """``intercept`` plus a lookup table per feature and per pair of features."""

    intercept: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.intercept)
        for i, (cut, table) in enumerate(zip(self.cuts, self.tables)):
            total += table[np.searchsorted(cut, rows[:, i], "left")]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            a = np.searchsorted(self.pair_cuts[i], rows[:, i], "left")
            b = np.searchsorted(self.pair_cuts[j], rows[:, j], "left")
            total += table[a, b]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _sums(bins: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    return np.bincount(bins, weights=weights, minlength=n)


def _split(g: np.ndarray, h: np.ndarray) -> int:
    """Where a cut between bins gains most; 0 for none."""
    if len(g) < 2:
        return 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = left_g**2 / (left_h + 1) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + 1)
    k = int(np.argmax(gain))
    return k + 1 if gain[k] > g.sum() ** 2 / (h.sum() + 1) + 1e-9 else 0


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """A shallow tree on one binned feature, as the step it adds to each bin."""
    k = _split(g, h) if depth else 0
    if not k:
        return np.full(len(g), -g.sum() / (h.sum() + 1))
    return np.concatenate([_tree(g[:k], h[:k], depth - 1), _tree(g[k:], h[k:], depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The tree that cuts each axis once with most gain over the four corners it
    makes, as a table of steps, and that gain; all pairs of cuts are compared."""
    if min(g.shape) < 2:
        return np.zeros_like(g), 0.0

    def corners(x: np.ndarray) -> list[np.ndarray]:
        c = x.cumsum(0).cumsum(1)
        low, rows, cols, whole = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return [low, rows - low, cols - low, whole - rows - cols + low]

    gains = sum(a * a / (b + 1) for a, b in zip(corners(g), corners(h)))
    i, j = np.unravel_index(int(gains.argmax()), gains.shape)
    out = np.zeros_like(g)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            out[rows, cols] = -g[rows, cols].sum() / (h[rows, cols].sum() + 1)
    return out, float(gains[i, j])


def fit(rows: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS) -> Model:
    """Cyclic boosting with logistic loss: features in turn, then the best pairs in turn.

    Without rows the score is one half everywhere; with one class alone it is
    that class's smoothed share.
    """
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    model = Model(float(np.log(share / (1 - share))))
    if len(np.unique(labels)) < 2:
        return model
    width = rows.shape[1]
    model.cuts = [_edges(rows[:, i], BINS) for i in range(width)]
    model.pair_cuts = [_edges(rows[:, i], PAIR_BINS) for i in range(width)]
    binned = [np.searchsorted(c, rows[:, i], "left") for i, c in enumerate(model.cuts)]
    coarse = [np.searchsorted(c, rows[:, i], "left") for i, c in enumerate(model.pair_cuts)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    total = np.full(len(rows), model.intercept)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return p - labels, p * (1 - p)

    for _ in range(rounds):
        for i in range(width):
            g, h = slope()
            n = len(model.tables[i])
            step = RATE * _tree(_sums(binned[i], n, g), _sums(binned[i], n, h))
            model.tables[i] += step
            total += step[binned[i]]

    def grid(i: int, j: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = len(model.pair_cuts[i]) + 1, len(model.pair_cuts[j]) + 1
        cell = coarse[i] * b + coarse[j]
        return cell, _sums(cell, a * b, g).reshape(a, b), _sums(cell, a * b, h).reshape(a, b)

    g, h = slope()
    gains = []
    for i in range(width):
        for j in range(i):
            _, gg, hh = grid(j, i, g, h)
            gains.append((-_pair_tree(gg, hh)[1], j, i))
    model.pairs = [(i, j) for _, i, j in sorted(gains)[:pairs]]
    model.pair_tables = [
        np.zeros((len(model.pair_cuts[i]) + 1, len(model.pair_cuts[j]) + 1)) for i, j in model.pairs
    ]
    for _ in range(rounds // 3):
        for k, (i, j) in enumerate(model.pairs):
            g, h = slope()
            cell, gg, hh = grid(i, j, g, h)
            step = RATE * _pair_tree(gg, hh)[0]
            model.pair_tables[k] += step
            total += step.ravel()[cell]
    return model


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([features(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64())),
            ],
            ["y", "x"],
        )


def held_out(doc_id: F.Column) -> F.Column:
    """Whether the CRC-32 of the id, as text, is divisible by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fits on labelled rows that are not held out, at most ``fit_rows`` of them.

    Where there are more, the ids with the smallest hashes are taken; that
    bound is what reaches the driver.  Labels without an id or a quality, and
    repeats of an id, are left out; of the texts of one id the smallest is taken.
    """
    usable = (
        labels.where("doc_id is not null and quality is not null")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("quality").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(fit_rows)
    )
    if fit_rows <= BROADCAST_ROWS:  # so few pairs of numbers go to every executor
        usable = F.broadcast(usable)
    rows = (
        docs.select("doc_id", F.col("text").cast("string").alias("text"))
        .join(usable, "doc_id")
        .groupBy("doc_id").agg(F.max("y").cast("int").alias("y"), F.min("text").alias("text"))
        .select("y", "text")
        .mapInArrow(_featured, "y int, x array<double>")
        .toArrow()
    )
    if not rows.num_rows:
        return fit(np.empty((0, len(FEATURES))), np.empty(0))
    x = np.array(rows.column("x").to_pylist(), np.float64)
    y = (rows.column("y").to_numpy() > 0).astype(np.float64)
    order = np.lexsort((*x.T, y))  # the order of rows must not matter
    return fit(x[order], y[order])


def quality_score(text: F.Column, model: Model) -> F.Column:
    """A column with the score, 0 to 1, of each text; null and empty texts are scored too."""

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        rows = np.array([features(t) for t in texts], np.float64).reshape(-1, len(FEATURES))
        return pd.Series(model.score(rows))

    return score(text)


def classify(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Scores come from the text alone.  Null and empty texts have features of
    zeros and a score like others; a null ``doc_id`` hashes like the empty text
    and is scored; repeated rows score alike; without labels every score is one
    half; an empty table gives no rows; other columns are not read.
    """
    model = train(docs, labels, fit_rows)
    return (
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            held_out(F.col("doc_id")).alias("held_out"),
            quality_score(F.col("text").cast("string"), model).alias("score"),
        )
        .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
    )


def keep_good(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, that the model does not reject."""
    model = train(docs, labels, fit_rows)
    return docs.where(quality_score(F.col("text").cast("string"), model) >= THRESHOLD)
