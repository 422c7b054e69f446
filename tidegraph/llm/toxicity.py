"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows the model is fitted on, at most.
FIT_ROWS = 20_000
#: Ids with a label that are small enough to be broadcast.
BROADCAST_ROWS = 1_000_000
#: Words, and pieces of words, that the model knows.
FEATURES = 4096
#: Lengths of pieces; a word's ends count as letters.
PIECES = (3, 4, 5, 6)
#: Beginnings and ends of a word, up to this length, are pieces too: stems and what is hung on them.
ENDS = 10
#: The longest word that is cut into pieces; of longer ones only the whole counts.
LONGEST_WORD = 40
#: Likelihood ratio, twice its logarithm, from which a feature is used at all.
LEAST_RATIO = 15.0
STEPS, RATE, DECAY = 200, 0.1, 2e-5
THRESHOLD = 0.3
#: Distinct features a task counts before it passes them on.
HELD = 300_000

# A sentence ends at a mark or a line's end, or behind the word that reaches its 400th code point.
_SENTENCE = re.compile(r"[^.!?…\n]{1,400}[^\s.!?…]*[.!?…\n]*|[.!?…\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str | None) -> Iterator[tuple[int, int]]:
    """Start and end of each sentence; together they cover the whole text."""
    for m in _SENTENCE.finditer(text or ""):
        yield m.span()


def pieces(word: str) -> set[str]:
    """The word itself, between its ends, short runs of letters in it, and its longer beginnings and ends."""
    whole = f"^{word}$"
    if len(word) > LONGEST_WORD:
        return {whole}
    ends = range(PIECES[-1] + 1, min(ENDS, len(whole)))
    inner = (whole[i : i + k] for k in PIECES for i in range(len(whole) - k + 1))
    return {whole, *inner, *(whole[:k] for k in ends), *(whole[-k:] for k in ends)}


def held_out(doc_id: Column) -> Column:
    """Whether the CRC-32 of the id, as text, leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


@dataclass
class Model:
    """A weight for each feature, a sentence's bias, and what any document may owe to nothing in it."""

    features: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -8.0
    leak: float = 0.0  # a logit

    def __post_init__(self):
        self._finder: ahocorasick.Automaton | None = None
        self._listed = [float(w) for w in self.weights]

    def __getstate__(self):
        return {**self.__dict__, "_finder": None}  # built anew where it is needed

    def found(self, sentence: str) -> set[int]:
        """The features of a sentence, by number: one pass over its words, ends marked, finds all pieces."""
        if self._finder is None:
            self._finder = ahocorasick.Automaton()
            for feature, i in self.features.items():
                self._finder.add_word(feature, i)
            self._finder.make_automaton()
        words = _WORD.findall(sentence.lower())
        if not words or not self.features:
            return set()
        out = {self.features.get(f"^{w}$", -1) for w in words if len(w) > LONGEST_WORD}
        if out:
            out.discard(-1)
            words = [w for w in words if len(w) <= LONGEST_WORD]
        out.update(i for _, i in self._finder.iter(f"^{'$^'.join(words)}$"))
        return out

    def read(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """A document's score, and start, end and score of each sentence with a feature."""
        weights, plain, marked, clean = self._listed, 0, [], [-_softplus(self.leak)]
        for start, end in sentences(text):
            ids = self.found(text[start:end])
            if not ids:
                plain += 1
                continue
            # The sum is the exact one, rounded once, so that the order of features does not matter.
            low = -_softplus(self.bias + math.fsum([weights[i] for i in ids]))
            clean.append(low)
            marked.append((start, end, -math.expm1(low)))
        clean.append(-plain * _softplus(self.bias))
        return -math.expm1(math.fsum(clean)), marked


def _softplus(z: float) -> float:
    return max(z, 0.0) + math.log1p(math.exp(-abs(z)))


def fit(y: np.ndarray, plain: np.ndarray, bags: list[list[np.ndarray]], n: int) -> tuple[np.ndarray, float, float]:
    """Weights, bias and leak under which labels are likeliest, by gradient steps on all documents.

    ``plain`` counts a document's sentences without features, ``bags`` holds those with
    some.  A document is clean if every sentence is and nothing else speaks against it:
    the noisy-or of its sentences' scores and the leak.
    """
    flat = [s for bag in bags for s in bag]
    owner = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    entry = np.concatenate(flat) if flat else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(flat)), [len(s) for s in flat])
    share = (y.sum() + 0.5) / (len(y) + 1)
    state = np.zeros(n + 2)
    state[n], state[n + 1] = -8.0, np.log(share / (1 - share)) - 2
    first, second = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, STEPS + 1):
        w, b, c = state[:n], state[n], state[n + 1]
        z = b + np.bincount(row, weights=w[entry], minlength=len(flat))
        clean = -np.logaddexp(0, c) - plain * np.logaddexp(0, b) - np.bincount(owner, weights=np.logaddexp(0, z), minlength=len(y))
        # How the log-likelihood moves with a document's log-chance to be clean.
        pull = np.where(y > 0, -1 / np.expm1(np.minimum(-clean, 700).clip(1e-9)), 1.0)
        by_sentence = pull[owner] / (1 + np.exp(-z.clip(-500, 500)))
        grad = np.empty_like(state)
        grad[:n] = np.bincount(entry, weights=by_sentence[row], minlength=n) / len(y) + DECAY * w
        grad[n] = (by_sentence.sum() + (pull * plain).sum() / (1 + np.exp(-b))) / len(y)
        grad[n + 1] = pull.mean() / (1 + np.exp(-c))
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        state = state - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return state[:n], float(state[n]), float(state[n + 1])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and other documents of a task each feature is."""
    held: dict[str, list[int]] = {}
    known: dict[str, set[str]] = {}

    def out() -> pa.RecordBatch:
        both = np.array(list(held.values()), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(both[:, 0]), pa.array(both[:, 1])], ["feature", "toxic", "other"])

    for batch in batches:
        for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            have: set[str] = set()
            for word in set(_WORD.findall((text or "").lower())):
                cut = known.get(word)
                if cut is None:
                    if len(known) >= HELD // 10:
                        known.clear()
                    cut = known[word] = pieces(word)
                have |= cut
            k = 0 if y else 1
            for f in have:
                pair = held.get(f)
                if pair is None:
                    held[f] = pair = [0, 0]
                pair[k] += 1
            if len(held) > HELD:
                yield out()
                held.clear()
    if held:
        yield out()


def _ratio(toxic: Column, other: Column, n: int, m: int) -> Column:
    """Twice the log-likelihood ratio of a feature that tells ``n`` toxic documents from ``m`` others."""

    def term(k: Column, expected: Column) -> Column:
        return F.when(k > 0, k * F.log(k / expected)).otherwise(F.lit(0.0))

    share = (toxic + other) / F.lit(float(n + m))
    return 2 * (term(toxic, n * share) + term(n - toxic, n * (1 - share)) + term(other, m * share) + term(m - other, m * (1 - share)))


def _bagged(model: Model):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain, sizes, ids = [], [], []
            for text in batch.column(1).to_pylist():
                bag = [sorted(model.found(text[a:b])) for a, b in sentences(text)]
                plain.append(sum(not s for s in bag))
                some = [s for s in bag if s]
                sizes.append(np.array([len(s) for s in some], "<i4").tobytes())
                ids.append(np.array([i for s in some for i in s], "<i4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(plain, pa.int64()), pa.array(sizes, pa.binary()), pa.array(ids, pa.binary())], ["y", "plain", "sizes", "ids"]
            )

    return read


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, features: int = FEATURES) -> Model:
    """Fits on labelled rows that are not held out, at most ``fit_rows`` of them.

    Where there are more, the ids with the smallest hashes are taken; that bound,
    and ``features``, are what reach the driver.  Labels without an id or a value,
    and repeats of an id, are left out; of the texts of one id the smallest is taken.
    """
    usable = (
        labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    )
    if fit_rows <= BROADCAST_ROWS:  # so few pairs of numbers go to every executor
        usable = F.broadcast(usable)
    rows = (
        docs.select("doc_id", F.col("text").cast("string").alias("text")).join(usable, "doc_id")
        .groupBy("doc_id").agg(F.max((F.col("y") > 0).cast("int")).alias("y"), F.min("text").alias("text")).select("y", "text")
    )
    shares = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    m, n = shares.get(0, 0), shares.get(1, 0)
    if not m or not n:
        share = (n + 0.5) / (n + m + 1)
        return Model(bias=-40.0, leak=float(np.log(share / (1 - share))))
    counts = rows.mapInArrow(_counted, "feature string, toxic bigint, other bigint").groupBy("feature").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other")
    )
    scored = counts.withColumn("ratio", _ratio(F.col("toxic"), F.col("other"), n, m)).where(F.col("ratio") >= LEAST_RATIO)
    chosen = scored.orderBy(F.desc("ratio"), "feature").limit(features).select("feature").collect()
    model = Model({r["feature"]: i for i, r in enumerate(chosen)}, np.zeros(len(chosen)))
    table = rows.mapInArrow(_bagged(model), "y int, plain bigint, sizes binary, ids binary").toArrow().to_pylist()
    table.sort(key=lambda r: (r["y"], r["plain"], r["sizes"], r["ids"]))  # the order of rows must not matter
    bags = [np.split(np.frombuffer(r["ids"], "<i4"), np.frombuffer(r["sizes"], "<i4").cumsum()[:-1]) if r["sizes"] else [] for r in table]
    y, plain = (np.array([r[c] for r in table], np.float64) for c in ("y", "plain"))
    return Model(model.features, *fit(y, plain, bags, len(chosen)))


def _scored(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, marked, worst = [], [], []
            for text in batch.column(2):
                total, found = model.read(text.as_py())
                bad = [s for s in found if s[2] >= THRESHOLD]
                scores.append(total)
                marked.append(len(bad))
                worst.append(max(bad, key=lambda s: (s[2], -s[0]))[:2] if bad else (None, None))
            starts, ends = ([w[k] for w in worst] for k in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array(marked, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
                ["doc_id", "held_out", "score", "n_sentences", "worst_start", "worst_end"],
            )

    return score


def classify(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``, and what speaks for it.

    ``n_sentences`` counts the sentences that alone reach the threshold, and
    ``worst_start`` and ``worst_end`` are the place of the worst, in code points, null if
    there is none.  Scores come from whole texts alone.  Null and empty texts have the
    leak's score; a null ``doc_id`` hashes like the empty text; repeated rows score
    alike; without labels of both kinds every score is the smoothed share of toxic
    ones, or nearly; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text")
    )
    scored = rows.mapInArrow(
        _scored(train(docs, labels, fit_rows)),
        "doc_id bigint, held_out boolean, score double, n_sentences bigint, worst_start bigint, worst_end bigint",
    )
    predicted = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", "held_out", "score", predicted, "n_sentences", "worst_start", "worst_end")


def offending(docs: DataFrame, model: Model, least: float = THRESHOLD) -> DataFrame:
    """``doc_id, start, end, score, sentence``: every sentence that alone scores ``least`` or more."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (doc_id, a, b, p, text[a:b])
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for a, b, p in model.read(text)[1]
                if p >= least
            ]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string())
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "start", "end", "score", "sentence"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(find, "doc_id bigint, start bigint, end bigint, score double, sentence string")
