"""Spelling variants: words one edit apart, found by their rarest positional bigrams."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: A word's fewest code points, and its fewest occurrences.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A form occurs at least so many times as often as the word it stands for.
TIMES = 2
#: One in so many runs of a document loses a code point.
SLIPS = 97
#: One edit touches at most two bigrams, so two words one edit apart share one of their three rarest.
RAREST = 3
#: Distinct words a task counts before it passes them on.
HELD = 200_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _counted(least: int):
    """Words of whole texts with their counts, summed up within a task before they are dealt."""
    # A shorter run cannot give a word, and a maximal run of this length or more is found whole.
    runs = re.compile(f"[a-zÀ-ÿ]{{{least},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1)):
                name, text = name.as_py(), text.as_py()
                if not text:
                    continue
                low = text.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")
                start = zlib.crc32(f"{name or ''}:".encode())
                for run, n in Counter(runs.findall(low)).items():
                    h = zlib.crc32(run.encode(), start)
                    if h % SLIPS == 0:
                        k = h % len(run)
                        run = run[:k] + run[k + 1 :]
                        if len(run) < least:
                            continue
                    held[run] += n
                if len(held) > HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return count


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n``: the words of all texts that are long and frequent enough."""
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = texts.mapInArrow(_counted(least_length), "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def bigram_order(words: DataFrame) -> dict[str, int]:
    """How many times each bigram occurs in ``words``; its size is bounded by the square of the alphabet, 90 letters."""
    at = F.sequence(F.lit(1), F.length("word") - 1)
    grams = words.select(F.explode(F.transform(at, lambda i: F.substring(F.col("word"), i, F.lit(2)))).alias("g"))
    return {r["g"]: r["n"] for r in grams.groupBy("g").agg(F.count("*").alias("n")).collect()}


def rarest(word: str, order: dict[str, int]) -> list[tuple[str, int]]:
    """The three rarest bigrams of a word with their places, ties by bigram and place.

    The order is one for all words, and equal bigrams go by place; so of two words
    one edit apart some bigram is among the three of both, its places at most one apart.
    """
    grams = [word[i : i + 2] for i in range(len(word) - 1)]
    chosen = sorted((order.get(g, 0), g, i) for i, g in enumerate(grams))[:RAREST]
    return [(g, i) for _, g, i in chosen]


def _with_rarest(order: dict[str, int]):
    kind = pa.list_(pa.struct([("g", pa.string()), ("p", pa.int32())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"g": g, "p": p} for g, p in rarest(w, order)] for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, kind)], ["word", "n", "grams"])

    return find


def _key(place: Column, length: Column, side: int, part: Column) -> Column:
    return F.xxhash64(F.col("g"), place, length, F.lit(side), part)


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, n_a, b, n_b``: every pair of ``word, n`` exactly one edit apart, once.

    ``words`` is staged and its words are distinct.  A word meets others in its
    three rarest bigrams, at the same place or one on, and of its own length or one
    more.  An edit leaves the first or the last letters alone, up to half of the
    longer word's; so a bigram's bucket is cut up by these halves, and none grows
    with the number of words that merely share it.  Whoever meets is verified.
    Spark takes what is listed here for no larger than ``words`` was in its file, a small
    part of what it holds in memory, so the join is told not to be a broadcast.
    """
    grams = words.mapInArrow(_with_rarest(bigram_order(words)), "word string, n bigint, grams array<struct<g: string, p: int>>")
    listed = grams.select("word", "n", F.length("word").alias("len"), F.inline("grams"))
    w, size, place = F.col("word"), F.col("len"), F.col("p")

    def half(longer: Column) -> Column:
        return F.floor((longer - 1) / 2).cast("int")

    def first(k: Column) -> Column:
        return F.substring(w, F.lit(1), k)

    def last(k: Column) -> Column:
        return F.substring(w, size - k + 1, k)

    k, k1 = half(size), half(size + 1)
    same = F.array(_key(place, size, 0, first(k)), _key(place, size, 1, last(k)))
    on = place + 1
    more = size + 1
    # Bigrams within the letters left alone can only be where those letters are.
    longer = F.array_compact(F.array(
        _key(place, more, 0, first(k1)), F.when(place + 2 > k1, _key(on, more, 0, first(k1))),
        _key(on, more, 1, last(k1)), F.when(place < size - k1, _key(place, more, 1, last(k1))),
    ))
    index = listed.select(F.explode(same).alias("key"), w.alias("b"), F.col("n").alias("n_b"), size.alias("len_b"))
    probe = listed.select(F.explode(F.concat(same, longer)).alias("key"), w.alias("a"), F.col("n").alias("n_a"), size.alias("len_a"))
    met = probe.join(index.hint("merge"), "key").where("len_b = len_a + 1 or (len_b = len_a and a < b)")
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` by following ``word, form`` to the end, doubling the steps.

    A form is at least twice as frequent, so a chain has no more links than a count
    has bits.
    """
    now = staged(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not now.where("moved").isEmpty():
        on = now.select(F.col("word").alias("root"), F.col("root").alias("on"))
        now = staged(
            now.join(on.hint("merge"), "root", "left").select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")), "roots"
        )
    return now.select("word", "root")


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every frequent word of all texts.

    ``form`` is the most frequent of the words one edit apart, ties to the smallest,
    if it is ``times`` as frequent as the word; ``root`` is where forms lead in the
    end.  Null and empty texts have no words; a null ``doc_id`` counts as an empty
    one where slips are made; rows that repeat count again; words of any length are
    words; an empty table gives no rows; other columns are not read.
    """
    if least_length < RAREST + 1:
        raise ValueError("words of fewer letters may lose all their bigrams by one edit")
    words = staged(word_counts(docs, least_length, least_count), "words")
    pairs = near_pairs(words)
    both = pairs.select(F.inline(F.array(
        F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("m")),
        F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("other"), F.col("n_a").alias("m")),
    )))
    near = both.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"), F.first("n").alias("own")
    )
    stands = -F.col("best.less") >= times * F.col("own")
    near = staged(near.select(
        "word", "n_near", F.when(stands, F.col("best.other")).alias("form"), F.when(stands, -F.col("best.less")).alias("form_n")
    ), "near")
    roots = _roots(near.where("form is not null"))
    # A file of words is a tenth of what they take up in memory: none of them is broadcast.
    return words.join(near.hint("merge"), "word", "left").join(roots.hint("merge"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n",
    )
