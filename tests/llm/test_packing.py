import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidegraph.llm import packing


def paths():
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


def test_ids_equal_the_tokenizers():
    exact = Tokenizer.from_file(paths()[1])
    draw = random.Random(1)
    parts = ["a", " b", "  ", "\n\n", "\t", "'s", "'S", "é", "ΣΑ", "😀", "中文", "123", "<|endoftext|>", "!!", "\u00a0", "\u200b", "\x00", "don't", "٣", "ａ", "\r\n", "_", "\u2028"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.choice([0, 1, 3, 10, 40]))) for _ in range(1500)]
    for text, got in zip(texts, exact.encode_batch(texts, add_special_tokens=False)):
        assert packing.token_ids(text, *paths()) == got.ids


def used(plan):
    total = Counter()
    for bin_, times in plan:
        for x in bin_:
            total[x] += times
    return total


@pytest.mark.parametrize("seed", range(6))
def test_plans_use_every_length(seed):
    draw = random.Random(seed)
    capacity = draw.choice([10, 50, 2048])
    counts = dict(Counter(draw.randint(1, capacity) for _ in range(draw.choice([1, 20, 300]))))
    plan = packing.bin_completion(counts, capacity, 2000).bins
    assert used(plan) == counts and all(sum(b) <= capacity and n > 0 for b, n in plan)
    size = sum(n for _, n in plan)
    assert packing.lower_bound(counts, capacity) <= size <= sum(n for _, n in packing._greedy(counts, capacity))


def fewest(items, capacity):
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins)}.values():
            if bins[k] + items[i] <= capacity:
                bins[k] += items[i]
                go(i + 1, bins)
                bins[k] -= items[i]
        bins.append(items[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(25))
def test_few_documents_are_packed_best(seed):
    draw = random.Random(seed)
    items = sorted((draw.randint(2, 14) for _ in range(10)), reverse=True)
    plan = packing.bin_completion(dict(Counter(items)), 20)
    assert plan.size == fewest(items, 20) and plan.least


def test_fewer_of_a_filling_than_there_could_be():
    """Two sequences of 9+4+4 are one too many: the best has one, and one of 9+6."""
    plan = packing.bin_completion({4: 4, 6: 5, 9: 2}, 17)
    assert plan.size == 4 and plan.least and used(plan.bins) == {4: 4, 6: 5, 9: 2}


def by_subsets(items, capacity):
    """Fewest sequences, and then the least in the last of them, for every subset."""
    best = [(0, capacity + 1)] * (1 << len(items))
    best[0] = (0, capacity)
    for mask in range(1, 1 << len(items)):
        best[mask] = min(
            (n, room + x) if room + x <= capacity else (n + 1, x)
            for k, x in enumerate(items) if mask >> k & 1 for n, room in [best[mask ^ (1 << k)]]
        )
    return best[-1][0]


def test_ten_thousand_drawn_cases_with_repeats():
    draw = random.Random(17)
    for _ in range(10_000):
        capacity = draw.randint(9, 30)
        sizes = [draw.randint(2, capacity * 2 // 3) for _ in range(draw.randint(1, 4))]
        items = [draw.choice(sizes) for _ in range(draw.randint(1, 8))]
        plan = packing.bin_completion(dict(Counter(items)), capacity)
        assert plan.least and used(plan.bins) == Counter(items) and all(sum(b) <= capacity for b, _ in plan.bins)
        assert plan.size == by_subsets(items, capacity), (capacity, items)


def test_a_search_cut_short_says_so():
    counts = {4: 4, 6: 5, 9: 2}
    plan = packing.bin_completion(counts, 17, steps=1)
    assert not plan.least and plan.size - plan.bound >= 1 and used(plan.bins) == counts


def test_branching_beats_best_fit():
    # Largest first fills 6+4 and leaves a third sequence.
    counts = {6: 1, 5: 1, 4: 1, 3: 1, 2: 1}
    assert packing.bin_completion(counts, 10).size == 2


def check(rows, texts, capacity):
    exact = Tokenizer.from_file(paths()[1])
    ids = {i: [*exact.encode(t or "", add_special_tokens=False).ids, 0] for i, t in texts}
    for i, whole in ids.items():
        own = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i)
        at = 0
        for k, (piece, start, length, crc) in enumerate(own):
            assert (piece, start) == (k, at) and (k == 0 or length == capacity)
            assert crc == zlib.crc32(np.array(whole[at : at + length], "<u4").tobytes())
            at += length
        assert at == len(whole)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_pack(spark):
    draw = random.Random(3)
    texts = [(i, " ".join(draw.choice(["alpha", "beta", "x1", "été"]) for _ in range(draw.choice([0, 1, 5, 30, 70, 300])))) for i in range(120)] + [(900, None), (901, "")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    rows = packing.pack(df, capacity=64).collect()
    n = check(rows, texts, 64)
    assert n == packing.lower_bound(Counter(r["length"] for r in rows), 64)
    assert packing.pack(df.limit(0)).count() == 0


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "c"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "7 as length", "'x' as rank")
    packed = packing.pack(df).collect()
    assert len(packed) == 4 and len({(r["sequence_id"], r["offset"]) for r in packed}) == 4


def test_cuts():
    assert packing.cuts(5, 8) == [0, 5] and packing.cuts(16, 8) == [0, 8, 16] and packing.cuts(17, 8) == [0, 1, 9, 17]
