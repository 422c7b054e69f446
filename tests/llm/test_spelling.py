import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidegraph.llm import spelling

DOCS = "doc_id bigint, text string, word string"
LOWER = {c: c + 32 for c in range(65, 91)}


def one_edit(a, b):
    """By hand: one letter replaced, or one put in."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def drawn(seed, docs, letters="abcé", low=4, high=9):
    draw = random.Random(seed)
    stems = ["".join(draw.choice(letters) for _ in range(draw.randrange(low, high))) for _ in range(60)]
    rows = []
    for i in range(docs):
        some = []
        for _ in range(draw.randrange(5, 120)):
            w = draw.choice(stems[: draw.randrange(1, len(stems) + 1)])
            k = draw.randrange(len(w) + 1)
            w = draw.choice([w, w, w[:k] + draw.choice(letters) + w[k:], w[:k] + w[k + 1 :], w[:k] + draw.choice(letters) + w[k + 1 :], w.upper(), w.title()])
            some.append(w + draw.choice([" ", "-", "1", "\n", ", "]))
        rows.append((draw.choice([i, i, -i, 10**12 + i]), "".join(some), "clash"))
    return rows


@pytest.mark.parametrize("seed, letters", [(1, "abcé"), (2, "ab"), (3, "aÀ×÷ÿzß")])
def test_against_all_pairs(spark, seed, letters):
    rows = drawn(seed, 80, letters)
    found = {tuple(r) for r in spelling.variants(spark.createDataFrame(rows, DOCS)).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    expected = plain(rows)
    assert found == expected and len(found) > 100


def test_shared_rare_bigrams_never_miss():
    """The filter's promise, for every way of editing many drawn words under drawn orders."""
    draw = random.Random(5)
    for _ in range(3000):
        letters = draw.choice(["ab", "abc", "abcdefgh"])
        word = "".join(draw.choice(letters) for _ in range(draw.randrange(4, 12)))
        k, x = draw.randrange(len(word) + 1), draw.choice(letters)
        other = draw.choice([word[:k] + x + word[k:], word[:k] + x + word[k + 1 :]])
        order = {a + b: draw.randrange(4) for a in letters for b in letters}
        mine, theirs = spelling.rarest(word, order), spelling.rarest(other, order)
        assert any(g == h and 0 <= q - p <= (len(other) > len(word)) for g, p in mine for h, q in theirs)


def test_odd_tables(spark):
    long = "ab" * 20_000
    rows = [(None, "Hello hello HELLO hellp", "w"), (3, None, None), (4, "", "x"), (5, f"{long} {long} {long}c {long}", "y"), (5, "hello hello", "y"), (5, "hello hello", "y")]
    found = {tuple(r) for r in spelling.variants(spark.createDataFrame(rows, DOCS)).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert found == plain(rows)
    empty = spark.createDataFrame([], DOCS)
    assert spelling.variants(empty).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, "tiny word", "")], DOCS)).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(empty, least_length=3)


def test_ties_go_to_the_smallest(spark):
    text = "grata " * 6 + "grate " * 6 + "gratu " * 3 + "ngratu " * 3
    # And forms of forms of forms, to be followed to the end.
    text += "".join(f"{w} " * (3 * 2**k) for k, w in enumerate(["lomenid", "lomenit", "lumenit", "lumenits", "lumendits", "kumendits"]))
    df = spark.createDataFrame([(7, text, "")], DOCS).withColumn("n", F.lit(1))
    found = {tuple(r) for r in spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert found == plain([(7, text)])
    assert {r[0]: r[2] for r in found}["lomenid"] == "kumendits"


def test_lists_of_words_are_not_broadcast(spark):
    """What is listed for a word is many times as large as its file, so its estimate says nothing; here all of it is small."""
    words = [(a + b + c + d, 3 * 2 ** (ord(a) % 3)) for a in "abcdef" for b in ("rt", "st") for c in "xyz" for d in ("um", "us")]
    staged = spelling.staged(spark.createDataFrame(words, "word string, n bigint"), "words")
    pairs = spelling.near_pairs(staged)
    docs = spark.createDataFrame([(k, f"{w} " * n, "") for k, (w, n) in enumerate(words)], DOCS)
    found = spelling.variants(docs)
    for frame in (pairs, found):
        assert frame.collect()
        assert "Broadcast" not in frame._jdf.queryExecution().executedPlan().toString()
