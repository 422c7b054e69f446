import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tidegraph.llm import toxicity

DOCS = "doc_id bigint, text string, start int"
LABELS = "doc_id bigint, quality int, toxic int"
BAD = ["vremlig", "groaster", "snuff"]
GOOD = ["river", "lantern", "harbour", "quiet", "meadow", "stone", "evening", "slowly", "under", "bright"]


def labelled(n=700, seed=3):
    draw = random.Random(seed)
    docs, labels, bad = [], [], {}
    for i in range(n):
        some = [" ".join(draw.choice(GOOD) + "s" * draw.randrange(2) for _ in range(draw.randrange(3, 9))) for _ in range(draw.randrange(1, 30))]
        toxic = draw.random() < 0.3
        if toxic:
            k = draw.randrange(len(some))
            word = draw.choice(BAD)
            some[k] = some[k] + " " + draw.choice([word, word.upper(), word + "en"])
            bad[i] = k
        docs.append((i, ". ".join(some) + ".", 5))
        labels.append((i, 1, int(toxic)))
    return docs, labels, bad


def test_held_out_accuracy_and_places(spark):
    docs, labels, bad = labelled()
    d, y = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    found = {r["doc_id"]: r for r in toxicity.classify(d, y).collect()}
    held = [i for i, _, _ in docs if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in found.items() if r["held_out"]} == set(held)
    assert all(found[i]["predicted"] == (i in bad) for i in held)
    for i in held:
        if i in bad:  # the sentence that holds the word is the one that is found
            place = docs[i][1][found[i]["worst_start"] : found[i]["worst_end"]].lower()
            assert any(w in place for w in BAD) and found[i]["n_sentences"] == 1
        else:
            assert found[i]["worst_start"] is None and found[i]["n_sentences"] == 0
    # Labels of held-out rows change nothing.
    flipped = y.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r["doc_id"]: r["score"] for r in toxicity.classify(d, flipped).collect()} == {i: r["score"] for i, r in found.items()}
    model = toxicity.train(d, y)
    listed = {r["doc_id"]: r for r in toxicity.offending(d, model).collect()}
    assert {i for i in listed if i in held} == {i for i in held if i in bad}
    assert all(docs[i][1][r["start"] : r["end"]] == r["sentence"] for i, r in listed.items())


def test_score_is_the_noisy_or_of_sentences():
    """A score against the definition, sentence by sentence and feature by feature."""
    names = ["^stone$", "tone", "lant", "^bri"]
    model = toxicity.Model({f: i for i, f in enumerate(names)}, np.array([3.0, 1.5, -2.0, 7.0]), -5.0, -4.0)
    text = "Stone stones lantern. Bright\nquiet quiet! lantern of stone"

    def chance(z):
        return 1 / (1 + np.exp(-z))

    clean = 1 - chance(-4.0)
    for part in ("Stone stones lantern.", " Bright\n", "quiet quiet!", " lantern of stone"):
        have = {p for w in part.lower().replace(".", "").replace("!", "").split() for p in toxicity.pieces(w)}
        clean *= 1 - chance(-5.0 + sum(w for f, w in zip(names, (3.0, 1.5, -2.0, 7.0)) if f in have))
    score, marked = model.read(text)
    assert abs(score - (1 - clean)) < 1e-12 and [text[a:b] for a, b, _ in marked] == ["Stone stones lantern.", " Bright\n", " lantern of stone"]


def test_sentences_cover_the_text():
    draw = random.Random(2)
    for _ in range(300):
        text = "".join(draw.choice("ab .\n!é…") * draw.choice([1, 1, 1, 30, 500]) for _ in range(draw.randrange(30)))
        spans = list(toxicity.sentences(text))
        assert "".join(text[a:b] for a, b in spans) == text and all(a < b for a, b in spans)


def test_gradient_fit_against_direct_maximum():
    """One feature and one sentence a document: the fit is plain counting."""
    y = np.array([1.0] * 30 + [0.0] * 10 + [0.0] * 60)
    bags = [[np.array([0])]] * 40 + [[]] * 60
    plain = np.array([0.0] * 40 + [1.0] * 60)
    weights, bias, leak = toxicity.fit(y, plain, bags, 1)
    chance = lambda z: 1 / (1 + np.exp(-z))
    with_it = 1 - (1 - chance(leak)) * (1 - chance(bias + weights[0]))
    assert abs(with_it - 0.75) < 0.05 and 1 - (1 - chance(leak)) * (1 - chance(bias)) < 0.02


def test_odd_tables(spark):
    docs, labels, _ = labelled(160)
    odd = [(None, "snuff", 1), (900, None, 1), (901, "", 1), (902, "snuff " * 40_000, 1), (902, "snuff " * 40_000, 1), (903, "...!\n\n", 1), (904, "river " * 40_000, 1)]
    d, y = spark.createDataFrame(docs + odd, DOCS), spark.createDataFrame(labels + [(None, 1, 1), (5, 1, None), (6, None, 0), (900, 1, 0)], LABELS)
    rows = toxicity.classify(d, y).collect()
    assert len(rows) == len(docs) + len(odd) and all(0 <= r["score"] <= 1 for r in rows)
    score = {r["doc_id"]: r["score"] for r in rows}
    assert score[900] == score[901] < 0.3 and score[902] > 0.9 and score[904] < 0.3
    assert sum(r["doc_id"] == 902 for r in rows) == 2
    assert toxicity.classify(d.limit(0), y).count() == 0
    assert {r["predicted"] for r in toxicity.classify(d, y.limit(0)).collect()} == {1}  # nothing is known: one half
    clean = {r["score"] for r in toxicity.classify(d, y.where("toxic = 0")).collect()}
    assert max(clean) < 0.05
