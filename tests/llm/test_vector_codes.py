import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegraph.llm import vector_codes

ROWS = "vec_id bigint, embedding array<float>, label int"


def plain(rows, entries=256, rounds=4, scale=1024):
    """Every part against every entry, with whole numbers of any size."""
    kept = []
    for i, v, label in rows:
        if v is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(scale * float(np.float32(x))) for x in v], label))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    width = len(kept[0][1]) // 4
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[part(v, p) for _, v, _ in kept[:entries]] for p in range(4)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(4):
            groups = defaultdict(list)
            for _, v, _ in kept:
                groups[nearest(part(v, p), books[p])[1]].append(part(v, p))
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])]
    out, by_label = [], defaultdict(int)
    for i, v, label in kept:
        best = [nearest(part(v, p), books[p]) for p in range(4)]
        error = sum(d for d, _ in best)
        by_label[label] += error
        out.append((i, "".join(f"{k:02x}" for _, k in best), error, label))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, c, e, by_label[la], sha) for i, c, e, la in out)


def found(df, **kw):
    return sorted(tuple(r) for r in vector_codes.compress(df, **kw).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


@pytest.mark.parametrize("seed, spread, entries", [(1, 1.0, 16), (2, 0.004, 16), (3, 900.0, 256)])
def test_against_plain(spark, seed, spread, entries):
    """Also with so few distinct values that ties abound, and with components of thousands."""
    draw = random.Random(seed)
    rows = [(i * 3 + 1, [draw.gauss(0, spread) for _ in range(8)], draw.choice([None, 1, 1, 1, 2])) for i in range(400)]
    draw.shuffle(rows)
    assert found(spark.createDataFrame(rows, ROWS), entries=entries) == plain(rows, entries)


def test_search_against_all_distances():
    """Any start gives the nearest entry, ties to the lower index, beyond exact floats too."""
    draw = np.random.default_rng(4)
    for top, n in ((3, 256), (2000, 100), (2**23, 60)):
        entries = draw.integers(-top, top + 1, (n, 5))
        rows, start = draw.integers(-top, top + 1, (500, 5)), draw.integers(0, n, 500)
        square = ((rows[:, None] - entries[None]) ** 2).sum(2)
        best, least = vector_codes.Codebook(entries).nearest(rows, start)
        assert (best == square.argmin(1)).all() and (least == square.min(1)).all()


def test_search_leaves_far_entries_out():
    """Two far groups of entries: rows that start in theirs never look at the other."""
    draw = np.random.default_rng(6)
    entries = np.concatenate([draw.integers(0, 50, (100, 4)), draw.integers(10_000, 10_050, (100, 4))])
    book = vector_codes.Codebook(entries)
    looked = []
    plain_distances = book._distances
    book._distances = lambda rows, ids: looked.append(ids) or plain_distances(rows, ids)
    book.nearest(draw.integers(0, 50, (300, 4)), draw.integers(0, 100, 300))
    assert max(i.max() for i in looked) < 100 and np.mean([len(i) for i in looked]) < 100


def test_odd_tables(spark):
    draw = random.Random(8)
    rows = [(i, [draw.uniform(-1, 1) for _ in range(4)], None) for i in range(20)]
    bad = [(90, None, 1), (91, [0.1, None, 0.2, 0.3], 1), (92, [math.inf, 0.0, 0.0, 0.0], 1), (93, [math.nan] * 4, 1), (94, [], 1), (95, [0.5] * 3, 1), (96, [0.5] * 8, 1)]
    df = spark.createDataFrame(rows + bad, ROWS).withColumn("code", F.lit("clash")).withColumn("error", F.lit(1))
    assert found(df) == plain(rows)
    again = spark.createDataFrame(rows + rows + [(None, [0.25] * 4, 7)], ROWS)
    some = vector_codes.compress(again).collect()
    assert len(some) == 41 and sum(r["vec_id"] is None for r in some) == 1
    assert vector_codes.compress(df.limit(0)).count() == 0
    assert vector_codes.compress(spark.createDataFrame(bad[:4], ROWS)).count() == 0
    with pytest.raises(Exception, match="must stay below"):
        vector_codes.compress(spark.createDataFrame([(1, [1e9, 0.0, 0.0, 0.0], 1)], ROWS)).collect()


def test_many_labels(spark, monkeypatch):
    """Beyond what is broadcast, rows of a label are dealt over buckets, nulls too."""
    rows = spark.createDataFrame([(i, f"{i:08x}", i % 5, None if i % 3 else i % 4) for i in range(200)], "vec_id bigint, code string, error bigint, label int")
    monkeypatch.setattr(vector_codes, "BROADCAST_ROWS", 0)
    total = {r["label"]: r["s"] for r in rows.groupBy("label").agg(F.sum("error").alias("s")).collect()}
    out = vector_codes.with_label_error(rows).collect()
    assert len(out) == 200 and all(r["label_error"] == total[r["label"]] for r in out)
