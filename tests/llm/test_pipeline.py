"""The pipeline over a small folder, each stage against a plain version of itself."""

import hashlib
import math
import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_near_dedup import plain
from test_packing import check
from test_pii import CARD, EMAIL, IP, PHONE, luhn

from tidegraph.llm import quality
from tidegraph.llm.mixing import SEED, TEMPERATURE


def documents():
    draw = random.Random(11)
    vocabulary = ["".join(draw.choice("abdeiklmnorstu") for _ in range(draw.randrange(2, 9))) for _ in range(300)]
    rows = []
    for i in range(140):
        some = [draw.choice(vocabulary) for _ in range(draw.randrange(15, 90))]
        text = " ".join(some) + "."
        if i % 7 == 0:
            text = "!! ".join(w.upper() for w in some)
        if i % 9 == 0:
            # No value occurs in several texts, so no term has the evidence to be removed.
            text += f" write to user{i}@mail.example.com or +1 (555) 555-{i:04} at 10.0.0.{i}"
            text += " card 4111 1111 1111 1111" * (i == 9)
        rows.append((i, text, "en", "hot" if i % 3 else f"s{i % 5}"))
    rows += [(200 + i, rows[i][1], "en", "hot") for i in range(0, 30)]
    rows += [(300 + i, rows[i][1].replace(" ", "  ", 3), "en", None) for i in range(5, 20)]
    rows += [(400, None, None, None), (401, "", "en", "hot"), (402, "short", "en", "hot")]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    docs = documents()
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{at}/documents.parquet")
    labels = [(i, int(i % 7 != 0), 0) for i, *_ in docs if i < 140 and i % 2]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def cleaned(text):
    spans = []
    for kind, pattern in (("EMAIL", EMAIL), ("IP", IP), ("CARD", CARD), ("PHONE", PHONE)):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "EMAIL" or kind == "IP" and all(int(p) < 256 for p in m[0].split(".")) or kind == "CARD" and 16 <= len(digits) <= 19 and luhn(digits) or kind == "PHONE" and 8 <= len(digits) <= 15:
                spans.append((m.start(), -m.end(), f"[{kind}]"))
    out, at = "", 0
    for start, back, put in sorted(spans):
        if start >= at:
            out += text[at:start] + put
        at = max(at, -back)
    return out + text[at:]


def copies(doc_id, rate):
    parts = max(1, math.ceil(rate / 64))
    total = 0
    for part in range(1, parts + 1):
        u = int(hashlib.md5(f"{doc_id}:{part}:{SEED}".encode()).hexdigest()[:13], 16) / 2**52
        mass = reach = math.exp(-rate / parts)
        k = 0
        while reach <= u:
            k += 1
            mass *= rate / parts / k
            reach += mass
        total += k
    return total


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs.collect())

    model = quality.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    every = documents()
    good = model.score(np.array([quality.features(t) for _, t, *_ in every])) >= quality.THRESHOLD
    assert sorted(r["doc_id"] for r in kept[0]) == sorted(d[0] for d, g in zip(every, good) if g)
    assert {i for i in range(140) if i % 7} <= {r["doc_id"] for r in kept[0]}

    groups = plain([(r["doc_id"], r["text"]) for r in kept[0]])
    assert sorted(r["doc_id"] for r in kept[1]) == sorted(i for i, (_, low) in groups.items() if i == low)

    text = {r["doc_id"]: r["text"] for r in kept[1]}
    assert {r["doc_id"]: r["text"] for r in kept[2]} == {i: t and cleaned(t) for i, t in text.items()}
    assert all(r["n_chars"] == len(r["text"] or "") for r in kept[2])

    sizes = Counter(r["source"] for r in kept[2])
    scale = sum(n**TEMPERATURE for n in sizes.values())
    rate = {s: len(kept[2]) * n**TEMPERATURE / scale / n for s, n in sizes.items()}
    wanted = Counter({r["doc_id"]: copies(r["doc_id"], rate[r["source"]]) for r in kept[2]})
    assert Counter(r["doc_id"] for r in kept[3]) == +wanted

    pieces = Counter(r["doc_id"] for r in kept[4])
    assert sum(pieces.values()) == len(kept[3])
    once = {}
    for r in kept[4]:
        once.setdefault(r["doc_id"], r)
    clean = {r["doc_id"]: r["text"] for r in kept[3]}
    check([{**r.asDict(), "sequence_id": i, "offset": 0} for i, r in enumerate(once.values())], list(clean.items()), 2048)
    filled = {}
    for r in kept[4]:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and rows.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty_documents(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_copies_at_the_similarity_of_the_stage(spark):
    rows = []
    for i in range(60):
        words = [f"d{i}w{k}" for k in range(204)]  # 200 shingles
        # A tail of k other words: 200 - k of 200 + k shingles are common, 0.802 to 0.843.
        k = 17 + i % 6
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:-k] + [f"x{i}y{j}" for j in range(k)]))]
        if i % 6 == 5:
            assert 0.8 <= (200 - k) / (200 + k) < 0.81
    rows += [(1000, " ".join(f"a{k}" for k in range(204))), (1001, " ".join([f"a{k}" for k in range(181)] + [f"b{k}" for k in range(23)]))]  # 0.794
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(0, 120, 2), 1000, 1001]
