import random

from tidegraph.llm import near_dedup
from tidegraph.llm.shingles import MinHasher, shingle_set, words
from tidegraph.operators.components import star_components

WS = " \t\n\x0b\x0c\r"


def plain_shingles(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in WS:
            if word:
                out.append(word)
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    if not out:
        return set()
    k = min(5, len(out))
    return {tuple(out[i : i + k]) for i in range(len(out) - k + 1)}


def plain(rows):
    sets = [plain_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return {rows[i][0]: (len(sets[i]), min(groups[find(i)])) for i in range(len(rows))}


def corpus(seed, bases=25):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "naïve", "ΣΑΣ"]
    rows = []
    for _ in range(bases):
        base = [draw.choice(vocabulary) for _ in range(draw.choice([1, 3, 5, 8, 40, 120, 300]))]
        for _ in range(draw.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(draw.choice([0, 0, 1, 2, 4, 9])):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            sep = draw.choice([" ", "\n", "\t ", "\x0b"])
            rows.append(sep.join(w.upper() if draw.random() < 0.1 and w.isascii() else w for w in copy))
    rows += ["", "   ", None, "One", "one", "\u00a0", "\u2003 x"]
    draw.shuffle(rows)
    return list(enumerate(rows, 100))


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return near_dedup.near_duplicates(df).collect()


def test_against_all_pairs(spark):
    rows = corpus(1)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in run(spark, rows)}
    assert found == plain(rows)


def test_large_group_whose_members_differ(spark):
    draw = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(80):
        copy = list(base)
        for k in draw.sample(range(200), draw.choice([1, 2, 3, 5])):
            copy[k] = f"x{draw.random()}"
        rows.append((i, " ".join(copy)))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in run(spark, rows)}
    assert found == plain(rows)


def test_odd_rows(spark):
    rows = [(5, "a b c"), (5, "a b c"), (None, "a b c"), (None, "only here"), (7, None), (8, ""), (9, "A B\nC")]
    found = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in run(spark, rows)]
    assert sorted(found, key=str) == sorted(
        [(5, 1, 5, True), (5, 1, 5, True), (None, 1, 5, False), (None, 1, None, True), (7, 0, 7, True), (8, 0, 8, True), (9, 1, 5, False)],
        key=str,
    )
    assert run(spark, []) == []
    odd = spark.createDataFrame([(1, "x y", 3, "k")], "doc_id bigint, text string, component_id int, digest string")
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == 1


def test_keep_one(spark):
    rows = [(3, "a b c d e f g"), (2, "A b c d e f g"), (2, "A b c d e f g"), (4, "other"), (6, None), (7, None)]
    kept = near_dedup.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 6, 7]


def test_one_id_with_several_texts(spark):
    """Each text is placed by itself: a clean one stays when another of its id is a copy."""
    copy = " ".join(f"w{i}" for i in range(60))
    rows = [(3, copy), (5, copy + " more"), (5, "something else that nobody copied at all"), (5, "something else that nobody copied at all"), (9, copy)]
    found = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in run(spark, rows))
    assert found == [(3, 56, 3, True), (5, 3, 5, True), (5, 3, 5, True), (5, 57, 3, False), (9, 56, 3, False)]
    left = near_dedup.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted((r["doc_id"], r["text"]) for r in left.collect()) == [(3, copy), (5, "something else that nobody copied at all")]
    case = spark.createDataFrame([(1, "A b"), (1, "a B"), (None, "a b"), (None, "x"), (None, "x")], "doc_id bigint, text string")
    assert sorted(r["doc_id"] or 0 for r in near_dedup.keep_one(case).collect()) == [0, 0, 1]


def test_components(spark):
    draw = random.Random(4)
    pairs = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(0, i) for i in range(1, 60)]
    root = list(range(300))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    found = {r["node"]: r["component"] for r in star_components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    assert found == {x: find(x) for p in pairs if p[0] != p[1] for x in p}


def test_signature_estimates_similarity():
    a, b = shingle_set(" ".join(map(str, range(400)))), shingle_set(" ".join(map(str, range(60, 460))))
    hasher = MinHasher(512)
    true = len(set(a) & set(b)) / len(set(a) | set(b))
    assert abs((hasher.minima(a) == hasher.minima(b)).mean() - true) < 0.08
    assert words("Ab\u00a0C \tD") == ["ab\u00a0c".encode(), b"d"] and len(shingle_set("a " * 9)) == 1
