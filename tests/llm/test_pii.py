import hashlib
import random
import re

from tidegraph.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    text = text or ""
    out = {k: [] for k in pii.KINDS}
    for kind, pattern in zip(pii.KINDS, (EMAIL, IP, CARD, PHONE)):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else True,
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out[kind].append((m.start(), m.end()))
    joined = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in out[k])
    return {**{f"n_{k}": len(out[k]) for k in pii.KINDS}, "base_sha256": hashlib.sha256(joined.encode()).hexdigest(), "joined": joined}


def texts(seed, n=400):
    draw = random.Random(seed)
    pieces = [
        "a", "b.c", "@", "x@y", ".", ".com", "..", "-", "_", "%", "+", " ", "\n", "1", "12", "255", "256", "0255", "1.2.3.4", "9.9.9.9.9",
        "4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111-1", "+1 (555) 555-0100", "+49", "(", ")", "é", "😀", "\u00a0", "٣", "me@mail.example.com",
        "44657583828894370", "00000000000000000000",
    ]
    return ["".join(draw.choice(pieces) for _ in range(draw.choice([1, 3, 8, 20, 60]))) for _ in range(n)]


def run(spark, rows, **settings):
    return pii.report(spark.createDataFrame(rows, "doc_id bigint, text string"), **settings).collect()


def test_base_spans_against_plain(spark):
    rows = [*enumerate(texts(1)), (1000, None), (1001, ""), (1002, "1" * 20000 + "." * 20000 + "a" * 20000 + "@"), (1003, "x.y" * 4000 + "@" + "a.b" * 4000)]
    wanted = {i: plain(t) for i, t in rows}
    found = run(spark, rows)
    assert len(found) == len(rows)
    for r in found:
        want = wanted[r["doc_id"]]
        assert {k: r[k] for k in want if k != "joined"} == {k: v for k, v in want.items() if k != "joined"}
        assert r["spans"].startswith(want["joined"])


def secrets():
    filler = ["the weather was mild on that day", "nothing else happened in town", "people went home early again"]
    draw = random.Random(8)
    own = ["the weather " + " ".join("".join(draw.choice("aeioklmnst") for _ in range(6)) for _ in range(40)) for _ in range(4)]
    rows = [(i, f"{own[i]} the weather zephyrine wrote from boss@acme.example.com, {filler[i % 3]}") for i in range(4)]
    return rows + [(10 + i, f"{filler[i % 3]} number {i} the the weather") for i in range(60)]


def test_disclosing_terms(spark):
    rows = secrets()
    found = {r["doc_id"]: r for r in run(spark, rows)}
    for i, text in rows[:4]:
        at = text.index("zephyrine")
        assert f"term:{at}:{at + 9}" in found[i]["spans"].split(",")
        assert not any(text[int(a) : int(b)] in ("weather", "the") for k, a, b in (s.split(":") for s in found[i]["spans"].split(",")) if k == "term")
    assert all(found[i]["n_term"] == 0 for i, _ in rows[4:])
    # Copies of one text are one context, which is no evidence, edited or not.
    copies = [(i, rows[0][1].replace("weather", "weather " * (i % 3))) for i in range(9)] + rows[4:]
    assert all(r["n_term"] == 0 for r in run(spark, copies))


def test_sanitise(spark):
    rows = [(1, "call +1 (555) 555-0100 or me@x.example.com now", 46), (2, None, 0), (3, "clean", 5), (1, "call +1 (555) 555-0100 or me@x.example.com now", 46)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")
    clean = pii.sanitise(df)
    assert clean.columns == df.columns
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in clean.where("doc_id <> 2").collect()) == [
        (1, "call [PHONE] or [EMAIL] now", 27), (1, "call [PHONE] or [EMAIL] now", 27), (3, "clean", 5)
    ]
    assert clean.where("doc_id = 2").first()["text"] is None
    told = {r["doc_id"]: r["text"] for r in pii.sanitise(spark.createDataFrame(secrets(), "doc_id bigint, text string")).collect()}
    assert "zephyrine" not in told[0] and "acme" not in told[0] and "weather" in told[0]


def test_odd_tables(spark):
    assert run(spark, []) == []
    odd = spark.createDataFrame([(None, "9 a@b.example.org", "x")], "doc_id bigint, text string, _key string")
    assert pii.report(odd).first()["n_email"] == 1
    assert pii.sanitise(odd).first()["text"] == "9 [EMAIL]"
    assert pii.sanitise(odd.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame(secrets(), "doc_id bigint, text string")
    for result in (pii.report(df), pii.sanitise(df)):
        plan = result._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_copies_of_disclosing_texts(spark):
    rows = secrets()
    copied = rows + [(1000 + 200 * i + k, rows[i][1]) for i in range(4) for k in range(200)]
    found = run(spark, copied)
    for r in found:
        i = (r["doc_id"] - 1000) // 200 if r["doc_id"] >= 1000 else r["doc_id"]
        if i < 4:
            at = rows[i][1].index("zephyrine")
            assert f"term:{at}:{at + 9}" in r["spans"].split(",")


def plain_disclosing(rows, generalise=pii.GENERALISE, remove=pii.REMOVE, support=pii.SUPPORT):
    """The same by counting, for texts none of which is a near copy of another: term to replacement."""
    import math

    def mentions(text):
        out = set()
        for kind, pattern in zip(pii.KINDS, (EMAIL, IP, CARD, PHONE)):
            for m in pattern.finditer(text):
                if f"{kind}:{m.start()}:{m.end()}" in plain(text)["joined"].split(","):
                    out.add(f"{kind}:{m[0].lower()}")
                    digits = re.sub("[^0-9]", "", m[0])
                    out |= {
                        "email": {"name:" + m[0].lower().split("@")[0], "host:" + m[0].lower().split("@")[-1]},
                        "ip": {"net:" + m[0].rsplit(".", 1)[0]}, "phone": {"area:" + digits[:4]}, "card": {"issuer:" + digits[:6]},
                    }[kind]
        return out

    def words(text):
        return set(re.findall(r"[^\W\d_]{3,}", text.lower()))

    masked = []
    for _, t in rows:
        for pattern in (EMAIL, IP, CARD, PHONE):
            t = pattern.sub(" ", t)
        masked.append(t)
    who = [mentions(t) for _, t in rows]
    near, every = [words(t) for t in masked], [words(t) for _, t in rows]
    n, out = len(rows), {}
    for c in set().union(*who):
        nc = sum(c in w for w in who)
        if not support <= nc < n:
            continue
        for t in set().union(*[x for x, w in zip(near, who) if c in w]):
            both = sum(t in x and c in w for x, w in zip(near, who))
            if both >= support:
                nt = max(both, sum(t in x for x in every))
                out[t] = max(out.get(t, 0), math.log(n * both / nt / nc) / math.log(n / nc))
    return {t: "" if d >= remove else "[TERM]" for t, d in out.items() if d >= generalise}


def story(seed):
    """Texts of random words; three people each have words of their own, near, far from and without their address."""
    draw = random.Random(seed)
    made = lambda n: ["".join(draw.choice("aeioubcdklmnrst") for _ in range(draw.choice([4, 6, 8]))) for _ in range(n)]
    common, rows = made(30), []
    for k, address in enumerate(("boss@acme.example.com", "+1 (555) 555-0100", "10.1.2.3")):
        own, shared = f"zephyrine{'abc'[k]}", f"seldom{'abc'[k]}"
        for i in range(6):
            body = made(60) + [draw.choice(common) for _ in range(60)]
            draw.shuffle(body)
            body.insert(draw.randrange(len(body)), own.upper() if i % 2 else own)
            body.insert(draw.randrange(len(body)), shared)
            if i < 5 or not k:
                body.insert(draw.randrange(len(body)), address)
            rows.append(" ".join(body))
        rows += [" ".join(made(80) + [shared] + made(5)) for _ in range(k)]
    rows += [" ".join(made(50) + [draw.choice(common) for _ in range(40)]) for _ in range(60)]
    rows.append(" ".join([f"someone{draw.randrange(10**9)}@a.example.org" for _ in range(1500)]))
    draw.shuffle(rows)
    return list(enumerate(rows))


def test_terms_against_plain_counts(spark):
    rows = story(3)
    wanted = plain_disclosing(rows, generalise=0.85)
    assert {"zephyrinea", "zephyrineb", "zephyrinec"} <= set(wanted) and len(set(wanted.values())) == 2
    found = run(spark, rows, generalise=0.85)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(spark.createDataFrame(rows, "doc_id bigint, text string"), generalise=0.85).collect()}
    for r in found:
        text = rows[r["doc_id"]][1]
        spans = [s.split(":") for s in r["spans"].split(",") if s.startswith("term")]
        places = [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{3,}", text) if m[0].lower() in wanted]
        assert [(int(a), int(b)) for _, a, b in spans] == places and r["n_term"] == len(places)
        for pattern, kind in zip((EMAIL, IP, CARD, PHONE), pii.KINDS):
            text = pattern.sub(lambda m, kind=kind: f"[{kind.upper()}]" if plain(m[0])[f"n_{kind}"] else m[0], text)
        assert clean[r["doc_id"]] == re.sub(r"[^\W\d_]{3,}", lambda m: wanted.get(m[0].lower(), m[0]), text)


def test_groups_of_mentions_and_marks(spark):
    """Terms that give a host, a net, an area or an issuer away; and one that is called like a mark."""
    draw = random.Random(21)
    made = lambda n: ["".join(draw.choice("aeioubcdklmnrst") for _ in range(7)) for _ in range(n)]
    issuer = ["4111111111111111", "4111110000000005", "4111110000000013", "4111110000000021"]
    kinds = (
        [f"p{i}x@inner.example.com" for i in range(4)], [f"10.20.30.{i}" for i in range(4)],
        [f"+1 (555) 555-01{i}0" for i in range(4)], [c for c in issuer if luhn(c)],
    )
    rows = []
    for words, group in zip(("phone", "zetanet", "areaword", "issuerword"), kinds):
        for mention in group:
            body = made(50) + [mention]
            draw.shuffle(body)
            rows.append(" ".join([*body, words]))
    rows += [" ".join(made(50)) for _ in range(80)]
    rows = list(enumerate(rows))
    wanted = plain_disclosing(rows)
    assert {"phone", "zetanet", "areaword"} <= set(wanted) and ("issuerword" in wanted) == (len(kinds[3]) >= 3)
    told = [r["text"] for r in pii.sanitise(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert sum("[PHONE]" in t for t in told) == 4 and not any(re.search("phone|zetanet|areaword", t) for t in told)
    found = run(spark, rows)
    assert sum(r["n_term"] for r in found) == sum(w in wanted for _, t in rows for w in re.findall(r"[^\W\d_]{3,}", t.lower()))


def test_words_stay_whole_and_go_everywhere(spark):
    """A word is never cut, and one that gives an entity away goes where the entity is not named, too."""
    rows = [(i, t.replace("the weather zephyrine wrote", "zephyrine wrote " + "filling words between them " * 9 + "counterpoint")) for i, t in secrets()]
    rows += [(100, "zephyrine came alone, far off"), (101, "a point of no importance")]
    draw = random.Random(2)
    rows += [(200 + i, " ".join("".join(draw.choice("aeioklmnst") for _ in range(6)) for _ in range(20))) for i in range(300)]
    told = {r["doc_id"]: r["text"] for r in pii.sanitise(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    found = {r["doc_id"]: r for r in run(spark, rows)}
    assert told[101] == "a point of no importance" and found[101]["n_term"] == 0
    assert "zephyrine" not in told[100] and told[100].endswith("came alone, far off")
    for i, text in rows:
        for kind, a, b in (s.split(":") for s in found[i]["spans"].split(",") if s):
            if kind == "term":
                a, b = int(a), int(b)
                assert not text[a - 1 : a].isalpha() and not text[b : b + 1].isalpha()
