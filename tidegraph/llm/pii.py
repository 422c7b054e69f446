"""Personal data: exact patterns, and terms that give protected entities away.

Everything is made of DataFrame expressions.  A term discloses an entity as far
as seeing the term makes the entity expected.  With N distinct texts, an entity
c in n(c) of them, a term t in n(t) and both in n(t, c), near copies counted
about once in each of these, the disclosure is the share of the entity's
information that the pointwise mutual information of both amounts to:

    log(N n(t,c) / (n(t) n(c))) / log(N / n(c))

It is 1 for a term that occurs with the entity only.  Terms whose disclosure of
any entity reaches ``GENERALISE`` are replaced by a general word, from ``REMOVE``
on they are removed, in every text in which they stand, whether that names the
entity or not.  An entity is a mention, and also what several mentions share: the
local part and the host of an e-mail, the first three parts of an address, the
country and area digits of a phone number, the issuer's digits of a card.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_mark, staged

KINDS = ("email", "ip", "card", "phone")
#: Possessive, and anchored behind what a match cannot start in, so that a long
#: run of one class is scanned once; they find what the plain patterns find.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a search to be worth while.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Leading digits of a phone number and of a card that many share.
AREA, ISSUER = 4, 6
SUPPORT = 3
SEEDS = 6
GENERALISE, REMOVE = 0.9, 0.97
TERM = r"\p{L}{3,}"
#: So many terms are sent to every executor; more are joined by term.
BROADCAST_TERMS = 200_000
#: Matches that one block of a text holds: spans are gathered block by block, so
#: that a text with very many matches costs no more for each of them.
BLOCK = 128
_SPANS = "array<struct<start: bigint, stop: bigint, found: string>>"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _valid(kind: str, x: str) -> str:
    digits = f"regexp_replace({x}, '[^0-9]', '')"
    if kind == "ip":
        part = "regexp_replace(p, '^0+', '')"
        return (
            f"forall(split({x}, '[.]'), p -> CASE WHEN length({part}) > 3 THEN false "
            f"ELSE cast(concat('0', {part}) AS int) <= 255 END)"
        )
    if kind == "card":
        digit = f"cast(substr({digits}, -i, 1) AS int)"
        return (
            f"CASE WHEN length({digits}) BETWEEN 16 AND 19 THEN aggregate(sequence(1, length({digits})), 0, "
            f"(a, i) -> a + CASE WHEN i % 2 = 1 THEN {digit} WHEN {digit} > 4 THEN 2 * {digit} - 9 "
            f"ELSE 2 * {digit} END) % 10 = 0 ELSE false END"
        )
    if kind == "phone":
        return f"length({digits}) BETWEEN 8 AND 15"
    return "true"


def _pieces(text: str, pattern: str) -> str:
    """SQL for the gaps between matches (`0`) and the matches (`1`), which end to end are the text."""
    p = _quoted(pattern)
    return f"arrays_zip(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0))"


def matches(text: str, pattern: str, valid: str = "true") -> str:
    """SQL for the spans of ``pattern`` in the column ``text``, by code points."""
    long = "length(m.`0`) + coalesce(length(m.`1`), 0)"
    spans = f"""aggregate(b, named_struct('at', at, 'out', cast(array() AS {_SPANS})),
        (s, m) -> named_struct(
            'at', s.at + {long},
            'out', CASE WHEN m.`1` IS NOT NULL AND {valid.replace("$", "m.`1`")} THEN concat(s.out, array(named_struct(
                'start', s.at + length(m.`0`), 'stop', s.at + length(m.`0`) + length(m.`1`), 'found', m.`1`)))
            ELSE s.out END),
        s -> s.out)"""
    starts = f"""aggregate(blocks, named_struct('at', 0L, 'out', cast(array() AS array<bigint>)),
        (s, b) -> named_struct('at', s.at + aggregate(b, 0L, (n, m) -> n + {long}), 'out', concat(s.out, array(s.at))),
        s -> s.out)"""
    blocks = f"transform(sequence(0, (size(pieces) - 1) div {BLOCK}), k -> slice(pieces, k * {BLOCK} + 1, {BLOCK}))"
    # An array of one element names what is used several times.
    return f"""transform(transform(array({_pieces(text, pattern)}), pieces -> {blocks}),
        blocks -> flatten(zip_with(blocks, {starts}, (b, at) -> {spans})))[0]"""


def replaced(text: str, pattern: str, put: str) -> str:
    """SQL for ``text`` with each match replaced by ``put``, an expression over ``$``, the match."""
    return f"""array_join(transform({_pieces(text, pattern)},
        m -> concat(m.`0`, CASE WHEN m.`1` IS NULL THEN '' ELSE {put.replace("$", "m.`1`")} END)), '')"""


def _worth(kind: str, text: str) -> Column:
    hint = HINTS[kind]
    return F.col(text).contains(hint) if hint else F.col(text).rlike("[0-9][ -]?[0-9]")


def base_spans(docs: DataFrame, text: str) -> DataFrame:
    """Adds one column of spans for each of ``KINDS``, named ``_email`` and so on."""
    return docs.withColumns(
        {
            f"_{kind}": F.when(_worth(kind, text), F.expr(matches(text, PATTERNS[kind], _valid(kind, "$")))).otherwise(
                F.expr(f"cast(array() AS {_SPANS})")
            )
            for kind in KINDS
        }
    )


def _tagged(kinds: tuple[str, ...]) -> Column:
    def tagged(kind: str) -> Column:
        name = F.lit(kind).alias("kind")
        return F.transform(f"_{kind}", lambda s: F.struct(name, s["start"].alias("start"), s["stop"].alias("stop"), s["found"].alias("found")))

    return F.concat(*map(tagged, kinds))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def _terms(text: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), 0))


def _context(text: str) -> Column:
    """Under each of ``SEEDS``, the smallest hash of three words in a row.

    Copies that were edited a little share most of them, so a text counts about
    once however often it was copied.
    """
    words = _quoted(TERM)
    return F.expr(f"""transform(transform(array(regexp_extract_all(lower({text}), {words}, 0)),
        w -> transform(sequence(1, greatest(1, size(w) - 2)), i -> xxhash64(slice(w, i, 3)))),
        runs -> transform(sequence(0, {SEEDS - 1}), seed -> array_min(transform(runs, x -> xxhash64(x, seed)))))[0]""")


def _worded(words: DataFrame, terms: DataFrame) -> DataFrame:
    """``words`` that are among ``terms``, with what these say."""
    terms = staged(terms, "terms")
    return words.join(F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms, "term")


def _texts_of(rows: DataFrame, *keys: str) -> DataFrame:
    """``n`` for each ``keys``: about how many texts, near copies counted once.

    The distinct hashes are counted for each seed; the second largest count is
    neither misled by one hash that many texts share nor by one that an edit hit.
    """
    seeded = rows.select(*keys, F.posexplode("context").alias("seed", "low"))
    counts = seeded.groupBy(*keys, "seed").agg(F.countDistinct("low").alias("n"))
    return counts.groupBy(*keys).agg(F.sort_array(F.collect_list("n"), asc=False)[1].alias("n"))


def _shared(kind: str, name: str, part: Callable[[Column], Column]) -> Column:
    return F.transform(f"_{kind}", lambda s: F.concat(F.lit(name + ":"), part(s["found"])))


def _leading_digits(n: int) -> Callable[[Column], Column]:
    return lambda found: F.left(F.regexp_replace(found, "[^0-9]", ""), F.lit(n))


def _entities() -> Column:
    """What the mentions of a text stand for: each itself, and the groups that it belongs to."""
    groups = (
        _shared("email", "name", lambda x: F.lower(F.substring_index(x, "@", 1))),
        _shared("email", "host", lambda x: F.lower(F.substring_index(x, "@", -1))),
        _shared("ip", "net", lambda x: F.substring_index(x, ".", 3)),
        _shared("phone", "area", _leading_digits(AREA)),
        _shared("card", "issuer", _leading_digits(ISSUER)),
    )
    return F.array_distinct(F.concat(F.transform(_tagged(KINDS), lambda s: F.concat_ws(":", s["kind"], F.lower(s["found"]))), *groups))


def _unmentioned(text: str) -> str:
    """SQL for ``text`` without what the base patterns match: a mention's own words are no evidence."""
    for kind in KINDS:
        text = f"regexp_replace({text}, {_quoted(PATTERNS[kind])}, ' ')"
    return text


def disclosing_terms(held: DataFrame, texts: DataFrame, generalise: float, support: int) -> DataFrame:
    """``term, disclosure``: the terms that reach ``generalise`` for some entity, and the most they reach.

    ``held`` are the texts with mentions, ``texts`` all of them.  Contexts are
    texts, near copies counted about once, in all four counts.

    What cannot reach ``generalise`` goes before contexts are counted, by bounds that
    hold for all counts to come.  A pair has at most as many contexts as rows; a term
    has at least as many as the smaller count of two seeds in the texts with mentions;
    and a term of n(t) contexts discloses an entity only if n(t) is at most
    ``n(t,c) (N / n(c)) ** (1 - generalise)``.  First whole terms go by the most
    frequent entity, then pairs by their own, so that only near misses are counted
    under every seed.
    """
    mentions = staged(
        held.select(
            F.monotonically_increasing_id().alias("text"), _context("_text").alias("context"), _entities().alias("entities"),
            F.expr(_unmentioned("_text")).alias("_rest"),
        ),
        "mentions",
    )
    named = mentions.select("text", "context", F.explode("entities").alias("entity"))
    entities = staged(_texts_of(named, "entity").where(F.col("n") >= support).withColumnRenamed("n", "nc"), "entities")
    of_texts = staged(named.join(entities, "entity").select("text", "entity", "nc"), "of_texts")
    asked = mentions.join(of_texts.select("text").distinct(), "text", "left_semi")
    worded = asked.select("text", F.explode(_terms("_rest")).alias("term"))
    rows = float(max(2, texts.count()))
    top = entities.agg(F.max("nc")).first()[0]
    if top is None:
        return worded.select("term", F.lit(0.0).alias("disclosure")).limit(0)

    def reach(n: Column) -> Column:
        return F.pow(rows / n, F.lit(1 - generalise)) * (1 + 1e-9)

    # Rows are narrow until few are left: a term and the text's number, without its contexts.
    seeded = asked.select(F.explode(_terms("_rest")).alias("term"), *[F.col("context")[k].alias(f"low{k}") for k in (0, 1)])
    often = seeded.groupBy("term").agg(
        F.count("*").alias("rows"), F.least(F.countDistinct("low0"), F.countDistinct("low1")).alias("fewest")
    ).where((F.col("rows") >= support) & (F.col("fewest") <= top * reach(F.lit(float(top))))).select("term", "fewest")
    often = staged(often, "often")
    pairs = worded.join(often, "term").join(of_texts, "text")
    close = staged(
        pairs.groupBy("entity", "term").agg(F.count("*").alias("rows"), F.max("fewest").alias("fewest"), F.max("nc").alias("nc"))
        .where((F.col("rows") >= support) & (F.col("fewest") <= F.col("rows") * reach(F.col("nc")))).select("entity", "term"),
        "close",
    )
    near = staged(
        worded.join(close.select("term").distinct(), "term", "left_semi").join(of_texts.select("text", "entity"), "text")
        .join(close, ["entity", "term"], "left_semi"),
        "near",
    )
    joint = _texts_of(near.join(mentions.select("text", "context"), "text"), "entity", "term").withColumnRenamed("n", "both")
    joint = staged(joint.where(F.col("both") >= support), "joint")
    # A term of many texts discloses nothing, and it is in as many as mention anything
    # at least: with more rows than contexts, and fewer texts, the bound holds for all.
    partly = _texts_of(
        mentions.select("context", F.explode(_terms("_rest")).alias("term")).join(joint.select("term").distinct(), "term"), "term"
    ).withColumnRenamed("n", "least")
    candidates = staged(
        joint.join(entities, "entity").join(partly, "term").where(F.col("least") <= F.col("both") * reach(F.col("nc"))).drop("least"), "candidates"
    )
    if candidates.isEmpty():  # nothing to count in all texts
        return candidates.select("term", F.lit(0.0).alias("disclosure"))
    contexts = texts.select("_text", _context("_text").alias("context"))
    # The terms to count are few, and only their rows are dealt.
    words = _worded(contexts.select("context", F.explode(_terms("_text")).alias("term")), candidates.select("term").distinct())
    documents = _texts_of(words, "term").withColumnRenamed("n", "nt")
    total = _texts_of(contexts.select("context", F.lit(0).alias("all")), "all").select("n").scalar()
    n = F.col("total").cast("double")
    return (
        candidates.join(documents, "term")
        .withColumn("total", total)
        .where("nc < total")
        .withColumn("disclosure", F.log(n * F.col("both") / F.greatest("nt", "both") / F.col("nc")) / F.log(n / F.col("nc")))
        .where(F.col("disclosure") >= generalise)
        .groupBy("term").agg(F.max("disclosure").alias("disclosure"))
    )


def _prepared(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_mark().alias("_mark"), text.alias("_text"))


def _hits(texts: DataFrame, narrow: DataFrame, generalise: float, remove: float, support: int) -> DataFrame:
    """``_mark, _put``: what stands in for each disclosing term of a text, a general word or nothing."""
    held = narrow.where("_hold is not null").withColumnRenamed("_hold", "_text")
    put = F.when(F.col("disclosure") >= remove, "").otherwise("[TERM]")
    telling = disclosing_terms(held, texts, generalise, support).select("term", put.alias("put"))
    return (
        _worded(texts.select("_mark", F.explode(_terms("_text")).alias("term")), telling).distinct()
        .groupBy("_mark").agg(F.map_from_entries(F.collect_list(F.struct("term", "put"))).alias("_put"))
    )


def _narrow(texts: DataFrame) -> DataFrame:
    """Base spans of every text, and the text where there are some; written once."""
    some = " + ".join(f"size(_{k})" for k in KINDS) + " > 0"
    return staged(base_spans(texts, "_text").withColumn("_hold", F.when(F.expr(some), F.col("_text"))).drop("_text"), "spans")


def find(
    docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, support: int = SUPPORT
) -> DataFrame:
    """A row per row of ``docs``: ``doc_id, _email, _ip, _card, _phone, _term``.

    ``_term`` has the spans of disclosing terms, ``found`` being what to put in
    their place: a general word, or nothing.  A term that stands in a base span is
    listed as well.

    Null text counts as empty; null ``doc_id`` is an id like others; repeated
    rows get equal spans; an empty table gives no rows; other columns are not
    read.  Spans are code points, end exclusive.
    """
    texts = _prepared(docs)
    narrow = _narrow(texts)
    hits = _hits(texts, narrow, generalise, remove, support)
    listed = F.expr(matches("_text", TERM, "map_contains_key(_put, lower($))"))
    spans = (
        texts.select("_mark", "_text").join(hits, "_mark").dropDuplicates(["_mark"])
        .select("_mark", "_put", listed.alias("_term"))
        .withColumn("_term", F.transform("_term", lambda s: F.struct(
            s["start"].alias("start"), s["stop"].alias("stop"), F.element_at("_put", F.lower(s["found"])).alias("found")
        ))).drop("_put")
    )
    return narrow.drop("_hold").join(spans, "_mark", "left").withColumn(
        "_term", F.coalesce("_term", F.expr(f"cast(array() AS {_SPANS})"))
    ).drop("_mark")


def report(docs: DataFrame, **settings) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term`` per row.

    Spans are written ``kind:start:end``, by kind as listed and then by start.
    See ``find`` for odd rows.
    """
    found = find(docs, **settings)
    listed = found.select(
        "doc_id",
        *[F.size(f"_{k}").cast("bigint").alias(f"n_{k}") for k in KINDS],
        F.sha2(_listed(_tagged(KINDS)).cast("binary"), 256).alias("base_sha256"),
        _listed(_tagged((*KINDS, "term"))).alias("spans"),
        F.size("_term").cast("bigint").alias("n_term"),
    )
    return listed


def sanitise(
    docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, support: int = SUPPORT
) -> DataFrame:
    """``docs`` with its columns, personal data replaced in ``text``.

    A base match becomes its kind in brackets, kinds in the order listed, and then
    a disclosing term a general word or nothing.  A null text stays null.
    ``n_chars``, where there is one, is set to the new length if the text changed.
    The base patterns run where a text is, once to learn from the mentions and once
    to replace them, which is cheaper than dealing the texts anew.
    """
    texts = _prepared(docs)
    hits = _hits(texts, _narrow(texts), generalise, remove, support)
    rows = docs.select(F.struct("*").alias("_row"), row_mark().alias("_mark"), F.col("text").cast("string").alias("_text"))
    clean = rows.join(hits, "_mark", "left").withColumn("_new", F.col("_text"))
    for kind in KINDS:
        put = F.expr(replaced("_new", PATTERNS[kind], f"CASE WHEN {_valid(kind, '$')} THEN '[{kind.upper()}]' ELSE $ END"))
        clean = clean.withColumn("_new", F.when(_worth(kind, "_new"), put).otherwise(F.col("_new")))
    # What stands in brackets for a mention is no word of the text.
    marks = "|".join(rf"\[{kind.upper()}\]" for kind in KINDS)
    put = F.expr(replaced("_new", f"{marks}|{TERM}", "coalesce(try_element_at(_put, lower($)), $)"))
    clean = clean.withColumn("_new", F.when(F.col("_put").isNotNull(), put).otherwise(F.col("_new")))
    out = []
    for name in docs.columns:
        old = F.col("_row")[name]
        if name == "text":
            old = F.col("_new").cast(docs.schema[name].dataType)
        elif name == "n_chars":
            old = F.when(F.col("_new") != F.col("_text"), F.length("_new")).otherwise(old).cast(docs.schema[name].dataType)
        out.append(old.alias(name))
    return clean.select(*out)
