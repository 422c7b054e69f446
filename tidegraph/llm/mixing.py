"""Mixing sources to target weights by Poisson replication (native expressions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

TEMPERATURE = 0.7
SEED = 17
#: A larger mean is drawn as a sum of equal parts, as exp(-mean) must not vanish.
PART = 64.0
#: So many sources, with some 300 bytes each, are sent to every executor; more are
#: joined by source and a salt, so that a large source is not met in one task.
BROADCAST_SOURCES, SALTS = 10_000, 64


def _uniform(key: Column, part: Column, seed: int) -> Column:
    """52 bits of an MD5 as a number in [0, 1): the same in any SQL engine."""
    text = F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("null")), part, F.lit(seed))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def target_rates(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    temperature: float = TEMPERATURE,
    epochs: float = 1.0,
) -> DataFrame:
    """``source, rate``: the mean number of copies of a document of each source.

    ``weights`` gives each source's share of the mixed rows (any positive
    scale; sources without a weight get none).  Without it a source of n rows
    weighs ``n ** temperature``.  The mix has ``epochs`` times as many rows as
    ``docs`` on average.
    """
    sizes = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        named = {k: v for k, v in weights.items() if k is not None}
        table = F.create_map(*[F.lit(x) for kv in named.items() for x in kv]) if named else None
        known = F.try_element_at(table, F.col("source")) if named else F.lit(None)
        weighed = sizes.withColumn(
            "weight",
            F.when(F.col("source").isNull(), F.lit(float(weights.get(None, 0))))
            .otherwise(F.coalesce(known.cast("double"), F.lit(0.0))),
        )
    rows = sizes.agg(F.sum("n")).scalar()
    everything = weighed.agg(F.sum("weight")).scalar()
    return weighed.withColumn("rows", rows).withColumn("everything", everything).select(
        "source",
        F.when(
            F.col("everything") > 0,
            F.lit(epochs) * F.col("rows") * F.col("weight") / F.col("everything") / F.col("n"),
        )
        .otherwise(0.0)
        .alias("rate"),
    )


def _thresholds() -> Column:
    """The Poisson distribution function at 0, 1, 2, ... for mean ``part_mean``.

    The count for a uniform u is how many entries are at most u.
    """
    last = F.ceil(F.col("part_mean") + 10 * F.sqrt(F.col("part_mean")) + 20).cast("int")
    first = F.exp(-F.col("part_mean"))
    state = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct(first.alias("mass"), first.alias("reach"), F.array(first).alias("steps")),
        lambda s, k: F.struct(
            (s["mass"] * F.col("part_mean") / k).alias("mass"),
            (s["reach"] + s["mass"] * F.col("part_mean") / k).alias("reach"),
            F.concat(s["steps"], F.array(s["reach"] + s["mass"] * F.col("part_mean") / k)).alias("steps"),
        ),
        lambda s: s["steps"],
    )
    return state


def poisson_mix(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    temperature: float = TEMPERATURE,
    epochs: float = 1.0,
    seed: int = SEED,
    shuffle: bool = True,
) -> DataFrame:
    """Every column of ``docs`` plus ``mix_copy`` (from 1) and ``mix_key``.

    Each document is repeated a Poisson number of times: the inverse of the
    distribution with its source's mean rate, at a uniform number hashed from
    ``doc_id`` and ``seed``.  Copies are then dealt and sorted by ``mix_key``, a
    hash of document and copy, which is a global shuffle without a sampling
    pass.

    Null ``source`` is a source of its own; null ``doc_id`` hashes like the
    word null; repeated rows draw alike; null texts are mixed like others;
    columns of ``docs`` named like the two new ones are replaced; an empty
    table gives no rows.
    """
    docs = docs.drop("mix_copy", "mix_key")
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")
    rates = (
        target_rates(docs, weights, temperature, epochs)
        .select(F.col("source").alias("_source"), "rate", parts.alias("parts"))
        .withColumn("part_mean", F.col("rate") / F.col("parts"))
        .select("_source", F.struct("parts", _thresholds().alias("steps")).alias("_law"))
    )
    rates = staged(rates, "rates")
    same = F.col("source").eqNullSafe(F.col("_source"))
    if rates.count() <= BROADCAST_SOURCES:
        drawing = docs.join(F.broadcast(rates), same)
    else:
        salted = rates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = docs.withColumn("_deal", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        drawing = dealt.join(salted, same & (F.col("_deal") == F.col("_salt"))).drop("_deal", "_salt")
    drawn = F.aggregate(
        F.sequence(F.lit(1), F.col("_law.parts")),
        F.lit(0),
        lambda n, part: n
        + F.size(
            F.filter(F.col("_law.steps"), lambda reach: reach <= _uniform(F.col("doc_id"), part, seed))
        ),
    )
    copies = (
        drawing.withColumn("_n", drawn)
        .where("_n > 0")
        .withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
        .withColumn(
            "mix_key",
            F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("mix_copy"), F.lit(seed), F.lit("order"))),
        )
        .drop("_n", "_law", "_source")
    )
    return copies.repartition("mix_key").sortWithinPartitions("mix_key") if shuffle else copies


def mix_sql(temperature: float = TEMPERATURE, seed: int = SEED) -> str:
    """The same mix in DuckDB SQL, for rates of at most ``PART``."""
    return f"""
WITH RECURSIVE sizes AS (
  SELECT source, count(*) AS n FROM documents GROUP BY source
), rates AS (
  SELECT source,
         (SELECT sum(n) FROM sizes) * pow(n::DOUBLE, {temperature})
           / (SELECT sum(pow(n::DOUBLE, {temperature})) FROM sizes) / n AS rate
  FROM sizes
), law(source, rate, k, mass, reach) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM rates
  UNION ALL
  SELECT source, rate, k + 1, mass * rate / (k + 1), reach + mass * rate / (k + 1)
  FROM law WHERE k < ceil(rate + 10 * sqrt(rate) + 20)
), drawn AS (
  SELECT d.*, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':1:{seed}'), 1, 13))::BIGINT::DOUBLE
              / 4503599627370496.0 AS u
  FROM documents d
), counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars,
         (SELECT count(*) FROM law WHERE law.source IS NOT DISTINCT FROM d.source AND law.reach <= d.u) AS copies
  FROM drawn d
)
SELECT doc_id, text, lang, source, n_chars, mix_copy::INTEGER AS mix_copy,
       md5(coalesce(doc_id::VARCHAR, 'null') || ':' || mix_copy || ':{seed}:order') AS mix_key
FROM (SELECT *, unnest(range(1, copies + 1)) AS mix_copy FROM counted WHERE copies > 0)
"""
