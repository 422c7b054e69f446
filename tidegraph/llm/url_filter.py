"""URL verdicts from host and path rules and from trust that spreads over links."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.rounds import forget, measured
from .common import staged

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Verdict, host, path.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
DAMPING = 0.85
#: The spread ends when no host's score moves by more than this part of what a
#: wholly trusted or blocked seed starts with.
TOLERANCE = 1e-3
#: What a link between a host and its parent domain weighs.
KINSHIP = 1.0
#: A host is blocked when the distrust that reaches it exceeds its trust and at
#: least this part of what a wholly blocked seed starts with.
THRESHOLD = 0.5


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(
        F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit("")
    )


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _suffixes(host: Column) -> Column:
    """The host itself and every parent domain."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def rules_by_host(hosts: DataFrame, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """``host, rules``: the rules that fit each host, longest first."""
    spark = hosts.sparkSession
    listed = spark.createDataFrame(list(rules), "verdict string, on string, under string")
    ordered = F.sort_array(
        F.collect_set(
            F.struct(
                (-F.length(F.concat("on", "under"))).alias("order"),
                F.concat("on", "under").alias("rule"),
                "under",
                "verdict",
            )
        )
    )
    return (
        hosts.select("host", F.explode(_suffixes(F.col("host"))).alias("on"))
        .join(listed, "on")
        .groupBy("host")
        .agg(ordered.alias("rules"))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, weight``: pages of host ``src`` that link to another host ``dst``."""
    link = r"""(?is)<a\s[^>]*?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""
    return (
        pages.where(F.col("html").contains("//"))
        .select(
            F.col("host").alias("src"),
            F.explode(F.array_distinct(F.transform(
                F.regexp_extract_all("html", F.lit(link), 1),
                lambda x: host_of(F.concat(F.lit(":"), F.regexp_extract(x, r"(?s)//.*$", 0))),
            ))).alias("dst"),
        )
        .where("src <> '' and dst <> '' and src <> dst")
        .groupBy("src", "dst")
        .agg(F.count("*").cast("double").alias("weight"))
    )


def domain_edges(hosts: DataFrame, weight: float = KINSHIP) -> DataFrame:
    """``src, dst, weight``: every host and its parent domain, both ways, up to two labels."""
    pairs = (
        hosts.select(F.filter(_suffixes(F.col("host")), lambda x: x.contains(".")).alias("chain"))
        .where("size(chain) > 1")
        .select(F.explode(F.arrays_zip(F.slice("chain", F.lit(1), F.size("chain") - 1).alias("low"), F.slice("chain", F.lit(2), F.size("chain") - 1).alias("high"))).alias("p"))
        .select("p.low", "p.high").distinct()
    )
    return pairs.select(
        F.inline(F.array(
            F.struct(F.col("low").alias("src"), F.col("high").alias("dst"), F.lit(weight).alias("weight")),
            F.struct(F.col("high").alias("src"), F.col("low").alias("dst"), F.lit(weight).alias("weight")),
        ))
    )


def propagate(
    seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE
) -> DataFrame:
    """``kind, host, score``: personalised PageRank of ``seeds (kind, host, seed)`` over ``edges``.

    Each kind of ``edges (kind, src, dst, weight)`` is a graph of its own; all are
    spread in the same rounds.  A host passes on ``damping`` of its score, split
    over its links by weight; what hosts without links would pass on goes back to
    the seeds.  Every round is a join on the source and a pre-aggregated sum at the
    target; rounds end when twice no score moves by more than ``tolerance`` of
    ``1 - damping``, twice because what goes back arrives a round later.
    """
    keys = ["kind", "src"]
    out = edges.groupBy(*keys).agg(F.sum("weight").alias("total"))
    shares = staged(
        edges.join(out, keys).select(*keys, "dst", (F.col("weight") * damping / F.col("total")).alias("share")), "shares"
    )
    mass = {r["kind"]: r["seed"] for r in seeds.groupBy("kind").agg(F.sum("seed").alias("seed")).collect()}
    if not mass:
        return seeds.select("kind", "host", F.col("seed").alias("score"))
    given = {kind: 1 - damping for kind in mass}
    base = seeds.select("kind", "host", F.col("seed"))
    scores = base.select("kind", "host", (F.col("seed") * (1 - damping)).alias("score"))
    quiet, now = 0, None
    while True:
        weight = F.create_map(*[F.lit(x) for item in given.items() for x in item])
        start = base.select("kind", "host", (F.col("seed") * weight[F.col("kind")]).alias("score"), F.lit(0.0).alias("old"))
        moved = shares.join(scores.withColumnRenamed("host", "src"), keys).select(
            "kind", F.col("dst").alias("host"), (F.col("score") * F.col("share")).alias("score"), F.lit(0.0).alias("old")
        )
        before = scores.select("kind", "host", F.lit(0.0), F.col("score"))
        summed = start.union(moved).union(before).groupBy("kind", "host").agg(F.sum("score").alias("score"), F.sum("old").alias("old"))
        # What the next round needs to know is summed up while the scores are written.
        sums = {f"{name}_{kind}": F.sum(F.when(F.col("kind") == kind, F.col(name))) for kind in mass for name in ("score", "old")}
        last, (now, told) = now, measured(summed, "scores", moved=F.max(F.abs(F.col("score") - F.col("old"))), **sums)
        if last is not None:
            forget(last)
        scores = now.select("kind", "host", "score")
        quiet = quiet + 1 if told["moved"] <= tolerance * (1 - damping) else 0
        if quiet == 2:
            return scores
        for kind in mass:
            passed = told[f"score_{kind}"] - given[kind] * mass[kind]
            given[kind] = 1 - damping + max(0.0, damping * told[f"old_{kind}"] - passed) / mass[kind]


def url_verdicts(
    pages: DataFrame,
    rules: Iterable[tuple[str, str, str]] = RULES,
    edges: DataFrame | None = None,
    damping: float = DAMPING,
    tolerance: float = TOLERANCE,
    kinship: float = KINSHIP,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` for every row of ``pages``.

    A rule fits its host and all subdomains where the path starts with its own;
    the longest fitting rule decides.  Elsewhere the host does: trust starts at
    hosts by the share of their pages that rules allow and follows links;
    distrust starts by the share that rules block and follows links backwards.
    Besides the links of pages, or ``edges``, every host is linked with its parent
    domain both ways with the weight ``kinship``, which joins the hosts of a site.
    A host is blocked if its distrust exceeds its trust and ``threshold`` of
    ``1 - damping``, what a wholly blocked host starts with.

    Null url, or one without ``://``: empty host and path, no rule, allowed.
    Null html has no links.  Repeated rows count as often as they occur and are
    all returned; an empty table gives no rows; of the other columns none is
    read.  ``rules`` is a list in the program, so a small table.
    """
    rules = list(rules)
    read = pages.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        F.col("html").cast("string").alias("html"),
    )
    placed = staged(read.select("page_id", "host", "path"), "urls")
    hosts = placed.select("host").distinct()
    fitting = rules_by_host(hosts, rules)
    best = F.filter("rules", lambda r: F.col("path").startswith(r["under"]))
    ruled = staged(
        placed.join(fitting, "host", "left").select(
            "page_id", "host", "path", F.try_element_at(best, F.lit(1)).alias("best")
        ),
        "ruled",
    )
    seeds = staged(
        ruled.where("host <> ''").groupBy("host").agg(
            F.avg(F.coalesce((F.col("best.verdict") == "allow").cast("double"), F.lit(0.0))).alias("good"),
            F.avg(F.coalesce((F.col("best.verdict") == "block").cast("double"), F.lit(0.0))).alias("bad"),
        ),
        "seeds",
    )
    links = link_edges(read) if edges is None else edges.select("src", "dst", "weight")
    forward = links.unionByName(domain_edges(seeds, kinship)) if kinship > 0 else links
    both = forward.select(F.inline(F.array(
        F.struct(F.lit("trust").alias("kind"), "src", "dst", "weight"),
        F.struct(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"),
    ))).groupBy("kind", "src", "dst").agg(F.sum("weight").alias("weight"))
    start = seeds.select("host", F.inline(F.array(
        F.struct(F.lit("trust").alias("kind"), F.col("good").alias("seed")), F.struct(F.lit("distrust").alias("kind"), F.col("bad").alias("seed"))
    ))).where("seed > 0")
    judged = (
        propagate(start, both, damping, tolerance).groupBy("host").agg(
            F.sum(F.when(F.col("kind") == "trust", F.col("score")).otherwise(0.0)).alias("trust"),
            F.sum(F.when(F.col("kind") == "distrust", F.col("score")).otherwise(0.0)).alias("distrust"),
        )
    )
    spread = F.when(
        (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= threshold * (1 - damping)), "block"
    ).otherwise("allow")
    return ruled.join(judged, "host", "left").select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), spread).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
