"""The operators of this subpackage applied to the synthetic tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import html_text, images, mixing, near_dedup, packing, pii, quality, sharding, spelling, topk, toxicity, url_filter, vector_codes
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.image_copies(images.drawn(table(spark, sf_dir, "embeddings")))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_index(table(spark, sf_dir, "documents"), 40)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.poisson_mix(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


#: All pairs that share a shingle, compared in full; for one row per doc_id.
_NEAR_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), runs AS (SELECT doc_id, w, least(5, len(w)) AS k FROM worded WHERE len(w) > 0),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS s FROM runs, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
r(n, m) USING KEY (n) AS (
  SELECT doc_id, doc_id FROM documents UNION
  SELECT e.b, min(r.m) FROM r JOIN e ON r.n = e.a JOIN recurring.r x ON x.n = e.b WHERE r.m < x.m GROUP BY e.b
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.m AS component_id, d.doc_id = r.m AS kept
FROM documents d JOIN r ON r.n = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

_TOPK_SQL = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 5
"""

#: Runs, slips by CRC-32 (a table of its bytes, then one step a byte), words, and words with one letter left out.
_SPELLING_SQL = r"""
WITH RECURSIVE bytes AS (
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS steps
  FROM range(256) AS t(b)
), found AS (
  SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS r FROM documents
), runs AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS c
  FROM found GROUP BY ALL HAVING length(w) >= 5
), summed AS (
  SELECT w, c, xor(list_reduce(
    flatten(list_transform(string_split(concat(doc_id, ':', w), ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)] ELSE [195, ord(x) - 64] END)),
    lambda h, x: xor(h >> 8, steps[(xor(h, x) & 255) + 1]), 4294967295), 4294967295) AS h
  FROM runs, bytes
), words AS (
  SELECT CASE WHEN h % 97 = 0 THEN concat(left(w, (h % length(w))::INT), substr(w, (h % length(w))::INT + 2)) ELSE w END AS word, sum(c)::BIGINT AS n
  FROM summed GROUP BY 1 HAVING length(word) >= 5 AND sum(c) >= 3
), cut AS (
  SELECT word, n, i, concat(left(word, i), substr(word, i + 2)) AS d FROM (SELECT word, n, unnest(range(length(word)))::INT AS i FROM words)
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.d = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.d = b.word
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN other END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
), walk AS (
  SELECT word, word AS at FROM formed UNION ALL SELECT walk.word, f.form FROM walk JOIN formed f ON f.word = walk.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN walk ON walk.word = f.word JOIN formed g ON g.word = walk.at WHERE g.form IS NULL
"""


def _codes_sql() -> str:
    """The rounds spelled out: every part against every entry, squares summed component by component."""

    def assigned(k: int) -> str:
        return f"""a{k} AS MATERIALIZED (
  SELECT id, part, min(struct_pack(d := list_sum(list_transform(list_zip(v, e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), entry := entry)) AS best
  FROM parts JOIN e{k} USING (part) GROUP BY id, part
)"""

    def moved(k: int) -> str:
        return f"""s{k} AS (
  SELECT part, entry, list(m ORDER BY i) AS e FROM (
    SELECT p.part, best.entry, i, floor(sum(v[i + 1]) / count(*))::BIGINT AS m
    FROM a{k} JOIN parts p USING (id, part), LATERAL (SELECT unnest(range(len(v))) AS i) GROUP BY ALL
  ) GROUP BY ALL
), e{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(s{k}.e, e{k}.e) AS e FROM e{k} LEFT JOIN s{k} USING (part, entry))"""

    rounds = ", ".join(f"{assigned(k)}, {moved(k)}" for k in range(4))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT)) - 1 AS id, vec_id, label,
         list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT id, part, v[part * len(v) // 4 + 1 : (part + 1) * len(v) // 4] AS v FROM kept, range(4) AS t(part)
), e0 AS (SELECT part, id AS entry, v AS e FROM parts WHERE id < 256),
{rounds}, {assigned(4)},
coded AS (
  SELECT id, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a4 GROUP BY id
), book AS (
  SELECT sha256(string_agg(x, ',' ORDER BY part, entry)) AS codebooks_sha256 FROM (SELECT part, entry, array_to_string(e, ',') AS x FROM e4)
)
SELECT k.vec_id, c.code, c.error, sum(c.error) OVER (PARTITION BY k.label)::BIGINT AS label_error, codebooks_sha256
FROM kept k JOIN coded c USING (id), book
"""


def queries() -> dict[str, Query]:
    return {
        "op1_near_dedup": op1_near_dedup,
        "op2_media": op2_media,
        "op3_pii": op3_pii,
        "op4_html_text": op4_html_text,
        "op5_sharding": op5_sharding,
        "op6_packing": op6_packing,
        "op7_mixing": op7_mixing,
        "op8_quality": op8_quality,
        "op9_topk": op9_topk,
        "op10_url_filter": op10_url_filter,
        "op11_spelling": op11_spelling,
        "op12_toxicity": op12_toxicity,
        "op13_vector_codes": op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_near_dedup": _NEAR_SQL,
        "op7_mixing": mixing.mix_sql(),
        "op9_topk": _TOPK_SQL,
        "op11_spelling": _SPELLING_SQL,
        "op13_vector_codes": _codes_sql(),
    }
