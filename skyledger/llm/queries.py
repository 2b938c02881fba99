"""Registered queries of the operators, each over its whole table, and the SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm import (
    exact,
    extract,
    language,
    mixing,
    near,
    negatives,
    packing,
    quality,
    spelling,
    toxicity,
    urls,
    vectors,
    warc,
)
from skyledger.llm.common import remainder
from skyledger.session import configure

Plan = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Plan] = {}
ORACLE: dict[str, str] = {}


def query(plan: Plan) -> Plan:
    QUERIES[plan.__name__] = plan
    return plan


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def judged(scores: DataFrame, modulus: int, out: int, least: float) -> DataFrame:
    """doc_id, held_out, score and predicted from scores per document."""
    return scores.select(
        "doc_id", (remainder(F.col("doc_id"), modulus) == out).alias("held_out"), "score",
        (F.col("score") >= least).cast("int").alias("predicted"),
    )


@query
def op2_mixing(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


# Quotients are ranked one seat at a time here; the operator ranks only those that can decide.
ORACLE["op2_mixing"] = r"""
WITH docs AS (
  SELECT doc_id, source, md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS ord,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    greatest(1, (count(*) FILTER (size > 0) + 999) // 1000) AS shards FROM docs GROUP BY source),
placed AS (
  SELECT docs.*, CAST('0x' || left(ord, 8) AS BIGINT) % shards AS part
  FROM docs JOIN sizes ON docs.source IS NOT DISTINCT FROM sizes.source WHERE size > 0),
shards AS (
  SELECT source, part, part // 1024 AS grp, CAST(sum(size) AS BIGINT) AS shard_size,
    CAST((2 * sum(size) + 7) // 8 AS BIGINT) AS room FROM placed GROUP BY source, part),
named AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS pos FROM sizes),
weighed AS (
  SELECT *, CASE (pos - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
    2.0::DOUBLE * source_size AS most FROM named),
levels AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(most) OVER earlier, 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER earlier, 0)) AS level
  FROM weighed WINDOW earlier AS (ORDER BY most / w, source IS NULL, encode(source)
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, pos,
    least(most, coalesce(max(CASE WHEN level * w <= most THEN level END) OVER () * w, most)) AS target
  FROM levels),
seats1 AS (
  SELECT source, row_number() OVER (ORDER BY target / (2 * j + 1) DESC, pos, j) AS won,
    (SELECT CAST(floor(sum(target) / 8 + 0.5) AS BIGINT) FROM targets) AS seats
  FROM targets, LATERAL (SELECT unnest(range(0, source_size // 4 + 2)) AS j) WHERE target > 0),
quota1 AS (SELECT source, count(*) AS seats FROM seats1 WHERE won <= seats GROUP BY source),
groups AS (
  SELECT source, grp, sum(shard_size) AS size, CAST(sum(room) AS BIGINT) AS room FROM shards GROUP BY source, grp),
seats2 AS (
  SELECT g.source, g.grp, seats, row_number() OVER (PARTITION BY g.source
    ORDER BY CAST(size AS DOUBLE) / (2 * j + 1) DESC, g.grp, j) AS won
  FROM groups g JOIN quota1 ON g.source IS NOT DISTINCT FROM quota1.source,
    LATERAL (SELECT unnest(range(0, room)) AS j)),
quota2 AS (SELECT source, grp, count(*) AS seats FROM seats2 WHERE won <= seats GROUP BY source, grp),
seats3 AS (
  SELECT s.source, s.part, seats, row_number() OVER (PARTITION BY s.source, s.grp
    ORDER BY CAST(shard_size AS DOUBLE) / (2 * j + 1) DESC, s.part, j) AS won
  FROM shards s JOIN quota2 q ON s.source IS NOT DISTINCT FROM q.source AND s.grp = q.grp,
    LATERAL (SELECT unnest(range(0, room)) AS j)),
quota3 AS (SELECT source, part, count(*) AS quota FROM seats3 WHERE won <= seats GROUP BY source, part),
filled AS (
  SELECT shards.*, least(coalesce(quota, 0) * 8, 2 * shard_size) AS words
  FROM shards LEFT JOIN quota3
    ON shards.source IS NOT DISTINCT FROM quota3.source AND shards.part = quota3.part),
laid AS (
  SELECT doc_id, size, placed.source, shard_size, words,
    coalesce(CAST(sum(size) OVER (PARTITION BY placed.source, placed.part ORDER BY ord, doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS ahead
  FROM placed JOIN filled
    ON placed.source IS NOT DISTINCT FROM filled.source AND placed.part = filled.part
  UNION ALL SELECT doc_id, 0, source, 1, 0, 0 FROM docs WHERE size = 0)
SELECT doc_id, size, source_size, target,
  CAST(words // shard_size * size + greatest(0, least(size, words % shard_size - ahead)) AS BIGINT) AS taken
FROM laid JOIN targets ON laid.source IS NOT DISTINCT FROM targets.source
"""


@query
def op3_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact.mark_copies(table(spark, sf, "documents"))


ORACLE["op3_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query
def op6_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near.near_groups(table(spark, sf, "documents"))


ORACLE["op6_minhash_near_dedup"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    END AS shingles FROM words),
sizes AS (SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n FROM sets),
held AS (SELECT doc_id, unnest(shingles) AS shingle FROM sets),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM held x JOIN held y
    ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * c >= 85 * (p.n + q.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, l.b FROM reached r JOIN both_ways l ON l.a = r.other)
SELECT s.doc_id, n AS n_shingles, min(other) AS component_id, s.doc_id = min(other) AS kept
FROM sizes s JOIN reached r ON r.doc_id = s.doc_id GROUP BY s.doc_id, n
"""


@query
def op1_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = toxicity.fit(docs, labels, remainder(F.col("doc_id"), 4) != 2)
    return judged(toxicity.score(docs, model), 4, 2, 0.3)


@query
def op7_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality.fit(docs, labels, remainder(F.col("doc_id"), 4) != 2)
    return judged(quality.score(docs, model), 4, 2, 0.7)


@query
def op10_packing(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(table(spark, sf, "documents"), path)


@query
def op5_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    found = language.predict(docs, language.fit(docs, remainder(F.col("doc_id"), 5) != 0))
    return found.select(
        "doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score"
    )


@query
def op4_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return extract.extract(table(spark, sf, "pages"))


RULES = (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
    ("allow", "com/fr/"), ("block", "com/de/"),
)


@query
def op9_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return urls.judge(table(spark, sf, "pages"), RULES)


@query
def op8_embedding_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf, "embeddings"))


ORACLE["op8_embedding_near_dedup"] = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y
    ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= 0.93),
reached AS (
  SELECT vec_id, vec_id AS other FROM embeddings
  UNION SELECT r.vec_id, l.b FROM reached r JOIN links l ON l.a = r.other),
degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT r.vec_id, coalesce(max(n), 0) AS n_links, min(other) AS component_id, r.vec_id = min(other) AS kept
FROM reached r LEFT JOIN degrees ON a = r.vec_id GROUP BY r.vec_id
"""


@query
def op11_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf, "embeddings").withColumn("label", moved)
    return negatives.mine(rows, F.col("vec_id") % 50 == 0)


ORACLE["op11_hard_negatives"] = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND coalesce(list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))), true)),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM usable a JOIN usable b ON len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


@query
def op12_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.round_trip(table(spark, sf, "pages"))


ORACLE["op12_warc"] = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN last_id END AS refers_to
FROM g
"""


@query
def op13_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.variants(table(spark, sf, "documents"))
