"""Queries over the training-data tables, one an operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.llm import centroids, classifier, compression, exact, forest, html, interactions, mixing, nearest, packing, sharding, tokenfiles, warc
from typeloom.llm.common import table
from typeloom.llm.tokens import vocabulary


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = compression.quality_rules(docs, bands=compression.fitted(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", *[f"_rules.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op2_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest.nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed, _ = packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0)
    return packed


def op4_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixing_rates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op6_arrow_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.round_trip(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)


def op7_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), least_bytes=0)


def op8_nb_support_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = classifier.train(docs, table(spark, sf_dir, "labels"))
    scored = classifier.score_documents(docs, model)
    predicted = (F.col("score") >= classifier.THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", classifier.held_out(F.col("doc_id")).alias("held_out"), "score", predicted)


def op9_karmarkar_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=16)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_boosted_dom(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_annulus_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), dims=64, clusters=40, rounds=5, seed=2)


def op12_incidence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_compression_bands, op2_collision_counting, op3_best_fit_packing, op4_lsh_forest, op5_mixing, op6_arrow_tokens, op7_warc_salvage, op8_nb_support_vectors, op9_karmarkar_karp, op10_boosted_dom, op11_annulus_search, op12_incidence_audit, op13_grace_dedup)
}

_OP5 = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM sized GROUP BY source
), ordered AS (
  SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST) AS place FROM sources
), levels AS (
  SELECT place, 3 * source_size / weight AS ratio,
         CAST((SELECT sum(source_size) FROM sources) - 3 * coalesce(sum(source_size) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / CAST(sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM ordered
), level AS (SELECT coalesce(arg_min(level, place) FILTER (WHERE ratio > level), 0) AS level FROM levels),
targets AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), weight * level) AS target FROM sources, level
), drawn AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         CAST('0x' || substr(md5('mix-0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / 4503599627370496.0 AS draw
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM drawn
"""

_OP12 = """
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body FROM documents
), words AS (
  SELECT *, regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY body) AS first FROM docs
), said AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), judged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(w) < 100 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * len(regexp_replace(body, '[^A-Z]', '', 'g')) > 10 * length(body) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN first IS NOT NULL AND (words.doc_id IS NULL OR words.doc_id > first) THEN 'E' ELSE '' END AS fails
  FROM words LEFT JOIN said USING (doc_id)
), cells AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY part, fails
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.f NOT IN (b.f, c.f, d.f, e.f) AND b.f NOT IN (c.f, d.f, e.f) AND c.f NOT IN (d.f, e.f) AND d.f <> e.f
), steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS before
  FROM orders, range(1, 6) AS r(step)
), outcomes AS (
  SELECT part, filter_order, step, f, n, good, toxic, fails,
         CASE WHEN contains(fails, f) THEN 1 ELSE 0 END AS fail,
         CASE WHEN translate(fails, before, '') <> fails THEN 1 ELSE 0 END AS gone
  FROM cells, steps
), counted AS (
  SELECT part, filter_order, step, f,
         CAST(sum(n * (1 - fail) * (1 - gone)) AS BIGINT) AS kept, CAST(sum(n * fail * (1 - gone)) AS BIGINT) AS removed,
         CAST(sum(n * fail * gone) AS BIGINT) AS redundant,
         CAST(sum(CASE WHEN fails = f THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(sum(good * fail * (1 - gone)) AS BIGINT) AS good_lost, CAST(sum(toxic * fail * (1 - gone)) AS BIGINT) AS toxic_lost
  FROM outcomes GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""

_OP13 = """
WITH texts AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents
), grouped AS (
  SELECT doc_id, body, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM texts
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(body) AS text_sha256 FROM grouped
"""



def _op11(rounds: int = 5) -> str:
    """Rounds of assignment and means, one after the other."""
    parts = [
        """v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64
)""",
        """c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), vec_id, v) - 1 AS cluster, v AS c FROM v
  QUALIFY cluster < 40
)""",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT row, any_value(vec_id) AS vec_id, any_value(v) AS v, min((far, cluster)) AS best FROM (
    SELECT row, vec_id, v, cluster, CAST(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS far
    FROM v, c{i}) GROUP BY row
)""")
        parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c{i}.cluster, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN (
    SELECT cluster, list(CAST(floor(x / n) AS BIGINT) ORDER BY i) AS c FROM (
      SELECT cluster, i, sum(x) AS x, count(*) AS n FROM (SELECT best[2] AS cluster, unnest(v) AS x, unnest(range(64)) AS i FROM a{i}) GROUP BY cluster, i
    ) GROUP BY cluster) AS m USING (cluster)
)""")
    parts.pop()  # the last assignment moves nothing
    return "WITH " + ", ".join(parts) + f"""
SELECT vec_id, CAST(best[2] AS INTEGER) AS cluster, best[1] AS distance, CAST(sum(best[1]) OVER (PARTITION BY best[2]) AS BIGINT) AS cluster_inertia,
       CAST(sum(best[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON best[2] = c{rounds}.cluster
"""


ORACLES: dict[str, str] = {"op11_annulus_search": _op11(), "op5_mixing": _OP5, "op12_incidence_audit": _OP12, "op13_grace_dedup": _OP13}
