"""Registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.llm import alignment, clustering, decontamination, html_extract, language_id, line_dedup, mixing, packing, pii, quality_classifier, quality_rules, simhash, toxicity
from sessionlake.llm.labelled import fold

ACCEPT = 0.3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(folds: int, out: int):
    return F.coalesce(fold(F.col("doc_id"), folds) == out, F.lit(False)).alias("held_out")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_lines(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs)).select("doc_id", _held_out(3, 1), "lang_pred", "score")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", _held_out(4, 2), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = quality_classifier.score(docs, quality_classifier.fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", _held_out(5, 0), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    found = html_extract.extract_text(pages, html_extract.fit(pages))
    return found.select("page_id", "url", "text", html_extract.code_points(F.col("text")).alias("n_chars"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.with_inertia(clustering.cluster(clustering.whole_vectors(_table(spark, sf_dir, "embeddings"))))


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_counts(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_decontamination, op2_line_dedup, op3_language_id, op4_toxicity, op5_quality_rules, op6_quality_classifier, op7_simhash, op8_html_extraction, op9_pii, op10_mixing, op11_clustering, op12_alignment, op13_packing)
}

_OP5 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS rid, hash(doc_id, source, text) AS did FROM documents),
w AS (
  SELECT rid, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
win AS (
  SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS h
  FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, h) AS n FROM win) WHERE n > 1),
covered AS (
  SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n_repeat_words
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM twice) GROUP BY rid),
l AS (
  SELECT rid, did, source, line FROM (SELECT rid, did, source, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY rid),
norm AS (
  SELECT rid, did, source, lower(trim(line)) AS line,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l),
lim AS (SELECT source, greatest(20, floor(count(DISTINCT did) * 0.1)) AS lim FROM d GROUP BY source),
freq AS (
  SELECT norm.source, line FROM norm JOIN lim ON norm.source IS NOT DISTINCT FROM lim.source
  GROUP BY norm.source, line HAVING count(DISTINCT did) > any_value(lim)),
lost AS (
  SELECT rid, sum(n) AS lost FROM norm JOIN freq
    ON norm.source IS NOT DISTINCT FROM freq.source AND norm.line = freq.line GROUP BY rid),
b AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(lost, 0) AS BIGINT) AS n_boilerplate_words
  FROM d JOIN w USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN covered USING (rid) LEFT JOIN lost USING (rid)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT n_boilerplate_words > 0.5 * n_words AS kept, n_boilerplate_words
FROM f
"""

_OP10 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
  FROM d GROUP BY source),
r AS (SELECT *, CAST(source_size * 2 AS DOUBLE) AS cap, CAST(source_size * 2 AS DOUBLE) / weight AS ratio FROM s),
n AS (
  SELECT *, row_number() OVER o AS nth,
         (sum(cap) OVER () * 0.75 - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM r WINDOW o AS (ORDER BY ratio, source NULLS LAST)),
t AS (
  SELECT source, source_size, least(cap, weight * (SELECT arg_min(level, nth) FROM n WHERE level <= ratio)) AS target FROM n),
p AS (
  SELECT doc_id, size, source_size, target, CAST(round(target) AS BIGINT) AS quota,
         CAST(sum(size) OVER (PARTITION BY d.source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS BIGINT) - size AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       greatest(0, least(place + size, quota) - place) + greatest(0, least(place + size, quota - source_size) - place) AS taken
FROM p
"""



def _op11_sql(k: int = 16, rounds: int = 3) -> str:
    """Plain rounds over all distances, in DuckDB's SQL."""
    parts = ["""v AS (
  SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"""c0 AS (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS m
  FROM (SELECT v, sha256('1:' || vec_id) AS h FROM v WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {k}))"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
  SELECT rid, arg_min(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT rid, c, CAST(list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{r}) GROUP BY rid)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c, coalesce(m2, m) AS m FROM c{r} LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m2
    FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v JOIN a{r} USING (rid)) GROUP BY c, i) GROUP BY c) USING (c))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(m, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM v JOIN a{rounds} USING (rid) JOIN c{rounds} USING (c)"""


ORACLE_SQL: dict[str, str] = {"op5_quality_rules": _OP5, "op10_mixing": _OP10, "op11_clustering": _op11_sql()}
