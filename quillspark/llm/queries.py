"""The registered queries of the operators on the whole tables of documents and vectors, and SQL that checks them."""

from pyspark.sql import functions as F

from quillspark.llm import (
    centroids, exact_dedup, fingerprints, licenses, mixing, ngram_join, packing, pii, quality, suffix_dedup, token_files, toxicity, vector_codes,
)


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_pii(spark, sf_dir):
    return pii.summary(documents(spark, sf_dir))


def op2_mixing(spark, sf_dir):
    plan = mixing.mix_plan(documents(spark, sf_dir))
    rows = plan.select(
        F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken",
        F.when(F.size("visits") > 0, F.expr("visits[0].position")).alias("position"), "order",
    )
    placed = F.coalesce("position", F.lit(2.0))
    return rows.repartitionByRange(placed, F.col("order")).sortWithinPartitions(placed, "order").drop("order")


def op3_fingerprints(spark, sf_dir):
    return fingerprints.neighbour_fingerprints(documents(spark, sf_dir))


def op4_ngram_join(spark, sf_dir):
    rows = ngram_join.near_components(documents(spark, sf_dir), words=3, percent=90)
    return rows.select("doc_id", "n_shingles", "component_id")


def op5_licenses(spark, sf_dir):
    return licenses.summary(documents(spark, sf_dir))


def tokenizer(name):
    """Place of a public tokenizer's file; the operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), end_id=0)


def op7_exact_dedup(spark, sf_dir):
    return exact_dedup.copy_groups(documents(spark, sf_dir), digest_all=True)


def op8_toxicity(spark, sf_dir):
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_suffix_dedup(spark, sf_dir):
    return suffix_dedup.repeated_spans(documents(spark, sf_dir)).drop("starts", "ends")


def op10_token_files(spark, sf_dir):
    return token_files.token_table(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"), end_id=1)


def op11_quality(spark, sf_dir):
    return quality.quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_vector_codes(spark, sf_dir):
    return vector_codes.compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_centroids(spark, sf_dir):
    return centroids.clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


_OP2 = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(concat_ws('|', 'mix', doc_id)) AS ord
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3)::INT AS cls
  FROM sized GROUP BY source),
limits AS (SELECT *, (cls + 1)::DOUBLE AS weight, source_size * 3 AS most FROM sources),
filled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER earlier, 0))::BIGINT AS words_left,
         sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS weight_left
  FROM limits WINDOW earlier AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
opened AS (SELECT *, most * weight_left <= words_left * weight AS is_full FROM filled),
first_open AS (SELECT words_left, weight_left FROM opened WHERE NOT is_full ORDER BY weight_left DESC LIMIT 1),
targets AS (
  SELECT source, cls, weight, source_size,
         CASE WHEN is_full THEN most::DOUBLE
              ELSE (SELECT words_left::DOUBLE FROM first_open) * weight / (SELECT weight_left FROM first_open) END AS target
  FROM opened),
streams AS (
  SELECT s.*, t.cls, t.weight, t.source_size, t.target,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY ord, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
         CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
cuts AS (
  SELECT *, greatest(0, least(size, floor(target)::BIGINT - passes * source_size - start))::BIGINT AS extra FROM streams),
reads AS (
  SELECT *, passes * size + extra AS taken, CASE WHEN passes > 0 THEN size ELSE extra END AS first_words FROM cuts),
shares AS (
  SELECT *, least((start + first_words / 2) / target, 1.0::DOUBLE) * weight AS need,
         weight * (1 + [0.5, 0.0, -0.5][cls + 1]::DOUBLE) AS w0, weight * (1 - [0.5, 0.0, -0.5][cls + 1]::DOUBLE) AS w1
  FROM reads)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken,
       CASE WHEN first_words > 0 THEN CASE WHEN need <= 0 THEN 0.0::DOUBLE ELSE
         least(2.0::DOUBLE * need / (w0 + sqrt(greatest(w0 * w0 + 2 * (w1 - w0) * need, 0.0::DOUBLE))), 1.0::DOUBLE) END END AS position
FROM shares
"""

_OP7 = r"""
WITH normal AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER best = 1 AS kept, text_sha256
FROM normal WINDOW best AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id ASC NULLS LAST)
"""

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_FLOOR_MEAN = "(s - ((s % n) + n) % n) // n"


def _lloyd(rounds, assigned, entries):
    """CTEs a0, b1, a1, ...: assignments to entries b0, then entries by floored means and assignments again."""
    steps = [assigned.format(r=0)]
    for r in range(rounds):
        steps += [entries.format(r=r, q=r + 1), assigned.format(r=r + 1)]
    return ",\n".join(steps)


# parts and entries stand as rows (part, pos, x); k packs squared distance and index, so that its minimum is the nearest, ties to the lower index
_OP12 = (
    f"""
WITH kept AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY vec_id, embedding) AS row, len(embedding) // 4 AS width FROM embeddings WHERE {_FINITE}),
cells AS MATERIALIZED (
  SELECT row, (i - 1) // width AS part, (i - 1) % width AS pos, floor(1024 * embedding[i]::DOUBLE)::BIGINT AS x
  FROM (SELECT *, unnest(generate_series(1, len(embedding))) AS i FROM kept)),
b0 AS MATERIALIZED (SELECT part, row - 1 AS e, pos, x FROM cells WHERE row <= 256),
"""
    + _lloyd(
        4,
        """a{r} AS MATERIALIZED (
  SELECT row, part, min(d * 256 + e) AS k FROM (
    SELECT c.row, c.part, b.e, sum((c.x - b.x) * (c.x - b.x))::BIGINT AS d FROM cells c JOIN b{r} b USING (part, pos) GROUP BY ALL) GROUP BY ALL)""",
        f"""b{{q}} AS MATERIALIZED (
  SELECT part, e, pos, coalesce(m.x, b.x) AS x FROM b{{r}} b LEFT JOIN (
    SELECT part, e, pos, ({_FLOOR_MEAN})::BIGINT AS x FROM (
      SELECT part, k % 256 AS e, pos, sum(x)::BIGINT AS s, count(*) AS n FROM a{{r}} JOIN cells USING (row, part) GROUP BY ALL)) m USING (part, e, pos))""",
    )
    + """,
coded AS (
  SELECT row, string_agg(lower(lpad(hex(k % 256), 2, '0')), '' ORDER BY part) AS code, sum(k // 256)::BIGINT AS error FROM a4 GROUP BY row),
book AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, e, pos)) AS codebooks_sha256 FROM b4)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (row), book
"""
)

_OP13 = (
    f"""
WITH kept AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, embedding) AS row FROM embeddings WHERE {_FINITE} AND len(embedding) = 64),
cells AS MATERIALIZED (
  SELECT row, i AS pos, floor(256 * embedding[i]::DOUBLE)::BIGINT AS x FROM (SELECT *, unnest(generate_series(1, 64)) AS i FROM kept)),
b0 AS MATERIALIZED (SELECT row - 1 AS e, pos, x FROM cells WHERE row <= 40),
"""
    + _lloyd(
        5,
        """a{r} AS MATERIALIZED (
  SELECT row, min(d * 64 + e) AS k FROM (
    SELECT c.row, b.e, sum((c.x - b.x) * (c.x - b.x))::BIGINT AS d FROM cells c JOIN b{r} b USING (pos) GROUP BY ALL) GROUP BY ALL)""",
        f"""b{{q}} AS MATERIALIZED (
  SELECT e, pos, coalesce(m.x, b.x) AS x FROM b{{r}} b LEFT JOIN (
    SELECT e, pos, ({_FLOOR_MEAN})::BIGINT AS x FROM (
      SELECT k % 64 AS e, pos, sum(x)::BIGINT AS s, count(*) AS n FROM a{{r}} JOIN cells USING (row) GROUP BY ALL)) m USING (e, pos))""",
    )
    + """,
named AS (SELECT e, sha256(string_agg(x::VARCHAR, ',' ORDER BY pos)) AS centroid_sha256 FROM b5 GROUP BY e)
SELECT vec_id, (k % 64)::INTEGER AS cluster, k // 64 AS distance, sum(k // 64) OVER (PARTITION BY k % 64)::BIGINT AS cluster_inertia,
       sum(k // 64) OVER ()::BIGINT AS inertia, centroid_sha256
FROM a5 JOIN kept USING (row) JOIN named ON named.e = k % 64
"""
)

QUERIES = {
    "op1_pii": op1_pii,
    "op2_mixing": op2_mixing,
    "op3_fingerprints": op3_fingerprints,
    "op4_ngram_join": op4_ngram_join,
    "op5_licenses": op5_licenses,
    "op6_packing": op6_packing,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_token_files": op10_token_files,
    "op11_quality": op11_quality,
    "op12_vector_codes": op12_vector_codes,
    "op13_centroids": op13_centroids,
}

ORACLES = {"op2_mixing": _OP2, "op7_exact_dedup": _OP7, "op12_vector_codes": _OP12, "op13_centroids": _OP13}
