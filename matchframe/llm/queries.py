"""The registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, html_extract, lm_lattice, minmax_dedup, packing, pii_info, quality_nbsvm, quality_rules, sharding, simhash_dedup, simplex_clusters, token_align, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_lattice.score(table(spark, sf_dir, "documents"), lm_lattice.vocabulary_path())


def op2_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_nbsvm.score(docs, quality_nbsvm.fit(docs, table(spark, sf_dir, "labels")))


def op4_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_disclosure_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_info.find(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents"), "word_bpe_49k.json"))


def op7_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the contract's columns next_shard: where the row goes once the map is grown by a shard."""
    path = sharding.new_map_path(spark)
    placed = sharding.shard(table(spark, sf_dir, "documents"), map_path=path)
    grown = sharding.slot_map(spark, path, sharding.grow(spark, path, 40))
    grown = grown.select("virtual_slot", F.col("shard").alias("next_shard"))
    return placed.join(F.broadcast(grown), "virtual_slot")  # one row per slot


def op9_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")), 2)
    base = F.col("failures").bitwiseAND(F.lit(quality_rules.mask_of(quality_rules.POLICIES[1]))) != 0
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failures", "policy_version")


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op11_simplex_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simplex_clusters.clusters(table(spark, sf_dir, "embeddings"))


def op12_pair_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_align.tokenizer_path
    return token_align.alignment(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))


def op13_minmax_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_lattice_likelihood, op2_toxic_segments, op3_quality_nbsvm, op4_simhash_groups, op5_disclosure_spans, op6_best_fit_packing, op7_template_leaks, op8_virtual_slots, op9_rule_ledger,
        op10_main_text, op11_simplex_clusters, op12_pair_bitmaps, op13_minmax_groups, pipeline,
    )
}

#: All ten rounds written out: distances of all vectors to all centroids by axis, then the means.
_ROUND = """
d{k} AS MATERIALIZED (SELECT rid, c.k, CAST(sum((f.x - c.x) * (f.x - c.x)) AS BIGINT) AS d FROM flat f JOIN c{k} c ON f.axis = c.axis GROUP BY rid, c.k),
a{k} AS MATERIALIZED (SELECT rid, k, d FROM d{k} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, k) = 1),
m{k} AS MATERIALIZED (
  SELECT a.k, f.axis, CAST(sum(f.x) AS BIGINT) AS s, count(*) AS n FROM a{k} a JOIN flat f ON a.rid = f.rid GROUP BY a.k, f.axis),
c{next} AS MATERIALIZED (
  SELECT c.k, c.axis, CASE WHEN m.n IS NULL THEN c.x ELSE m.s // m.n - CASE WHEN m.s % m.n < 0 THEN 1 ELSE 0 END END AS x
  FROM c{k} c LEFT JOIN m{k} m ON c.k = m.k AND c.axis = m.axis),"""

ORACLE_SQL = {
    "op11_simplex_clusters": r"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS xs
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
flat AS MATERIALIZED (SELECT rid, unnest(range(1, 65)) AS axis, unnest(xs) AS x FROM kept),
c0 AS MATERIALIZED (
  SELECT k, unnest(range(1, 65)) AS axis, unnest(xs) AS x
  FROM (SELECT row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)), xs) - 1 AS k, xs FROM kept WHERE vec_id IS NOT NULL) WHERE k < 8),"""
    + "".join(_ROUND.format(k=k, next=k + 1) for k in range(10))
    + """
d10 AS MATERIALIZED (SELECT rid, c.k, CAST(sum((f.x - c.x) * (f.x - c.x)) AS BIGINT) AS d FROM flat f JOIN c10 c ON f.axis = c.axis GROUP BY rid, c.k),
a10 AS MATERIALIZED (SELECT rid, k, d FROM d10 QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, k) = 1),
h AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY axis)) AS sha FROM c10 GROUP BY k)
SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha AS centroid_sha256
FROM a10 a JOIN kept USING (rid) JOIN h ON a.k = h.k
""",
    "op13_minmax_groups": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (
  SELECT x, y FROM p JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * shared >= 80 * (nx.n + ny.n - shared)),
both_ways AS MATERIALIZED (SELECT x, y FROM e UNION SELECT y, x FROM e),
r(a, b) AS (SELECT x, y FROM both_ways UNION SELECT r.a, g.y FROM r JOIN both_ways g ON r.b = g.x),
low AS (SELECT a, least(a, min(b)) AS m FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m, w.doc_id) AS component_id, coalesce(m, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN low ON w.doc_id = low.a
""",
    "op9_rule_ledger": r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM p),
r AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words
      FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM g WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(ls) AS BIGINT) AS n_lines, regexp_matches(t, '\p{L}') AS has_letter
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
f AS (
  SELECT *, CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN word_chars > 25 * n_words THEN 4 ELSE 0 END) + (CASE WHEN 5 * n_symbols > n_words THEN 8 ELSE 0 END)
    + (CASE WHEN 2 * n_dup_lines > n_lines THEN 16 ELSE 0 END) + (CASE WHEN NOT has_letter THEN 32 ELSE 0 END) AS BIGINT) AS failures
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failures & 3) <> 0 AS base_failed, failures = 0 AS kept, failures, CAST(2 AS INTEGER) AS policy_version
FROM f
""",
}
