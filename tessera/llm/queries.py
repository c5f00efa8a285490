"""The registered queries of the corpus operators: thin wrappers with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bitslice, crf, jaccard, licenses, mincut, mixing, packing, quality, sharding, suffixes

OP4_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
    FROM w
), n AS (
    SELECT w.doc_id, count(s.g) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY 1
), p AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
    SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)
), e AS (
    SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (
    SELECT doc_id AS root, doc_id AS node FROM w
    UNION
    SELECT r.root, e.y FROM r JOIN e ON e.x = r.node
)
SELECT n.doc_id, n.n AS n_shingles, m.component_id
FROM n JOIN (SELECT node, min(root) AS component_id FROM r GROUP BY 1) m ON m.node = n.doc_id
"""

OP6_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 50 = 0
), r AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP9_SQL = r"""
WITH d AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
           md5(concat(coalesce(CAST(doc_id AS VARCHAR), 'null'), ':mix')) AS key
    FROM documents
), g AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
    SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS ord FROM g
), c AS (
    SELECT *, CAST([3, 1, 2][(ord - 1) % 3 + 1] AS DOUBLE) AS w, CAST(2 * source_size AS DOUBLE) AS cap,
           1.5 * CAST((SELECT sum(source_size) FROM g) AS DOUBLE) AS budget
    FROM w
), l AS (
    SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(w) OVER (ORDER BY cap / w, ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM c
), m AS (
    SELECT max(level) AS level FROM l WHERE level <= cap / w
), t AS (
    SELECT source, source_size, coalesce(least(cap, (SELECT level FROM m) * w), cap) AS target FROM l
), e AS (
    SELECT *, CAST(round(target) AS BIGINT) AS take, CAST(round(target) AS BIGINT) // greatest(source_size, 1) AS epochs FROM t
), p AS (
    SELECT d.*, e.source_size, e.target, e.epochs, e.take - e.epochs * e.source_size AS rest,
           coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
    FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, rest - pos)) AS BIGINT) AS taken
FROM p
"""

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.identify(_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(_table(spark, sf_dir, "documents")).drop("_k1", "_k2")


def op5_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mincut.extract(_table(spark, sf_dir, "pages"))


def op6_bitslice(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return bitslice.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_crf, op2_quality, op3_sharding, op4_jaccard, op5_mincut, op6_bitslice, op7_packing, op8_licenses, op9_mixing, op10_suffixes)}


def oracle_sql() -> dict[str, str]:
    return {"op4_jaccard": OP4_SQL, "op6_bitslice": OP6_SQL, "op9_mixing": OP9_SQL}
