"""The corpus operators' queries, by name, and their SQL where DuckDB can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, chat, dualtree, imatch, langid, licenses, mixing, probminhash, rlz, threshold, token_counts, toxicity
from .common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def tokenizer(name: str) -> str:
    """Where a public vocabulary file is; it is installed on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"))


PROBE = "</s>[INST] ok [/INST]"


@query
def op2_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return chat.digests(turns.unionByName(probe))


# The characters of escape(x): one more for each backslash and control string.
_ESC = r"(length({0}) + len(regexp_extract_all({0}, '\\|</?s>|\[/?INST\]|\[/?ROLE\]')))"
ORACLE_SQL["op2_chat_template"] = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(3 + sum(13 + {_ESC.format("role")} + {_ESC.format("text")} + CASE WHEN role = 'assistant' THEN 4 ELSE 13 END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


@query
def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(read(spark, sf_dir, "documents"))


ORACLE_SQL["op4_source_mix"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, 3.0::DOUBLE * sum(size)::DOUBLE AS cap FROM d GROUP BY source),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
    row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS k FROM s),
f AS (SELECT level FROM l WHERE cap >= level * w ORDER BY k LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN source_size > 0 THEN least(w * f.level, cap) ELSE 0.0 END AS target,
    ('0x' || substr(md5('20|' || coalesce('s' || source, 'n')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u FROM l, f),
p AS (
  SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY size, substr(md5(doc_id::VARCHAR), 1, 2), doc_id)::DOUBLE AS place FROM d)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size > 0 THEN floor(place * (target / source_size::DOUBLE) + u) - floor((place - 1) * (target / source_size::DOUBLE) + u) ELSE 0 END AS BIGINT) * size AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
"""


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(read(spark, sf_dir, "documents"))


ORACLE_SQL["op1_license_scan"] = licenses.oracle_sql()


@query
def op10_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold.nearest(read(spark, sf_dir, "embeddings"))


ORACLE_SQL["op10_threshold_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.held_out_report(read(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edit_report(read(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE_SQL["op3_imatch"] = imatch.oracle_sql()


@query
def op5_rlz_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz.digests(read(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE_SQL["op5_rlz_substrings"] = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM d WHERE len(w) >= 20),
h AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM s),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM h) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r),
g AS (SELECT doc_id, list(p) AS p FROM c GROUP BY doc_id),
e AS (SELECT d.doc_id, len(w) AS n_words, list_filter(w, lambda x, i: p IS NULL OR NOT list_contains(p, i)) AS kept FROM d LEFT JOIN g ON d.doc_id = g.doc_id)
SELECT doc_id, n_words, n_words - len(kept) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM e
"""


@query
def op6_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.report(read(spark, sf_dir, "documents"))


@query
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digests(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dualtree.hard_negatives(read(spark, sf_dir, "embeddings"))


ORACLE_SQL["op11_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 100 * score BETWEEN 50 * positive_score AND 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
