"""The registered queries of this subpackage: thin wrappers over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file is; the operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import piece_digests

    return piece_digests(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_report

    return mix_report(_table(spark, sf_dir, "documents"))


def op5_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import token_report

    return token_report(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import score_documents

    good = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return score_documents(_table(spark, sf_dir, "documents"), good, tokenizer_file("piece_bpe_32k.model"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secret_report

    return secret_report(_table(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_classes

    return jaccard_classes(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import language_report

    return language_report(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_report

    return quality_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_ngram_jaccard, op3_mixing, op4_language_id, op5_embedding_neardup, op6_token_files, op7_nearest, op8_lm_score, op9_secrets, op10_quality)}

_JACCARD = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(x, y) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, CAST(min(r.y) AS BIGINT) AS component_id
FROM s JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, len(sh)
"""

_NEAR = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
n AS (SELECT x, count(*) AS c FROM links GROUP BY x),
m AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT v.vec_id, CAST(coalesce(n.c, 0) AS BIGINT) AS n_links, CAST(m.c AS BIGINT) AS component_id, v.vec_id = m.c AS kept
FROM v JOIN m ON m.x = v.vec_id LEFT JOIN n ON n.x = v.vec_id
"""


def _secrets_sql() -> str:
    """The base and further rules, cut at their matches: lengths of cuts and matches give the places."""
    from .secrets import RULES

    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    parts = []
    for r in RULES:
        p = quoted(r.pattern)
        parts.append(
            f"SELECT doc_id, {r.rank} AS rank, '{r.kind}' AS kind, {str(r.base).lower()} AS base, i,"
            f" list_sum(list_transform(cuts[1:i], lambda c: length(c))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS s, length(hits[i]) AS n, length(marks[i]) AS k, {r.least} AS least"
            f" FROM (SELECT doc_id, hits, cuts, marks, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, {p}, 0) AS hits, string_split_regex(text, {p}) AS cuts, regexp_extract_all(text, {p}, {r.group}) AS marks FROM d))"
        )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS (SELECT doc_id, rank, kind, base, CAST(s AS BIGINT) AS s, CAST(s + n AS BIGINT) AS e FROM ({" UNION ALL ".join(parts)}) WHERE k >= least)
SELECT d.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (WHERE base), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (WHERE kind IS NOT NULL), '') AS spans
FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id
"""


ORACLES: dict[str, str] = {"op2_ngram_jaccard": _JACCARD, "op5_embedding_neardup": _NEAR, "op9_secrets": _secrets_sql()}
