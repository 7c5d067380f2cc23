"""From raw documents to encoded training documents, stage by stage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwake.llm import language, mixing, pieces, secrets
from emberwake.llm.arrow import free
from emberwake.llm.jaccard import jaccard_rows, text_key
from emberwake.llm.queries import tokenizer_file
from emberwake.session import checkpoint_dir, cut

#: A language less sure than this is a rejection, as is a text without a letter.
LEAST_SCORE = 0.4
PIECES = "piece_bpe_32k.model"


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages. Learned as in op4, without the held-out rows."""
    model = language.train(docs.where(~language.held_out(docs["doc_id"], 4, 2)), tokenizer_file(PIECES))
    found = language.identify(docs, model, keep=True)
    pred, score = found.columns[-2:]
    return found.where((F.col(pred) != language.UNDETERMINED) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: of smallest id, or without id if none has one.

    Rows are told apart by id and text, so a repeated id with another text, and rows without an id, stay if no
    other row is their near copy. A row repeated with its id stays once. Texts without words are copies of nothing.
    """
    names = docs.columns
    rows = cut(jaccard_rows(docs).select("doc_id", "text_key", "n_shingles", "class_id"))
    order = F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "text_key")
    linked = rows.where("n_shingles > 0").groupBy("class_id").agg(F.min(order).alias("first")).select("first.doc_id", "first.text_key")
    alone = rows.where("n_shingles = 0").select("doc_id", "text_key").distinct()
    own, i, key = free(names, "_text_key", "_id", "_key")
    first = linked.union(alone).select(F.col("doc_id").alias(i), F.col("text_key").alias(key))
    same = F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(own) == F.col(key))
    keyed = docs.withColumn(own, text_key(F.col("text").cast("string")))
    kept = keyed.join(first, same, "left_semi")
    repeated = rows.where("doc_id is not null or n_shingles > 0").groupBy("doc_id", "text_key").count().where("count > 1")
    repeated = repeated.select(F.col("doc_id").alias(i), F.col("text_key").alias(key))
    if repeated.isEmpty():
        return kept.select(*names)
    once = kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", own])
    return kept.join(repeated, same, "left_anti").unionByName(once).select(*names)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars counted anew where the text changed."""
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix plays, twice if it plays them twice."""
    return mixing.mix(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document of the mix."""
    return pieces.piece_digests(docs, tokenizer_file(PIECES))


STAGES = [
    ("language", keep_known_language),
    ("ngram_jaccard", keep_one_of_copies),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Language models and tokenizers are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each result is written as Parquet in the shared folder and read again."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/corpus-pipeline/{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
