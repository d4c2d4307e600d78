"""The training-data pipeline: each stage reads what the one before it wrote.

toxicity -> near duplicates -> decontamination -> personal data -> token ids.
Every row is a document: rows with null or repeated ids are judged one by one,
and of rows that are alike the near-duplicate stage keeps one. Null texts count
as empty. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit.llm import bpe, decontam, minhash, pii, queries, toxicity
from marlpit.llm.common import cut, give_back, table

#: Percent of shared shingles from which documents are near duplicates.
NEAR_PERCENT = 80


def whole_rows(docs: DataFrame) -> DataFrame:
    """(row, text): every column in one struct, which operators carry as the row's identity."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose toxicity stays below the operator's threshold; learn from the labelled rows that are not held out."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.not_held_out())
    kept = toxicity.score(whole_rows(docs), model, "row").where("predicted = 0").select("doc_id.*")
    # The driver's copy has been shipped; the memory that training took is not kept through the stages to come.
    del model
    give_back()
    return kept


#: A column that no table of documents has.
OWN_ID = "own id "


def with_own_ids(docs: DataFrame) -> DataFrame:
    """docs with an id of its own, OWN_ID, for every row: doc_id, or a number past all of them where that is null or repeats."""
    shared = docs.groupBy("doc_id").agg(F.count("*").alias("rows ")).where("`rows ` > 1 or doc_id is null").select("doc_id", F.lit(True).alias("shared "))
    if shared.isEmpty():
        return docs.withColumn(OWN_ID, F.col("doc_id"))
    most = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0)).cast("long")).first()[0]
    marked = docs.join(shared.where("doc_id is not null"), "doc_id", "left").withColumn("shared ", F.coalesce("shared ", F.col("doc_id").isNull()))
    # Written, so that a row keeps its number.
    return cut(marked.withColumn(OWN_ID, F.when(F.col("shared "), F.monotonically_increasing_id() + F.lit(most + 1)).otherwise(F.col("doc_id"))).drop("shared "))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near duplicates, that with the smallest id; rows whose id is null or repeats are documents of their own."""
    numbered = with_own_ids(docs)
    kept = minhash.near_duplicates(numbered, NEAR_PERCENT, id_col=OWN_ID).where("kept").select(F.col("doc_id").alias(OWN_ID))
    return numbered.join(kept, OWN_ID, "left_semi").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents in which no benchmark window occurs."""
    found = decontam.find_windows(whole_rows(docs), table(spark, sf_dir, "benchmark"), id_col="row")
    return found.where(F.size("hit_spans") == 0).select("doc_id.*")


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write surrogates over personal data; n_chars follows the new text."""
    clean = pii.replace_pii(docs, queries.SAMPLE_KEY).select(docs.columns)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def to_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as packed token ids, with digests of the ids and of what they decode to."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(whole_rows(docs), ranks, public_tokenizers.PATTERN, "row", decoded=True)
    kept = [F.col(f"doc_id.{c}").alias(c) for c in ("doc_id", "lang", "source") if c in docs.columns]
    return encoded.select(
        *kept,
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_personal_data),
    ("byte_bpe", to_token_ids),
]

#: Trained scores, groups and merges are beyond SQL; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
