"""A training corpus from ``documents``: five stages, each written as Parquet and read by the next.

1. ``toxicity``: documents that the classifier rejects go.
2. ``near_duplicates``: of each group of near copies (five-word shingles, Jaccard 0.8) the smallest doc_id stays.
3. ``pii``: personal data is masked; ``n_chars`` follows the text.
4. ``mixing``: sources are tempered, every document being used at least once and none more than
   ``MAX_REPETITION`` times on average by source.
5. ``byte_bpe``: token ids, and the digest of what they decode to.

All but the last return the columns of their input.  Null texts count as empty in every
decision and stay null; rows without a doc_id can't be grouped and are kept by stage 2; of rows
that share a doc_id, stage 2 keeps the one with the smallest text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import bpe, mixing, ngramjoin, pii, store, toxicity

#: The most that a source's documents are repeated on average.
MAX_REPETITION = 1.25

#: No stage but the third could be put in SQL.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    store.reach_workers(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs.withColumn("__own", F.struct(*docs.columns)).select("__own", "text"), model)
    return scored.where(F.col("score") < toxicity.THRESHOLD).select("__own.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = ngramjoin.near_duplicates(docs, ngramjoin.Rule(size=5, num=80, den=100))
    stay = groups.where(F.col("component_id") == F.col("doc_id")).select("doc_id").distinct()
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last()))
    kept = docs.join(stay, "doc_id", "left_semi").withColumn("__rank", rank).where("__rank = 1").select(docs.columns)
    return kept.unionByName(docs.where("doc_id IS NULL"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _, plans = mixing.plan(mixing.measure(docs), entropy_share=0.99, max_repetition=MAX_REPETITION, cover=True)
    return mixing.realise(docs, plans)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("byte_bpe", to_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, store.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not read:
            store.discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
