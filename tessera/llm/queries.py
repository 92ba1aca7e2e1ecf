"""The ``opN_<name>`` queries: each applies its operator to a whole table and derives the agreed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.oracles import ORACLES  # noqa: F401


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    from tessera.llm.store import reach_workers

    reach_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import toxicity

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (toxicity.fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import store, warc

    pages = warc.mark_revisits(_read(spark, sf_dir, "pages"), least_bytes=0)
    files = store.materialise(warc.write_archives(pages, store.fresh_path(spark, "warc")), "warc-files")
    tasks = max(1, files.count())
    return warc.read_archives(files.repartition(tasks), keep_payload=False).drop("payload")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from tessera.llm import store, tokenfiles

    encoded = tokenfiles.encode_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    encoded = store.materialise(encoded, "encoded")
    files = store.materialise(tokenfiles.write_shards(encoded, store.fresh_path(spark, "hufids")), "hufids-files")
    return tokenfiles.read_shards(files, keep_ids=False)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from tessera.llm import bpe

    return bpe.round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import pii

    return pii.find(_read(spark, sf_dir, "documents"))


def op2_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import multiindex

    return multiindex.nearest(_read(spark, sf_dir, "embeddings"), every=20, k=20)


def op9_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import covertree

    return covertree.exact_top_k(_read(spark, sf_dir, "embeddings"), every=20, k=20, scale=64)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import mixing

    sizes = mixing.measure(_read(spark, sf_dir, "documents"))
    mix, plans = mixing.plan(sizes, entropy_share=0.97, max_repetition=4.0)
    found = mixing.assign(sizes, plans).withColumns({"alpha": F.lit(mix.alpha), "targets_met": F.lit(mix.entropy_met and mix.repetition_met)})
    return found.select("doc_id", "source", "n_tokens", "weight", "copies", "block", "places", "alpha", "targets_met")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import ngramjoin

    return ngramjoin.near_duplicates(_read(spark, sf_dir, "documents"), ngramjoin.Rule(size=3, num=90, den=100))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import substrings

    return substrings.drop_repeats(_read(spark, sf_dir, "documents"), width=35).drop("kept")


QUERIES = {"op10_substrings": op10_substrings, "op1_ngram_join": op1_ngram_join, "op4_mixing": op4_mixing, "op9_cover_tree": op9_cover_tree, "op2_multi_index": op2_multi_index, "op3_pii": op3_pii, "op8_byte_bpe": op8_byte_bpe, "op6_token_files": op6_token_files, "op5_warc": op5_warc, "op7_toxicity": op7_toxicity}
