"""The pipeline's stages on a small corpus with known decisions."""

import random
import zlib

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for i in range(600):
        words = [word() for _ in range(40)]
        if i % 6 == 0:
            words[3:3] = ["vile", "scorn"]
        rows.append((i, " ".join(words), "en", f"s{i % 4 and 1 + i % 3}", 0))
    copied = rows[1][1].split()
    rows += [(1000, rows[1][1], "en", "s1", 0), (1001, " ".join([*copied[:-1], "changed"]), "en", "s1", 0), (1002, "call +31 20 123 4567 or a.b@c.de", "en", "s1", 7), (1003, None, "en", None, None), (None, rows[1][1], "en", "s1", 0)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(600)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, folder).cache()
    left = {r["doc_id"] for r in clean.collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert clean.columns == docs.columns
    assert sum((i in left) == (i % 6 > 0) for i in held) >= 0.95 * len(held) and {1, 1000, 1001, 1002, 1003, None} <= left
    single = stages["near_duplicates"](spark, clean, folder).cache()
    ids = [r["doc_id"] for r in single.collect()]
    assert single.columns == docs.columns and 1 in ids and None in ids and not {1000, 1001} & set(ids) and len(ids) == len(left) - 2
    masked = stages["pii"](spark, single, folder).cache()
    row = masked.where("doc_id = 1002").first()
    assert row["text"] == "call [PHONE] or [EMAIL]" and row["n_chars"] == len(row["text"]) and masked.columns == docs.columns
    mixed = stages["mixing"](spark, masked, folder).cache()
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} == set(ids)
    tokens = stages["byte_bpe"](spark, mixed, folder)
    assert tokens.count() == mixed.count() and tokens.where("n_tokens = 0").count() == mixed.where("text IS NULL OR text = ''").count()


def test_every_query_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in names if k.startswith("op")} and names["pipeline"] is corpus_pipeline.run


def test_run_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
