"""Every ``opN_`` query as registered, on the smallest tables: against its DuckDB text, or against the libraries and plain versions."""

import hashlib
import os
import zlib

import numpy as np
import pytest

from tessera.llm import toxicity
from tessera.llm.queries import ORACLES, QUERIES
from tests.test_oracle import plain

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def table(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in table(spark, "documents").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for one in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {one} AS FROM '{FOLDER}/{one}.parquet'")
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    found = QUERIES[name](spark, FOLDER)
    assert sorted(names) == sorted(found.columns)
    rows = sorted((tuple(plain(r[c]) for c in names) for r in found.collect()), key=repr)
    assert rows == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)


def test_op2(spark):
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in table(spark, "embeddings").collect() if r["embedding"]}
    got = QUERIES["op2_multi_index"](spark, FOLDER).collect()
    found = {}
    for r in got:
        assert r["query_id"] % 20 == 0 and r["vec_id"] != r["query_id"] and abs(r["score"] - float(x[r["query_id"]] @ x[r["vec_id"]])) < 1e-12
        found.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    assert set(found) == {q for q in x if q % 20 == 0} and all(sorted(f) == list(range(1, 21)) for f in found.values())
    best = {q: set(sorted((i for i in x if i != q), key=lambda i: (-float(x[q] @ x[i]), i))[:20]) for q in found}
    assert np.mean([len(best[q] & set(f.values())) / 20 for q, f in found.items()]) >= 0.9


def test_op6(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    library, start = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op6_token_files"](spark, FOLDER).collect()}
    known = texts(spark)
    assert got.keys() == known.keys()
    for i in sorted(known):
        ids = [*library.encode(known[i], add_special_tokens=False).ids, 1]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op8(spark):
    P = pytest.importorskip("public_tokenizers")
    import tiktoken

    from tessera.llm.bpe import load_ranks

    library = tiktoken.Encoding("ranks", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op8_byte_bpe"](spark, FOLDER).collect()}
    for i, text in texts(spark).items():
        ids = library.encode_ordinary(text)
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_op3(spark):
    from tessera.llm import pii

    got = {r["doc_id"]: r for r in QUERIES["op3_pii"](spark, FOLDER).collect()}
    for i, text in texts(spark).items():
        base = sorted(pii.base_spans(text), key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        assert got[i]["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert set(pii.joined(base).split(",")) <= set(got[i]["spans"].split(","))


def test_op4_and_op7(spark):
    known = texts(spark)
    mixed = {r["doc_id"]: r for r in QUERIES["op4_mixing"](spark, FOLDER).collect()}
    assert mixed.keys() == known.keys() and all(r["copies"] == len(r["places"]) and r["copies"] <= 4 for r in mixed.values())
    assert all(r["n_tokens"] == len([w for w in known[i].encode().split()]) for i, r in mixed.items())
    scored = {r["doc_id"]: r for r in QUERIES["op7_toxicity"](spark, FOLDER).collect()}
    assert scored.keys() == known.keys()
    for i, r in scored.items():
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= toxicity.THRESHOLD) and r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
