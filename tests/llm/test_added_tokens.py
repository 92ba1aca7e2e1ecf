"""Added tokens are matched in their own case, before the normalizer."""

import pytest

from tessera.llm import store, tokenfiles, wordhash


def test_added_tokens_keep_their_case():
    P = pytest.importorskip("public_tokenizers")
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = ["a <|ENDOFTEXT|> b", "a <|endoftext|> b", "X<|EndOfText|>Y <|STARTOFTEXT|>, Word", "Up<|startoftext|>UP.", "<|ENDOFTEXT|> \u00e9", "<|endoftext|>\u00c9", "<|", "Plain Words."]
    encoder = tokenfiles.PieceEncoder(path)
    for some in (texts, texts[::-1], *([t] for t in texts)):
        ids, cut = encoder.encode(*wordhash.text_buffers(pa.array(some)))
        assert [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in some]


def test_pieces_give_the_librarys_ids_whatever_is_remembered(monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [None, "", "a", "DON'T 123abc x,,y..", "e\u0301 \u03a3\u0391\u03a3. \u00abhm\u00bb.,, na\u00efve.,", "\x1f \x85 b\u00a0c", "\u0301 a'll a\x00b", "x" * 3000 + "!!", "\u0130i \u017f", "ab.Cd,9x 007"]
    texts += [f"w{i}ord{i * 7919 % 1000},{'xyz' * (i % 5)} Ab{i}" for i in range(300)]
    monkeypatch.setattr(tokenfiles, "REMEMBERED", 200)  # so that pieces are forgotten and learned again
    encoder = tokenfiles.PieceEncoder(path)
    for k in [*range(0, len(texts), 20), *range(0, len(texts), 20)]:
        ids, cut = encoder.encode(*wordhash.text_buffers(pa.array(texts[k : k + 20], pa.string())))
        assert [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts[k : k + 20]]
    assert len(encoder._key) < 600


def test_shards_keep_rows_without_an_id_and_the_least_id(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    docs = spark.createDataFrame([(None, "x"), (-(2**63), "y"), (5, None), (5, "z z"), (None, "")], "doc_id long, text string")
    encoded = tokenfiles.encode_documents(docs, P.path("word_bpe_49k.json"))
    files = store.materialise(tokenfiles.write_shards(encoded, f"file://{tmp_path}/s"), "f")
    got = [tuple(r)[:3] for r in tokenfiles.read_shards(files).orderBy("start").collect()]
    assert [g[0] for g in got] == [None, None, -(2**63), 5, 5] and sorted(g[2] for g in got) == [1, 1, 2, 2, 3]
    assert [g[1] for g in got] == [sum(g[2] for g in got[:i]) for i in range(5)]
