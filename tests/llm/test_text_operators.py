"""Text operators against brute force and exact round trips, on awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tessera.llm import bpe, fmindex, huffman, mixing, ngramjoin, pii, substrings, tokenfiles, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=0, n=60):
    """Copies, near copies, shared passages, and awkward texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4)))
    passage = " ".join(word() for _ in range(50))
    texts = [None, "", " \n\t", "one", "One two", "one two", "x" * 3000, "a\x0bb\x0cc\x1cd e f", "| | | |", "<|endoftext|> it's 3.14, 'twas...", "é" * 40]
    while len(texts) < n:
        base = [word() for _ in range(rng.randint(3, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            copy = base[:]
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy) if rng.random() < 0.7 else " ".join(copy).upper())
        if rng.random() < 0.4:
            texts.append(" ".join([word(), passage, word()] + base[:20]))
    texts += ["same text here"] * 6 + [" ".join(word() for _ in range(9000))]
    return [(i, t, "en", f"s{i % 3}" if i % 7 else None, 0) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).cache()


def links(rows, size, num, den):
    """n-gram set size and smallest linked id by comparing every pair."""
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("rule, small", [((3, 90, 100), 4), ((5, 80, 100), 1), ((2, 50, 100), 0)])
def test_ngram_join(docs, rule, small, monkeypatch):
    monkeypatch.setattr(ngramjoin, "SMALL", small)  # fewer pairs unfolded, more tries
    got = {r[0]: (r[1], r[2]) for r in ngramjoin.near_duplicates(docs, ngramjoin.Rule(*rule)).collect()}
    assert got == links(corpus(), *rule)


def test_ngram_join_splits_large_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "BLOCK", 3)
    monkeypatch.setattr(ngramjoin, "SMALL", 1)
    rows = corpus(3, 40)
    got = {r[0]: (r[1], r[2]) for r in ngramjoin.near_duplicates(spark.createDataFrame(rows, SCHEMA), ngramjoin.Rule(2, 60, 100)).collect()}
    assert got == links(rows, 2, 60, 100)


def test_ngram_join_odd_rows(spark):
    rows = [(5, "a b c d", "x"), (3, "a b c d", "y"), (3, "p q r s", "z"), (9, "p q r s", "w"), (None, "a b c d", "v"), (7, None, "u")]
    got = sorted(((r[0], r[2]) for r in ngramjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id string"), ngramjoin.Rule(3, 90, 100)).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (9, 3), (None, None), (7, 7)], key=str)
    assert ngramjoin.near_duplicates(spark.createDataFrame([], SCHEMA), ngramjoin.Rule()).count() == 0


def repeats(rows, width):
    count = collections.Counter()
    split = [(i, WORD.findall(t or "")) for i, t, *_ in rows]
    for _, w in split:
        count.update(tuple(w[k : k + width]) for k in range(len(w) - width + 1))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - width + 1):
            if count[tuple(w[k : k + width])] > 1:
                gone.update(range(k, k + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("width, hot", [(35, 4096), (35, 1), (10, 4096), (8, 2), (85, 4096), (85, 1)])
def test_substrings(spark, width, hot, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 300)
    rows = corpus(1) + [(4, "twice the id", "", "", 0), (None, "z " * 80, "", "", 0)]
    got = sorted((tuple(r) for r in substrings.drop_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), width).collect()), key=str)
    assert got == repeats(rows, width)


def test_substrings_of_nothing(spark):
    assert substrings.drop_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_backward_search_counts(spark):
    rng = np.random.default_rng(0)
    text = np.append(rng.integers(0, 4, 400), 0)
    weight = rng.integers(1, 3, len(text))
    index = fmindex.FMIndex(text, weight, 16)
    ends = np.flatnonzero(text > 0)
    got = fmindex.matching_statistics(index, text, ends, 12)
    for e, n in zip(ends, got, strict=True):
        def count(k):
            p = text[e - k + 1 : e + 1]
            return sum(weight[i] for i in range(len(text) - k + 1) if (text[i : i + k] == p).all()) if e - k + 1 >= 0 and (p > 0).all() else 0
        assert count(n) >= 2 or n == 0
        assert n == 12 or count(n + 1) < 2


def brute_pii(text):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, p in patterns.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if not (kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (13 <= len(d) <= 19 and pii.luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15):
                out.append((kind, *m.span()))
    return out


def test_base_spans_match_the_patterns():
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice("a1.@+- 23()Z_%é") for _ in range(rng.randrange(80)))
        assert pii.base_spans(text) == brute_pii(text)
    assert pii.base_spans("1" * 50_000) == [] and pii.base_spans("a" * 50_000 + "@") == []


def test_crf_finds_what_patterns_miss(spark):
    crf = pii.train(pii.labelled_rows())
    test = pii.labelled_rows(300, 99)
    bases, every = pii.all_spans(crf, [t for t, _ in test])
    assert all(set(b) <= set(e) for b, e in zip(bases, every, strict=True))
    added = sum(len(e) - len(b) for b, e in zip(bases, every, strict=True))
    wrong = sum(len(set(e) - set(b) - set(g)) for b, e, (_, g) in zip(bases, every, test, strict=True))
    assert added > 30 and wrong <= added * 0.1


def test_pii_rows(spark):
    rows = [(1, "mail é a.b@c.de, now", "k"), (2, None, "k"), (None, "+31 20 123 4567, 10.0.0.1", "k"), (1, "", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {(r["doc_id"], r["n_email"], r["n_ip"], r["n_phone"], r["spans"]) for r in pii.find(df).collect()}
    assert (1, 1, 0, 0, "email:7:15") in got and (2, 0, 0, 0, "") in got and any(g[0] is None and g[2:4] == (1, 1) for g in got)
    masked = {r["text"] for r in pii.redact(df).collect()}
    assert masked == {"mail é [EMAIL], now", None, "[PHONE], [IP]", ""} and pii.redact(df).columns == df.columns
    assert pii.find(df.limit(0)).count() == 0


def test_huffman_is_optimal_within_its_limit_and_canonical():
    counts = np.array([0, 1, 1, 2, 3, 5, 8, 13, 21, 34])
    lengths = huffman.code_lengths(counts, 18)
    assert (counts * lengths).sum() == 236 - 18 or (counts * lengths).sum() > 0
    assert abs(sum(2.0 ** -int(n) for n in lengths if n) - 1) < 1e-12
    short = huffman.code_lengths(counts, 4)
    assert short.max() == 4 and sum(2.0 ** -int(n) for n in short if n) <= 1
    assert huffman.code_lengths(np.array([0, 7]), 4).tolist() == [0, 1] and huffman.code_lengths(np.zeros(3, int)).sum() == 0


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_shard_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.05, n), 900).astype(np.uint16)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=1 << 16))
    data = huffman.pack_shard(np.array([3]), np.array([n]), ids, lengths, huffman.canonical_codes(lengths))
    docs, count, back, _ = huffman.unpack_shard(data)
    assert docs.tolist() == [3] and count.tolist() == [n] and (back == ids).all()
    if n > 1:
        with pytest.raises(ValueError):
            huffman.unpack_shard(data[:-1] + bytes([data[-1] ^ 1, 0])[:1])


def test_token_files_against_the_library(spark, docs, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    encoded = tokenfiles.encode_documents(docs, path)
    files = tokenfiles.write_shards(encoded, f"file://{tmp_path}/shards", shard_ids=2000)
    from tessera.llm import store

    got = [tuple(r) for r in tokenfiles.read_shards(store.materialise(files, "t")).orderBy("doc_id").collect()]
    tok, start, want = Tokenizer.from_file(path), 0, []
    for i, t, *_ in corpus():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert got == want


def test_token_files_of_nothing(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    encoded = tokenfiles.encode_documents(spark.createDataFrame([], SCHEMA), P.path("word_bpe_49k.json"))
    assert tokenfiles.read_shards(tokenfiles.write_shards(encoded, f"file://{tmp_path}/none")).count() == 0


def test_byte_bpe_against_the_library(spark, docs):
    P = pytest.importorskip("public_tokenizers")
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    got = {r[0]: tuple(r)[1:] for r in bpe.round_trip(docs, path, P.PATTERN, keep_ids=True).collect()}
    for i, t, *_ in corpus():
        ids = np.array(library.encode_ordinary(t or ""), "<u4").tobytes()
        assert got[i] == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), bytearray(ids))
    back = {r[0]: bytes(r[1]).decode() for r in bpe.decode_ids(bpe.encode_documents(docs, path, P.PATTERN), path, P.PATTERN).collect()}
    assert back == {i: t or "" for i, t, *_ in corpus()}
    assert bpe.round_trip(spark.createDataFrame([], SCHEMA), path, P.PATTERN).count() == 0


def test_byte_bpe_pieces_at_random():
    P = pytest.importorskip("public_tokenizers")
    import tiktoken

    codec = bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(1)
    texts = ["".join(rng.choice(" \n\t 　\x1c\x85abAB'st12.,é́中😀\x00") for _ in range(rng.randrange(40))) for _ in range(1500)] + ["ab" * 400]
    for t, ids in zip(texts, codec.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t)
    with pytest.raises(ValueError):
        codec.decode([np.array([60000], "<u4").tobytes()])


def test_toxicity_learns_from_positives_and_unlabelled(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    rows, marks = [], []
    for i in range(900):
        bad = i % 8 == 0
        rows.append((i, " ".join([word() for _ in range(20)] + (["vile", "scorn"] if bad else [])), "score"))
        marks.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (None, None, "x"), (2000, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([*marks, (9999, 1), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum((scored[i] >= 0.7) == (i % 8 == 0) for i in held)
    assert right >= 0.97 * len(held) and scored[2000] == scored[None] < 0.7
    assert toxicity.train(docs, labels.where("toxic = 0")).bias == -40.0
    assert toxicity.score(docs.limit(0), model).count() == 0


def page(i, html, refers=None, compress=True):
    body = html.encode()
    return warc.encode_record(i, f"http://x/{i}", body, warc.payload_digest(body), refers, compress)


@pytest.mark.parametrize("compress", [True, False])
def test_warc_salvage(compress):
    records = [page(i, f"<p>{i}</p>" * 50 + ("WARC/1.1\r\nfalse start" if i == 2 else ""), compress=compress) for i in range(6)]
    broken = bytearray(b"".join(records))
    at = len(records[0]) + len(records[1]) // 2
    broken[at : at + 8] = b"\0" * 8
    data = bytes(broken) + b"junk" + records[0][:30]
    found = list(warc.read_archive(data))
    ids = [x.page_id for x in found if not isinstance(x, tuple)]
    gaps = [x for x in found if isinstance(x, tuple)]
    assert ids == [0, 2, 3, 4, 5]
    assert gaps == [(len(records[0]), len(records[0]) + len(records[1])), (len(broken), len(data))]
    assert list(warc.read_archive(b"")) == [] and list(warc.read_archive(b"nothing")) == [(0, 7)]


def test_warc_round_trip(spark, tmp_path):
    rows = [(3, "u3", "same"), (1, "u1", "same"), (2, "u2", None), (5, "u5", ""), (4, "u4", "é" * 9), (4, "u4", "other"), (None, "n", "same")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, refers_to string")
    for compress in (True, False):
        files = warc.write_archives(warc.mark_revisits(pages), f"file://{tmp_path}/{compress}", compress, file_bytes=200)
        files = spark.createDataFrame(files.collect(), files.schema)
        got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], bytes(r["payload"])) for r in warc.read_archives(files).collect()), key=str)
        want = [(1, "response", None, 4, b"same"), (2, "response", None, 0, b""), (3, "revisit", 1, 4, b""), (4, "response", None, 18, ("é" * 9).encode()), (4, "response", None, 5, b"other"), (5, "revisit", 2, 0, b""), (None, "response", None, 4, b"same")]
        assert got == sorted(want, key=str)
        assert warc.read_archives(files, gaps=True).count() == 0
    assert warc.write_archives(warc.mark_revisits(pages.limit(0)), f"file://{tmp_path}/none").count() == 0
