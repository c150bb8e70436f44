"""Byte-level BPE against tiktoken, and token files against plain counts."""

import base64
import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from textlake.llm import bpe, tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

TEXTS = [None, "", " ", "  \n\n x", "Hello world's don't I'll", "naïve café — 東京 😀😀", "a" * 5000, "\x00\xffĀ ", "1234567890 " * 50, "<|endoftext|>", "  " * 999, "ß" * 300, "x y\r\n\tz"]


def peer(name):
    path = public_tokenizers.path(name)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module", params=["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def pair(request):
    path, enc = peer(request.param)
    return bpe.Tokenizer(open(path, "rb").read(), public_tokenizers.PATTERN).build(), enc


def ids(tokenizer, text):
    return np.frombuffer(tokenizer.encode(text), "<u4").tolist()


def test_same_ids_as_tiktoken(pair):
    own, enc = pair
    for text in TEXTS:
        assert ids(own, text) == enc.encode_ordinary(text or "")
        assert own.decode(own.encode(text)) == (text or "").encode()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("abthe in'sç 1é\n", max_size=80))
def test_same_ids_for_any_text(pair, text):
    own, enc = pair
    assert ids(own, text) == enc.encode_ordinary(text)


def test_every_token_encodes_as_the_merges_say(pair):
    own, enc = pair
    words = [w for w in own.ranks if w.decode("utf-8", "ignore").encode() == w]
    for w in words[:: max(1, len(words) // 4000)]:
        assert ids(own, w.decode()) == enc.encode_ordinary(w.decode())


def test_small_memory_gives_the_same_ids(pair, monkeypatch):
    own, enc = pair
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    fresh = bpe.Tokenizer(own.rank_file, own.pattern).build()
    text = "the quick brown fox jumps over the lazy dog and the quickest brownest foxes jumped"
    assert ids(fresh, text) == ids(fresh, text) == enc.encode_ordinary(text)


@pytest.fixture(scope="module")
def tokenizer(spark):
    return bpe.load(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", i) for i, t in enumerate(TEXTS)] + [(None, "x", None, None), (1, "", "y", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, made string, token_ids long").repartition(3)


def test_digests_and_recoding(spark, docs, tokenizer):
    _, enc = peer("byte_bpe_multi_50k.tiktoken")
    got = bpe.digests(docs, tokenizer).collect()
    assert len(got) == docs.count()
    want = {i: enc.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] != 1:
            w = want[r["doc_id"]]
            assert r["n_tokens"] == len(w) and r["ids_sha256"] == hashlib.sha256(np.array(w, "<u4").tobytes()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256((TEXTS[r["doc_id"]] or "").encode()).hexdigest()
    back = bpe.recoded(docs, tokenizer)
    assert set(back.columns) == set(docs.columns)
    for r in back.where("doc_id <> 1").collect():
        assert r["token_ids"] == want[r["doc_id"]] and r["text"] == (TEXTS[r["doc_id"]] or "")
    two = bpe.decode(bpe.encode(docs, tokenizer), tokenizer)
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in two.collect())
    none = docs.limit(0)
    assert bpe.digests(none, tokenizer).collect() == [] and bpe.recoded(none, tokenizer).collect() == []


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 20])
def test_document_tokens(spark, docs, tokenizer, block):
    _, enc = peer("byte_bpe_multi_50k.tiktoken")
    got = tokens.document_tokens(docs, tokenizer, block_tokens=block).collect() if block > 7 else tokens.document_tokens(docs.where("length(text) < 100 OR text IS NULL"), tokenizer, block_tokens=block).collect()
    want = sorted((i if i is not None else -1, len(enc.encode_ordinary(t or ""))) for i, t in [*enumerate(TEXTS), (None, "x"), (1, "")] if block > 7 or t is None or len(t) < 100)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"]) for r in got) == want


def brute(ids_, separator):
    out, n = [], 0
    for i in ids_:
        if i == separator:
            out.append((n, True))
            n = 0
        else:
            n += 1
    return out + ([(n, False)] if n else [])


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_count_tokens_of_foreign_files(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    files = {}
    for k, n in enumerate([0, 1, 2, 30, 500]):
        data = rng.integers(0, 4, n).astype("<u4")
        (tmp_path / f"{k}.bin").write_bytes(data.tobytes())
        files[str(tmp_path / f"{k}.bin")] = brute(data.tolist(), 0)
    df = spark.createDataFrame([(p,) for p in [*files, *files]], "path string")
    got = tokens.count_tokens(df, separator=0, dtype="<u4", block_tokens=block).collect()
    want = sorted((p, i, n, e) for p, found in files.items() for i, (n, e) in enumerate(found))
    assert sorted(tuple(r) for r in got) == want


def test_empty_table_writes_nothing(spark, docs, tokenizer):
    assert tokens.document_tokens(docs.limit(0), tokenizer).collect() == []


def test_odd_file_is_an_error(spark, tmp_path):
    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="no whole number"):
        tokens.count_tokens(spark.createDataFrame([(str(tmp_path / "odd.bin"),)], "path string")).collect()


@pytest.mark.parametrize("separator, dtype, why", [(50256, "|u1", "fit"), (220, "<u2", "token id"), (200, "|u1", "does not fit")])
def test_ids_that_cannot_be_told_are_errors(spark, docs, tokenizer, separator, dtype, why):
    with pytest.raises(Exception, match=why):
        tokens.write_token_files(docs, tokenizer, separator=separator, dtype=dtype).collect()


def test_long_pieces_leave_the_memory(pair, monkeypatch):
    own, enc = pair
    monkeypatch.setattr(bpe, "REMEMBERED_CHARS", 500)
    for n in range(20):
        text = f"{'q' * (100 + n)} short {'z' * 90}{n}"
        assert ids(own, text) == enc.encode_ordinary(text)
    assert sum(map(len, own.known)) <= 1000


def test_a_worker_keeps_no_pieces_after_recoding(spark, pair):
    own, _ = pair
    docs = spark.createDataFrame([(i, f"unheard-of word{i} strung{i}together") for i in range(300)], "doc_id long, text string").coalesce(1)
    sent = spark.sparkContext.broadcast(bpe.Tokenizer(own.rank_file, own.pattern))
    assert bpe.recoded(docs, sent).agg({"text": "max"}).count() == 1

    def held(batches):
        for _ in batches:
            pass
        t = sent.value
        yield pa.RecordBatch.from_pydict({"n": [len(getattr(t, "known", ())) + len(getattr(t, "older", ())) + len(getattr(t, "fits", ()))]})

    assert [r["n"] for _ in range(8) for r in docs.mapInArrow(held, "n long").collect()] == [0] * 8
