import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from foliospark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_encoding_and_round_trip(rows, clashing, reference):
    found = {(r.doc_id, r.ids_sha256): r for r in bpe.encode_documents(clashing, PATH, public_tokenizers.PATTERN).collect()}
    for i, t, *_ in rows:
        ids = reference.encode_ordinary(t or "")
        r = found[(i, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())]
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_decode_documents(spark, docs, empty):
    encoded = bpe.encode_documents(docs.where("doc_id < 20"), PATH, public_tokenizers.PATTERN)
    texts = {r.doc_id: r.text for r in docs.where("doc_id < 20").collect()}
    assert all(bytes(r.bytes).decode() == texts[r.doc_id] for r in bpe.decode_documents(encoded, PATH).collect())
    assert bpe.encode_documents(empty, PATH, public_tokenizers.PATTERN).count() == 0


def test_ties_and_repeats_in_a_piece(reference):
    rng = random.Random(1)
    codec = bpe.Codec(bpe.MergeReplay(bpe.read_ranks(PATH)), public_tokenizers.PATTERN)
    texts = ["".join(rng.choice(["a", "b", "ab", "aa", " ", "the", "é", "日本", "\n", "1", "'s", "ing"]) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    texts += ["a" * 3000, "ab" * 2000, " " * 300, ""]
    for t, numbers in zip(texts, codec.encode_block(texts), strict=True):
        assert codec.ids(numbers) == reference.encode_ordinary(t)


def test_cache_is_bounded(monkeypatch, reference):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 5)
    codec = bpe.Codec(bpe.MergeReplay(bpe.read_ranks(PATH)), public_tokenizers.PATTERN)
    for k in range(6):
        text = " ".join(f"w{k}{i}" for i in range(9))
        (numbers,) = codec.encode_block([text])
        assert codec.ids(numbers) == reference.encode_ordinary(text)
        assert len(codec.pieces) <= 40
