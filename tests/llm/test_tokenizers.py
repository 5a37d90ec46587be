from __future__ import annotations

import base64
import hashlib
import random

import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from umbra.llm import bpe, pieces, registry

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "\n", "\t", "a", "b", "'s", "é", "ß", "1", "23", "!", "...", "  ", "\u3000", "\x1c", "▁", "中", "😀", "<|endoftext|>", "'ll", "Don't", "\r\n", "\x85", "the", "ing", "\u200b", "٣", "aaaaaaaa", " a", "<s>"]


def fuzz(n: int = 1500) -> list[str]:
    rng = random.Random(1)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["a" * 3000 + " b" * 500 + " " * 700, "ab" * 2000]


def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def large(texts):
    return pa.array(texts, pa.large_string())


def test_ranks_like_the_library():
    texts, tool, own = fuzz(), reference(), bpe.encoder("ranks", RANKS, public_tokenizers.PATTERN)
    for text, ids in zip(texts, own.encode(large(texts)), strict=True):
        assert ids.tolist() == tool.encode_ordinary(text), text
        assert own.table.decode(ids).decode() == text


def test_json_like_the_library():
    texts, tool = fuzz(), Tokenizer.from_file(JSON)
    for text, ids in zip(texts, bpe.encoder("json", JSON, public_tokenizers.PATTERN).encode(large(texts)), strict=True):
        assert ids.tolist() == tool.encode(text, add_special_tokens=False).ids, text


def test_pieces_like_the_library():
    texts, tool = fuzz(), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert pieces.counter(MODEL).count(large(texts)).tolist() == [len(x) for x in tool.encode(texts)]


def test_queries_on_documents(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    tool, model = reference(), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    encoded, counted = registry.op2_byte_bpe(spark, small).collect(), registry.op7_token_counts(spark, small).collect()
    assert len(encoded) == len(counted) == len(texts)
    for r in encoded:
        ids = tool.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    for r in counted:
        n = len(model.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)


def test_odd_rows(odd, odd_rows, empty):
    tool, model = reference(), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = bpe.decode(bpe.encode(odd, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()
    both = bpe.encode(odd, RANKS, public_tokenizers.PATTERN, with_decoded=True).collect()
    assert sorted(map(str, both)) == sorted(map(str, got))
    want = [(i, tool.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in odd_rows]
    assert sorted((str(r.doc_id), r.ids, bytes(r.decoded)) for r in got) == sorted((str(i), x, b) for i, x, b in want)
    counts = pieces.count_tokens(odd, MODEL, 10).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in counts) == sorted((str(i), len(model.encode(t or ""))) for i, t, _ in odd_rows)
    assert bpe.encode(empty, RANKS, public_tokenizers.PATTERN).count() == pieces.count_tokens(empty, MODEL, 10).count() == 0


def test_cache_starts_anew():
    own = bpe.Encoder(bpe.encoder("ranks", RANKS, public_tokenizers.PATTERN).table)
    own.cache.most = 10
    for text in ("one two three four five six seven eight nine ten eleven", "one twelve"):
        assert own.encode(large([text]))[0].tolist() == reference().encode_ordinary(text)


def test_null_ids_decode_to_nothing(spark):
    df = spark.createDataFrame([(1, [5, 6]), (2, None)], "doc_id long, ids array<int>")
    got = {r.doc_id: bytes(r.decoded) for r in bpe.decode(df, RANKS, public_tokenizers.PATTERN).select("doc_id", F.col("decoded")).collect()}
    assert got[2] == b"" and got[1] == reference().decode_bytes([5, 6])
