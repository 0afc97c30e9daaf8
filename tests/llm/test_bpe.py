import base64
import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from panelforge.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})

HARD = [
    "", " ", "  ", "\n", " \n ", "a", " a", "  a", "a  ", "a \n b", "'s", "''s", "'s's", "'re're'll", "can't won't I've",
    "x'", "x'r", "x're", "!'s", " 's", " a", "　　x", "日本語 テスト", "1 22  333", "a1b2", "é́x", "🙂🙂 🙂", " a", "\x00\x01",
    "'S 'RE", "ſ's", "tab\tx\t\ty", "x" * 500, "ab" * 400, "!" * 300, "\U0001f468‍\U0001f469", "ᲉꟋ", "<|endoftext|>",
]


def encoded(texts):
    ids, offsets, at = bpe.load(PATH).encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(at, at[1:])], [offsets[a:b].tolist() for a, b in zip(at, at[1:])]


def test_hard_texts_match_the_library():
    got, offsets = encoded(HARD)
    assert got == [LIBRARY.encode_ordinary(t) for t in HARD]
    for text, ids, starts in zip(HARD, got, offsets):
        parts = [LIBRARY.decode_single_token_bytes(k) for k in ids]
        assert b"".join(parts) == text.encode()
        assert starts == [sum(map(len, parts[:k])) for k in range(len(parts))]


def test_random_texts_match_the_library():
    rng = random.Random(5)
    alphabet = list("ab'strevlmd  \n\t 12!.é日 🙂")
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(0, 60))) for _ in range(4000)]
    assert encoded(texts)[0] == [LIBRARY.encode_ordinary(t) for t in texts]


def test_both_merges_agree():
    rng = random.Random(6)
    words = bpe.load(PATH)
    for _ in range(300):
        piece = "".join(rng.choices("aabeinrst é", k=rng.randrange(2, 90))).encode()
        assert words._merge_short(piece) == words._merge_long(piece)


def test_round_trip_in_spark(spark):
    rows = [(k, t, "c") for k, t in enumerate(HARD)] + [(900, None, "c"), (0, HARD[0], "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string")
    back = bpe.decode(bpe.encode(df, PATH), PATH)
    assert back.columns == ["doc_id", "ids", "decoded"]
    got = sorted((r.doc_id, bytes(r.decoded).decode()) for r in back.collect())
    assert got == sorted((k, t or "") for k, t, _ in rows)
    assert bpe.decode(bpe.encode(df.limit(0), PATH), PATH).count() == 0


def test_decoding_in_the_same_worker_agrees(spark):
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate([*HARD, None])], "doc_id long, text string, Back int")
    one = bpe.encode(df, PATH, decoded="back")
    assert one.columns == ["doc_id", "ids", "offsets", "back"]
    two = bpe.decode(one.drop("back"), PATH)
    assert sorted((r.doc_id, r.ids, bytes(r.back)) for r in one.collect()) == sorted((r.doc_id, r.ids, bytes(r.decoded)) for r in two.collect())


def test_query_against_the_library(spark, sf):
    texts = {r.doc_id: r.text or "" for r in queries.table(spark, sf, "documents").collect()}
    got = queries.op1_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = LIBRARY.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_unknown_ids_raise(spark):
    df = spark.createDataFrame([(1, [10**6])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="outside the vocabulary"):
        bpe.decode(df, PATH, offsets=None).collect()
