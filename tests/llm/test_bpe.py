"""Byte-level BPE against the tokenizer library, and back."""

import hashlib
import random

import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from tidemark.llm import bpe, queries

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
CODER = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = [(1, "It's an état  of\n\n the  \U0001F600\U0001F600 art, 1234567 times!!!"), (2, None), (3, ""), (4, "a"), (4, "a"), (None, "no id\there "), (5, " \t\n\x85\xa0  x\x1c\x1dy\x00"),
         (6, "Grüße Straße ñandú Überraschung ciónmente " * 400), (7, "x" * 700 + " " + "abcdé" * 60), (8, "的一是不了人我在有他这为之大来以个中上们"), (9, "   "), (10, "<|endoftext|> 'S 'll're")]


def digest(doc_id, text):
    ids = CODER.encode_ordinary(text or "")
    h = lambda b: hashlib.sha256(b).hexdigest()
    return doc_id, len(ids), h(",".join(map(str, ids)).encode()), h((text or "").encode())


def test_cut_equals_the_pattern():
    """The vectorised cutter and the regular expression agree on texts made of all that the pattern tells apart."""
    assert bpe.GPT_PATTERN == public_tokenizers.PATTERN
    rng, parts = random.Random(3), ["'", "s", "t", "re", "ve", "ll", "m", "d", "'s", "'re", "é", " ", "  ", "\n", "\t", "\x85", "\u00a0", "\u3000", "\x1c", "7", "½", "!", "\U0001F600", "的", "S", "x", "\0", "\u0301"]
    for _ in range(300):
        texts = ["".join(rng.choices(parts, k=rng.randrange(0, 12))) for _ in range(30)]
        data, ends, sizes = bpe.cut([t.encode() for t in texts], bpe.GPT_PATTERN)
        body, begins = data.tobytes(), [0, *ends.tolist()]
        got = [body[a:b].decode() for a, b in zip(begins, begins[1:])]
        assert got == [w for t in texts for w in regex.findall(bpe.GPT_PATTERN, t)], texts
        assert sizes.tolist() == [len(regex.findall(bpe.GPT_PATTERN, t)) for t in texts]
        other = bpe.cut([t.encode() for t in texts], "(?:" + bpe.GPT_PATTERN + ")")
        assert other[0].tobytes() == body and other[1].tolist() == ends.tolist() and other[2].tolist() == sizes.tolist()
    every = "".join(chr(c) for c in range(0x2000) if c != 39)
    data, ends, _ = bpe.cut([every.encode()], bpe.GPT_PATTERN)
    assert len(ends) == len(regex.findall(bpe.GPT_PATTERN, every))


def test_rank_hash_is_sparks(spark):
    data = [b"", b"a", b"\xff\x80", b"abcd", b"abcde\xfe\x01", bytes(range(250, 256)) * 3]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in data], "x binary").select(F.hash("x")).collect()]
    assert got == [bpe.mmh(x) for x in data]


@pytest.mark.parametrize("head", [0, 1 << 18])
def test_encode_and_decode(spark, head, monkeypatch):
    monkeypatch.setattr(bpe, "HEAD", head)
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 200)
    monkeypatch.setattr(bpe, "PIECE_BYTES", 90)
    monkeypatch.setattr(bpe, "OUT_WORDS", 50)
    docs = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in TEXTS], "doc_id long, text string, ids int, words string, at string").repartition(2)
    coded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN).withColumn("back", bpe.decode(F.col("ids"), RANKS))
    got = sorted(((r.doc_id, list(r.ids), bytes(r.back)) for r in coded.collect()), key=repr)
    assert got == sorted(((i, CODER.encode_ordinary(t or ""), (t or "").encode()) for i, t in TEXTS), key=repr)


def test_one_join_at_a_time(spark):
    """A join may make a pair of lower rank than its own: the next join must be that one, not the same pair further on."""
    ranks = {bytes([b]): 1000 + b for b in range(256)} | {b"ab": 5, b"aba": 1, b"bab": 0}
    words = [b"ababab", b"abab", b"babab", b"aabbab", b"c", b"abcabab"]
    got = spark.createDataFrame([(words,)], "w array<binary>").select(bpe.encode_words(F.col("w"), ranks).alias("x")).first().x

    def brute(word):
        parts = [word[i:i + 1] for i in range(len(word))]
        while True:
            found = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), default=None)
            if found is None:
                return [ranks[p] for p in parts]
            i = found[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    assert [list(x) for x in got] == [[ranks[w]] if w in ranks else brute(w) for w in words]


def test_empty_table_and_errors(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), RANKS, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(spark.createDataFrame([], "doc_id long, text string"), {b"a": 0}, public_tokenizers.PATTERN)


def test_query_equals_library(spark):
    small = "/root/testdata/sf0.001"
    texts = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = [tuple(r) for r in queries.op11_byte_bpe(spark, small).collect()]
    assert sorted(got) == sorted(digest(*r) for r in texts)
