"""Patterns behind a byte search, words without a pattern, similarities without row objects: the plain results, cheaper."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.functions import hashing, text, vocab
from tidemark.operators import intent

TEXTS = ["", None, "no google", "nothing googled", "not  microsoft, avoid google", "under 50000 rupees below 3 usd", "underdog 5 usd", "over 200 dollars",
         "real-time sync and instant collaboration", "encrypted mail", "private  email", "explain: basic, simple for dummies", "advanced settings", "e2e encryption",
         "end to end encrypt", "ad-free no ads adless", "on-device storage", "simplex", "open source free software oss", "how do i"]


def patterns(x):
    if isinstance(x, str):
        return [x] if x.startswith(r"\b") else []
    items = x.items() if isinstance(x, dict) else x if isinstance(x, (list, tuple)) else []
    return [p for y in items for p in patterns(y)]


def test_heads_of_groups():
    assert text.literal_heads(r"\b(?:under|less than|below)\s*(\d+)\s*(?:rs|₹)\b") == ["below", "less than", "under"]
    assert text.literal_heads(r"\b(real[-\s]*time|instant)\s+(sync|collaboration)\b") == ["instant", "real"]
    assert text.literal_heads(r"\b(no\s+(google|gmail))\b") == ["no"]
    assert text.literal_heads(r"\b(colou?r|a[b|c]d)\b") is None and text.literal_heads(r"\b(colou?r)\b") == ["colo"]
    assert text.literal_heads(r"\b(?:new )?word\b") is None and text.literal_heads(r"(?i)word") is None
    assert text.literal_heads(r"new|old\|er") == ["new", "old"]


def test_gated_patterns_give_the_plain_results(spark):
    every = sorted({p for n in dir(vocab) if n.isupper() for p in patterns(getattr(vocab, n))})
    assert len(every) > 60
    df = spark.createDataFrame([(x,) for x in TEXTS], "x string")
    x = F.col("x")
    plain = [F.regexp_count(x, F.lit(text.boundary(p))) for p in every]
    gated = [text.count_matches(x, [p]) for p in every]
    hits = [text.matches(x, p) for p in every]
    for r in df.select(F.array(*plain).alias("p"), F.array(*gated).alias("g"), F.array(*hits).alias("h")).collect():
        assert r.p == r.g and r.h == [None if n is None else n > 0 for n in r.p]
    prices = [p for p, _ in vocab.PRICE_PATTERNS]
    found = df.select(*[F.regexp_extract_all(x, F.lit(text.boundary(p)), 1).alias(f"p{i}") for i, p in enumerate(prices)],
                      *[text.all_matches(x, p, 1).alias(f"g{i}") for i, p in enumerate(prices)]).collect()
    assert all(r[f"p{i}"] == r[f"g{i}"] for r in found for i in range(len(prices))) and any(r["p0"] for r in found)


def test_words_of_any_white_space(spark):
    rows = ["a b", " a  b ", "a\tb\nc\vd\fe\rf", "", "   ", None, "a b c"]
    got = [r.w for r in spark.createDataFrame([(x,) for x in rows], "x string").select(text.words(F.col("x")).alias("w")).collect()]
    assert got == [None if x is None else [w for w in re.split(r"[ \t\n\v\f\r]+", x) if w] for x in rows]


def test_similarities_of_sliced_digests(spark):
    build = hashing._arrow_cosines(hashing.EMBED_DIMS, hashing.EMBED_STEP, hashing.EMBED_MOD, hashing.HASH_BYTES)
    plain, _ = hashing._cosines(hashing.EMBED_DIMS, hashing.EMBED_STEP, hashing.EMBED_MOD, hashing.HASH_BYTES)()
    residues, _, _ = build()
    digests = [bytes((i * 31 + j * 7) % 256 for j in range(16)) for i in range(9)]
    for kind in (pa.binary(), pa.large_binary()):
        assert (residues(pa.array(digests, kind)[3:8]) == plain(digests[3:8])).all()
    assert len(residues(pa.array([], pa.binary()))) == 0
    df = spark.createDataFrame([("a b", "b a"), (None, "x"), ("x", "x")], "a string, b string")
    rows = df.select(hashing.similarity(F.col("a"), F.col("b")).alias("s"), hashing.similarities(F.col("a"), ["b a", "x"]).alias("l"),
                     hashing.similarity(F.col("a"), F.lit("x")).alias("t")).collect()
    assert abs(rows[0].s - rows[0].l[0]) < 1e-12 and all(abs(r.t - r.l[1]) < 1e-12 for r in rows) and abs(rows[2].s - 1) < 1e-12


def test_constraints_come_once_without_comparing_them(spark):
    rows = [("no google, avoid google, not google: end to end encryption, e2e encrypted under 5 usd below 5 usd over 5 usd",), ("phone",), ("",), (None,)]
    df = spark.createDataFrame(rows, "x string").select(intent.constraints(F.col("x")).alias("c"))
    assert "array_distinct(concat" not in df._jdf.queryExecution().optimizedPlan().toString()
    first, phone, none, null = [None if r.c is None else [(c.type, c.dimension, *c["values"]) for c in r.c] for r in df.collect()]
    assert first == [("exclusion", "provider", "Google"), ("range", "price", "<=5"), ("range", "price", ">=5"), ("inclusion", "feature", "end-to-end_encryption")]
    assert phone == [("inclusion", "platform", "Android")] and none == [] and not null
