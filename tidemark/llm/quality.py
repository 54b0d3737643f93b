"""Quality classifier by positive-unlabelled learning.

Texts with label 1 are trusted positives; all other texts are unlabelled, whatever their label says. The class prior among
the unlabelled is estimated from the scores of a first classifier; the final one minimises the non-negative unbiased risk
prior * R+(P) + max(0, R-(U) - prior * R-(P)) with the logistic loss. A text is described by shape statistics of the whole
text, each cut into quantile bins, so the score is a sum of one weight per statistic.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import byte_texts, written

SAMPLE = 12_000  # rows of each of the two training samples
CAUTION = 1  # standard errors
BINS = 12
STATISTICS = ["words", "word_length", "long_words", "distinct", "distinct_pairs", "top_word", "upper", "all_caps", "capitalised", "digits",
              "punctuation", "exclaim", "symbols", "wide", "spaces", "lines", "line_length", "repeated_lines", "stops", "commas", "urls", "repeats"]
_LETTERS = np.zeros((8, 256), bool)
for _row, _set in enumerate([b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:!?'\"()-", b"!", b"#$%&*+/<=>@[\\]^_`{|}~", bytes(range(128, 256)), b" \t\r\n", b","]):
    _LETTERS[_row, list(_set)] = True


def statistics(text: bytes) -> list[float]:
    """Shape of one text; all zero without words."""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, size = len(words), len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, digits, points, exclaim, symbols, wide, spaces, commas = ((_LETTERS * counts).sum(1) / size).tolist()
    lengths = np.fromiter(map(len, words), np.int64, n)
    lower = text.lower().split()
    seen = Counter(lower)
    pairs = len(set(zip(lower, lower[1:], strict=False))) / max(1, n - 1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [float(np.log1p(n)), float(lengths.mean()), float((lengths > 12).mean()), len(seen) / n, pairs, seen.most_common(1)[0][1] / n, upper,
            sum(w.isupper() for w in words) / n, sum(w[:1].isupper() for w in words) / n, digits, points, exclaim, symbols, wide, spaces,
            len(lines) / n, float(np.log1p(size / max(1, len(lines)))), 1 - len(set(lines)) / len(lines), sum(c for w, c in seen.items() if len(w) <= 3) / n, commas,
            len(re.findall(rb"https?://|www\.", text)) / n, sum(a == b for a, b in zip(lower, lower[1:], strict=False)) / n]


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and ``x``, the statistics of the whole text (null: empty)."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("x", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], pa.array([statistics(t) for t in byte_texts(batch["text"])], pa.list_(pa.float32()))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, x array<float>")


@dataclass
class Model:
    edges: np.ndarray  # statistics x inner bin edges
    weights: np.ndarray  # statistics x bins
    bias: float
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for j in range(x.shape[1]):
            z += self.weights[j][np.searchsorted(self.edges[j], x[:, j], side="right")]
        return z


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from two histograms over the same rising scores: the least ratio of unlabelled
    to positive rows above a score, judged with CAUTION standard errors added, so that few rows do not decide; the ratio itself
    is returned."""
    p, u = np.cumsum(positive[::-1])[::-1], np.cumsum(unlabelled[::-1])[::-1]
    n_p, n_u = max(1, p[0]), max(1, u[0])
    p, u = np.maximum(p / n_p, 1 / n_p), u / n_u
    ratio = u / p
    error = np.sqrt(u * (1 - u) / n_u) / p + ratio * np.sqrt(p * (1 - p) / n_p) / p
    best = int(np.argmin(np.where(p >= 0.3, ratio + CAUTION * error, np.inf)))
    return float(np.clip(ratio[best], 0.01, 0.99))


def _descend(gradient, cp: np.ndarray, cu: np.ndarray, size: int, rounds: int, rate: float, ridge: float) -> tuple[np.ndarray, float]:
    w, b, m, v = np.zeros(size), 0.0, np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, rounds + 1):
        gp, gu = gradient(w[cp].sum(1) + b, w[cu].sum(1) + b)
        g = np.append(np.bincount(cp.ravel(), np.repeat(gp, cp.shape[1]), size) + np.bincount(cu.ravel(), np.repeat(gu, cu.shape[1]), size) + ridge * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def _cells(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], 1) + np.arange(len(edges)) * BINS


def rank(positive: np.ndarray, unlabelled: np.ndarray, edges: np.ndarray, rounds: int = 800, rate: float = 0.03, ridge: float = 1e-4) -> Model:
    """A classifier of positives against unlabelled rows; it orders rows and knows no class prior."""
    cp, cu = _cells(positive, edges), _cells(unlabelled, edges)
    ridge += 0.01 / (len(positive) + len(unlabelled))
    w, b = _descend(lambda zp, zu: ((_sigmoid(zp) - 1) / len(zp) / 2, _sigmoid(zu) / len(zu) / 2), cp, cu, edges.shape[0] * BINS, rounds, rate, ridge)
    return Model(edges, w.reshape(-1, BINS), float(b), 0.5)


def fit(positive: np.ndarray, unlabelled: np.ndarray, edges: np.ndarray, prior: float, rounds: int = 800, rate: float = 0.03, ridge: float = 1e-4) -> Model:
    """Model from statistics of trusted positives and of unlabelled texts, by the non-negative risk under a class prior."""
    cp, cu = _cells(positive, edges), _cells(unlabelled, edges)
    ridge += 0.01 / (len(positive) + len(unlabelled))

    def risk(zp: np.ndarray, zu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        plus = prior * (_sigmoid(zp) - 1) / len(zp)  # gradient of prior * R+(P)
        minus_p, minus_u = prior * _sigmoid(zp) / len(zp), _sigmoid(zu) / len(zu)
        rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        # below zero the unlabelled part is overfitted: climb back
        return (plus - minus_p, minus_u) if rest >= 0 else (minus_p, -minus_u)

    w, b = _descend(risk, cp, cu, edges.shape[0] * BINS, rounds, rate, ridge)
    return Model(edges, w.reshape(-1, BINS), float(b), prior)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.7) -> DataFrame:
    """doc_id, text_hash (xxhash64), held_out, score (0 to 1) and predicted (score >= threshold) of every row of ``docs``.

    ``docs`` needs doc_id, text, ``labels`` doc_id, quality; other columns are ignored. Labels are read only where crc32 of
    doc_id as text, modulo 4, is not 2. Training takes at most ``sample`` positive and ``sample`` unlabelled rows of those,
    by a hash; everything else covers all rows. A document is positive if all its labels are 1; null labels count as none.
    Null and empty texts are scored like any other; rows without doc_id are not held out. Repeated rows get equal scores.
    Without any positive or unlabelled row all scores are 0.5. An empty table gives an empty result.
    """
    x = written(describe(docs), "quality-statistics")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    good = (labels.select(F.col("doc_id").cast("long").alias("id"), "quality").filter("id is not null and quality is not null")
            .groupBy("id").agg(F.min("quality").alias("quality")).filter("quality = 1").select("id"))
    train = x.filter(fold != 2).join(good, F.col("doc_id") == F.col("id"), "left").withColumn("h", F.xxhash64(F.lit(5), "doc_id"))
    train = written(train.select("id", "h", "x"), "quality-train")
    take = lambda df: np.array([r["x"] for r in df.orderBy("h", "x").limit(sample).select("x").collect()], np.float64)
    positive, unlabelled = take(train.filter("id is not null")), take(train)
    model = _trained(x, train, positive, unlabelled, take) if len(positive) and len(unlabelled) else None
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            values = batch["x"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, len(STATISTICS)))
            score = _sigmoid(model.logits(values)) if model else np.full(n, 0.5)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], pa.array(score)], schema=schema)

    scored = x.mapInArrow(run, "doc_id long, text_hash long, score double")
    return scored.select("doc_id", "text_hash", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _trained(x: DataFrame, train: DataFrame, positive: np.ndarray, unlabelled: np.ndarray, take) -> Model:
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1].tolist()
    asked = [F.percentile_approx(F.col("x")[j].cast("double"), quantiles, 10_000).alias(f"e{j}") for j in range(len(STATISTICS))]
    edges = np.array(list(x.agg(*asked).first()), np.float64)
    half = lambda n: train.filter(F.pmod(F.col("h"), F.lit(2)) == n)
    counts = np.zeros((2, 257))
    for fold in (0, 1):  # each half is ranked by what the other half taught
        first_p, first_u = take(half(fold).filter("id is not null")), take(half(fold))
        if len(first_p) and len(first_u):
            counts += _histograms(half(1 - fold), rank(first_p, first_u, edges), first_p)
    return fit(positive, unlabelled, edges, class_prior(*counts) if counts[0].sum() and counts[1].sum() else 0.5)


def _histograms(rows: DataFrame, first: Model, sample: np.ndarray) -> np.ndarray:
    """Positives and all rows by their score, in 257 bins between the scores of a sample of positives."""
    cuts = np.quantile(first.logits(sample), np.linspace(0, 1, 258)[1:-1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(cuts) + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                values = batch["x"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                at = np.searchsorted(cuts, first.logits(values), side="right")
                total[1] += np.bincount(at, minlength=len(cuts) + 1)
                total[0] += np.bincount(at[batch["id"].is_valid().to_numpy(zero_copy_only=False)], minlength=len(cuts) + 1)
        bins = np.tile(np.arange(len(cuts) + 1, dtype=np.int32), 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([0, 1], np.int32), len(cuts) + 1)), pa.array(bins), pa.array(total.ravel())], names=["kind", "bin", "n"])

    counts = np.zeros((2, len(cuts) + 1))
    for r in rows.select("id", "x").mapInArrow(count, "kind int, bin int, n long").groupBy("kind", "bin").agg(F.sum("n").alias("n")).collect():  # 514 numbers
        counts[r["kind"], r["bin"]] = r["n"]
    return counts
