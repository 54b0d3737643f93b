"""The segmented index against sums over all postings in plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.functions import vocab
from tidemark.operators import searchindex

COLUMNS = "page_id bigint, url string, title string, content string, meta_description string"
WORDS = ["Straße", "naïve", "ключ", "x1", "red", "blue", "green", "the", "Ä", "2024", "deep", "sea"]


def pages(n, seed, first=0):
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choices(WORDS, weights=range(1, len(WORDS) + 1), k=k))
    return [(first + i, f"http://h{i % 3}.example/{rng.choice(WORDS)}", text(3), text(rng.randrange(0, 40)), rng.choice([None, text(4)])) for i in range(n)]


def words(text):
    return [w for w in (x.lower() for x in re.findall(r"[^\W_]+", text or "")) if w not in vocab.INDEX_STOP_WORDS]


def full_sum(rows, queries, k):
    fields = {f: {r[0]: words(r[i]) for r in rows} for f, i in (("title", 2), ("content", 3), ("meta_description", 4), ("url", 1))}
    score = defaultdict(Counter)
    for f, texts in fields.items():
        texts = {p: t for p, t in texts.items() if t}
        df = Counter(w for t in texts.values() for w in set(t))
        mean = sum(map(len, texts.values())) / len(texts) if texts else 0
        for p, t in texts.items():
            for w, tf in Counter(t).items():
                idf = math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5))
                k1, b = vocab.BM25_K1, vocab.BM25_B
                score[w][p] += idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(t) / mean)) * (2.0 if f == "title" else 1.0)
    out = {}
    for q in queries:
        total = Counter()
        for w in dict.fromkeys(words(q)):
            total.update(score[w])
        out[q] = sorted(((-round(s, 6), p) for p, s in total.items()))[:k]
    return {q: [(p, -s) for s, p in v] for q, v in out.items() if v}


def found(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query, r["rank"])):
        out[r.query].append((r.page_id, r.score))
    return dict(out)


QUERIES = ["red STRASSE", "Straße ключ", "the", "blue sea deep", "nothing here", "2024 x1 naïve", "h1 example", ""]


def check(spark, postings, rows, k):
    blocks = searchindex.seal(searchindex.impacts(postings))
    got = found(searchindex.search(spark.createDataFrame([(q,) for q in QUERIES + QUERIES[:1]], "query string").distinct(), blocks, k).collect())
    want = full_sum(rows, QUERIES, k)
    assert got.keys() == want.keys()
    for q, w in want.items():
        assert [p for p, _ in got[q]] == [p for p, _ in w], q
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in w], abs=2e-6)


def test_blocks_equal_full_sum(spark, monkeypatch):
    monkeypatch.setattr(searchindex, "RANGE_PAGES", 8)
    rows = pages(150, 1)
    df = spark.createDataFrame(rows, COLUMNS)
    check(spark, searchindex.postings(searchindex.with_phrases(df)), rows, 5)


def test_segments_replace_remove_and_merge(spark, tmp_path):
    path, old, new, back = f"{tmp_path}/i", pages(60, 2), pages(20, 3, 10), pages(3, 4, 25)
    frame = lambda rows: spark.createDataFrame(rows, COLUMNS)
    searchindex.write_segment(frame(old), path, 0)
    searchindex.write_segment(frame(new), path, 1)
    searchindex.write_segment(frame(new), path, 1)  # a repeated batch
    searchindex.write_tombstones(frame(old[20:40]), path, 2)
    searchindex.write_segment(frame(back), path, 3)
    live = {r[0]: r for r in old} | {r[0]: r for r in new}
    live = {p: r for p, r in live.items() if not 20 <= p < 40} | {r[0]: r for r in back}
    check(spark, searchindex.live_postings(spark, path, [0, 1, 3], [2]), list(live.values()), 4)
    assert searchindex.merge_segments(spark, path, [0, 1, 3], [2], 4) == [4]
    check(spark, searchindex.live_postings(spark, path, [4]), list(live.values()), 4)


def test_bounds_close_most_blocks(spark, monkeypatch):
    """Once a rare, strong page is found, ranges of weak pages are not opened."""
    monkeypatch.setattr(searchindex, "RANGE_PAGES", 4)
    rows = [(i, "", "filler words", "red " + "pad " * 60, None) for i in range(200)] + [(200 + i, "", "red red", "red", None) for i in range(4)]
    blocks = searchindex.seal(searchindex.impacts(searchindex.postings(searchindex.with_phrases(spark.createDataFrame(rows, COLUMNS)))))
    best = searchindex.search(spark.createDataFrame([("red",)], "query string"), blocks, 2, first=1).collect()
    assert {r.page_id for r in best} == {200, 201}
    floor = min(r.score for r in best)
    assert blocks.where((F.col("term") == "red") & (F.col("top") >= floor - 1e-6)).count() == 1 and blocks.where("term = 'red'").count() == 51


def test_empty(spark):
    none = spark.createDataFrame([], COLUMNS)
    blocks = searchindex.seal(searchindex.impacts(searchindex.postings(searchindex.with_phrases(none))))
    assert searchindex.search(spark.createDataFrame([("red",)], "query string"), blocks, 2).count() == 0


def test_tasks_follow_the_number_of_postings(spark, monkeypatch):
    """No join deals postings by their field (a handful of keys), and more postings get more tasks, not larger ones."""
    monkeypatch.setattr(searchindex, "TASK_PAGES", 10, raising=False)
    monkeypatch.setattr(searchindex, "TASK_POSTINGS", 100, raising=False)
    rows = [(i, f"http://h.example/{i}", f"t{i} t{i + 1}", f"c{i} d{i} e{i} red", None) for i in range(150)]
    postings = searchindex.postings(searchindex.with_phrases(spark.createDataFrame(rows, COLUMNS))).cache()
    impacts = searchindex.impacts(postings)
    plan = impacts._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(field" not in plan.split("BroadcastExchange")[0]
    tasks = [n for n, in impacts.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(tasks) > 8 and max(tasks) < 400 and sum(tasks) == impacts.count()
    assert len({p for p, in postings.select(F.spark_partition_id()).distinct().collect()}) > 8
    postings.unpersist()


@pytest.mark.parametrize("few", [0, 100])
def test_search_reads_blocks_once(spark, monkeypatch, few):
    monkeypatch.setattr(searchindex, "RANGE_PAGES", 8)
    monkeypatch.setattr(searchindex, "BROADCAST_LIMIT_ROWS", few, raising=False)
    rows = pages(60, 5)
    blocks = searchindex.seal(searchindex.impacts(searchindex.postings(searchindex.with_phrases(spark.createDataFrame(rows, COLUMNS))))).cache()
    calls = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    got = found(searchindex.search(spark.createDataFrame([("red blue",), ("deep",)], "query string"), blocks.mapInArrow(count, blocks.schema), 3, first=1).collect())
    want = full_sum(rows, ["red blue", "deep"], 3)
    assert calls.value == blocks.count() and {q: [p for p, _ in v] for q, v in got.items()} == {q: [p for p, _ in v] for q, v in want.items()}
    blocks.unpersist()


def test_one_segment_is_read_without_a_join(spark, tmp_path):
    rows = pages(20, 6)
    searchindex.write_segment(spark.createDataFrame(rows, COLUMNS), f"{tmp_path}/i", 0)
    live = searchindex.live_postings(spark, f"{tmp_path}/i", [0])
    assert "Join" not in live._jdf.queryExecution().executedPlan().toString()
    check(spark, live, rows, 4)


def test_repeated_page_counts_once(spark):
    """Two equal rows of a page give one posting per term, with the sum of their counts."""
    rows = spark.createDataFrame([(1, "u", "red", "blue blue", None)] * 2, COLUMNS)
    got = {(r.term, r.field): (r.length, r.tf) for r in searchindex.postings(rows, ("title", "content")).collect()}
    assert got == {("red", "title"): (1, 2), ("blue", "content"): (2, 4)}
