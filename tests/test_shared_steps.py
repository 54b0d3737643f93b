"""Steps that many queries share are computed once per row, and give the rows of the plain rule."""

import random

from pyspark.sql import functions as F

from tidemark.functions import hashing
from tidemark.functions.text import keep
from tidemark.operators import dedup, ordered, ranking, retrieval, urls
from tidemark.operators import pages as pg


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranked_reads_its_rows_once(spark):
    rows = spark.range(40).select((F.col("id") % 3).alias("k"), "id", (F.col("id") * 0.1).alias("score"))
    calls = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    r = ordered.ranked(rows.mapInArrow(count, rows.schema), ["k"], "score", "id")
    assert r.count() == 40 and calls.value == 40


def test_greedy_digests_equals_sequential_rule(spark):
    rng = random.Random(7)
    words = ["red", "green", "blue", "old", "new", "fast"]
    data = [(q, i, " ".join(rng.choices(words, k=2))) for q in range(4) for i in range(q * 25 + 3)]
    df = spark.createDataFrame(data, "q int, n int, x string").withColumn("d", hashing.digest(F.col("x")))
    distinct = sorted({x for *_, x in data})
    cross = spark.createDataFrame([(a, b) for a in distinct for b in distinct], "a string, b string")
    cos = {(r.a, r.b): r.c for r in cross.select("a", "b", hashing.similarity(F.col("a"), F.col("b")).alias("c")).collect()}
    want, kept = set(), {}
    for q, n, x in sorted(data):
        if not any(cos[y, x] > 0.75 for y in kept.setdefault(q, [])):
            kept[q].append(x)
            want.add((q, n))
    got = {(r.q, r.n) for r in dedup.greedy_digests(df, "q", "n", "d", 0.75, block=4).collect()}
    assert got == want


def test_keep_is_no_lambda_and_drops_nulls(spark):
    df = spark.range(1).select(keep([(F.lit("a"), F.lit(True)), (F.lit("b"), F.col("id") > 0), (F.lit(None).cast("string"), F.lit(True))]).alias("x"))
    assert df.first()[0] == ["a"]
    assert "lambda" not in plan(spark.range(1).select(keep([(F.lit("b"), F.col("id") > 0)])))


def test_url_facts_are_found_once(spark):
    df = spark.createDataFrame([("https://www.mail.proton.me/a-b/set_up x1.zip",), ("http://notproton.me/é-ßtadt",), (None,)], "url string")
    a = urls.analyse_urls(df).where(F.col("privacy_score") >= 0.2)
    assert plan(a).count("duckduckgo") <= 6  # one pattern and five tables
    rows = {r.url: (r.privacy_score, r.title) for r in a.collect()}
    assert rows["https://www.mail.proton.me/a-b/set_up x1.zip"] == (0.95, "Set Up X1.Zip")
    assert rows["http://notproton.me/é-ßtadt"][0] == 0.5


def test_tags_read_a_parsed_page(spark):
    df = spark.createDataFrame([(1, "u", "<title>T</title><body>learn python tutorial</body>"), (2, "u", "<body>buy</body>")], "page_id long, url string, html string")
    tagged = pg.analyse_pages(pg.html_to_page(df))
    found = retrieval.tag_search(tagged, goal="learn", use_case="learning").select("page_id", "skill_level")
    assert plan(found).count("</body>") <= 4  # the body is cut out once, not once per pattern
    assert [r.page_id for r in found.collect()] == [r.page_id for r in tagged.orderBy("page_id").collect() if r.primary_goal == "learn" and "learning" in r.use_cases]


def test_overlap_join_shuffles_texts(spark):
    left = spark.createDataFrame([(1, "a b"), (2, "")], "k int, lt string")
    right = spark.createDataFrame([(1, "b  c"), (2, "x")], "k int, rt string")
    j = ranking.overlap_pairs(left, right, "k")
    assert {r.k: round(r.jaccard, 6) for r in j.collect()} == {1: 0.333333, 2: 0.0}


def test_pagerank_splits_lists_and_keeps_multiplicity(spark, monkeypatch):
    """Lists of targets split over parts, parallel links, null URLs and rankless ends against a plain power iteration."""
    from collections import Counter

    from tidemark.operators import graph

    monkeypatch.setattr(graph, "FAN_OUT", 2)
    links = [("hub", f"p{i % 9}") for i in range(20)] + [("p1", "hub"), ("p2", "p1"), ("p2", "p1"), ("p2", None), (None, "p3"), ("p4", "p4")]
    nodes = {u for e in links for u in e} | {"alone"}
    out = Counter(a for a, _ in links)
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(5):
        flow = Counter()
        for a, b in links:
            if a is not None and b is not None:
                flow[b] += rank[a] / out[a]
        rank = {u: 0.15 / len(nodes) + 0.85 * flow[u] for u in nodes}
    total = sum(rank.values())
    before = {t.name for t in spark.catalog.listTables()}
    got = graph.pagerank(spark.createDataFrame(links, "src string, dst string"), spark.createDataFrame([("alone",), ("p1",)], "url string"), iterations=5, tolerance=0.0)
    got = {r.url: r["rank"] for r in got.collect()}
    assert got.keys() == nodes and all(abs(got[u] - rank[u] / total) < 1e-12 for u in nodes)
    assert {t.name for t in spark.catalog.listTables()} == before


def test_links_of_odd_markup(spark):
    """Each way of quoting, and links cut by comments, scripts and a missing end."""
    html = ("""<a href="/one">One</a><A class='x' HREF='/two'>T<b>w</b>o</A><a href=/three>Three</a><a href="/it's">Own</a>"""
            """<!-- <a href="/no">No</a> --><script>"<a href='/no'>No</a>"</script><a href="">Here</a><a data-x="1" href = "/a&amp;b">A &amp; B</a><a href="/open">Open""")
    rows = spark.createDataFrame([(1, "http://h.example/p/", html), (2, "http://h.example/", None)], "page_id bigint, url string, html string")
    got = {(r.target_url, r.anchor_text) for r in pg.extract_links(rows).collect()}
    base = "http://h.example"
    assert got >= {(f"{base}/one", "One"), (f"{base}/two", "Two"), (f"{base}/three", "Three"), (f"{base}/it's", "Own"), (f"{base}/a&b", "A & B")}
    assert not any(a in ("No", "Open") for _, a in got) and len(got) == 6
