"""Graph and frontier queries: L1-L8, J5, P13, A17."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.text import r6
from tidemark.operators import graph
from tidemark.operators import pages as pg
from tidemark.plans.registry import cte, query
from tidemark.plans.retrieval import results

cte("page_edges", "SELECT p.url AS src, l.target_url AS dst FROM page_links l JOIN pages p ON p.page_id = l.source_page_id")
# suppliers and parts that trade with each other, a denser graph
cte("trade_edges", """
SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem WHERE l_returnflag <> 'R'
UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem WHERE l_returnflag = 'R'""")


def page_edges(t):
    return graph.link_to_page(pg.extract_links(t.table("pages")), t.table("pages"))


def trade_edges(t):
    l = t.table("lineitem")  # noqa: E741
    s, p = F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    back = F.col("l_returnflag") == "R"
    return l.select(F.when(back, p).otherwise(s).alias("src"), F.when(back, s).otherwise(p).alias("dst"))


@query("link_to_page", "SELECT src, dst FROM page_edges")
def _(t):
    return page_edges(t)


@query("build_graph", """
SELECT url FROM pages UNION SELECT src FROM page_edges UNION SELECT dst FROM page_edges""")
def _(t):
    return graph.vertices(page_edges(t), t.table("pages"))


@query("degrees", """
SELECT url, CAST(sum(o) AS BIGINT) AS out_links, CAST(sum(i) AS BIGINT) AS in_links FROM (
  SELECT src AS url, 1 AS o, 0 AS i FROM trade_edges UNION ALL SELECT dst, 0, 1 FROM trade_edges) GROUP BY url""")
def _(t):
    return graph.degrees(trade_edges(t))


ROUNDS = graph.ITERATIONS


def rank_sql(edges: str, pages: str, rounds: int) -> str:
    steps = [f"r0 AS (SELECT url, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS rank FROM nodes)"]
    for i in range(rounds):
        steps.append(f"""r{i + 1} AS MATERIALIZED (SELECT n.url, 0.15::DOUBLE / (SELECT count(*) FROM nodes) + 0.85::DOUBLE * coalesce(f.flow, 0) AS rank
FROM nodes n LEFT JOIN (SELECT dst, sum(rank * share) AS flow FROM shares JOIN r{i} ON url = src GROUP BY dst) f ON f.dst = n.url)""")
    return f"""WITH nodes AS MATERIALIZED (SELECT src AS url FROM {edges} UNION SELECT dst FROM {edges}{pages}),
shares AS MATERIALIZED (SELECT src, dst, count(*) / any_value(o) AS share FROM {edges} JOIN (SELECT src, count(*)::DOUBLE AS o FROM {edges} GROUP BY src) USING (src) GROUP BY src, dst),
{", ".join(steps)},
ranked AS (SELECT url, rank / (SELECT sum(rank) FROM r{rounds}) AS rank FROM r{rounds})
"""


@query("pagerank", rank_sql("trade_edges", "", ROUNDS) + "SELECT url, round(rank, 6) AS rank FROM ranked")
def _(t):
    return graph.pagerank(trade_edges(t), iterations=ROUNDS, tolerance=0.0).withColumn("rank", r6(F.col("rank")))


@query("store_pagerank", rank_sql("page_edges", " UNION SELECT url FROM pages", ROUNDS) + """
SELECT page_id, url, round(coalesce(rank, 0), 6) AS pagerank FROM pages LEFT JOIN ranked USING (url)""")
def _(t):
    ranks = graph.pagerank(page_edges(t), t.table("pages"), iterations=ROUNDS, tolerance=0.0)
    return graph.store_pagerank(t.table("pages").select("page_id", "url"), ranks).select("page_id", "url", r6(F.col("pagerank")).alias("pagerank"))


@query("top_pages", rank_sql("trade_edges", "", ROUNDS) + "SELECT url, round(rank, 6) AS rank FROM ranked ORDER BY round(rank, 9) DESC, url LIMIT 20")
def _(t):
    ranks = graph.pagerank(trade_edges(t), iterations=ROUNDS, tolerance=0.0).withColumn("rank", F.round("rank", 9))
    return graph.top_pages(ranks, 20).select("url", r6(F.col("rank")).alias("rank"))


# ---------------------------------------------------------------- frontier
cte("queue", """
SELECT url, CAST(page_id % 10 AS INT) AS priority, 0 AS depth, CASE WHEN page_id % 4 = 0 THEN 'done' ELSE 'pending' END AS status,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(page_id) AS scheduled_at FROM pages""")
cte("visited", "SELECT url FROM pages WHERE page_id % 3 = 0 UNION SELECT target_url FROM page_links WHERE anchor_text = 'The'")


def queue(t):
    k = F.col("page_id")
    return t.table("pages").select("url", (k % 10).cast("int").alias("priority"), F.lit(0).alias("depth"),
                                   F.when(k % 4 == 0, "done").otherwise("pending").alias("status"),
                                   F.timestamp_add("MINUTE", k, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("scheduled_at"))


def visited(t):
    seen = pg.extract_links(t.table("pages")).where(F.col("anchor_text") == "The").select(F.col("target_url").alias("url"))
    return t.table("pages").where(F.col("page_id") % 3 == 0).select("url").union(seen).distinct()


@query("dedupe_visited", "SELECT DISTINCT target_url AS url FROM page_links WHERE target_url NOT IN (SELECT url FROM visited)")
def _(t):
    return graph.unvisited(pg.extract_links(t.table("pages")).select(F.col("target_url").alias("url")).distinct(), visited(t))


@query("frontier_add", """
SELECT * FROM queue UNION ALL SELECT DISTINCT target_url, 1, 1, 'pending', TIMESTAMP '2024-02-01 00:00:00' FROM page_links
WHERE target_url NOT IN (SELECT url FROM visited) AND target_url NOT IN (SELECT url FROM queue)""")
def _(t):
    links = pg.extract_links(t.table("pages")).select(F.col("target_url").alias("url"))
    return graph.frontier_add(queue(t), links, visited(t), 1, 1, "2024-02-01 00:00:00")


@query("frontier_next", "SELECT url, priority, scheduled_at FROM queue WHERE status = 'pending' ORDER BY priority DESC, scheduled_at, url LIMIT 25")
def _(t):
    return graph.frontier_next(queue(t), 25).select("url", "priority", "scheduled_at")


@query("search_results_to_frontier", """
WITH once AS (SELECT *, coalesce(score, 0) > 5.0 AS is_high FROM results QUALIFY row_number() OVER (PARTITION BY query_id, url ORDER BY row_id) = 1),
numbered AS (SELECT *, row_number() OVER (PARTITION BY query_id, is_high ORDER BY row_id) AS n FROM once)
SELECT query_id, url, CASE WHEN is_high THEN 8 ELSE 5 END AS priority, CASE WHEN is_high THEN 1 ELSE 2 END AS depth FROM numbered
WHERE n <= CASE WHEN is_high THEN 3 ELSE 4 END""")
def _(t):
    return graph.results_to_frontier(results(t), 3, 4)


@query("queue_stats", """
SELECT 'queue:' || status AS measure, count(*) AS count FROM queue GROUP BY status UNION ALL SELECT 'visited', count(*) FROM visited""")
def _(t):
    return graph.queue_stats(queue(t), visited(t))
