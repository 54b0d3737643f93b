"""Values worked out by hand from the rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import hashing, stats
from tidemark.functions.text import literal_heads
from tidemark.functions.urls import normalise_url, resolve
from tidemark.operators import attribution, experiments, filters, fraud, governance, graph, intent, matching, pages, urls
from tidemark.operators import topics as tp

T0 = dt.datetime(2024, 1, 10, 12, 0, 0)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def sec(n):
    return T0 + dt.timedelta(seconds=n)


CLICK = "click_id bigint, ad_id bigint, session_id string, ts timestamp_ntz, ip_hash string, user_agent_hash string, user_agent string, screen_width int"
UA = "Mozilla/5.0 (X11; Linux x86_64)"


@pytest.mark.parametrize("signals, risk, action", [
    ([], 0.0, "allow"),
    ([("high", 0.95)], 0.665, "flag_for_review"),
    ([("high", 0.95), ("low", 0.1)], 0.765, "block_and_investigate"),
    ([("high", 0.85), ("medium", 0.6)], 0.695, "flag_for_review"),
    ([("high", 0.85), ("medium", 0.6), ("medium", 0.6)], 0.795, "block_and_investigate"),
    ([("critical", 1.0), ("high", 0.9)], 1.0, "block_and_investigate"),
])
def test_risk_boundaries(spark, signals, risk, action):
    arr = F.array(*[fraud.signal("k", s, c, F.lit("r")) for s, c in signals]).cast(f"array<{fraud.SIGNAL}>")
    score = fraud.risk_score(arr)
    assert one(spark, score) == pytest.approx(risk)
    assert one(spark, fraud.recommended_action(score)) == action


def test_velocity_default_limit_is_five_per_minute(spark):
    rows = [(i, i, f"s{i}", sec(15 * i), "ip", "h", UA, None) for i in range(5)]
    clicks = spark.createDataFrame(rows, CLICK)
    got = {r.click_id: [s.kind for s in r.signals] for r in fraud.analyse_clicks(clicks).collect()}
    assert got[3] == [] and got[4] == ["velocity_violation"]
    wider = spark.createDataFrame([(*r[:3], sec(15 * r[0] + (1 if r[0] == 4 else 0)), *r[4:]) for r in rows], CLICK)
    assert {r.click_id: len(r.signals) for r in fraud.analyse_clicks(wider).collect()}[4] == 0  # one second too late


def test_machine_timing_and_agents(spark):
    rows = [(i, i, f"s{i}", sec(i), "ip", "h", UA, None) for i in range(3)]
    rows = [(*r[:3], T0 + dt.timedelta(milliseconds=500 * r[0]), *r[4:]) for r in rows]
    rows += [(10, 1, "a", sec(9000), "ip2", None, "", None), (11, 1, "b", sec(19000), "ip2", "h", "curl/8", 1200),
             (12, 1, "c", sec(29000), "ip2", "h", "Mozilla/4.0", 500), (13, 1, "d", sec(39000), "ip2", "h", "iPhone", 1920)]
    got = {r.click_id: [(s.kind, s.confidence) for s in r.signals] for r in fraud.analyse_clicks(spark.createDataFrame(rows, CLICK)).collect()}
    assert got[1] == [] and got[2] == [("click_fraud", 0.85)]
    assert got[10] == [("bot_traffic", 0.6)] and got[11] == [("bot_traffic", 0.95)]
    assert got[12] == [("bot_traffic", 0.7), ("device_spoofing", 0.65)] and got[13] == [("device_spoofing", 0.65)]


def test_five_agents_on_one_ip(spark):
    rows = [(i, i, f"s{i}", sec(600 * i), "ip", f"h{i}", UA, None) for i in range(6)]
    got = {r.click_id: [s.kind for s in r.signals] for r in fraud.analyse_clicks(spark.createDataFrame(rows, CLICK)).collect()}
    assert got[3] == [] and got[4] == ["ip_anomaly"]


def test_conversions_fast_and_duplicate(spark):
    clicks = spark.createDataFrame([(1, 1, "s", T0, "ip", "h", UA, None), (2, 1, "s", T0, "ip", "h", UA, None)], CLICK)
    conv = spark.createDataFrame([(1, 1, "p", 1.0, T0 + dt.timedelta(milliseconds=4900), "verified"), (2, 2, "p", 1.0, sec(5), "verified"),
                                  (3, 2, "p", 1.0, sec(50), "verified")],
                                 "conversion_id bigint, click_id bigint, conversion_type string, value double, ts timestamp_ntz, status string")
    got = {r.conversion_id: [s.confidence for s in r.signals] for r in fraud.analyse_conversions(conv, clicks).collect()}
    assert got == {1: [0.9], 2: [0.95], 3: [0.95]}


def attributed(spark, touches, conv_at):
    clicks = spark.createDataFrame([(i, ad, "s", at, "ip", "h", UA, None) for i, (ad, at) in enumerate(touches)], CLICK)
    conv = spark.createDataFrame([(1, len(touches) - 1, "p", 10.0, conv_at, "verified")],
                                 "conversion_id bigint, click_id bigint, conversion_type string, value double, ts timestamp_ntz, status string")
    out = {}
    for r in attribution.attribute(conv, clicks, "2024-01-10 00:00:00").collect():
        out.setdefault(r.model, {})[r.ad_id] = r.weight
    return out


def test_attribution_models(spark):
    day = dt.timedelta(days=1)
    got = attributed(spark, [(1, T0 - 8 * day), (2, T0 - 3 * day), (3, T0 - 2 * day), (1, T0 - day)], T0)
    assert got["first_touch"] == {1: 1.0, 2: 0.0, 3: 0.0} and got["last_touch"] == {1: 1.0, 2: 0.0, 3: 0.0}
    assert got["linear"] == {1: 0.5, 2: 0.25, 3: 0.25}
    assert got["position_based"] == pytest.approx({1: 0.8, 2: 0.1, 3: 0.1})
    raw = {d: 0.5 ** (d / 7) for d in (8, 3, 2, 1)}
    assert got["time_decay"][2] == pytest.approx(raw[3] / sum(raw.values()))
    for weights in got.values():
        assert sum(weights.values()) == pytest.approx(1.0)


def test_attribution_edges(spark):
    day = dt.timedelta(days=1)
    assert attributed(spark, [(1, T0 - 30 * day), (2, T0)], T0)["position_based"] == {1: 0.5, 2: 0.5}  # exactly 30 days
    assert attributed(spark, [(1, T0 - 31 * day), (2, T0)], T0)["linear"] == {2: 1.0}
    assert attributed(spark, [(7, T0 - day), (7, T0)], T0)["position_based"] == {7: 1.0}
    assert attributed(spark, [(9, T0 - 40 * day)], T0)["time_decay"] == {9: 1.0}  # falls back to its own click


def test_experiment_buckets_and_statistics(spark):
    import hashlib
    import math

    for user in ("a", "user-77", "é"):
        h = hashlib.sha256(f"3:{user}".encode()).hexdigest()
        want = int(hashlib.md5(h.encode()).hexdigest(), 16) % 10000
        assert one(spark, experiments.bucket(experiments.user_hash(F.lit(3), F.lit(user)))) == want
    assert one(spark, stats.erf(F.lit(0.7))) == pytest.approx(math.erf(0.7), abs=2e-7)
    assert one(spark, stats.two_proportion_p(F.lit(0), F.lit(10), F.lit(0), F.lit(10))) == 1.0
    low, high = stats.wilson_bounds(F.lit(0), F.lit(0), F.lit(0.95))
    assert (one(spark, low), one(spark, high)) == (0.0, 0.0)


def test_price_grammar(spark):
    ok = lambda f, p, s: one(spark, f(F.lit(p).cast("double"), F.lit(s)))
    assert ok(filters.price_v1, 0, "<=10") and ok(filters.price_v1, None, ">=10") and not ok(filters.price_v1, 11, "<=10")
    assert ok(filters.price_v2, 0, "free") and not ok(filters.price_v2, 5, "budget") and ok(filters.price_v2, 5, "1-5.5")
    assert not ok(filters.price_v2, 101, "max 100") and ok(filters.price_v2, 101, "min 100") and ok(filters.price_v2, 5, "odd")


def test_query_constraints(spark):
    dims = lambda t: [(c.type, c.dimension, list(c["values"])) for c in one(spark, intent.constraints(F.lit(t)))]
    assert ("inclusion", "platform", ["Android"]) in dims("set up email on Android")
    assert ("exclusion", "provider", ["Google"]) in dims("email no google")
    assert ("exclusion", "provider", ["Google", "Microsoft", "Apple", "Amazon", "Meta"]) in dims("no big tech please")
    assert ("inclusion", "feature", ["end-to-end_encryption"]) in dims("end-to-end encrypted chat")
    assert dims("free and budget") == [] and dims("under 500 rupees") == [("range", "price", ["<=500"])]
    assert one(spark, intent.urgency(F.lit("I know"))) == "immediate"  # substring rule
    assert one(spark, intent.goal(F.lit("zzz"))) is None


def test_alignment_golden(spark):
    sig = "array<struct<dimension:string,preference:string>>"
    schema = f"""doc_goal string, doc_use_cases array<string>, doc_complexity string, doc_ethical_signals {sig}, doc_recency string, goal string,
      use_cases array<string>, skill_level string, ethical_signals {sig}, temporal struct<horizon:string,recency:string,frequency:string>"""
    rows = [("learn", ["learning"], "simple", [], None, "learn", ["learning"], "beginner", [], None),
            ("purchase", ["comparison"], "advanced", [], None, "learn", ["learning"], "beginner", [], None)]
    got = [round(r.alignment, 6) for r in matching.alignment(spark.createDataFrame(rows, schema)).collect()]
    assert got == [0.8, 0.095]


def test_domains(spark):
    score = lambda d: one(spark, urls.domain_facts(F.lit(d))["privacy_score"])
    assert score("protonmail.com") == 0.95 and score("www.maps.google.com") < 0.5 and score("mail.proton.me") == 0.95
    assert score("en.wikipedia.org") > 0.8 and score("nobody.example") == 0.5
    assert one(spark, urls.authority(F.lit("gist.github.com"))) == 0.9 and one(spark, urls.authority(F.lit("x.example"))) == 0.5
    assert one(spark, urls.title_case(F.lit("o'neil's 3rd file.zip"))) == "O'Neil'S 3Rd File.Zip"


def test_urls(spark):
    n = lambda u: one(spark, normalise_url(F.lit(u)))
    assert n("http://a.b/x?utm_source=1&b=2&a=&b=3#top") == "http://a.b/x/?b=2&b=3"
    assert n("http://a.b/x.html?ref=q") == "http://a.b/x.html"
    r = lambda b, h: one(spark, resolve(F.lit(b), F.lit(h)))
    assert r("http://a.b/c/d?q=1", "/für") == "http://a.b/f%C3%BCr" and r("http://a.b/c/d", "e") == "http://a.b/c/e"
    assert r("https://a.b/c", "//x.y/z") == "https://x.y/z" and r("http://a.b/c?q=1", "#t") == "http://a.b/c?q=1#t"


def test_ad_fairness_and_compliance(spark):
    f = lambda d: one(spark, filters.ad_fair(F.array(*[F.lit(x) for x in d]).cast("array<string>")))
    assert f([]) and not f(["Age", "location"]) and f(["precise_location"])


def test_pagerank_sample_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("d", "c"), ("e", "d")], "src string, dst string")
    ranks = {r.url: r["rank"] for r in graph.pagerank(edges, tol_mode="sum", tolerance=1e-3, iterations=12).collect()}
    assert len(ranks) == 5 and sum(ranks.values()) == pytest.approx(1.0)
    assert max(ranks, key=ranks.get) == "c" and ranks["e"] == min(ranks.values())


def test_consents(spark):
    rows = [(1, "u", "analytics", True, None, None, T0), (2, "u", "analytics", False, None, None, sec(1)),
            (3, "v", "analytics", True, sec(5), None, T0), (4, "w", "analytics", True, None, sec(2), T0), (5, "x", "analytics", True, None, None, T0)]
    c = spark.createDataFrame(rows, "id bigint, user_id string, consent_type string, granted boolean, expires_at timestamp_ntz, withdrawn_at timestamp_ntz, created_at timestamp_ntz")
    got = {r.user_id: r.status for r in governance.consent_state(c, "2024-01-11 00:00:00").collect()}
    assert got == {"u": "denied", "v": "expired", "w": "withdrawn", "x": "granted"}


def test_hash_embedding_forms_agree(spark):
    import hashlib

    import numpy as np

    def vec(t):
        b = hashlib.md5(t.encode()).digest()
        return np.array([((b[i % 16] + i * 17) % 100) / 100.0 for i in range(384)])

    a, b = vec("how to"), vec("zebra é")
    want = a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    x, y = F.lit("how to"), F.lit("zebra é")
    assert one(spark, hashing.residue_similarity(hashing.byte_residues(x), hashing.byte_residues(y))) == pytest.approx(want)
    df = spark.createDataFrame([("how to", "zebra é")], "x string, y string")
    assert df.select(hashing.similarity(F.col("x"), F.col("y"))).first()[0] == pytest.approx(want)
    assert np.allclose(df.select(hashing.embedding(F.col("x"))).first()[0], a / np.linalg.norm(a))


def test_html_paths_agree_on_plain_pages(spark):
    html = '<html><head><title>A &amp; B</title><meta name="description" content="d"></head><body><p>One</p>\n<b>two</b> &lt;3</body></html>'
    df = spark.createDataFrame([(1, "http://a.b/", html)], "page_id bigint, url string, html string")
    cols = ["title", "content", "meta_description"]
    assert pages.html_to_page(df).select(*cols).first() == pages.html_to_page_parsed(df).select(*cols).first()


def test_pattern_heads():
    assert literal_heads(r"\b(vs\.?|instructions?|open[- ]?source)\b") == ["instruction", "open", "vs"]
    assert literal_heads(r"\b(a|bb)\b") is None


def test_topic_keywords(spark):
    assert one(spark, tp.query_keywords(F.lit("How to learn Go and go 1x élan"))) == ["go", "1x"]
    assert one(spark, tp.categorise_query(F.lit("django on docker"))) == "python"
