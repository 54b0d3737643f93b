"""Every operator on small tables with nulls, empty texts, ties, repeated rows and clashing columns, against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import chat, components, mixing, pii, quality, queries, runindex, simhash, substring, topk, warc, winnow
from tidemark.llm.common import table
from tests.oracle_check import compare

SMALL = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 37}x{i % 11}" for i in range(90))
TEXTS = [(1, LONG), (2, "start " + LONG), (3, None), (4, ""), (5, LONG), (5, LONG), (6, "a b"), (None, "start " + LONG), (None, None), (7, " \t\n"), (8, "A É\U0001F600 " * 60)]
SCHEMA = "doc_id long, text string, block int, fp long, words int, kept string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, 2, 3, "x") for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    ok, message = compare(spark, SMALL, name, queries.QUERIES[name], queries.ORACLES[name])
    assert ok, message


def test_substring(spark, docs, none):
    known = [(i, t) for i, t in TEXTS if i is not None]
    seen, want = set(), []
    for i, t in sorted(known, key=lambda r: (r[0], r[1] or "")):
        w = (t or "").split()
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for a in range(len(w) - 19):
            key = tuple(w[a:a + 20])
            gone |= set(range(a, a + 20)) if key in seen else set()
            seen.add(key)
        want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = [tuple(r) for r in substring.remove_repeats(docs.filter("doc_id is not null")).collect()]
    assert order(got) == order(want)
    assert substring.remove_repeats(docs).count() == len(TEXTS) and substring.remove_repeats(none).count() == 0


@pytest.mark.parametrize("hot", [2000, 1])
def test_run_index(docs, none, hot, monkeypatch):
    monkeypatch.setattr(runindex, "HOT", hot)
    rows = [(i, (t or "").encode()) for i, t in TEXTS]
    many = Counter(t[a:a + 400] for _, t in rows for a in range(len(t) - 399))
    want = []
    for i, t in rows:
        gone = np.zeros(len(t) + 1, bool)
        for a in range(len(t) - 399):
            if many[t[a:a + 400]] > 1:
                gone[a:a + 400] = True
        spans = int(np.sum(gone[:-1] & ~np.concatenate([[False], gone[:-2]]))) if len(t) else 0
        want.append((i, len(t), int(gone.sum()), spans, bytes(x for x, g in zip(t, gone) if not g)))
    result = runindex.remove_repeats(docs).collect()
    got = [(*r[:4], bytes(r.kept)) for r in result]
    assert all((r.longest_match >= 400) == (r.n_removed > 0) for r in result)
    assert order(got) == order(want) and runindex.remove_repeats(none).count() == 0


def test_run_index_reports_shorter_repeats(spark):
    """Passages under the length stay, but most are told; nothing is told of texts that share nothing."""
    rng = np.random.default_rng(2)
    prose = lambda n: bytes(rng.choice(list(b"abcdefghijklmnop "), n).tolist()).decode()
    rows = []
    for i in range(60):
        passage = prose(380)
        rows += [(3 * i, prose(900) + passage + prose(700)), (3 * i + 1, prose(600) + passage + prose(900)), (3 * i + 2, prose(2000))]
    got = {r.doc_id: r for r in runindex.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(r.n_removed == 0 and r.longest_match in (0, *range(300, 400)) for r in got.values())
    assert not any(got[i].longest_match for i in range(2, 180, 3))
    told = [got[i].longest_match for i in range(180) if i % 3 < 2]
    assert sum(x > 0 for x in told) > 0.7 * len(told) and max(told) >= 380


def test_run_index_matches():
    strings = [b"abracadabra", b"cadabraxx", b"aaaa"]
    joined = b"\0".join(strings) + b"\0"
    got = runindex.RunIndex(strings).matches_elsewhere()
    for i in range(len(joined)):
        room = joined.index(b"\0", i) - i
        best = 0
        for j in range(len(joined)):
            if j != i:
                n = 0
                while n < room and joined[i + n] == joined[j + n]:
                    n += 1
                best = max(best, n)
        assert got[i] == best, (i, got[i], best)


def test_run_index_ties():
    """Many equal suffixes: their order must be the same from one place to the next, or matches are lost."""
    rng = np.random.default_rng(5)
    for _ in range(60):
        strings = []
        for _ in range(12):  # the same body under four heads, two of them equal, and near relatives
            body = bytes(rng.choice(list(b"abc"), 12).tolist())
            heads = rng.choice(list(b"pqr"), 4).tolist()
            strings += [bytes([h]) + body for h in heads] + [body[: int(rng.integers(4, 12))]]
        strings = [strings[i] for i in rng.permutation(len(strings))]
        got, at = runindex.RunIndex(strings).matches_elsewhere(), 0
        grams = Counter(s[i:j] for s in strings for i in range(len(s)) for j in range(i + 1, len(s) + 1))
        for s in strings:
            for i in range(len(s)):
                best = max((j - i for j in range(i + 1, len(s) + 1) if grams[s[i:j]] > 1), default=0)
                assert got[at + i] == best, (s, i, got[at + i], best)
            at += len(s) + 1


def brute_print(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@pytest.mark.parametrize("group", [64, 0])
def test_simhash(spark, docs, none, group, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", group)
    more = table(spark, SMALL, "documents").filter("doc_id < 150").select(F.col("doc_id") + 100, "text")
    rows = [tuple(r) for r in docs.filter("doc_id is not null").select("doc_id", "text").union(more).collect()]
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 2:
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[find(k)] = min(low.get(find(k), i), i)
    want = [(i, f"{prints[k]:016x}", low[find(k)]) for k, (i, _) in enumerate(rows)]
    got = [tuple(r) for r in simhash.near_duplicates(docs.filter("doc_id is not null").select("doc_id", "text").union(more)).collect()]
    assert order(got) == order(want)
    assert simhash.near_duplicates(docs).count() == len(TEXTS) and simhash.near_duplicates(none).count() == 0


def test_near_copies(spark, none):
    base = [f"w{i * i % 977}" for i in range(400)]
    edited = [*base[:100], "other", *base[101:300], "new", *base[301:]]
    rows = [(9, " ".join(base)), (4, " ".join(edited)), (5, " ".join(reversed(base))), (6, " ".join(f"z{i}" for i in range(300)))]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {9: 4, 4: 4, 5: 5, 6: 6} and simhash.near_copies(none).count() == 0


def test_alike_in_large_components(spark, monkeypatch):
    """Pairs settled by shares of the tokens equal pairs settled at once."""
    rng = np.random.default_rng(3)
    base = rng.integers(-(1 << 62), 1 << 62, 120)
    sets = {i: np.unique(np.concatenate([base[: 100 + i % 20], rng.integers(-(1 << 62), 1 << 62, i % 25)]).view(np.uint64)).view(np.int64) for i in range(40)}
    pairs = [(a, b) for a in sets for b in sets if a < b]
    want = {(a, b) for a, b in pairs if (n := len(np.intersect1d(sets[a], sets[b]))) * 5 >= (len(sets[a]) + len(sets[b]) - n) * 4}
    table_ = spark.createDataFrame([(i, x.tolist()) for i, x in sets.items()], "id long, x array<long>")
    asked = spark.createDataFrame(pairs, "a long, b long")
    for tokens in (1 << 21, 500):
        monkeypatch.setattr(simhash, "CELL_TOKENS", tokens)
        assert {tuple(r) for r in simhash._alike(asked, table_, 4, 5).collect()} == want and 0 < len(want) < len(pairs)


def test_pairs_of_large_components_are_dealt_once(spark, monkeypatch):
    """Rows grow with the pairs, not with pairs times the size of their component."""
    star = [(0, b) for b in range(1, 60)] + [(b, b + 1) for b in range(1, 59)]
    pairs = spark.createDataFrame(star, "a long, b long")
    sizes = spark.createDataFrame([(i, 100) for i in range(60)], "node long, size long")
    for tokens in (1 << 21, 500):
        monkeypatch.setattr(simhash, "CELL_TOKENS", tokens)
        dealt = simhash._deal(pairs, sizes).collect()
        assert sorted((r.a, r.b) for r in dealt) == sorted(star)
        cells = {}
        for r in dealt:
            cells.setdefault((r.r, r.i), set()).update((r.a, r.b))
        assert sum(map(len, cells.values())) <= 60 + len(star) and (len(cells) > 4) == (tokens == 500)


def test_sketches_lose_no_pair():
    rng = np.random.default_rng(5)
    draw = lambda k: rng.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2)
    ruled_out = 0
    for size in (0, 1, 3, 16, 60, 500, 9000):
        base = draw(size)
        for kept in (1.0, 0.95, 0.9, 0.85, 0.5, 0.0):
            other = np.concatenate([base[:int(size * kept)], draw(int(size * (1 - kept) * 0.5))])
            x, y = np.unique(base), np.unique(other)
            both = len(np.intersect1d(x, y))
            held = simhash.may_be_alike(simhash.sketch(x), simhash.sketch(y), 4, 5)
            assert held or both * 5 < (len(x) + len(y) - both) * 4
            ruled_out += not held
    assert ruled_out > 8
    assert simhash.sketch(np.arange(5000, dtype=np.uint64)) == b"" and simhash.may_be_alike(b"", simhash.sketch(draw(9)), 4, 5)


def test_near_copies_meet_by_fingerprints(spark, monkeypatch):
    """The links of op3 find copies with small edits by themselves; the exact check drops those that only look alike."""
    base = [f"w{i * i % 977}" for i in range(400)]
    one = [*base[:399], "last"]
    bulk = " ".join(f"line{i}" for i in range(13)) + " "
    texts = [" ".join(base), " ".join(one), bulk * 400 + "some own words here now", bulk * 400 + "these are quite other words"]
    prints = [int(simhash.fingerprint(t.encode(), 3)[0]) for t in texts]
    assert all(bin((prints[i] ^ prints[i + 1]) & (1 << 64) - 1).count("1") <= 2 for i in (0, 2))
    monkeypatch.setattr(simhash, "_prefix", lambda x, *_: x[:0])
    assert copies_of(spark, texts) == [0, 0, 2, 3]


def test_components_unsettled(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)], "a long, b long")
    assert {r.root for r in simhash.components(edges).collect()} == {0}
    with pytest.raises(RuntimeError):
        simhash.components(edges, rounds=1)


def test_components_of_few_edges_leave_few_files(spark):
    """Rounds over a handful of edges do not write a file for each of very many shuffle partitions."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(50, i) for i in range(40, 60)], "a long, b long")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    rounds, cut = [], components.cut_lineage
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        components.cut_lineage = lambda df: rounds.append(cut(df)) or rounds[-1]
        roots = {r.node: r.root for r in components.components(edges).collect()}
    finally:
        components.cut_lineage = cut
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert roots == {i: 0 for i in range(13)} | {i: 40 for i in range(40, 60)}
    assert len(rounds) > 4 and all(r.rdd.getNumPartitions() == 1 for r in rounds[1:])


def brute_copies(texts, n=5):
    """component (smallest index) of each text: exact Jaccard of distinct shingles, all pairs."""
    sets = [set(simhash.shingles(t.encode(), n)) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def copies_of(spark, texts):
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    return [got[i] for i in range(len(texts))]


@pytest.mark.parametrize("block", [512, 16])
def test_near_copies_of_busy_keys(spark, block, monkeypatch):
    """Hundreds of different texts under the same tokens: pages around one template, 0.7 to 0.9 alike, chained or not."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng, template = np.random.default_rng(3), [f"t{i}" for i in range(120)]
    pages = []
    for i in range(240):  # most differ from each other, some are near the template or another page
        share = int(rng.choice([4, 8, 11, 13, 18, 25]))
        pages.append(" ".join(template[share:] + [f"p{i}x{k}" for k in range(share)]))
    texts = [*pages, " ".join(template), *[p + " more words" for p in pages[::7]]]
    want = brute_copies(texts)
    assert 20 < len(set(want)) < len(texts) - 20 and copies_of(spark, texts) == want


def test_near_copies_exact(spark):
    """Pairs just above and below 0.8: short, long and repetitive texts; repeats within a text do not count."""
    words = lambda p, n: [f"{p}{i}" for i in range(n)]
    texts = []
    for n in (7, 8, 9, 10, 12, 24, 100, 300):  # n words and some more, or fewer, at the end
        for more in {1, 2, 3, (n - 4) // 4, (n - 4) // 4 + 1, (n - 4) // 5}:
            w = words(f"w{n}m{more}q", n)
            texts += [" ".join(w), " ".join(w + words(f"z{n}m{more}q", more))]
    line = " ".join(words("line", 12)) + " "
    texts += [line * 100 + " ".join(words("own", 30)), line * 100 + " ".join(words("other", 30))]  # one bulk, different texts
    rest = words("rest", 40)
    texts += [" ".join(rest), " ".join(rest + rest[:20] + rest), " ".join(rest * 30)]  # one set, but for the seams
    want = brute_copies(texts)
    assert want[-5] != want[-4] and len({*want[-3:]}) == 1 and copies_of(spark, texts) == want


def base_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_personal_data(spark, docs, none):
    tricky = ["a@b.c_d@e.f.g@h.i", "x@y", "😀 me@é.com you@site.example.org.", "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.255", "4111 1111-1111 1111 4111111111111112",
              "+1 (523) 555-6688 +12 +1((((", "a" * 20000 + "@", "1." * 5000, None, "", "call 555-123-4567 now", "a@b.cc@d.ee"]
    df = spark.createDataFrame(list(enumerate(tricky)), "doc_id long, text string").union(table(spark, SMALL, "documents").select(F.col("doc_id") + 100, "text"))
    for r in pii.find_personal_data(df).withColumn("shown", pii.redacted()).collect():
        assert [(pii.KINDS[s.k], s.s, s.e) for s in r.base] == base_spans(r.text or ""), r.text
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}
        if not r.spans:
            assert r.shown == r.text
    assert pii.find_personal_data(none).count() == 0 and pii.find_personal_data(docs).count() == len(TEXTS)
    post = pii.reliabilities([(0, (1, 1, 1, 1), 90), (0, (0, -1, -1, -1), 100), (0, (1, 1, -1, -1), 40), (4, (-1, 1, -1, 1), 5), (4, (-1, 0, -1, 0), 5)])
    assert post[0, (1, 1, 1, 1)] > 0.9 > 0.1 > post[0, (0, -1, -1, -1)] and post[4, (-1, 1, -1, 1)] > 0.9 > 0.1 > post[4, (-1, 0, -1, 0)]


def test_personal_data_beyond_the_base(spark):
    """Spans that only the method adds: precision and recall on made texts, beside the base cases it learns from."""
    rng = np.random.default_rng(6)
    letters = lambda n, of="0123456789abcdef": "".join(rng.choice(list(of), n))
    keys = [letters(40) for _ in range(60)]
    secret = [f'so the token = "{k}" was left' for k in keys[:30]] + [f"password: {k} and more" for k in keys[30:]]
    harmless = [f"commit {letters(40)} fixed it" for _ in range(30)] + [f"a {letters(30, 'ab')} word" for _ in range(30)] + ["see " + "_".join(["snake"] * 6) for _ in range(30)]
    base = [f"mail me@site{i}.example.org or call +1 (523) 555-{1000 + i}" for i in range(60)] + [f"host 10.1.2.{i} and card 4111 1111 1111 1111 and 4111 1111 1111 1112" for i in range(60)]
    rows = list(enumerate(secret + harmless + base))
    found = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    added = {(i, rows[i][1][s.s:s.e]) for i in found for s in found[i].spans if s not in found[i].base}
    want = {(i, keys[i]) for i in range(60)}
    assert len(added & want) / len(want) >= 0.95 and len(added & want) / max(1, len(added)) >= 0.95


def test_personal_data_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "token = 0123456789abcdef0123456789", "x", 7), (2, None, None, 8)], "doc_id long, text string, k string, found int")
    got = {r.doc_id: r for r in pii.find_personal_data(df).collect()}
    assert got[1].k == "x" and got[2].spans == [] and "found" not in got[1]  # found, base, spans and _ names are the operator's own


def test_mixing(spark, docs, none):
    goal = mixing.targets([("b", 100), (None, 10), ("a", 1000)])
    assert goal[None] == 30 and abs(sum(goal.values()) - 1110) < 1e-6
    rows = [(i, f"s{i % 3}" if i % 7 else None, " ".join(["w"] * (i % 50))) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    first, second = (order(tuple(r) for r in mixing.mix_sources(df).collect()) for _ in range(2))
    assert first == second and len(first) == 3000
    taken = Counter()
    for r in mixing.mix_sources(df).collect():
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source, r.target] += r.taken
    assert all(abs(n - t) <= 0.01 * t for (_, t), n in taken.items())
    assert mixing.mix_sources(df.limit(0)).count() == 0
    assert mixing.mix_sources(docs.withColumn("source", F.lit("one"))).count() == len(TEXTS)


def test_quality(spark, docs, none):
    good = [(i, f"The {i} houses of town {i * 7 % 13} stand near a river, and people walk along it every day of week {i % 9}.") for i in range(400)]
    bad = [(i, "BUY!! NOW!! " * (3 + i % 5)) for i in range(400, 560)]
    df = spark.createDataFrame(good + bad + [(900, None), (901, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good[:300]] + [(i, 0) for i, _ in bad] + [(1, None)], "doc_id long, quality int")
    rows = {r.doc_id: r for r in quality.classify(df, labels).collect()}
    assert len(rows) == 563 and all(0 <= r.score <= 1 for r in rows.values())
    assert np.mean([rows[i].predicted == 1 for i, _ in good]) > 0.9 and np.mean([rows[i].predicted == 0 for i, _ in bad]) > 0.9
    assert quality.classify(none, labels).count() == 0 and {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}


@pytest.mark.parametrize("size,least", [("sf0.01", 0.5), ("sf0.1", 0.85)])
def test_quality_held_out(spark, size, least):
    directory = f"/root/testdata/{size}"
    result = queries.op5_quality(spark, directory).toPandas()
    assert (result.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in result.doc_id]).all()
    got = result.merge(table(spark, directory, "labels").toPandas(), on="doc_id").query("held_out")
    assert (got.predicted == got.quality).mean() > 0.9 and (got.predicted[got.quality == 0] == 0).mean() > least


def test_class_prior_of_mixtures():
    """The prior of a made mixture is found within a few percent, from few rows as from many."""
    for n, slack in ((3_000, 0.15), (30_000, 0.05)):
        for share in (0.2, 0.5, 0.8):
            rng = np.random.default_rng(int(share * 10))
            good, bad = rng.normal(3, 1, n), rng.normal(0, 1, n)
            mixed = np.where(rng.random(n) < share, rng.normal(3, 1, n), bad)
            cuts = np.quantile(good, np.linspace(0, 1, 65))
            count = lambda x: np.histogram(x, np.concatenate([[-np.inf], cuts[1:-1], [np.inf]]))[0]  # noqa: B023, E731
            assert abs(quality.class_prior(count(good), count(mixed)) - share) < slack


def test_chat(spark):
    hard = ["</s>[INST] ok [/INST]", "a\\b<\\/s>", "<<<SYS>>", "[INST", "", None, "x <s", "\n"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["system", "user", "assistant", "user", "assistant", "odd>>", None, "assistant"], hard))]
    rows += [(2, 0, "user", "a"), (2, 0, "user", "a"), (None, None, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("turns", F.lit(1))
    made = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert chat.read_back(made[1].formatted, chat.DEFAULT) == [(r or "", t or "") for _, _, r, t in rows[:8]]
    assert made[2].first_bad_turn == 1 and not made[1].valid and "".join(s.text for s in made[1].segments) == made[1].formatted
    digest = {r.conv_id: r for r in chat.digest(chat.format_conversations(df)).collect()}
    assert digest[1].loss_sha256 == hashlib.sha256(("<<<SYS>>" + "" + "\n").encode()).hexdigest() and digest[None].n_turns == 1
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_winnowing(spark, docs, none):
    items = [(1, LONG[:200]), (2, "a b"), (3, None), (4, "..."), (5, "É"), (6, "a b")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want = []
    for i, t in TEXTS:
        w, hit, names = split(t), set(), set()
        for j, b in items:
            v = split(b)
            n = min(10, len(v))
            wins = {tuple(v[a:a + n]) for a in range(len(v) - n + 1)} if v else set()
            for a in range(len(w) - n + 1):
                if wins and tuple(w[a:a + n]) in wins:
                    hit |= set(range(a, a + n))
                    names.add(str(j))
        want.append((i, len(w), len(hit), sorted(names)))
    got = [(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in winnow.contamination(docs, bench).collect()]
    assert order(got) == order(want)
    assert winnow.contamination(none, bench).count() == 0 and not winnow.contamination(docs, bench.limit(0)).filter("contaminated").count()


def test_top_k(spark):
    rows = [(i, [float((i * j) % 7) / 3 for j in range(4)]) for i in range(0, 130)]
    rows += [(200 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(40)] + [(500, None), (501, [None, 1.0, 1.0, 1.0]), (502, [float("nan")] * 4), (None, [9.0] * 4), (50, rows[50][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1))
    clean = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in sorted(i for i in clean if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(clean[q], v)), i) for i, v in clean.items() if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert order(tuple(r) for r in topk.top_k(df, block=16).collect()) == order(want)
    assert topk.top_k(df.limit(0)).count() == 0 and topk.top_k(df.filter("vec_id in (50, 51)")).count() == 1


def test_top_k_lengths(spark):
    rows = [(i, [float(i), 1.0]) for i in range(60)]
    with pytest.raises(ValueError, match="2 to 3 components"):
        topk.top_k(spark.createDataFrame([*rows, (60, [1.0, 1.0, 1.0])], "vec_id long, embedding array<double>"))


def test_warc(spark, tmp_path):
    pages = [(3, "http://a", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "u", None), (5, "v", ""), (7, "w\nx", "z" * 5000), (7, "w\nx", "z" * 5000), (None, "n", "<p>é</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("shard", F.lit(1))
    files = []
    for run in ("a", "b"):
        folder = f"file://{tmp_path}/{run}"
        manifest = warc.write_archive(df, folder, shard_bytes=2000, file_bytes=500)
        files.append(order(tuple(r) for r in manifest.collect()))
        got = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archive(manifest, folder).collect()}
    assert files[0] == files[1] and len(files[0]) > 1
    assert got == {(1, 9, "response", None), (3, 9, "revisit", 1), (None, 9, "revisit", 1), (2, 0, "response", None), (5, 0, "revisit", 2), (7, 5000, "response", None)}
    folder = f"file://{tmp_path}/c"
    assert warc.read_archive(warc.write_archive(df.limit(0), folder), folder).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = table(spark, SMALL, "documents")
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == [*docs.columns, "copies", "taken"] and 0 < out.count() <= docs.count()
    rows = out.select("doc_id", "text").collect()
    assert not any(base_spans(r.text or "") for r in rows)
    hit = winnow.contamination(out, table(spark, SMALL, "benchmark")).filter("contaminated").count()
    assert hit == 0
    for _, stage in corpus_pipeline.STAGES[1:3]:
        assert stage(spark, docs.limit(0), SMALL).count() == 0
