"""Personal data by weak supervision, in DataFrame expressions only.

Base patterns find the certain spans. Looser patterns add candidates; four labelers (format, shape, gazetteer, context) vote
on every candidate. Expectation-maximisation over the counted vote patterns estimates how reliable each labeler is, and its
posteriors train a logistic span classifier, which decides on the candidates that are not base spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ["email", "ip", "card", "phone"]  # kinds with base spans
KINDS = [*BASE, "secret"]
LOCAL = "[A-Za-z0-9._%+-]"
# The contract's patterns. A match can only begin where a run of its first sign begins, or where the last match ended; with
# that said, and possessive repeats, time stays proportional to the text.
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINTS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}+ ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z]{2,12}+",
    "phone": r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_/+=.-])[A-Za-z0-9_-]{20,}+(?![A-Za-z0-9_/+.@-])",
}
LOOSE_HINTS = {"email": r"rlike(_t, '[(\\[]at[)\\]]')", "phone": "rlike(_t, '[0-9]{3}[ .-][0-9]{4}')", "secret": "rlike(_t, '[A-Za-z0-9_-]{20}')"}
IP_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
SHAPES = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@?.*[.\]) ][A-Za-z]{2,12}$", "ip": r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$",
    "card": r"^(?:[0-9]{16,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4})$", "phone": r"^\+?[0-9]{0,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}$",
    "secret": r"^(?=.*[0-9].*[0-9].*[0-9])(?=.*[A-Za-z].*[A-Za-z].*[A-Za-z])(?:[a-z0-9]+|[A-Za-z0-9]+|[A-Za-z]{2,12}[_-][A-Za-z0-9_-]+)$",
}
# gazetteers: top-level domains, issuer prefixes, country codes, prefixes of issued keys; for addresses the ranges that belong to no one
# (all but those for addresses abstain where they know nothing)
GAZETTEER = {
    "email": r"(?i)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|us|it|nl|eu|test|example)$", "ip": r"^(?!0|127\.|255\.|22[4-9]\.|23[0-9]\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))", "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "secret": r"^(?:[sprg]k[_-]|gh[opsu]_|AKIA|xox[abp]-|eyJ)",
}
CONTEXT = {
    "email": r"(?i)(?:mail|contact|write|reach|from)\W*$", "ip": r"(?i)(?:\bip\b|address|host|server|client|from)\W*$",
    "card": r"(?i)(?:card|visa|credit|payment|account)\W*$", "phone": r"(?i)(?:phone|tel|call|mobile|fax|contact|reach)\W*$",
    "secret": r"(?i)(?:token|secret|key|password|passwd|pwd|bearer|auth|credential)s?\W{1,6}$",
}
AGAINST = r"(?i)(?:version|\bv|isbn|order|invoice|section|figure|total|price|commit|sha1|sha256|md5|digest|checksum|hash)\W*$"
VOTES = ["format", "shape", "gazetteer", "context"]
KINDS_AT = range(len(KINDS))
POOLED = 20  # rows that the reliabilities over all kinds count for in those of one kind
ACCEPT = 0.9


def _matches(text: str, pattern: str, when: str) -> str:
    """SQL for the matches of a pattern with their places in code points: array<struct<s, e, t>>."""
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    hits, parts = f"regexp_extract_all({text}, '{p}', 0)", f"split({text}, '{p}', -1)"
    none = "cast(array() as array<struct<s:int,e:int,t:string>>)"
    step = ("(a, x) -> named_struct('at', a.at + length(x.p) + length(x.h), 'out', concat(a.out, array(named_struct("
            "'s', a.at + length(x.p), 'e', a.at + length(x.p) + length(x.h), 't', x.h))))")
    zipped = f"zip_with({hits}, {parts}, (h, p) -> named_struct('h', h, 'p', p))"
    walked = f"aggregate(filter({zipped}, x -> x.h IS NOT NULL), named_struct('at', 0, 'out', {none}), {step}, a -> a.out)"
    return f"CASE WHEN {when} THEN {walked} ELSE {none} END"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _by_kind(column: str, patterns: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN x.k = {i} THEN rlike({column}, {_quoted(patterns[k])})" for i, k in enumerate(KINDS)) + " END"


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``found``: array of struct(k, s, e, t, ok, format, shape, gazetteer, context), base matches first; ok marks base spans."""
    digits = "regexp_replace(x.t, '[^0-9]', '')"
    luhn = ("aggregate(sequence(1, length(d)), 0, (a, i) -> a + CASE WHEN i % 2 = 1 THEN cast(substring(d, length(d) - i + 1, 1) AS int) "
            "ELSE 2 * cast(substring(d, length(d) - i + 1, 1) AS int) - CASE WHEN substring(d, length(d) - i + 1, 1) > '4' THEN 9 ELSE 0 END END) % 10 = 0").replace("d,", f"{digits},").replace("length(d)", f"length({digits})")
    ok = {"email": "true", "ip": f"rlike(x.t, {_quoted(f'^{IP_PART}(?:[.]{IP_PART}){{3}}$')})",
          "card": f"CASE WHEN length({digits}) BETWEEN 16 AND 19 THEN {luhn} ELSE false END", "phone": f"length({digits}) BETWEEN 8 AND 15"}
    df = docs.withColumn("_t", F.expr(f"coalesce({text}, '')"))
    lists = []
    for i, k in enumerate(BASE):
        when = f"contains(_t, '{HINTS[k]}')" if HINTS[k] else "rlike(_t, '[0-9]')"
        df = df.withColumn(f"_{k}", F.expr(f"transform({_matches('_t', PATTERNS[k], when)}, x -> named_struct('k', {i}, 's', x.s, 'e', x.e, 't', x.t, 'ok', {ok[k]}, 'loose', false))"))
        lists.append(f"_{k}")
    for k, pattern in LOOSE.items():
        i, when = KINDS.index(k), LOOSE_HINTS[k]
        df = df.withColumn(f"_loose_{k}", F.expr(f"transform({_matches('_t', pattern, when)}, x -> named_struct('k', {i}, 's', x.s, 'e', x.e, 't', x.t, 'ok', false, 'loose', true))"))
        lists.append(f"_loose_{k}")
    df = df.withColumn("_all", F.expr(f"concat({', '.join(lists)})"))
    before = "substring(_t, greatest(1, x.s - 23), least(x.s, 24))"
    # the base format speaks for its own matches and against those that fail its checks; of looser candidates it knows nothing
    votes = (f"'format', CASE WHEN x.ok THEN 1 WHEN x.loose THEN -1 ELSE 0 END, 'shape', CASE WHEN {_by_kind('x.t', SHAPES)} THEN 1 WHEN x.k = {KINDS.index('secret')} THEN 0 ELSE -1 END, "
             f"'gazetteer', CASE WHEN {_by_kind('x.t', GAZETTEER)} THEN 1 ELSE -1 END, "
             f"'context', CASE WHEN rlike({before}, {_quoted(AGAINST)}) THEN 0 WHEN {_by_kind(before, CONTEXT)} THEN 1 ELSE -1 END")
    df = df.withColumn("found", F.expr(f"transform(_all, x -> named_struct('k', x.k, 's', x.s, 'e', x.e, 't', x.t, 'ok', x.ok, {votes}))"))
    return df.drop("_t", "_all", *lists)


def reliabilities(rows: list[tuple[int, tuple[int, ...], int]], rounds: int = 200) -> dict[tuple[int, tuple[int, ...]], float]:
    """Expectation-maximisation over counted votes (kind, votes: 1 for, 0 against, -1 abstains, count): the posterior of every
    (kind, votes). Each kind has its own share of true spans and its own table of every labeler's votes on true and false
    ones; the tables over all kinds count as POOLED rows of each, so a kind with few votes leans on the others."""
    post = {(k, v): min(0.95, max(0.05, 0.5 + 0.15 * sum((x == 1) - (x == 0) for x in v))) for k, v, _ in rows}
    for _ in range(rounds):
        tables = {}
        for kind in (None, *KINDS_AT):
            some = [(v, n, post[k, v]) for k, v, n in rows if kind in (None, k)]
            yes, no = sum(n * q for _, n, q in some), sum(n * (1 - q) for _, n, q in some)
            for j in range(len(VOTES)):
                for x in (-1, 0, 1):
                    a, b = sum(n * (1 - q) for v, n, q in some if v[j] == x), sum(n * q for v, n, q in some if v[j] == x)
                    p0, p1 = tables.get((None, j, x), (1 / 3, 1 / 3))
                    weight = POOLED if kind is not None else 3
                    tables[kind, j, x] = ((a + weight * p0) / (no + weight), (b + weight * p1) / (yes + weight))
            tables[kind] = (yes + 1) / (yes + no + 2)
        new = {}
        for k, v in post:
            z = math.log(tables[k] / (1 - tables[k])) + sum(math.log(tables[k, j, x][1] / tables[k, j, x][0]) for j, x in enumerate(v))
            new[k, v] = 1 / (1 + math.exp(-max(-30, min(30, z))))
        done = max((abs(new[x] - post[x]) for x in post), default=0) < 1e-9
        post = new
        if done:
            break
    return post


def _features(kind: int, votes: tuple[int, ...]) -> list[float]:
    return [1.0, *[float(kind == i) for i in range(1, len(KINDS))], *[float(v == w) for v in votes for w in (0, 1)]]


def train(rows: list[tuple[int, tuple[int, ...], int]], rounds: int = 400, rate: float = 1.0, ridge: float = 1e-3) -> list[float]:
    """Weights of the span classifier, from (kind, votes, count): the posteriors are its targets."""
    target = reliabilities(rows)
    data = [(_features(k, v), target[k, v], n) for k, v, n in rows]
    total, w = sum(n for *_, n in data) or 1, [0.0] * len(_features(0, (0,) * len(VOTES)))
    for _ in range(rounds):
        grad = [ridge * x for x in w]
        for x, q, n in data:
            z = sum(a * b for a, b in zip(w, x, strict=True))
            off = n / total * (1 / (1 + math.exp(-max(-30, min(30, z)))) - q)
            for i, a in enumerate(x):
                grad[i] += off * a
        w = [a - rate * g for a, g in zip(w, grad, strict=True)]
    return w


def score(weights: list[float]) -> str:
    """SQL for the classifier's probability of candidate x."""
    names = ["1", *[f"cast(x.k = {i} AS int)" for i in range(1, len(KINDS))], *[f"cast(x.{v} = {w} AS int)" for v in VOTES for w in (0, 1)]]
    z = " + ".join(f"{w!r}D * {n}" for w, n in zip(weights, names, strict=True))
    return f"1 / (1 + exp(-({z})))"


def find_personal_data(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of struct(k, s, e), by kind (order of KINDS), then start.

    ``docs`` needs text; its other columns stay (names that begin with an underscore or equal found, base or spans are this
    operator's own). Base spans are the contract's patterns with their checks; spans adds the candidates that the classifier
    accepts and that overlap no base span. A null text is empty and has none. Repeated rows get equal results; an empty
    table an empty result. The driver holds one row per kind and vote pattern, 5 * 3^4 at most.
    """
    seen = candidates(docs.select("text"))
    counted = seen.select(F.explode_outer("found").alias("x")).filter("x IS NOT NULL").groupBy("x.k", *[f"x.{v}" for v in VOTES]).agg(F.count("*").alias("n")).collect()
    rows = sorted((r["k"], tuple(r[v] for v in VOTES), r["n"]) for r in counted)
    weights = train(rows)
    df = candidates(docs)
    slim = "x -> named_struct('k', x.k, 's', x.s, 'e', x.e)"
    df = df.withColumn("base", F.expr(f"array_sort(transform(filter(found, x -> x.ok), {slim}))"))
    more = f"transform(filter(found, x -> NOT x.ok AND {score(weights)} >= {accept} AND NOT exists(base, b -> b.s < x.e AND x.s < b.e)), {slim})"
    return df.withColumn("spans", F.expr(f"array_sort(array_union(base, {more}))")).drop("found")


def listed(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = f"element_at(array({', '.join(map(repr, KINDS))}), x.k + 1)"
    return F.expr(f"concat_ws(',', transform({spans}, x -> concat({names}, ':', x.s, ':', x.e)))")


def redacted(text: str = "text", spans: str = "spans") -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one mark, of the first's kind."""
    names = f"element_at(array({', '.join(repr('[' + k.upper() + ']') for k in KINDS)}), x.k + 1)"
    step = (f"(a, x) -> CASE WHEN x.s >= a.at THEN named_struct('at', x.e, 'out', concat(a.out, substring({text}, a.at + 1, x.s - a.at), {names})) "
            "ELSE named_struct('at', greatest(a.at, x.e), 'out', a.out) END")
    by_start = f"array_sort({spans}, (l, r) -> CASE WHEN l.s <> r.s THEN l.s - r.s ELSE r.e - l.e END)"
    walked = f"aggregate({by_start}, named_struct('at', 0, 'out', ''), {step}, a -> concat(a.out, substring({text}, a.at + 1)))"
    return F.expr(f"CASE WHEN size({spans}) > 0 THEN {walked} ELSE {text} END")
