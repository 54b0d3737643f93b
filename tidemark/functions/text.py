"""Text column builders. Everything stays in built-in expressions (no Python workers)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNICODE_WORD = r"[\p{L}\p{N}_]"
_ASCII_WORD = r"[A-Za-z0-9_]"


def boundary(pattern: str, unicode: bool = True) -> str:
    r"""Rewrite ``\b`` into an explicit class so that the JVM version does not decide what a word is.

    Java changed the meaning of ``\b`` for non-ASCII letters between releases; executors may differ.
    """
    w = _UNICODE_WORD if unicode else _ASCII_WORD
    edge = f"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))"
    # every list item starts and ends with a word character (but for the currency sign), so the outer
    # edges need only look one way
    if pattern.startswith(r"\b"):
        pattern = f"(?<!{w})" + pattern[2:]
    if pattern.endswith(r"\b") and "₹" not in pattern:
        pattern = pattern[:-2] + f"(?!{w})"
    return pattern.replace(r"\b", edge)


def alternatives(pattern: str) -> list[str]:
    """A pattern cut at the bars that are in no group and no class."""
    out, depth, inside, at = [""], 0, False, 0
    while at < len(pattern):
        c = pattern[at:at + 2] if pattern[at] == "\\" else pattern[at]
        inside = c == "[" or inside and c != "]"
        depth += 0 if inside else (c == "(") - (c == ")")
        if c == "|" and not depth and not inside:
            out.append("")
        else:
            out[-1] += c
        at += len(c)
    return out


def literal_heads(pattern: str) -> list[str] | None:
    r"""A literal start of every alternative of a pattern, or of the group it starts with; null if one has none.

    Text that holds none of them cannot match, and a byte search is far cheaper than a regex.
    """
    heads = []
    for one in alternatives(pattern.removeprefix(r"\b")):
        if one.startswith(("(?:", "(")) and (one.startswith("(?:") or not one.startswith("(?")):
            end = next(i for i in range(1, len(one) + 1) if len(alternatives(one[:i] + "|")) == 2)  # the group's end
            found = None if one[end:end + 1] in ("?", "*", "{") else literal_heads(one[3 if one.startswith("(?:") else 1:end - 1])
            if found is None:
                return None
            heads += found
            continue
        head = re.match(r"[A-Za-z0-9 '-]*", one).group(0)
        rest = one[len(head):]
        if rest[:1] in ("?", "*", "{"):
            head = head[:-1]
        if len(head) < 2:
            return None
        heads.append(head)
    return sorted(set(heads))


def matches(text: Column, pattern: str, unicode: bool = True) -> Column:
    hit = text.rlike(boundary(pattern, unicode))
    heads = literal_heads(pattern)
    return hit if heads is None else contains_any(text, heads) & hit


def count_matches(text: Column, patterns: Iterable[str], unicode: bool = True) -> Column:
    total = F.lit(0)
    for p in patterns:
        count, heads = F.regexp_count(text, F.lit(boundary(p, unicode))), literal_heads(p)
        total = total + (count if heads is None else F.when(text.isNull() | contains_any(text, heads), count).otherwise(0))
    return total


def all_matches(text: Column, pattern: str, group: int) -> Column:
    """The group's text in every match of a pattern."""
    found, heads = F.regexp_extract_all(text, F.lit(boundary(pattern)), group), literal_heads(pattern)
    return found if heads is None else F.when(text.isNull() | contains_any(text, heads), found).otherwise(F.array().cast("array<string>"))


def any_of(conditions: Iterable[Column]) -> Column:
    out: Column | None = None
    for c in conditions:
        out = c if out is None else (out | c)
    return F.lit(False) if out is None else out


def contains_any(text: Column, words: Sequence[str]) -> Column:
    return any_of(text.contains(w) for w in words)


def count_contains(text: Column, words: Sequence[str]) -> Column:
    total = F.lit(0)
    for w in words:
        total = total + text.contains(w).cast("int")
    return total


def first_match(rules: Sequence[tuple[str, Column]], default: str | None) -> Column:
    """First rule whose condition holds, in the given order."""
    chain: Column | None = None
    for value, cond in rules:
        chain = F.when(cond, value) if chain is None else chain.when(cond, value)
    return F.lit(default) if chain is None else chain.otherwise(F.lit(default))


def keep(rules: Sequence[tuple[Column, Column]]) -> Column:
    """Array of the values whose condition holds and that are not null, in order.

    Joined from arrays of one, not by ``array_compact``: that is a lambda function, whose input Spark interprets.
    """
    parts = []
    for value, cond in rules:
        one = F.array(value)
        parts.append(F.when(cond & value.isNotNull(), one).otherwise(F.slice(one, 1, 0)))
    return F.concat(*parts)


def best_scored(scores: Sequence[tuple[str, Column]], default: str) -> Column:
    """Label of the highest positive score; ties go to the label declared first."""
    ranked = F.greatest(*[
        F.struct(score.cast("int").alias("s"), F.lit(-i).alias("o"), F.lit(label).alias("v"))
        for i, (label, score) in enumerate(scores)
    ])
    return F.when(ranked["s"] > 0, ranked["v"]).otherwise(F.lit(default))


def words(text: Column) -> Column:
    """Whitespace-separated words, blanks dropped. Text without other white space than blanks, as most, needs no pattern."""
    odd = contains_any(text, ["\t", "\n", "\v", "\f", "\r"])
    return F.array_remove(F.when(odd, F.split(text, r"\s+")).otherwise(F.split(text, " ")), "")


def word_set(text: Column) -> Column:
    return F.array_distinct(words(F.lower(text)))


def overlap_ratio(query: Column, content: Column) -> Column:
    """|query words in content| / |query words|; null when the query has no words."""
    q = word_set(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, words(F.lower(content)))) / F.size(q))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two distinct arrays; 0 when either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    )


def quoted_alternation(items: Iterable[str]) -> str:
    return "|".join(re.escape(i) for i in items)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def r6(x: Column) -> Column:
    """Round a score for output, so that float summation order does not show."""
    return F.round(x.cast("double"), 6)


def ratio(num: Column, den: Column, scale: float = 1.0) -> Column:
    """Guarded ratio: 0 when the denominator is not positive."""
    return F.when(den > 0, num / den * scale).otherwise(F.lit(0.0))
