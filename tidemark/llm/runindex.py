"""Repeated byte strings by a run-length index.

A window of ``length`` bytes is filed under its anchor, the k-gram of smallest hash in it, so equal windows have equal
anchors at equal places. Stretches of windows with one anchor are segments; equal segments fold to one copy. Anchors seen
once hold no repeat. The segments of the other anchors are dealt into buckets by anchor, and every bucket builds a
run-compressed Burrows-Wheeler transform of its segments with a sample at every run end. Longest matches elsewhere are
measured at the samples only and streamed along the text from there (inside a run they shrink by one per byte); bytes in
matches of ``length`` or more go. An anchor with very many segments (a passage of a large part of the corpus) would swell
its bucket, so its windows are counted by hash instead: exact as well, and spread over all shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import mix, shuffle_width, written
from tidemark.llm.substring import blocks, expand, in_order, pack, runs_of, squeeze, unpack

LENGTH = 400
GRAM = 64
TOLD_FROM = 300  # bytes from which a shorter match is reported
HOT = 2000  # segments of one anchor that an index takes
BLOCK_BYTES = 4 << 20  # of text in a block: its arrays take about sixty times that
BUCKET_BYTES = 2 << 20
SHARD_WINDOWS = 1 << 20
ALL, INDEXED, COUNTED, MARKED, MASK = range(5)
_ROLL = 0x9E3779B97F4A7C15
_SEGMENT = pa.schema([("block", pa.int32()), ("anchor", pa.int64()), ("segment", pa.int64()), ("n", pa.int32())])
_BODY = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("anchor", pa.int64()), ("segment", pa.int64()), ("body", pa.binary())])
BODY = "shard int, block int, anchor long, segment long, body binary"
TOLD = "block int, kind int, anchor long, segment long, body binary"
_TOLD = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("anchor", pa.int64()), ("segment", pa.int64()), ("body", pa.binary())])


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


PIECE = 1 << 16  # places worked on at once: their arrays stay in a core's cache


def gram_hashes(data: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of the k bytes at every place, by differences of a running polynomial sum, piece by piece."""
    base = _ROLL ^ (seed << 1)
    n = max(0, len(data) - k + 1)
    out = np.empty(n, np.uint64)
    values = mix(np.arange(256, dtype=np.uint64) + np.uint64(seed))
    up, down = _powers(min(n, PIECE) + k, base), _powers(min(n, PIECE), pow(base, -1, 1 << 64))
    for at in range(0, n, PIECE):
        part = data[at:at + PIECE + k - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(values[part] * up[:len(part)], out=sums[1:])
        m = len(part) - k + 1
        out[at:at + m] = mix((sums[k:k + m] - sums[:m]) * down[:m])
    return out


def least_in_window(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling, piece by piece."""
    out = np.empty(max(0, len(x) - w + 1), x.dtype)
    for at in range(0, len(out), PIECE):
        part, size = x[at:at + PIECE + w - 1], 1
        while size < w:
            step = min(size, w - size)
            part = np.minimum(part[:-step], part[step:])
            size += step
        out[at:at + len(part)] = part
    return out


class Segments:
    """Windows of a block, cut into segments: stretches of windows of one document under one anchor."""

    def __init__(self, part: pa.Table, length: int):
        self.length, (self.ids, self.texts) = length, in_order(part)
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        sizes = np.array([len(t) for t in self.texts], np.int64)
        ends = np.cumsum(sizes)
        gram = min(GRAM, length)
        h = gram_hashes(self.data, gram, 7)
        places = np.uint64((1 << 28) - 1)
        if len(self.data) > int(places):
            raise ValueError("a block holds 256 MB at most")
        key = (h & ~places) | np.arange(len(h), dtype=np.uint64)
        low = least_in_window(key, length - gram + 1)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(max(0, len(self.data) - length + 1))
        at = at[at + length <= ends[doc[at]]] if len(at) else at
        anchor_at = (low[at] & places).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (anchor_at[1:] != anchor_at[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        self.begin = at[first]
        self.windows = np.diff(np.append(first, len(at)))  # windows of each segment
        self.anchor = h[anchor_at[first]].view(np.int64)
        whole = self.data.tobytes()
        self.whole = whole
        digest = (xxhash.xxh3_64_intdigest(whole[a:a + n + length - 1]) for a, n in zip(self.begin.tolist(), self.windows.tolist(), strict=True))
        self.segment = np.fromiter(digest, np.uint64, len(first)).view(np.int64)

    def names(self) -> list[tuple[int, int]]:
        return list(zip(self.anchor.tolist(), self.segment.tolist(), strict=True))

    def counted(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Two hashes of every window of the chosen segments, and where it starts."""
        at = np.concatenate([np.arange(self.begin[i], self.begin[i] + self.windows[i]) for i in chosen]) if len(chosen) else np.array([], np.int64)
        if not len(at):
            return np.array([], np.uint64), np.array([], np.uint64), at
        return gram_hashes(self.data, self.length, 11)[at], gram_hashes(self.data, self.length, 13)[at] >> np.uint64(32), at


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of a collection of strings, with samples at the ends of its runs."""

    def __init__(self, strings: list[bytes]):
        self.sizes = np.array([len(s) for s in strings], np.int64)
        text = np.frombuffer(b"".join(s + b"\0" for s in strings), np.uint8).astype(np.uint16)
        self.ends = np.cumsum(self.sizes + 1) - 1  # places of the separators
        text = text + np.uint16(1)
        text[self.ends] = 0
        self.text, n = text, len(text)
        padded = np.concatenate([text, np.zeros(4, np.uint16)]).astype(np.uint64)
        four = (padded[:n] << np.uint64(48)) | (padded[1:n + 1] << np.uint64(32)) | (padded[2:n + 2] << np.uint64(16)) | padded[3:n + 3]
        # separators differ by place, so no two suffixes are equal and followers keep the order that matches_elsewhere needs
        self.room = np.repeat(self.ends, self.sizes + 1) - np.arange(n)  # signs up to the separator
        masked = four & ~((np.uint64(1) << (np.uint64(16) * np.maximum(3 - self.room, 0).astype(np.uint64))) - np.uint64(1))
        order = np.argsort(masked, kind="stable")
        rank, size = self._ranks(masked, order, self.room < 4), 4
        while True:
            sorted_ = rank[order]
            tied = np.concatenate([[False], sorted_[1:] == sorted_[:-1], [False]])
            at = np.flatnonzero(tied[1:] | tied[:-1])  # suffixes that stand alone keep their place
            if not len(at):
                break
            who = order[at]
            # tied suffixes have ``size`` signs in common and no separator among them, so both go on within their strings
            key = (sorted_[at] << np.uint64(32)) | rank[who + size]
            step = np.argsort(key)
            order[at], key = who[step], key[step]
            head = np.concatenate([[True], key[1:] != key[:-1]])
            rank[order[at]] = at[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
            size *= 2
        self.four = four
        before = np.concatenate([[0], text[:-1]])[order]  # the transform
        change = (before[1:] != before[:-1]) | (before[1:] == 0)  # separators are all different
        self.heads = np.flatnonzero(np.concatenate([[True], change]))
        # samples: at a run's head the neighbour above, at its end the neighbour below
        self.samples = [(order[self.heads[1:]], order[self.heads[1:] - 1]), (order[self.heads[1:] - 1], order[self.heads[1:]])]

    @staticmethod
    def _ranks(key: np.ndarray, order: np.ndarray, alone: np.ndarray | bool = False) -> np.ndarray:
        """The place of the first of its equals in the order, for every key; one that stands alone has its own."""
        sorted_ = key[order]
        out = np.empty(len(key), np.uint64)
        new = (sorted_[1:] != sorted_[:-1]) | np.broadcast_to(alone, len(key))[order][1:]
        place = np.arange(len(key))
        place[1:][~new] = 0
        out[order] = np.maximum.accumulate(place)
        return out

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes within their strings, four signs at a time."""
        out, live, at = np.zeros(len(a), np.int64), np.arange(len(a)), 0
        room = np.minimum(self.room[a], self.room[b])
        while len(live):
            live = live[room[live] > at]
            same = self.four[a[live] + at] == self.four[b[live] + at]
            ends = live[~same]
            for step in range(4):  # where four signs differ, find the first
                if len(ends):
                    x, y = np.minimum(a[ends] + at + step, len(self.text) - 1), np.minimum(b[ends] + at + step, len(self.text) - 1)
                    ends = ends[(self.text[x] == self.text[y]) & (room[ends] > at + step)]
                    out[ends] += 1
            live, at = live[same], at + 4
            out[live] = at
        return np.minimum(out, room)

    def matches_elsewhere(self) -> np.ndarray:
        """For every place, the longest match that starts anywhere else: samples are measured, the rest streams from them."""
        n = len(self.text)
        best = np.zeros(n, np.int64)
        for here, there in self.samples:
            value, last = np.zeros(n, np.int64), np.zeros(n, np.int64)
            value[here] = self._common(here, there)
            last[here] = here
            starts = np.concatenate([[0], self.ends[:-1] + 1]) if n else []
            last[starts] = starts
            last = np.maximum.accumulate(last)
            best = np.maximum(best, value[last] - (np.arange(n) - last))
        return best


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, longest_match and ``kept`` (binary: the remaining bytes) of every row of ``docs``.

    ``docs`` needs doc_id, text; other columns are ignored. A byte of a text (UTF-8; null is empty) goes if a string of
    ``length`` bytes over it also starts anywhere else, in the same text or another; strings never cross texts. Repeated
    rows are repeats of each other. ``longest_match`` is the longest match the index measured for a string of the text, cut at
    the ends of its segment: ``length`` or more exactly if something is removed; from TOLD_FROM below that, a repeat too short
    to remove that shares an anchor with another (shorter passages may be missed there, none is removed); else 0. Rows without doc_id are treated like any other. An empty table gives an empty result.
    """
    dealt, total = blocks(docs, BLOCK_BYTES)
    spark = docs.sparkSession
    least = shuffle_width(spark)

    def segments(part: pa.Table) -> pa.Table:
        block, s = part["block"][0].as_py(), Segments(part, length)
        pairs = np.stack([s.anchor, s.segment], 1) if len(s.anchor) else np.zeros((0, 2), np.int64)
        names, n = np.unique(pairs, axis=0, return_counts=True)
        return pa.table([np.full(len(n), block, np.int32), names[:, 0], names[:, 1], np.minimum(n, 2).astype(np.int32)], schema=_SEGMENT)

    seen = written(dealt.groupBy("block").applyInArrow(segments, "block int, anchor long, segment long, n int"), "runindex-segments")
    shapes = seen.groupBy("anchor", "segment").agg(F.least(F.sum("n"), F.lit(2)).alias("n"), F.min("block").alias("home"))
    anchors = shapes.groupBy("anchor").agg(F.sum("n").alias("n"), F.count("*").alias("variants")).filter("n > 1").select("anchor", "variants")
    shapes = shapes.join(anchors, "anchor")
    told = seen.select("block", "anchor", "segment").join(shapes.withColumnRenamed("n", "copies"), ["anchor", "segment"])
    kind = (F.when(F.col("variants") == 1, F.lit(ALL)).when(F.col("variants") > HOT, F.lit(COUNTED)).otherwise(F.lit(INDEXED)))
    told = told.withColumn("kind", kind).withColumn("body", F.when((F.col("copies") > 1), F.encode(F.lit("x"), "UTF-8")))
    asked = told.filter((F.col("kind") == COUNTED) | ((F.col("kind") == INDEXED) & (F.col("block") == F.col("home")))).select("block", "kind", "anchor", "segment", "body")
    buckets = max(1, -(-total // BUCKET_BYTES))
    shards = 1 << max(0, int(max(total // 4 // SHARD_WINDOWS, least // 4)).bit_length())

    def send(part: pa.Table, told: pa.Table) -> pa.Table:
        """Segments to index, by bucket; windows to count, by shard (below zero)."""
        if not len(part) or not len(told):
            return _BODY.empty_table()
        block, s = part["block"][0].as_py(), Segments(part, length)
        kinds = {(a, c): k for k, a, c in zip(*(told[x].to_pylist() for x in ("kind", "anchor", "segment")), strict=True)}
        rows, hot, done = [], [], set()
        for i, name in enumerate(s.names()):
            k = kinds.get(name)
            if k == COUNTED:
                hot.append(i)
            elif k == INDEXED and name not in done:
                done.add(name)
                a = int(s.begin[i])
                rows.append((name[0] % buckets, block, *name, s.whole[a:a + int(s.windows[i]) + length - 1]))
        h1, h2, _ = s.counted(np.array(hot, np.int64))
        shard, h1, h2, n, _ = _grouped(h1, h2, shards)
        rows += [(-1 - x, block, 0, 0, squeeze(h1[a:b], h2[a:b].astype(np.uint32), (n[a:b] > 1).astype(np.uint8))) for x, a, b in runs_of(shard)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, _BODY.types, strict=True)], schema=_BODY)

    def index(part: pa.Table) -> pa.Table:
        if part["shard"][0].as_py() < 0:
            return _count(part)
        bodies = part["body"].to_pylist()
        best = RunIndex(bodies).matches_elsewhere()
        rows, at = [], 0
        for a, c, body in zip(part["anchor"].to_pylist(), part["segment"].to_pylist(), bodies, strict=True):
            longest = int(best[at:at + len(body)].max(initial=0))
            marks = best[at:at + len(body) - length + 1] >= length
            at += len(body) + 1
            if longest >= TOLD_FROM:
                rows.append((-1, MARKED, a, c, longest.to_bytes(4, "little") + (pack(marks) if marks.any() else b"")))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, _TOLD.types, strict=True)], schema=_TOLD)

    sent = dealt.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(send, BODY)
    found = sent.groupBy("shard").applyInArrow(index, TOLD)
    # one pass over what the buckets found: marks go to all blocks that hold the segment, masks to the block that asked
    holds = seen.select(F.col("block").alias("holder"), F.col("anchor").alias("a"), F.col("segment").alias("s"))
    marked = F.when(F.col("kind") == MARKED, F.col("anchor"))
    marks = found.join(holds, (marked == F.col("a")) & (F.col("segment") == F.col("s")), "left").select(
        F.coalesce("holder", "block").alias("block"), "kind", "anchor", "segment", "body")
    whole = told.filter((F.col("kind") != INDEXED) | F.col("body").isNotNull()).select("block", "kind", "anchor", "segment", "body")
    back = whole.unionAll(marks)
    arrow = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("longest_match", pa.int64()), ("kept", pa.binary())])

    def finish(part: pa.Table, told: pa.Table) -> pa.Table:
        if not len(part):
            return arrow.empty_table()
        s, all_, hot, marked, masks = Segments(part, length), set(), set(), {}, {}
        for k, a, c, body in zip(*(told[x].to_pylist() for x in ("kind", "anchor", "segment", "body")), strict=True):
            if k == MARKED:
                marked[(a, c)] = body
            elif k == MASK:
                masks[c] = body
            else:
                if k == ALL or body is not None:  # seen twice as it stands
                    all_.add((a, c))
                if k == COUNTED:
                    hot.add((a, c))
        depth = np.zeros(len(s.data) + 1, np.int64)
        stops = np.cumsum([len(t) for t in s.texts])
        doc, longest = np.searchsorted(stops, s.begin, "right"), np.zeros(len(s.texts), np.int64)
        counted = []
        for i, name in enumerate(s.names()):
            a, n = int(s.begin[i]), int(s.windows[i])
            if name in hot:
                counted.append(i)
            if name in all_:
                depth[a] += 1
                depth[a + n + length - 1] -= 1
                longest[doc[i]] = max(longest[doc[i]], n + length - 1)
            elif name in marked:
                body = marked[name]
                longest[doc[i]] = max(longest[doc[i]], int.from_bytes(body[:4], "little"))
                starts = a + np.flatnonzero(unpack(body[4:], n)) if len(body) > 4 else np.array([], np.int64)
                np.add.at(depth, starts, 1)
                np.add.at(depth, starts + length, -1)
        h1, h2, at = s.counted(np.array(counted, np.int64))
        shard, _, _, _, group = _grouped(h1, h2, shards)
        twice = np.zeros(len(shard), bool)
        for x, a, b in runs_of(shard):
            twice[a:b] = unpack(masks[x], b - a)
        starts = at[twice[group]] if len(at) else at
        np.add.at(depth, starts, 1)
        np.add.at(depth, starts + length, -1)
        np.maximum.at(longest, np.searchsorted(stops, starts, "right"), length)
        gone, rows, at = np.cumsum(depth)[:-1] > 0, [], 0
        for i, t, most in zip(s.ids, s.texts, longest.tolist(), strict=True):
            g = gone[at:at + len(t)]
            spans = int(np.count_nonzero(np.diff(np.concatenate([[0], g.astype(np.int8)])) == 1))
            rows.append((i, len(t), int(g.sum()), spans, most, s.data[at:at + len(t)][~g].tobytes()))
            at += len(t)
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

    return dealt.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(
        finish, "doc_id long, n_bytes long, n_removed long, n_spans long, longest_match long, kept binary")


def _grouped(h1: np.ndarray, h2: np.ndarray, shards: int):
    """Distinct windows by shard and hash: shard, hashes, count, and each window's group."""
    shard = (h1 & np.uint64(shards - 1)).astype(np.int64)
    order = np.lexsort((h2, h1, shard))
    new = np.ones(len(order), bool)
    new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    first = order[new]
    return shard[first], h1[first], h2[first], np.bincount(group, minlength=len(first)), group


def _count(part: pa.Table) -> pa.Table:
    """Exact counts of the windows of one shard; every block gets back which of its own are repeated."""
    got = [expand(x, np.uint64, np.uint32, np.uint8) for x in part["body"].to_pylist()]
    h1, h2, n = (np.concatenate(c) for c in zip(*got, strict=True))
    order = np.lexsort((h2, h1))
    new = np.ones(len(order), bool)
    new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    twice = (np.bincount(group, weights=1.0 + n) > 1)[group]
    parts = np.split(twice, np.cumsum([len(g[0]) for g in got])[:-1])
    rows = [(b, MASK, 0, -1 - x, pack(t)) for b, x, t in zip(part["block"].to_pylist(), part["shard"].to_pylist(), parts, strict=True)]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TOLD.types, strict=True)], schema=_TOLD)
