"""Substring deduplication with a count-min prefilter.

Documents are dealt into blocks of bounded size. Every block adds its windows of consecutive words to its own count-min
sketch; the sketches, sparse and cut into shards of cells, are merged shard by shard, and every block learns which of its
own cells hold at least two windows. That never underestimates, so all repeated windows are among the windows kept. A second
pass groups those windows alone, exactly (96 bits of two independent hashes and the order of documents), and tells every
block which of them start earlier elsewhere. Only sketches, keys and bit masks travel; a text is shuffled once, to its block.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import byte_texts, mix, shuffle_width

WINDOW = 20
DEPTH = 2  # rows of the sketch
CELL_BITS = 24  # cells of a shard in each row: 16 for each window it may hold
SHARD_WINDOWS = 1 << 20
BLOCK_BYTES = 8 << 20
LAST = np.iinfo(np.int64).max
MESSAGE = "block int, row int, shard int, body binary"
_MESSAGE = pa.schema([("block", pa.int32()), ("row", pa.int32()), ("shard", pa.int32()), ("body", pa.binary())])


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """doc_id, text, block, and the bytes of all texts. A document's rows meet in one block; rows without doc_id are spread."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(-(-total // block_bytes), shuffle_width(docs.sparkSession))
    home = F.xxhash64(F.coalesce(F.col("doc_id"), F.xxhash64("text")))
    return docs.withColumn("block", F.pmod(home, F.lit(n)).cast("int")), total


def in_order(part: pa.Table) -> tuple[list, list[bytes]]:
    """Ids and texts of a block by doc_id (null last), then text."""
    rows = sorted(zip(part["doc_id"].to_pylist(), byte_texts(part["text"]), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    return [r[0] for r in rows], [r[1] for r in rows]


def _rolled(h: np.ndarray, length: int, base: int) -> np.ndarray:
    """Polynomial hash of every run of ``length`` values, by doubling."""
    power = lambda e: np.uint64(pow(base, e, 1 << 64))
    runs, size, out, done = h, 1, None, 0
    while True:
        if length & size:
            out = runs if out is None else out[: len(runs) - done] * power(size) + runs[done:done + len(out)][: len(out[: len(runs) - done])]
            done += size
        if 2 * size > length:
            return out
        runs = runs[:-size] * power(size) + runs[size:] if len(runs) > size else runs[:0]
        size *= 2


class Block:
    """Words and windows of one block."""

    def __init__(self, part: pa.Table, length: int):
        self.ids, texts = in_order(part)
        self.words = [t.split() for t in texts]
        self.ends = np.cumsum([len(w) for w in self.words], dtype=np.int64)
        flat = [w for ws in self.words for w in ws]
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, flat), np.uint64, len(flat))
        begins = self.ends - np.array([len(w) for w in self.words], np.int64) if self.words else self.ends
        doc = np.repeat(np.arange(len(self.words)), self.ends - begins)
        at = np.arange(max(0, len(flat) - length + 1))
        self.start = at[at + length <= self.ends[doc[at]]] if len(at) else at
        self.doc, self.length = doc, length
        if len(self.start):
            self.h1 = mix(_rolled(h, length, 0x9E3779B97F4A7C15)[self.start])
            self.h2 = mix(_rolled(mix(h ^ np.uint64(0xA5A5A5A5)), length, 0xD6E8FEB86659FD93)[self.start])
        else:
            self.h1 = self.h2 = np.array([], np.uint64)

    def cells(self, row: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct (shard, cell) of one row of the sketch as single numbers, and how to find each window's."""
        x = mix(self.h1 + np.uint64((row + 1) * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1))
        key = ((x & np.uint64(shards - 1)) << np.uint64(CELL_BITS)) | (x >> np.uint64(64 - CELL_BITS))
        return np.unique(key, return_inverse=True)

    def candidates(self, told: dict, shards: int) -> np.ndarray:
        """Windows whose smallest estimate over the rows of the sketch is at least two."""
        held = np.ones(len(self.start), bool)
        for row in range(DEPTH):
            key, where = self.cells(row, shards)
            twice = np.zeros(len(key), bool)
            for shard, a, b in runs_of(key >> np.uint64(CELL_BITS)):
                twice[a:b] = unpack(told[(row, shard)], b - a)
            held &= twice[where]
        return np.flatnonzero(held)

    def keys(self, chosen: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct windows among ``chosen`` by shard and hash: shard, place of the first of each, and each one's group."""
        h1, h2 = self.h1[chosen], self.h2[chosen] >> np.uint64(32)
        shard = (h1 & np.uint64(shards - 1)).astype(np.int64)
        order = np.lexsort((h2, h1, shard))  # stable: equal windows stay in order of start
        new = np.ones(len(order), bool)
        new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        first = order[new]
        return shard[first], h1[first], h2[first].astype(np.uint32), chosen[first], group


def runs_of(shard: np.ndarray):
    """(value, begin, end) of equal stretches of a sorted array."""
    if len(shard):
        cut = np.flatnonzero(np.diff(shard.astype(np.int64))) + 1
        for a, b in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(shard)]]), strict=True):
            yield int(shard[a]), int(a), int(b)


def pack(bits: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def unpack(body: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(body), np.uint8), count=n).astype(bool)


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length, byte plane by byte plane, entropy-coded."""
    planes = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() for a in arrays)
    z = zlib.compressobj(1, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY)
    return len(arrays[0]).to_bytes(8, "little") + z.compress(planes) + z.flush()


def expand(body: bytes, *kinds: type) -> list[np.ndarray]:
    n, raw, at, out = int.from_bytes(body[:8], "little"), np.frombuffer(zlib.decompress(body[8:], -15), np.uint8), 0, []
    for kind in kinds:
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at:at + n * width].reshape(width, n).T).reshape(-1).view(kind))
        at += n * width
    return out


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, _MESSAGE.types, strict=True)], schema=_MESSAGE)


def _told(part: pa.Table) -> dict:
    return {(r, s): b for r, s, b in zip(part["row"].to_pylist(), part["shard"].to_pylist(), part["body"].to_pylist(), strict=True)}


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and ``kept`` (the kept words, joined by single spaces) of every row of ``docs``.

    ``docs`` needs doc_id, text; other columns are ignored. Words are runs without ASCII white space. A word goes if it lies
    in a window of ``window`` words that also starts earlier: in a smaller doc_id, or earlier in the same document. Rows of
    one doc_id count in order of their texts, so of repeated rows the first keeps its words; rows without doc_id come last,
    by block and text. A null or short text has no window and keeps its words. An empty table gives an empty result.
    """
    dealt, total = blocks(docs)
    shards = 1 << max(0, int(total // 6 // SHARD_WINDOWS).bit_length())

    def sketch(part: pa.Table) -> pa.Table:
        block, b, rows = part["block"][0].as_py(), Block(part, window), []
        for row in range(DEPTH):
            key, where = b.cells(row, shards)
            twice = np.bincount(where, minlength=len(key)) > 1 if len(key) else np.array([], bool)
            cell = (key & np.uint64((1 << CELL_BITS) - 1)).astype(np.uint32)
            for shard, i, j in runs_of(key >> np.uint64(CELL_BITS)):
                step = np.diff(cell[i:j], prepend=np.uint32(0)).astype(np.uint32)
                rows.append((block, row, shard, squeeze(step, twice[i:j].astype(np.uint8))))
        return _table(rows)

    def merge(part: pa.Table) -> pa.Table:
        got = [expand(x, np.uint32, np.uint8) for x in part["body"].to_pylist()]
        total = np.zeros(1 << CELL_BITS, np.uint8)
        for step, twice in got:
            cell = np.cumsum(step, dtype=np.int64)
            total[cell] = np.minimum(total[cell] + 1 + twice, 2)
        return _table([(b, r, s, pack(total[np.cumsum(step, dtype=np.int64)] > 1)) for b, r, s, (step, _) in
                       zip(part["block"].to_pylist(), part["row"].to_pylist(), part["shard"].to_pylist(), got, strict=True)])

    def choose(part: pa.Table, told: pa.Table) -> pa.Table:
        if not len(part):
            return _table([])
        block, b = part["block"][0].as_py(), Block(part, window)
        shard, h1, h2, first, _ = b.keys(b.candidates(_told(told), shards), shards)
        ids = np.array([LAST if i is None else i for i in b.ids], np.int64)[b.doc[b.start[first]]] if len(first) else np.array([], np.int64)
        rows = []
        for s, i, j in runs_of(shard):
            names, which = np.unique(ids[i:j], return_inverse=True)
            body = squeeze(np.diff(h1[i:j], prepend=np.uint64(0)), h2[i:j], which.astype(np.uint32))
            rows.append((block, DEPTH, s, len(names).to_bytes(8, "little") + names.tobytes() + body))
        return _table(rows)

    def group(part: pa.Table) -> pa.Table:
        h1, h2, doc, block, sizes = [], [], [], [], []
        for b, x in zip(part["block"].to_pylist(), part["body"].to_pylist(), strict=True):
            n = int.from_bytes(x[:8], "little")
            step, low, which = expand(x[8 + 8 * n:], np.uint64, np.uint32, np.uint32)
            h1.append(np.cumsum(step, dtype=np.uint64))
            h2.append(low)
            doc.append(np.frombuffer(x[8:8 + 8 * n], np.int64)[which])
            block.append(np.full(len(step), b, np.int32))
            sizes.append(len(step))
        h1, h2, doc, block = map(np.concatenate, (h1, h2, doc, block))
        order = np.lexsort((block, doc, h2, h1))
        later = np.zeros(len(order), bool)
        later[order[1:]] = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
        return _table([(b, DEPTH, s, pack(x)) for b, s, x in zip(part["block"].to_pylist(), part["shard"].to_pylist(), np.split(later, np.cumsum(sizes)[:-1]), strict=True)])

    arrow = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def finish(part: pa.Table, told: pa.Table) -> pa.Table:
        if not len(part):
            return arrow.empty_table()
        b, told = Block(part, window), _told(told)
        chosen = b.candidates(told, shards)
        shard, _, _, first, group_of = b.keys(chosen, shards)
        later = np.zeros(len(first), bool)
        for s, i, j in runs_of(shard):
            later[i:j] = unpack(told[(DEPTH, s)], j - i)
        gone = chosen[later[group_of] | (chosen != first[group_of])] if len(chosen) else chosen
        depth = np.zeros(len(b.doc) + 1, np.int64)
        np.add.at(depth, b.start[gone], 1)
        np.add.at(depth, b.start[gone] + window, -1)
        keep, rows, at = np.cumsum(depth)[:-1] == 0, [], 0
        for i, ws in zip(b.ids, b.words, strict=True):
            k = keep[at:at + len(ws)]
            at += len(ws)
            rows.append((i, len(ws), int(len(ws) - k.sum()), b" ".join(ws if k.all() else [w for w, x in zip(ws, k.tolist(), strict=True) if x]).decode()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

    told = dealt.groupBy("block").applyInArrow(sketch, MESSAGE).groupBy("row", "shard").applyInArrow(merge, MESSAGE)
    keys = dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(choose, MESSAGE)
    exact = keys.groupBy("shard").applyInArrow(group, MESSAGE)
    return dealt.groupBy("block").cogroup(told.unionAll(exact).groupBy("block")).applyInArrow(
        finish, "doc_id long, n_words long, n_removed long, kept string")
