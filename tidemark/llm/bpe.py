"""Byte-level BPE: encoding by higher-order functions over distinct words, decoding by concatenating binary pieces.

A task cuts its documents into words, chunk by chunk, and names every distinct word of a chunk once. One array expression
folds each of these words: it starts from single bytes and joins, step after step, the neighbours of the lowest rank
(leftmost first) until no two neighbours have a rank. The ranks are a literal, an array of small maps found by hash. Ids are
then dealt back to the places of their words. The words that most chunks hold, counted over all documents, are folded once
and handed to every task, HEAD of them at most; the others are folded in each chunk that holds them, by the same expression.
No document is shuffled, only distinct words and counts are, so no busy word or document gathers anywhere.
"""

from __future__ import annotations

import base64
import json
import sys
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import byte_texts, mix, written

CHUNK_BYTES = 16 << 20  # of text in a chunk; a longer document is a chunk of its own
BUCKETS = 1 << 14  # maps of the literal: about three ranks in each
NO_RANK, PLACE = (1 << 31) - 1, (1 << 32) - 1
HEAD = 3 << 18  # words folded once for all tasks: at most about 30 MB
HEAD_BYTES = 32  # longest word among them
PIECE_BYTES = 1 << 19  # of text cut at once
OUT_WORDS = 1 << 17  # words in a batch sent back
# fixed value: the pattern that ``word_starts`` knows; others go through the regular expression engine
GPT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

CHUNK = "doc_ids array<long>, sizes array<long>, at binary, words array<binary>"
_CHUNK = pa.schema([("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("at", pa.binary()), ("words", pa.list_(pa.binary()))])
_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def read_ranks(path: str) -> dict[bytes, int]:
    """Pieces and ranks of a rank file: a piece in base 64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


def mmh(data: bytes) -> int:
    """Spark's 32-bit hash of a binary value, signed."""
    m = 0xFFFFFFFF
    rotl = lambda x, r: ((x << r) | (x >> (32 - r))) & m
    mix_k = lambda k: rotl(k * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
    mix_h = lambda h, k: (rotl(h ^ k, 13) * 5 + 0xE6546B64) & m
    h, whole = 42, len(data) & ~3
    for i in range(0, whole, 4):
        h = mix_h(h, mix_k(int.from_bytes(data[i:i + 4], "little")))
    for b in data[whole:]:
        h = mix_h(h, mix_k((b - 256 if b > 127 else b) & m))
    h ^= len(data)
    h = (h ^ (h >> 16)) * 0x85EBCA6B & m
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & m
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The ranks as one constant: an array of maps from a piece in hex digits to its rank, the place given by the piece's hash."""
    maps: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        maps[mmh(piece) % BUCKETS][piece.hex().upper()] = rank
    return F.transform(F.from_json(F.lit(json.dumps(maps, separators=(",", ":"))), "array<map<string,int>>"), lambda m: F.transform_keys(m, lambda k, _: F.unhex(k)))


def piece_literal(ranks: dict[bytes, int]) -> Column:
    """The piece of every id, as one constant: an array in order of ids, null where there is none."""
    by_id: list[str | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        by_id[rank] = base64.b64encode(piece).decode()
    return F.from_json(F.lit(json.dumps(by_id, separators=(",", ":"))), "array<binary>")


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, the value computed once."""
    return F.transform(F.array(value), use)[0]


def encode_word(word: Column, table: Column) -> Column:
    """Ids of one word (binary): the whole word if it has a rank, else what the ranked joins leave.

    The state is an array of longs, one for each piece: above 32 bits the rank of the piece joined with the next one (NO_RANK:
    none), below them the place where the piece starts. So its minimum is the leftmost of the lowest ranks. Places before the
    first and after the last piece are such that nothing joins there.
    """
    size = F.octet_length(word)
    rank = lambda x: F.element_at(F.get(table, F.pmod(F.hash(x), F.lit(BUCKETS))), x)
    entry = lambda r, start: F.shiftleft(F.coalesce(r, F.lit(NO_RANK)).cast("long"), 32).bitwiseOR(start)
    start_of = lambda x: x.bitwiseAND(F.lit(PLACE)).cast("int")
    none = F.lit(NO_RANK << 32)

    def join(s: Column, _: Column) -> Column:
        def at(low: Column) -> Column:
            def around(k: Column) -> Column:
                before, here, end = start_of(F.get(s, k - 2)), start_of(low), start_of(F.get(s, k + 1))
                wider = rank(F.substring(word, before + 1, end - before))
                longer = rank(F.substring(word, here + 1, start_of(F.get(s, k + 2)) - here))
                return F.concat(F.slice(s, F.lit(1), k - 2), F.array(entry(wider, before), entry(longer, here)), F.slice(s, k + 2, F.lit(1 << 30)))

            return _with(F.array_position(s, low).cast("int"), around)

        return _with(F.array_min(s), lambda low: F.when(low >= none, s).otherwise(at(low)))

    # places: one past every text before the first piece; the end; zero after it
    pairs = F.transform(F.sequence(F.lit(1), size - 1), lambda i: entry(rank(F.substring(word, i, F.lit(2))), i - 1))
    begin = F.concat(F.array(none.bitwiseOR(F.lit(1 << 30))), pairs, F.array(none.bitwiseOR(size - 1), none.bitwiseOR(size), none))
    starts = F.aggregate(F.sequence(F.lit(2), size), begin, join, lambda s: F.transform(F.slice(s, F.lit(2), F.size(s) - 2), start_of))
    ids = _with(starts, lambda p: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda start, i: rank(F.substring(word, start + 1, F.get(p, i + 1) - start))))
    return _with(rank(word), lambda r: F.when(r.isNull(), ids).otherwise(F.array(r)))


def encode_words(words: Column, ranks: dict[bytes, int]) -> Column:
    """Ids of every word of an array of words. The literal is turned into maps once for each row."""
    return _with(rank_literal(ranks), lambda table: F.transform(words, lambda w: encode_word(w, table)))


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of an array of ids: their binary pieces, concatenated. An id without a piece is an error."""
    table = piece_literal(ranks).cast("array<string>")  # a constant; pieces are joined as they are, not read as UTF-8
    piece = lambda i: F.element_at(table, i + 1)
    if len(ranks) <= max(ranks.values()):  # ids between others without a piece
        piece = lambda i: F.coalesce(F.element_at(table, i + 1), F.raise_error(F.lit("an id without a piece")).cast("string"))
    return F.array_join(F.transform(ids, piece), "").cast("binary")


@lru_cache(1)
def _classes() -> np.ndarray:
    """Of every code point: 0 white space, 1 letter, 2 number, 3 anything else."""
    out = np.full(sys.maxunicode + 1, 3, np.uint8)
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(len(out)))
    for number, name in enumerate((r"\s+", r"\p{L}+", r"\p{N}+")):
        for m in regex.finditer(name, every):
            out[m.start():m.end()] = number
    return out


def word_starts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which code points begin a match of GPT_PATTERN; ``first`` holds the places where texts begin."""
    n = len(codes)
    kind = np.concatenate([_classes()[codes], [0, 0, 0]])
    text = np.zeros(n + 1, bool)
    text[first] = text[n] = True
    new = text.copy()
    new[1:n] |= kind[1:n] != kind[:n - 1]
    # of a run of white space before a word the last character stands alone; a blank goes with the word instead
    last = np.flatnonzero((kind[:n] == 0) & (kind[1:n + 1] != 0) & ~text[1:])
    new[last] = True
    new[last[codes[last] == 32] + 1] = False
    # contractions: an apostrophe that begins a match, with the letters it takes
    at = np.flatnonzero((codes == 39) & new[:n])
    padded = np.concatenate([codes, np.zeros(3, codes.dtype)])
    ends = np.concatenate([text, [True, True, True]])
    one = at[np.isin(padded[at + 1], [ord(c) for c in "stmd"]) & ~ends[at + 1]]
    pairs = (padded[at + 1].astype(np.int64) << 21) | padded[at + 2]
    two = at[np.isin(pairs, [(ord(x) << 21) | ord(y) for x, y in ("re", "ve", "ll")]) & ~ends[at + 1] & ~ends[at + 2]]
    new[one + 1] = new[two + 1] = False
    new[np.concatenate([one + 2, two + 3])] = True
    return new[:n]


def cut(texts: list[bytes], pattern: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All matches of ``pattern`` in UTF-8 texts: the joined texts, where words end in them, and the words of each text."""
    if pattern == GPT_PATTERN:
        strings = [t.decode("utf-8", "replace") for t in texts]
        sizes = np.array([len(x) for x in strings], np.int64)
        codes = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)
        ends = np.cumsum(sizes)
        new = word_starts(codes, (ends - sizes)[sizes > 0])
        width = np.cumsum(1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000))
        stops = np.append(np.flatnonzero(new)[1:], len(codes)) if len(codes) else np.array([], np.int64)
        upto = np.concatenate([[0], np.cumsum(new)])
        return np.frombuffer("".join(strings).encode(), np.uint8), width[stops - 1], np.diff(np.concatenate([[0], upto[ends]]))
    words = [regex.findall(pattern, t.decode("utf-8", "replace")) for t in texts]
    flat = [w.encode() for ws in words for w in ws]
    return (np.frombuffer(b"".join(flat), np.uint8), np.cumsum(np.array([len(w) for w in flat], np.int64)), np.array([len(ws) for ws in words], np.int64))


def word_hashes(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word of ``data``, by its bytes and their places in it."""
    if not len(ends):
        return np.array([], np.uint64)
    sizes = np.diff(ends, prepend=0)
    begins = ends - sizes
    place = np.arange(len(data)) - np.repeat(begins, sizes)
    powers = np.cumprod(np.full(int(sizes.max()), 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
    return mix(np.add.reduceat(mix(np.arange(1, 257, dtype=np.uint64))[data] * powers[place], begins) ^ sizes.astype(np.uint64))


class Cutter:
    """Cuts texts into words and numbers them: known words (by hash, rising) first, then the others of the chunk."""

    def __init__(self, pattern: str, known: np.ndarray):
        self.pattern, self.known = pattern, known

    def chunks(self, batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, list[bytes]]]:
        """doc_ids, words of each document, numbers of all words, and the words that are not known."""
        pieces, held = [], 0
        ids, texts, many = [], [], 0
        for part in (batch.slice(at, 64) for batch in batches for at in range(0, batch.num_rows, 64)):
            for doc_id, text in zip(part["doc_id"].to_pylist(), byte_texts(part["text"]), strict=True):
                ids.append(doc_id)
                texts.append(text)
                many += len(text) + 64
                if many >= PIECE_BYTES:
                    pieces.append(self.piece(ids, texts))
                    ids, texts, held, many = [], [], held + many, 0
                if held >= size:
                    yield self.joined(pieces)
                    pieces, held = [], 0
        if ids:
            pieces.append(self.piece(ids, texts))
        if pieces:
            yield self.joined(pieces)

    def piece(self, ids: list, texts: list[bytes]) -> tuple:
        """Ids, words of each text, number of every word (below zero: new to the piece), and the new words with their hashes."""
        data, ends, sizes = cut(texts, self.pattern)
        hashes, place, at = np.unique(word_hashes(data, ends), return_index=True, return_inverse=True)
        number = np.searchsorted(self.known, hashes)
        new = np.flatnonzero(self.known[np.minimum(number, len(self.known) - 1)] != hashes) if len(self.known) else np.arange(len(hashes))
        number[new] = -1 - np.arange(len(new))
        stops = ends[place[new]]
        begins = np.concatenate([[0], ends])[place[new]]
        body = data.tobytes()
        return ids, sizes, number[at].astype(np.int32), hashes[new], [body[a:b] for a, b in zip(begins.tolist(), stops.tolist(), strict=True)]

    def joined(self, pieces: list[tuple]) -> tuple[list, np.ndarray, np.ndarray, list[bytes]]:
        _, place, number = np.unique(np.concatenate([p[3] for p in pieces]), return_index=True, return_inverse=True)
        number = (number + len(self.known)).astype(np.int32)
        words = [w for p in pieces for w in p[4]]
        out, first = [], 0
        for _, _, at, hashes, _ in pieces:
            out.append(np.where(at >= 0, at, number[first - 1 - np.minimum(at, -1)]) if len(hashes) else at)
            first += len(hashes)
        return [i for p in pieces for i in p[0]], np.concatenate([p[1] for p in pieces]), np.concatenate(out).astype(np.int32), [words[i] for i in place.tolist()]


def _common_words(texts: DataFrame, pattern: str, ranks: dict[bytes, int]) -> tuple[np.ndarray, pa.Array]:
    """Hashes and ids of the HEAD words held by most chunks, more than one. Which words these are changes the work, not the ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *_, words in Cutter(pattern, np.array([], np.uint64)).chunks(batches, CHUNK_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array([w for w in words if len(w) <= HEAD_BYTES], pa.binary())], names=["word"])

    counts = texts.mapInArrow(run, "word binary").groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    head = written(counts.orderBy(F.desc("n"), "word").limit(HEAD).select("word"), "bpe-head")
    rows = head.repartition(64, "word").groupBy(F.pmod(F.xxhash64("word"), F.lit(64)).alias("part")).agg(F.array_sort(F.collect_list("word")).alias("words"))
    got = rows.select("words", encode_words(F.col("words"), ranks).alias("ids")).toArrow()
    words = [w for ws in got["words"].to_pylist() for w in ws]
    hashes = word_hashes(np.frombuffer(b"".join(words), np.uint8), np.cumsum(np.array([len(w) for w in words], np.int64)))
    order = np.argsort(hashes)
    ids = got["ids"].combine_chunks().flatten() if len(words) else pa.array([], pa.list_(pa.int32()))
    return hashes[order], ids.take(pa.array(order))


def _ragged(flat: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and all values of a list of lists."""
    return flat.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32), flat.flatten().to_numpy(zero_copy_only=False).astype(np.int32)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id and ``ids`` (array of int) of every row of ``docs``: every match of ``pattern`` encoded by itself.

    ``docs`` needs doc_id, text; other columns are ignored. A null or empty text has no ids. Rows without doc_id and repeated
    rows are all returned. A text of any length is encoded whole. An empty table gives an empty result. ``ranks`` must hold
    all 256 bytes.
    """
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the ranks must hold every single byte")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known, known_ids = _common_words(texts, pattern, ranks)
    known_sizes, known_flat = _ragged(known_ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sizes, at, words in Cutter(pattern, known).chunks(batches, CHUNK_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((ids, sizes, at.tobytes(), words), _CHUNK.types, strict=True)], schema=_CHUNK)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part = {c: batch[c].slice(row, 1).flatten() for c in ("doc_ids", "sizes", "encoded")}
                own_sizes, own_flat = _ragged(part["encoded"])
                sizes, flat = np.concatenate([known_sizes, own_sizes]), np.concatenate([known_flat, own_flat])
                starts = (np.cumsum(sizes) - sizes).astype(np.int32)
                at, ends = np.frombuffer(batch["at"][row].as_buffer(), np.int32), np.cumsum(part["sizes"].to_numpy())
                doc, first = 0, 0
                while doc < len(ends):
                    last = max(doc + 1, int(np.searchsorted(ends, first + OUT_WORDS, "right")))
                    words = at[first:ends[last - 1]]
                    n = sizes[words]
                    upto = np.cumsum(n)
                    ids = flat[np.repeat(starts[words] - upto + n, n) + np.arange(int(n.sum()))]
                    cuts = np.concatenate([[0], np.concatenate([[0], upto])[ends[doc:last] - first]]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([part["doc_ids"].slice(doc, last - doc), pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids, pa.int32()))], schema=_IDS)
                    doc, first = last, int(ends[last - 1])

    chunks = texts.mapInArrow(cut, CHUNK)
    chunks = chunks.select("doc_ids", "sizes", "at", encode_words(F.col("words"), ranks).alias("encoded"))
    return chunks.mapInArrow(deal, "doc_id long, ids array<int>")
