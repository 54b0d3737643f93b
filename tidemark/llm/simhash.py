"""SimHash near-duplicates with pigeonring filtering.

A fingerprint is cut into m segments in a ring. If two fingerprints differ in at most t bits, some segment starts a chain
whose first l segments together differ in at most floor(l * t / m) bits, for every l. With m = t + 1 the first segment of
that chain is equal, so equal segments find the candidates, and the chain prunes them before the full Hamming check.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import byte_texts, mix, written
from tidemark.llm.components import components

GROUP = 64  # fingerprints with an equal segment that are paired directly; larger groups meet at midpoints
SEED = 42
SAMPLE = 8_000  # texts, or a 32nd of all if that is more, that show which tokens are common
COMMON = 100_000  # tokens whose count is known; the others pass for rare
BLOCK = 512  # sets on each side of a block of pairs
BROADCAST_ROWS = 1 << 20  # wanted rows (three longs) that are sent to all texts, about 25 MB
CELL_TOKENS = 1 << 21  # tokens of a component whose pairs are settled in one task, 16 MB
SKETCH = 1 << 12  # most buckets of a set's sketch, a byte each
COLUMNS = 4096  # tokens of a block taken at once


def shingles(text: bytes, n: int) -> list[bytes]:
    """Space-joined runs of n words, lower-cased A-Z; the whole sequence if it is shorter; none without words."""
    words = text.lower().split()
    if len(words) <= n:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words)))
    starts = np.concatenate([[0], ends[:-1]])
    return [joined[a:b] for a, b in zip(starts[: len(words) - n + 1].tolist(), (ends[n - 1:] - 1).tolist(), strict=True)]


def fingerprint(text: bytes, n: int, width: int = 1) -> np.ndarray:
    """``width`` words of 64 bits. A bit is 1 if set in over half of the shingles' hashes; the first word uses XXH64 as it
    is, each further word a mix of it."""
    parts = shingles(text, n)
    if not parts:
        return np.zeros(width, np.int64)
    h = np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), np.uint64, len(parts))
    out = []
    for k in range(width):
        x = h if k == 0 else mix(h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        ones = np.zeros(64, np.int64)
        for at in range(0, len(x), 1 << 15):
            ones += np.unpackbits(x[at:at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(np.packbits(ones * 2 > len(x), bitorder="little").view(np.int64)[0])
    return np.array(out, np.int64)


def fingerprints(docs: DataFrame, n: int, width: int = 1) -> DataFrame:
    """doc_id, text_hash (xxhash64) and ``fp`` (array of ``width`` longs) of every row; a null text has no words, so fingerprint zero."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(t, n, width).tolist() for t in byte_texts(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], pa.array(fp, pa.list_(pa.int64()))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, fp array<long>")


def ring(m: int, bits: int = 64) -> list[tuple[int, int]]:
    """(shift, width) of the m segments."""
    cuts = [bits * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def chain_from(differences: list[Column], start: int, t: int) -> Column:
    """Whether the chain that starts at segment ``start`` keeps every proportional budget."""
    m, total, held = len(differences), F.lit(0), F.lit(True)
    for length in range(1, m):
        total = total + differences[(start + length - 1) % m]
        held = held & (total <= length * t // m)
    return held


def links(prints: DataFrame, t: int) -> DataFrame:
    """a, b: edges between distinct fingerprints (column fp, long) whose components are those of "at most t bits differ".

    Up to GROUP fingerprints with an equal segment are paired, pruned by the chain and checked. A larger group (copies with
    small edits) is not paired: in it two fingerprints are within t bits exactly if some point lies within t / 2 of both, and
    all members of such a point, few by nature, are tied to its smallest one. So t must be even.
    """
    if t % 2:
        raise ValueError("t must be even")
    segments = ring(t + 1)
    part = F.array(*[F.struct(F.lit(i).alias("i"), F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1).cast("long")).alias("seg")) for i, (s, w) in enumerate(segments)])
    cells = prints.select("fp", F.explode(part).alias("c")).select("c.i", "c.seg", "fp")
    counts = cells.groupBy("i", "seg").agg(F.count("*").alias("n")).filter("n > 1")
    cells = cells.join(counts, ["i", "seg"])
    cells = written(cells, "simhash-cells")
    few = cells.filter(F.col("n") <= GROUP).select("i", "seg", "fp")
    pairs = few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), ["i", "seg"]).filter("a < b")
    x = F.col("a").bitwiseXOR(F.col("b"))
    differ = [F.bit_count(x.bitwiseAND(F.lit(_signed(((1 << w) - 1) << s)))) for s, w in segments]
    chained = F.coalesce(*[F.when(F.col("i") == i, chain_from(differ, i, t)) for i in range(t + 1)])
    pairs = pairs.filter(chained).filter(F.bit_count(x) <= t).select("a", "b").distinct()
    many = cells.filter(F.col("n") > GROUP)
    flips = F.coalesce(*[F.when(F.col("i") == i, F.array(*[F.lit(m) for m in _flips(s, w, t // 2)])) for i, (s, w) in enumerate(segments)])
    many = many.repartition(F.col("fp")).withColumn("flip", F.explode(flips)).withColumn("mid", F.col("fp").bitwiseXOR(F.col("flip")))
    low = Window.partitionBy("i", "mid")
    stars = many.select("i", "mid", "fp").withColumn("a", F.min("fp").over(low)).filter("a <> fp").select("a", F.col("fp").alias("b")).distinct()
    return pairs.union(stars)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _flips(shift: int, width: int, radius: int) -> list[int]:
    """Masks of up to ``radius`` bits outside of one segment."""
    free = [b for b in range(64) if not shift <= b < shift + width]
    return [_signed(sum(1 << b for b in bits)) for r in range(radius + 1) for bits in combinations(free, r)]


def near_duplicates(docs: DataFrame, n: int = 3, t: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable, its own included) of every row.

    ``docs`` needs doc_id, text; other columns are ignored. A null or wordless text has fingerprint zero, linked like any
    other. Equal fingerprints fold to one before any pairing; repeated rows are all returned. A row without doc_id takes the
    smallest doc_id of its component, null if there is none. An empty table gives an empty result.
    """
    prints = written(fingerprints(docs, n).select("doc_id", F.col("fp")[0].alias("fp")), "simhash-prints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), t)).withColumnRenamed("node", "fp")
    named = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by = named.join(ids, "root").select("fp", "component_id")
    return prints.join(by, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def tokens(text: bytes, n: int) -> np.ndarray:
    """Hashes of the distinct n-word shingles, in ascending order."""
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in shingles(text, n)), np.uint64))


def _set_id(x: np.ndarray) -> int:
    return _signed(xxhash.xxh64_intdigest(x.tobytes(), SEED))


def _linked(prints: DataFrame, t: int) -> DataFrame:
    """a < b: the sets (id) to settle so that those of equal or linked fingerprints (fp) meet. Rows (fp, id) are distinct; the
    smallest set of a fingerprint stands for it."""
    first = written(prints.groupBy("fp").agg(F.min("id").alias("first")), "near-fingerprints")
    own = prints.join(first, "fp").select(F.col("first").alias("x"), F.col("id").alias("y"))
    met = links(first.select("fp"), t).join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b").select("x", "y")
    return own.union(met).filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _common(texts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that many texts hold, in ascending order, and how many; from a sample, as they only order the tokens."""
    share = max(1, min(texts.count() // SAMPLE, 32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [np.array([], np.uint64), *[tokens(t, n) for t in set(byte_texts(batch["text"]))]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got).view(np.int64))], names=["token"])

    got = texts.filter(F.pmod("text_hash", F.lit(share)) == 0).select("text").mapInArrow(run, "token long").groupBy("token").agg(F.count("*").alias("c")).filter("c > 1")
    got = got.orderBy(F.desc("c"), "token").limit(COMMON).toArrow()
    token, c = got["token"].to_numpy().view(np.uint64), got["c"].to_numpy()
    order = np.argsort(token)
    return token[order], c[order]


def _prefix(x: np.ndarray, common: tuple[np.ndarray, np.ndarray], num: int, den: int) -> np.ndarray:
    """The rarest tokens, as many as one of them must be shared by any set that is num / den alike or more."""
    token, c = common
    seen = np.zeros(len(x), np.int64)
    if len(token):
        at = np.minimum(np.searchsorted(token, x), len(token) - 1)
        seen = np.where(token[at] == x, c[at], 0)
    return x[np.lexsort((x, seen))[:len(x) + num * len(x) // -den + 1]] if len(x) else x


def alike_in_block(sids: np.ndarray, comps: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Edges whose components are those of all pairs of different ``comps`` that are num / den alike or more, by one
    product of the matrix of sets and shared tokens."""
    sizes = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, token, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = many[token] > 1
    owner, token = owner[keep], (np.cumsum(many > 1) - 1)[token[keep]]
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    both = np.zeros((len(sets), len(sets)), np.int64)
    for at in range(0, int(token[-1]) + 1 if len(token) else 0, COLUMNS):
        a, b = np.searchsorted(token, [at, at + COLUMNS])
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[owner[a:b], token[a:b] - at] = 1
        both += (m @ m.T).astype(np.int64)
    tied = (both * den >= (sizes[:, None] + sizes[None, :] - both) * num) & (comps[:, None] != comps[None, :])
    np.fill_diagonal(tied, True)
    label = np.arange(len(sets))
    while True:
        low = np.where(tied, label[None, :], len(sets)).min(1)
        if (low == label).all():
            break
        label = low
    return [(int(sids[i]), int(sids[j])) for i, j in enumerate(label.tolist()) if i != j]


def _sets(texts: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """id, x: the ascending tokens of the wanted sets, each from one row (d, h) that holds it. The list of rows goes to the
    texts if it is short, by its count; else the texts are shuffled to it."""
    schema = pa.schema([("id", pa.int64()), ("x", pa.list_(pa.int64()))])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()  # repeated rows
        for batch in batches:
            got = {}
            for i, t in zip(batch["id"].to_pylist(), byte_texts(batch["text"]), strict=True):
                if i not in done:
                    done.add(i)
                    got[i] = tokens(t, n).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int64()), pa.array(list(got.values()), pa.list_(pa.int64()))], schema=schema)

    wanted = written(wanted, "near-wanted")
    short = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    rows = texts.join(short, texts["doc_id"].eqNullSafe(wanted["d"]) & (texts["text_hash"] == wanted["h"]))
    return rows.select("id", "text").mapInArrow(build, "id long, x array<long>")


def sketch(x: np.ndarray) -> bytes:
    """How many tokens fall into each bucket of their leading bits, a byte a bucket and a bucket for one or two tokens; longer
    sets fill SKETCH buckets more. Empty if a byte does not hold a count."""
    bits = max(4, min(len(x), SKETCH).bit_length() - 1)
    counts = np.bincount((x >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def may_be_alike(p: bytes, q: bytes, num: int, den: int) -> bool:
    """Whether two sets of these sketches can be num / den alike: they share at most the lesser count of every bucket."""
    if not p or not q:
        return True
    x, y = (np.frombuffer(v, np.uint8).astype(np.int64) for v in sorted((p, q), key=len))
    both = np.minimum(x, y.reshape(len(x), -1).sum(1)).sum()
    return bool(both * (num + den) >= (x.sum() + y.sum()) * num)


def _hopeful(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that their sketches (id, sketch) do not rule out. No pair that is num / den alike is lost."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [may_be_alike(p, q, num, den) for p, q in zip(batch["p"].to_pylist(), batch["q"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["a"].filter(pa.array(held, pa.bool_())), batch["b"].filter(pa.array(held, pa.bool_()))], schema=schema)

    both = pairs.join(sketches.toDF("a", "p"), "a").join(sketches.toDF("b", "q"), "b")
    return both.select("a", "b", "p", "q").mapInArrow(run, "a long, b long")


def _deal(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """r, i, a, b: the one cell in which each pair is settled.

    Pairs of one component of the pair graph meet in one cell, and small components share cells. Those of a component of more
    than CELL_TOKENS tokens are dealt by the end that has fewer partners, so a set goes to at most as many cells as it has
    partners, and only the few sets in the middle of a star go to many.
    """
    roots = components(pairs)
    known = roots.join(sizes, "node")
    weight = written(known.groupBy("root").agg(F.sum("size").alias("size")).withColumn("parts", F.greatest(F.ceil(F.col("size") / CELL_TOKENS), F.lit(1))), "near-weights")
    shared = max(1, -(-(weight.filter("parts = 1").agg(F.sum("size")).first()[0] or 0) // CELL_TOKENS))
    home = weight.select("root", "parts", F.when(F.col("parts") > 1, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(shared))).alias("r"))
    dealt = written(pairs.join(roots.join(home, "root").select(F.col("node").alias("a"), "r", "parts"), "a"), "near-dealt")
    large = dealt.filter("parts > 1")
    ends = large.select("a").union(large.select("b")).toDF("node").groupBy("node").agg(F.count("*").alias("n"))
    large = large.join(ends.toDF("a", "n_a"), "a").join(ends.toDF("b", "n_b"), "b")
    owner = F.when(F.col("n_a") < F.col("n_b"), F.col("a")).otherwise(F.col("b"))
    large = large.select("r", F.pmod(F.xxhash64(owner), F.col("parts")).alias("i"), "a", "b")
    return dealt.filter("parts = 1").select("r", F.lit(-1).cast("long").alias("i"), "a", "b").union(large)


def _alike(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of the pairs a < b, those whose sets (id, x) are num / den alike or more. Each pair is settled once, where ``_deal`` puts it."""
    dealt = written(_deal(pairs, sets.select(F.col("id").alias("node"), F.size("x").cast("long").alias("size"))), "near-cells-of-pairs")
    where = dealt.select(F.col("r").alias("cell"), F.col("i").alias("part"), F.explode(F.array("a", "b")).alias("id")).distinct()
    bodies = sets.join(where, "id").select("cell", "part", "id", "x")

    def settle(bodies: pa.Table, pairs: pa.Table) -> pa.Table:
        flat = bodies["x"].combine_chunks()
        parts = np.split(flat.flatten().to_numpy(), np.cumsum(flat.value_lengths().to_numpy())[:-1]) if len(flat) else []
        held = {i: x.view(np.uint64) for i, x in zip(bodies["id"].to_pylist(), parts, strict=True)}
        found = []
        for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist(), strict=True):
            both = len(np.intersect1d(held[a], held[b], assume_unique=True))
            if both * den >= (len(held[a]) + len(held[b]) - both) * num:
                found.append((a, b))
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else ([], []))], names=["a", "b"])

    return bodies.groupBy("cell", "part").cogroup(dealt.groupBy("r", "i")).applyInArrow(settle, "a long, b long")


def near_copies(docs: DataFrame, n: int = 5, similarity: float = 0.8, words: int = 3, t: int = 2) -> DataFrame:
    """doc_id, text_hash, component_id: texts whose sets of n-word shingles have a Jaccard similarity of ``similarity`` or more.

    Every pair is settled by its exact similarity (shingles as 64-bit hashes). Equal sets fold to one. Texts whose
    fingerprints (of ``words``-word shingles) link at ``t`` bits by ``links`` are settled first; the rest of the step only
    looks for pairs that these links leave apart. Two sets that are alike enough share one of the rarest tokens of each
    (prefix filter), so sets meet by these. Under a token of up to GROUP
    sets all pairs are compared, but for those that share too few of the tokens. Under a token of more, a set is first
    compared with the smallest and the two before it; where that leaves different components, all their pairs are compared
    by blocks. So a large family of copies costs no pairs, and no pair is left out. Rows as in ``near_duplicates``; texts without words are one component.
    """
    num, den = Fraction(str(similarity)).as_integer_ratio()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("id", pa.int64()), ("fp", pa.int64()), ("sketch", pa.binary())])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, prints, sketches = [], [], []
            for text in byte_texts(batch["text"]):
                x = tokens(text, n)
                ids.append(_set_id(x))
                prints.append(int(fingerprint(text, words)[0]))
                sketches.append(sketch(x))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], *(pa.array(c, f.type) for c, f in zip((ids, prints, sketches), list(schema)[2:], strict=True))], schema=schema)

    prints = written(texts.mapInArrow(name, "doc_id long, text_hash long, id long, fp long, sketch binary"), "near-prints")
    distinct = written(prints.groupBy("id").agg(F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "text_hash")).alias("row")), "near-distinct")

    def settle(tried: DataFrame) -> DataFrame:
        ids = tried.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        sketches = prints.select("id", "sketch").join(ids, "id", "left_semi").dropDuplicates(["id"])
        tried = written(_hopeful(tried, sketches, num, den), "near-hopeful")
        return written(_alike(tried, sets_of(tried.select(F.explode(F.array("a", "b")).alias("id")).distinct()), num, den), "near-edges")

    def sets_of(ids: DataFrame) -> DataFrame:
        return written(_sets(texts, ids.join(distinct, "id").select("id", F.col("row.doc_id").alias("d"), F.col("row.text_hash").alias("h")), n), "near-sets")

    linked = settle(written(_linked(prints.select("fp", "id").distinct(), t), "near-linked"))
    classes = components(linked)
    common = _common(texts, n)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()
        for batch in batches:
            got, ids, sizes = [np.array([], np.uint64)], [], []
            for t in byte_texts(batch["text"]):
                x = tokens(t, n)
                if (i := _set_id(x)) not in done:
                    done.add(i)
                    got.append(_prefix(x, common, num, den))
                    ids.append(i)
                    sizes.append(len(x))
            many = [len(p) for p in got[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got).view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), many)),
                                              pa.array(np.repeat(np.array(sizes, np.int32), many)), pa.array(np.concatenate([np.array([], np.int32), *[np.arange(k, dtype=np.int32) for k in many]]))],
                                             names=["token", "id", "size", "at"])

    cells = texts.select("text").mapInArrow(meet, "token long, id long, size int, at int").repartition(F.col("token")).dropDuplicates(["token", "id"])
    by = Window.partitionBy("token")
    line = by.orderBy("size", "id")
    cells = cells.withColumn("n", F.count("*").over(by)).withColumn(
        "others", F.array(*[F.struct(x("id"), x("size")) for x in (lambda c: F.first(c).over(line).alias(c), lambda c: F.lag(c, 1).over(line).alias(c), lambda c: F.lag(c, 2).over(line).alias(c))]))
    cells = written(cells.filter("n > 1"), "near-cells")

    close = lambda p, q: F.least(p, q).cast("long") * den >= F.greatest(p, q).cast("long") * num
    big = cells.filter(F.col("n") > GROUP)
    stars = big.select("id", "size", F.explode("others").alias("o")).filter("o.id <> id").filter(close(F.col("size"), F.col("o.size")))
    stars = stars.select(F.least("id", "o.id").alias("a"), F.greatest("id", "o.id").alias("b")).distinct()
    # tokens shared up to the last known place, in big groups at most all of them, and all that follow
    few = cells.filter(F.col("n") <= GROUP).select("token", "id", "size", "at")
    few = few.join(big.groupBy("id").agg(F.count("*").alias("hot")), "id", "left").withColumn("hot", F.coalesce("hot", F.lit(0)))
    side = lambda x: few.select("token", *[F.col(c).alias(c + x) for c in ("id", "size", "at", "hot")])
    pairs = side("1").join(side("2"), "token").filter("id1 < id2").filter(close(F.col("size1"), F.col("size2")))
    pairs = pairs.groupBy(F.col("id1").alias("a"), F.col("id2").alias("b"), "size1", "size2", "hot1", "hot2").agg(
        F.count("*").alias("c"), F.max("at1").alias("at1"), F.max("at2").alias("at2"))
    most = F.col("c") + F.least("hot1", "hot2") + F.least(F.col("size1") - F.col("at1") - 1, F.col("size2") - F.col("at2") - 1)
    pairs = pairs.filter(most * (num + den) >= (F.col("size1") + F.col("size2")).cast("long") * num).select("a", "b")
    tried = stars.union(pairs).distinct()
    for end in "a", "b":
        tried = tried.join(classes.toDF(end, f"class_{end}"), end, "left").withColumn(f"class_{end}", F.coalesce(f"class_{end}", end))
    edges = linked.union(settle(written(tried.filter("class_a <> class_b").select("a", "b"), "near-tried")))
    roots = components(edges).withColumnRenamed("node", "id").withColumnRenamed("root", "comp")
    open_ = big.select("token", "id", "n").join(roots, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    mixed = open_.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1").select("token")
    open_ = written(open_.join(mixed, "token"), "near-open")

    def block(part: pa.Table) -> pa.Table:
        flat = part["x"].combine_chunks()
        sets_ = np.split(flat.flatten().to_numpy(), np.cumsum(flat.value_lengths().to_numpy())[:-1])
        found = alike_in_block(part["id"].to_numpy(), part["comp"].to_numpy(), sets_, num, den)
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else ([], []))], names=["a", "b"])

    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    many = open_.withColumn("i", F.pmod(F.xxhash64("id"), parts).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), parts - 1)))
    many = many.select("token", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "id", "comp").join(sets_of(open_.select("id").distinct()), "id")
    edges = edges.union(many.groupBy("token", "i", "j").applyInArrow(block, "a long, b long"))
    roots = components(edges).withColumnRenamed("node", "id")
    named = distinct.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_set = named.join(ids, "root").select("id", "component_id")
    return prints.join(by_set, "id").select("doc_id", "text_hash", "component_id")
