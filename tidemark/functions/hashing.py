"""Hash helpers: buckets from md5, and the deterministic text embedding built on md5 bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import ArrowUDFType, PandasUDFType

EMBED_DIMS = 384  # fixed value
EMBED_STEP = 17  # fixed value
EMBED_MOD = 100  # fixed value
HASH_BYTES = 16


def md5_mod(text: Column, modulus: int) -> Column:
    """The 128-bit md5 value modulo ``modulus``, by Horner's rule on four 32-bit words."""
    digest = F.md5(text)
    shift = (1 << 32) % modulus
    acc = F.lit(0).cast("bigint")
    for i in range(4):
        word = F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint")
        acc = (acc * F.lit(shift) + word) % F.lit(modulus)
    return acc


def byte_residues(text: Column) -> Column:
    """Sixteen numbers 0-99 that determine the hash embedding of a text.

    Dimension i of the embedding is ((byte[i % 16] + 17 i) % 100) / 100. Writing i = 16 j + r, every
    dimension with the same r depends only on (byte[r] + 17 r) % 100, so 16 small numbers stand for
    the 384-dimensional vector.
    """
    digest = F.md5(text)
    return F.array(*[
        ((F.conv(F.substring(digest, 2 * r + 1, 2), 16, 10).cast("int") + EMBED_STEP * r) % EMBED_MOD)
        for r in range(HASH_BYTES)
    ])


def embedding(text: Column) -> Column:
    """The full normalised vector of a text, in Arrow batches (a model would be called at the same place)."""
    dims, step, mod, width = EMBED_DIMS, EMBED_STEP, EMBED_MOD, HASH_BYTES

    def compute(texts):
        from hashlib import md5

        import numpy as np
        import pandas as pd

        if len(texts) == 0:
            return pd.Series([], dtype="object")
        digests = b"".join(md5(t.encode("utf-8")).digest() for t in texts.fillna(""))
        numbers = np.frombuffer(digests, dtype=np.uint8).reshape(-1, width).astype(np.int64)
        dim = np.arange(dims)
        raw = ((numbers[:, dim % width] + step * dim) % mod) / float(mod)
        norm = np.linalg.norm(raw, axis=1, keepdims=True)
        return pd.Series(list(np.divide(raw, norm, out=raw.copy(), where=norm > 0)))

    return F.pandas_udf(compute, T.ArrayType(T.DoubleType()), PandasUDFType.SCALAR)(text)


def _pair(x: Column, y: Column) -> Column:
    """What one residue pair adds to the dot product of two raw embeddings, times 10^4.

    The 24 dimensions of a residue step through the multiples of 4 modulo 100, all but one (28). With
    x = 4 a + p and y = 4 b + q the sum over all 25 steps is 16 C(d) + 1200 (p + q) + 25 p q, where
    d = (a - b) mod 25 and C(d) = sum of m ((m + d) mod 25) = 4900 + 300 d - 12.5 d (49 - d).
    """
    p, q = x % 4, y % 4
    d = (F.floor(x / 4) - F.floor(y / 4) + 25) % 25
    turned = F.lit(4900) + d * 300 - d * (F.lit(49) - d) * 12.5
    return turned * 16 + (p + q) * 1200 + p * q * 25 - ((x + 28) % 100) * ((y + 28) % 100)


def residue_similarity(a: Column, b: Column) -> Column:
    """Cosine of two hash embeddings, from their residues: 16 terms instead of 384."""
    dot = lambda u, v: F.aggregate(
        F.zip_with(u, v, _pair), F.lit(0.0), lambda acc, x: acc + x)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def digest(text: Column) -> Column:
    """The sixteen bytes that determine the hash embedding of a text (null: as empty)."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _cosines(dims: int, step: int, mod: int, width: int):
    """Numpy functions for use inside Arrow batches: residues of digests, and cosines of rows of residues."""
    def build():
        import numpy as np

        at = np.arange(mod)[:, None] + step * width * np.arange(dims // width)[None, :]
        raw = (at % mod) / float(mod)
        table = raw @ raw.T  # what one residue pair adds to the dot product

        def residues(digests):
            numbers = np.frombuffer(b"".join(digests), dtype=np.uint8).reshape(-1, width).astype(np.int64)
            return (numbers + step * np.arange(width)) % mod

        def cosine(u, v):
            return table[u, v].sum(axis=1) / np.sqrt(table[u, u].sum(axis=1) * table[v, v].sum(axis=1))

        return residues, cosine

    return build


def _arrow_cosines(dims: int, step: int, mod: int, width: int):
    """As ``_cosines``, for Arrow arrays of digests without nulls: no Python object is made of a row."""
    def build():
        import numpy as np
        import pyarrow as pa

        at = np.arange(mod)[:, None] + step * width * np.arange(dims // width)[None, :]
        raw = (at % mod) / float(mod)
        table = raw @ raw.T
        own = table.diagonal().copy()
        turned = (np.arange(256)[None, :] + step * np.arange(width)[:, None]) % mod  # by place and byte

        def residues(digests):
            digests = digests.cast(pa.binary())  # with short offsets
            start = np.frombuffer(digests.buffers()[1], dtype=np.int32, count=1, offset=4 * digests.offset)[0] if len(digests) else 0
            numbers = np.frombuffer(digests.buffers()[2] or b"", dtype=np.uint8, count=len(digests) * width, offset=int(start))
            return turned[np.arange(width), numbers.reshape(-1, width)]

        return residues, table, own

    return build


def similarity(a: Column, b: Column) -> Column:
    """Cosine of the hash embeddings of two texts, in Arrow batches.

    Same numbers as ``residue_similarity``. Array functions run interpreted in the JVM, some hundred
    microseconds a row; numpy gathers over a batch take a few. The texts' digests go to the function, not the texts. It keeps
    no state and is shipped by value.
    """
    of = _arrow_cosines(EMBED_DIMS, EMBED_STEP, EMBED_MOD, HASH_BYTES)

    def compute(left, right):
        import numpy as np
        import pyarrow as pa

        residues, table, own = of()
        u, v = residues(left), residues(right)
        return pa.array(table[u, v].sum(axis=1) / np.sqrt(own[u].sum(axis=1) * own[v].sum(axis=1)), pa.float64())

    return F.arrow_udf(compute, T.DoubleType(), ArrowUDFType.SCALAR)(digest(a), digest(b))


def similarities(text: Column, names: list[str]) -> Column:
    """Cosines of the hash embeddings of a text and of some fixed names, one array a row."""
    of = _arrow_cosines(EMBED_DIMS, EMBED_STEP, EMBED_MOD, HASH_BYTES)

    def compute(texts):
        from hashlib import md5

        import numpy as np
        import pyarrow as pa

        residues, table, own = of()
        rows = residues(texts)
        fixed = residues(pa.array([md5(n.encode("utf-8")).digest() for n in names], pa.binary()))
        near = np.zeros((len(rows), len(names)))
        for r in range(rows.shape[1]):
            near += table[:, fixed[:, r]][rows[:, r]]
        near /= np.sqrt(own[rows].sum(axis=1)[:, None] * own[fixed].sum(axis=1)[None, :])
        ends = np.arange(0, near.size + 1, len(names), dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(near.ravel()))

    return F.arrow_udf(compute, T.ArrayType(T.DoubleType()), ArrowUDFType.SCALAR)(digest(text))


def first_unlike(digests: Column, threshold: float) -> Column:
    """Of an array of digests, in order, the places (from 0) of those that no earlier kept one resembles by more than the
    threshold. All arrays of an Arrow batch are settled together, one place after the other."""
    of = _arrow_cosines(EMBED_DIMS, EMBED_STEP, EMBED_MOD, HASH_BYTES)

    def compute(lists):
        import numpy as np
        import pyarrow as pa

        residues, table, own = of()
        size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        start = np.cumsum(size) - size
        rows = residues(lists.flatten())
        length = np.sqrt(own[rows].sum(axis=1))
        keep = np.ones(len(rows), dtype=bool)
        for j in range(1, int(size.max(initial=0))):
            long = start[size > j]
            for i in range(j):
                open_ = long[keep[long + i] & keep[long + j]]
                near = table[rows[open_ + i], rows[open_ + j]].sum(axis=1) / (length[open_ + i] * length[open_ + j])
                keep[open_[near > threshold] + j] = False
        place = (np.arange(len(rows)) - np.repeat(start, size)).astype(np.int32)
        ends = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(size)])].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(place[keep]))

    return F.arrow_udf(compute, T.ArrayType(T.IntegerType()), ArrowUDFType.SCALAR)(digests)


def resembles_any(one: Column, digests: Column, threshold: float) -> Column:
    """Whether a digest's embedding resembles that of any digest of an array by more than the threshold."""
    of = _cosines(EMBED_DIMS, EMBED_STEP, EMBED_MOD, HASH_BYTES)

    def compute(ones, lists):
        import numpy as np
        import pandas as pd

        residues, cosine = of()
        size = np.array([len(x) for x in lists], dtype=np.int64)
        near = cosine(np.repeat(residues(ones), size, axis=0), residues([d for x in lists for d in x])) > threshold
        return pd.Series(np.bincount(np.repeat(np.arange(len(size)), size), weights=near, minlength=len(size)) > 0)

    return F.pandas_udf(compute, T.BooleanType(), PandasUDFType.SCALAR)(one, digests)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two dense vectors; 0 when either has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda acc, x: acc + x)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x))
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot / (na * nb))
