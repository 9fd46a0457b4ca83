"""Vector columns: hygiene, cosine, hashed lexical embedding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

FNV_OFFSET = 2166136261
FNV_PRIME = 16777619
MASK_32 = 0xFFFFFFFF


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))


def all_finite(vector: Column) -> Column:
    infinite = float("inf")
    return F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (x < F.lit(infinite)) & (x > F.lit(-infinite)),
    )


def unit(vector: Column) -> Column:
    """L2-normalised copy; a zero vector stays zero."""
    length = norm(vector)
    return F.when(length == 0, vector).otherwise(F.transform(vector, lambda x: x / length))


def cosine(left: Column, right: Column) -> Column:
    """Cosine clamped to [-1, 1]; 0 for a dimension mismatch or a zero vector."""
    scale = norm(left) * norm(right)
    raw = dot(left, right) / scale
    value = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw))
    return F.when((F.size(left) != F.size(right)) | (scale == 0), F.lit(0.0)).otherwise(value)


def fnv32(text: Column) -> Column:
    """32-bit FNV-1a over the characters of a short string."""
    return F.aggregate(
        F.split(text, ""),
        F.lit(FNV_OFFSET).cast("bigint"),
        lambda h, c: F.when(c == "", h).otherwise(
            (h.bitwiseXOR(F.ascii(c).cast("bigint")) * FNV_PRIME).bitwiseAND(F.lit(MASK_32))
        ),
    )


HASHED_TOKENS = 250_000  # tokens whose features are laid out at a time


def hashed_sums(tokens, han, dimensions: int):
    """Sums of signed hashed features of every row, as an int array (rows, ``dimensions``).

    ``tokens``, ``han``: Arrow lists of a row's tokens and of those among them with Han script. A token gives
    itself and its 3-grams (Han: pairs); each distinct token of the batch is hashed once, like ``fnv32``."""
    import numpy as np

    words = tokens.flatten().dictionary_encode()
    distinct, codes = words.dictionary.to_pylist(), words.indices.to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(tokens)), tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    sums = np.zeros(len(tokens) * dimensions, dtype="int32")
    if not distinct:
        return sums.reshape(-1, dimensions)
    paired = set(han.flatten().to_pylist())
    points = np.frombuffer("".join(distinct).encode("utf-32-le"), dtype="<u4").astype("uint64")
    size = np.array([len(w) for w in distinct])
    begin = np.cumsum(size) - size
    gram = np.array([2 if w in paired else 3 for w in distinct])
    prime, mask = np.uint64(FNV_PRIME), np.uint64(MASK_32)

    def hashes(at, length):
        """Hashes of the runs of ``length`` (falling) characters that begin ``at`` places of ``points``."""
        h = np.full(len(at), FNV_OFFSET, dtype="uint64")
        for i in range(int(length[0]) if len(at) else 0):
            n = int(np.searchsorted(-length, -i))
            h[:n] = ((h[:n] ^ points[at[:n] + i]) * prime) & mask
        return h

    longest = np.argsort(-size, kind="stable")
    whole = np.empty(len(distinct), dtype="uint64")
    whole[longest] = hashes(begin[longest], size[longest])
    grams = np.maximum(size - gram + 1, 0)
    word = np.repeat(np.arange(len(distinct)), grams)
    at = begin[word] + np.arange(len(word)) - (np.cumsum(grams) - grams)[word]
    order = np.argsort(-gram[word], kind="stable")
    parts = np.empty(len(word), dtype="uint64")
    parts[order] = hashes(at[order], gram[word][order])
    # features of a token stand together: the token, then its grams
    first = np.cumsum(grams + 1) - (grams + 1)
    features = np.empty(len(word) + len(distinct), dtype="uint64")
    features[first] = whole
    features[np.arange(len(word)) + word + 1] = parts
    bucket, sign = (features % np.uint64(dimensions)).astype("int64"), np.where(features % np.uint64(2) == 0, 1.0, -1.0)
    for low in range(0, len(codes), HASHED_TOKENS):
        code, of = codes[low : low + HASHED_TOKENS], row[low : low + HASHED_TOKENS]
        many = grams[code] + 1
        place = np.repeat(first[code] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        span = slice(int(of[0]) * dimensions, (int(of[-1]) + 1) * dimensions)
        cells = (np.repeat(of, many) - of[0]) * dimensions + bucket[place]
        sums[span] += np.bincount(cells, weights=sign[place], minlength=span.stop - span.start).astype("int32")
    return sums.reshape(-1, dimensions)


def fnv64(text: Column) -> Column:
    """64-bit FNV-1a as a signed bigint, kept as two 32-bit halves so nothing overflows."""
    high, low = 0xCBF29CE4, 0x84222325
    start = F.struct(F.lit(high).cast("bigint").alias("hi"), F.lit(low).cast("bigint").alias("lo"))

    def step(h: Column, c: Column) -> Column:
        mixed = h["lo"].bitwiseXOR(F.ascii(c).cast("bigint"))
        scaled = mixed * 435
        carried = h["hi"] * 435 + F.shiftright(scaled, 32) + F.shiftleft(mixed, 8)
        moved = F.struct(
            carried.bitwiseAND(F.lit(MASK_32)).alias("hi"), scaled.bitwiseAND(F.lit(MASK_32)).alias("lo")
        )
        return F.when(c == "", h).otherwise(moved)

    halves = F.aggregate(F.split(text, ""), start, step)
    return F.shiftleft(halves["hi"], 32).bitwiseOR(halves["lo"])


def weighted_sum(vectors: Column, weights: Column, size: int) -> Column:
    """Element-wise weighted sum of an array of equal-length vectors."""
    scaled = F.zip_with(vectors, weights, lambda v, w: F.transform(v, lambda x: x * w))
    zero = F.array_repeat(F.lit(0.0), size)
    return F.aggregate(scaled, zero, lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
