"""Vector functions: expressions over array columns, and the same over numpy matrices for Arrow batches.

Arithmetic is in double. A zero norm has no cosine (null). Bit codes are arrays of bigint words.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2", "ip", "cosine")


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _pairs(a: Column, b: Column, f) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))))


def held(value: Column, f) -> Column:
    """f(value) with the value computed once, held in an array of one, however often f reads it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def l2_sq(a: Column, b: Column) -> Column:
    """Sum of squared differences."""
    return _pairs(a, b, lambda x, y: (x - y) * (x - y))


def inner_product(a: Column, b: Column) -> Column:
    return _pairs(a, b, lambda x, y: x * y)


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine_similarity(a: Column, b: Column) -> Column:
    scale = norm(a) * norm(b)
    return F.when(scale > 0, inner_product(a, b) / scale)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)


def score(metric: str, a: Column, b: Column) -> Column:
    """Lower is nearer: squared L2, negated inner product, cosine distance; an unknown metric is L2."""
    return {"ip": lambda: -inner_product(a, b), "cosine": lambda: cosine_distance(a, b)}.get(metric, lambda: l2_sq(a, b))()


def normalize(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(doubles(a))


def distance_at_dimension(a: Column, b: Column, dim: int, normalized: bool = True) -> Column:
    """Over the first dim elements: cosine distance (1 if a norm is 0), or the root of L2; infinity for dim 0."""
    if dim <= 0:
        return F.lit(float("inf"))
    x, y = F.slice(a, 1, dim), F.slice(b, 1, dim)
    return F.coalesce(cosine_distance(x, y), F.lit(1.0)) if normalized else F.sqrt(l2_sq(x, y))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def popcount(a: Column) -> Column:
    return F.aggregate(F.transform(a, F.bit_count), F.lit(0), lambda s, x: s + x)


def pack_bits(bits: Column, n: int) -> Column:
    """n booleans as ceil(n / 64) words, the first bit lowest."""
    word = lambda b, w: reduce(lambda s, i: s.bitwiseOR(F.when(F.get(b, F.lit(i)), F.shiftleft(F.lit(1).cast("bigint"), i % 64)).otherwise(F.lit(0).cast("bigint"))), range(w * 64, min(n, w * 64 + 64)), F.lit(0).cast("bigint"))
    return held(bits, lambda b: F.array(*[word(b, w) for w in range(-(-n // 64))]))


def unpack_bits(words: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.call_function("shiftrightunsigned", F.get(words, (i / 64).cast("int")), i % 64).bitwiseAND(F.lit(1).cast("bigint")) == 1) if n else F.array().cast("array<boolean>")


def l2_codes(a: Column, b: Column, scale: Column | float = 1.0) -> Column:
    """Distance of 8-bit codes: squared difference times the squared scale."""
    return l2_sq(a, b) * scale * scale


def nibbles(codes: Column) -> Column:
    """The low, then the high half of each byte code."""
    return F.flatten(F.transform(codes, lambda c: F.array(c.cast("int").bitwiseAND(15), F.shiftright(c.cast("int"), 4).bitwiseAND(15))))


def l2_nibbles(a: Column, b: Column, scale: float = 1.0) -> Column:
    """Distance of packed 4-bit codes on the 8-bit scale: a step of four bits is sixteen of eight."""
    return l2_sq(nibbles(a), nibbles(b)) * 256.0 * scale * scale


def lookup_distance(table: Column, codes: Column) -> Column:
    """Sum over subspaces of table[subspace][code]."""
    return _sum(F.zip_with(table, codes, lambda row, c: F.get(row, c.cast("int"))))


def min_max(value: Column, over) -> Column:
    """Scaled to 0..1 over a window; 0.5 throughout if all are equal."""
    lo, hi = F.min(value).over(over), F.max(value).over(over)
    return F.when(hi == lo, F.lit(0.5)).otherwise((value - lo) / (hi - lo))


def softmax(value: Column, over, temperature: float = 1.0) -> Column:
    e = F.exp((value - F.max(value).over(over)) / temperature)
    return e / F.sum(e).over(over)


def max_sim(queries: Column, docs: Column) -> Column:
    """The largest inner product of any query vector with any document vector, at least 0."""
    best = F.array_max(F.flatten(F.transform(queries, lambda q: F.transform(docs, lambda d: inner_product(q, d)))))
    return F.greatest(F.lit(0.0), F.coalesce(best, F.lit(0.0)))


def random_axes(n: int, dim: int, seed: int) -> np.ndarray:
    """n unit gaussian axes."""
    a = np.random.default_rng(seed).standard_normal((n, dim))
    return a / np.linalg.norm(a, axis=1, keepdims=True)


def project(v: Column, axes: np.ndarray) -> Column:
    table = F.array(*[F.array(*[F.lit(float(x)) for x in axis]) for axis in axes])
    return held(v, lambda own: F.transform(table, lambda axis: inner_product(own, axis)))


def hadamard(n: int) -> np.ndarray:
    """The Walsh-Hadamard matrix of a power of two, in natural order, scaled to be orthonormal."""
    h = np.ones((1, 1))
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h / np.sqrt(n)


def walsh(v: Column, n: int = 64) -> Column:
    """The transform by butterflies: log2(n) steps of sums and differences, then the scale."""

    def step(a: Column, h: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when((F.floor(i / h) % 2) == 0, F.get(a, i) + F.get(a, i + h)).otherwise(F.get(a, i - h) - F.get(a, i)))

    out, h = doubles(v), 1
    while h < n:
        out = held(out, (lambda s: lambda a: step(a, s))(h))
        h *= 2
    return F.transform(out, lambda x: x / float(np.sqrt(n)))


def rotate_batch(x: np.ndarray, seed: int, rounds: int = 3) -> np.ndarray:
    """Random signs and a Hadamard transform, padded to a power of two, some rounds of it: an orthonormal rotation."""
    n = 1 << max(0, (x.shape[1] - 1).bit_length())
    out = np.zeros((len(x), n))
    out[:, : x.shape[1]] = x
    rng, h = np.random.default_rng(seed), hadamard(n)
    for _ in range(rounds):
        out = (out * rng.choice([-1.0, 1.0], n)) @ h
    return out


def splitmix64(state: int) -> tuple[int, int]:
    """(next state, output) of the generator."""
    mask = (1 << 64) - 1
    state = (state + 0x9E3779B97F4A7C15) & mask
    z = state
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & mask
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
    return state, z ^ (z >> 31)


def seeded_permutation(seed: int, n: int = 64) -> list[int]:
    """Fisher-Yates from the end, driven by splitmix64."""
    out = list(range(n))
    for i in range(n - 1, 0, -1):
        seed, r = splitmix64(seed)
        j = r % (i + 1)
        out[i], out[j] = out[j], out[i]
    return out


def pairwise(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Scores of all rows of a with all rows of b, lower nearer; nan where a cosine doesn't exist."""
    dot = a @ b.T
    if metric == "ip":
        return -dot
    na, nb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    if metric == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            return 1 - np.where((na[:, None] > 0) & (nb[None] > 0), dot / np.sqrt(na[:, None] * nb[None]), np.nan)
    return np.maximum(na[:, None] + nb[None] - 2 * dot, 0)


_CRC: list[int] = []


def crc32c(data: bytes) -> int:
    """The Castagnoli checksum, reflected, as logs use it (not the polynomial of the SQL function crc32)."""
    if not _CRC:
        for n in range(256):
            for _ in range(8):
                n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
            _CRC.append(n)
    crc = 0xFFFFFFFF
    for b in data:
        crc = crc >> 8 ^ _CRC[(crc ^ b) & 255]
    return crc ^ 0xFFFFFFFF


def fnv1a64(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & ((1 << 64) - 1)
    return h
