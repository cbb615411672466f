import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import vector
from quarry.functions.text import STOP_WORDS, TokenOptions, tokens, valid_json


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def arr(*v):
    return F.array(*[F.lit(float(x)) for x in v])


def test_distances(spark):
    a, b = arr(1, 2, 3, 4), arr(4, 3, 2, 1)
    assert one(spark, vector.l2_sq(a, b)) == 20 and one(spark, vector.inner_product(a, b)) == 20
    c, d = arr(0, 0, 1, -1), arr(0, 0, -1, 1)
    assert one(spark, vector.l2_sq(c, d)) == 8 and one(spark, vector.inner_product(c, d)) == -2
    assert one(spark, vector.cosine_similarity(c, d)) == pytest.approx(-1)
    assert one(spark, vector.cosine_similarity(arr(0, 0), arr(1, 0))) is None
    assert one(spark, vector.distance_at_dimension(arr(0, 0), arr(1, 0), 2)) == 1 and one(spark, vector.distance_at_dimension(a, b, 0)) == float("inf")
    assert one(spark, vector.distance_at_dimension(a, b, 1, False)) == 3
    assert one(spark, vector.normalize(arr(3, 4))) == [0.6, 0.8] and one(spark, vector.normalize(arr(0, 0))) == [0, 0]


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 6), st.integers(1, 6), st.integers(2, 12), st.integers(0, 99))
def test_pairwise_equals_the_definition(n, m, dim, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.standard_normal((n, dim)), rng.standard_normal((m, dim))
    assert np.allclose(vector.pairwise(a, b, "l2"), ((a[:, None] - b[None]) ** 2).sum(axis=2))
    assert np.allclose(vector.pairwise(a, b, "ip"), -a @ b.T)
    assert np.allclose(vector.pairwise(a, b, "cosine"), 1 - (a @ b.T) / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)))
    assert np.allclose(np.diag(vector.pairwise(a, a, "l2")), 0, atol=1e-9)


def test_bits(spark):
    bits = F.array(*[F.lit(i % 3 == 0) for i in range(70)])
    words = vector.pack_bits(bits, 70)
    assert one(spark, F.size(words)) == 2 and one(spark, vector.popcount(words)) == 24
    assert one(spark, vector.unpack_bits(words, 70)) == [i % 3 == 0 for i in range(70)]
    assert one(spark, vector.hamming(words, F.array(F.lit(0).cast("bigint"), F.lit(0).cast("bigint")))) == 24


def test_codes(spark):
    lut = F.array(arr(1, 2, 3), arr(0.5, 1.5, 2.5))
    assert one(spark, vector.lookup_distance(lut, F.array(F.lit(0), F.lit(2)))) == 3.5
    assert one(spark, vector.lookup_distance(lut, F.array(F.lit(1), F.lit(1)))) == 3.5
    a, b = F.array(F.lit(0x21)), F.array(F.lit(0x14))
    assert one(spark, vector.l2_nibbles(a, b, 0.5)) == ((1 - 4) ** 2 + (2 - 1) ** 2) * 256 * 0.25


def test_max_sim(spark):
    q, d = F.array(arr(1, 0), arr(0, 1)), F.array(arr(0.5, 0.2))
    assert one(spark, vector.max_sim(q, d)) == 0.5
    assert one(spark, vector.max_sim(F.array(arr(-1, 0)), d)) == 0


def test_rotations_keep_lengths():
    x = np.random.default_rng(0).standard_normal((5, 50))
    y = vector.rotate_batch(x, 3)
    assert y.shape == (5, 64) and np.allclose((x**2).sum(axis=1), (y**2).sum(axis=1))
    assert np.allclose(vector.hadamard(64) @ vector.hadamard(64).T, np.eye(64))


def test_seeds_and_checksums():
    assert sorted(vector.seeded_permutation(7)) == list(range(64)) != vector.seeded_permutation(7) == vector.seeded_permutation(7)
    assert vector.splitmix64(0)[1] == 0xE220A8397B1DCDAF
    assert vector.crc32c(b"123456789") == 0xE3069283 and vector.fnv1a64(b"") == 0xCBF29CE484222325


def test_tokens(spark):
    assert len(STOP_WORDS) == 45
    t = lambda s, **o: one(spark, tokens(F.lit(s), TokenOptions(**o)))
    assert t("The quick, BROWN fox! a I x") == ["quick", "brown", "fox"]
    assert t("Ärger the " + "x" * 51) == ["Ärger"] and t(None) == [] and t("") == []
    assert t("The cat's", remove_stop_words=False, lowercase=False) == ["The", "cat"]
    assert t("don't stop", remove_punctuation=False) == ["don't", "stop"]
    assert valid_json('{"a": 1}') and not valid_json("{a}") and not valid_json('"' + "x" * 70_000 + '"')
