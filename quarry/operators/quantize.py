"""Vector compression: product codes (with rotation), scalar bytes, binary codes, the 64-dimension cascade, prefixes, calibration.

A trained quantizer is a small model of numpy arrays on the driver. Encoding is an Arrow batch over the model; distances
between codes are array expressions or lookups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.errors import EngineError
from quarry.functions import vector
from quarry.operators import kmeans, scan
from quarry.operators.knn import SCALE, knn, matrix, rank


def _rows(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec).alias("vector"))


def _map(df: DataFrame, f, schema: str) -> DataFrame:
    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            if len(pdf):
                yield f(pdf)

    return df.mapInPandas(run, schema)


# product quantization


@dataclass
class ProductQuantizer:
    """codebooks: subspaces x codes x width; rotation, if any, is applied before the split."""

    codebooks: np.ndarray
    rotation: np.ndarray | None = None

    def split(self, x: np.ndarray) -> np.ndarray:
        x = x if self.rotation is None else x @ self.rotation
        m, _, width = self.codebooks.shape
        return x.reshape(len(x), m, width)

    def codes(self, x: np.ndarray) -> np.ndarray:
        parts = self.split(x)
        return np.stack([kmeans.nearest(parts[:, s], self.codebooks[s])[0] for s in range(len(self.codebooks))], axis=1).astype(np.int16)

    def reconstruct(self, codes: np.ndarray) -> np.ndarray:
        out = np.concatenate([self.codebooks[s][codes[:, s]] for s in range(len(self.codebooks))], axis=1)
        return out if self.rotation is None else out @ self.rotation.T

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Queries x subspaces x codes: squared distances to the codes."""
        parts = self.split(q)
        return np.stack([vector.pairwise(parts[:, s], self.codebooks[s], "l2") for s in range(len(self.codebooks))], axis=1)

    def encode(self, df: DataFrame, id_col: str = "id", vec: str = "vector", keep: bool = False) -> DataFrame:
        """(id, codes), and the vector if it is to be kept."""
        if keep:
            kind = dict(df.dtypes)[vec]
            return _map(_rows(df, id_col, vec), lambda p: p.assign(codes=list(self.codes(matrix(p["vector"]))))[["id", "codes", "vector"]], f"id bigint, codes array<smallint>, vector {kind}")
        return _map(_rows(df, id_col, vec), lambda p: pd.DataFrame({"id": p["id"], "codes": list(self.codes(matrix(p["vector"])))}), "id bigint, codes array<smallint>")

    def decode(self, codes: DataFrame) -> DataFrame:
        """(id, vector)."""
        return _map(codes.select("id", "codes"), lambda p: pd.DataFrame({"id": p["id"], "vector": list(self.reconstruct(np.stack(p["codes"].to_numpy())))}), "id bigint, vector array<double>")

    def error(self, df: DataFrame, id_col: str = "id", vec: str = "vector") -> DataFrame:
        """One row: mean squared distance of rows to what their codes give back."""
        own = _map(_rows(df, id_col, vec), lambda p: pd.DataFrame({"e": ((matrix(p["vector"]) - self.reconstruct(self.codes(matrix(p["vector"])))) ** 2).sum(axis=1)}), "e double")
        return own.agg(F.round(F.avg("e"), SCALE).alias("mse"))

    def search(self, queries: DataFrame, codes: DataFrame, k: int = 10) -> DataFrame:
        """(qid, id, score, rank) by asymmetric distance: of queries (qid, vector) as they are to what codes stand for."""
        return rank(scan.top(queries.select(F.col("qid").cast("bigint").alias("qid"), "vector"), codes.select("id", "codes"), scan.Vectors("l2"), k, view=self._seen), k)

    def _seen(self, block: dict, asks: bool) -> dict:
        """What the scan compares: a code's distance to a query is that of the vector it stands for."""
        return {"key": block["vector"] if asks else self.reconstruct(block["codes"])}

    def search_reranked(self, queries: DataFrame, rows: DataFrame, pool: int, k: int) -> DataFrame:
        """(qid, id, score, rank): of the pool nearest by codes the k truly nearest; rows: (id, codes, vector)."""
        view = lambda block, asks: self._seen(block, asks) | {"raw": block["vector"]}
        asked = queries.select(F.col("qid").cast("bigint").alias("qid"), "vector")
        return rank(scan.top(asked, rows.select("id", "codes", "vector"), scan.Vectors("l2"), pool, view=view, stages=((scan.Vectors("l2"), scan.same, "raw", k),)), k)

    def symmetric(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((self.reconstruct(a) - self.reconstruct(b)) ** 2).sum(axis=1)


def sample_matrix(df: DataFrame, rows: int, vec: str = "vector", id_col: str = "id", seed: int = 42) -> np.ndarray:
    """At most rows vectors, those with the lowest seeded hash of their id: the bound of what training brings to the driver."""
    own = df.select(F.col(id_col).alias("id"), F.col(vec).alias("vector")).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(rows)
    return matrix(own.toPandas()["vector"])


def _fit_codes(x: np.ndarray, k: int, seed: int, iterations: int = 25) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    if len(c) < k:
        c = np.vstack([c, np.repeat(c[:1], k - len(c), axis=0)])
    for _ in range(iterations):
        at, _ = kmeans.nearest(x, c)
        n = np.bincount(at, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def train_pq(df: DataFrame, m: int = 8, bits: int = 8, seed: int = 42, sample: int = 65_536, vec: str = "vector", id_col: str = "id", rotation: np.ndarray | None = None) -> ProductQuantizer:
    x = sample_matrix(df, sample, vec, id_col, seed)
    if not len(x) or x.shape[1] % m or len(x) < 1 << bits:
        raise EngineError("invalid_argument", "the dimension must divide by m and there must be a row for each code", "pq")
    return pq_from(x if rotation is None else x @ rotation, m, bits, seed, rotation)


def pq_from(x: np.ndarray, m: int, bits: int, seed: int, rotation: np.ndarray | None = None) -> ProductQuantizer:
    parts = x.reshape(len(x), m, -1)
    return ProductQuantizer(np.stack([_fit_codes(parts[:, s], 1 << bits, seed + s) for s in range(m)]), rotation)


def train_opq(df: DataFrame, m: int = 8, bits: int = 8, iterations: int = 10, seed: int = 42, sample: int = 65_536, pca: bool = True, vec: str = "vector", id_col: str = "id") -> ProductQuantizer:
    """Product codes with a rotation: codes and an orthogonal Procrustes step in turn, from principal axes or the identity."""
    x = sample_matrix(df, sample, vec, id_col, seed)
    r = np.linalg.eigh(np.cov(x.T))[1][:, ::-1] if pca else np.eye(x.shape[1])
    if pca:  # axes dealt out so that subspaces have like variance
        r = r[:, np.argsort(np.arange(x.shape[1]) % m, kind="stable")]
    q = pq_from(x @ r, m, bits, seed, r)
    best = q, ((x - q.reconstruct(q.codes(x))) ** 2).sum()
    for _ in range(iterations):
        y = ProductQuantizer(q.codebooks).reconstruct(q.codes(x))
        u, _, vt = np.linalg.svd(x.T @ y)
        q = pq_from(x @ (u @ vt), m, bits, seed, u @ vt)
        cost = ((x - q.reconstruct(q.codes(x))) ** 2).sum()
        if cost < best[1]:
            best = q, cost
    return best[0]


def pq_recall(q: ProductQuantizer, df: DataFrame, k: int = 10, id_col: str = "id", vec: str = "vector") -> DataFrame:
    """One row, recall: all rows as queries, code search against exact search."""
    from quarry.operators.metrics import recall_at_k

    queries = df.select(F.col(id_col).alias("qid"), F.col(vec).alias("vector"))
    return recall_at_k(q.search(queries, q.encode(df, id_col, vec), k), knn(queries, df, k, id_col=id_col, vec=vec), k)


# scalar codes


def dimension_quantiles(df: DataFrame, low: float, high: float, vec: str = "vector") -> DataFrame:
    """(pos, lo, hi): the values at floor(p * (n - 1)) of each dimension's order, and n."""
    long = df.select(F.posexplode(vec).alias("pos", "v")).withColumn("v", F.col("v").cast("double"))
    w = Window.partitionBy("pos")
    placed = long.withColumn("i", F.row_number().over(w.orderBy("v")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    at = lambda p: F.max(F.when(F.col("i") == F.floor(F.lit(p) * (F.col("n") - 1)), F.col("v")))
    return placed.groupBy("pos").agg(at(low).alias("lo"), at(high).alias("hi"))


@dataclass
class ScalarQuantizer:
    """lo and step of each dimension; codes 0..255."""

    lo: np.ndarray
    step: np.ndarray

    def encode(self, v: Column) -> Column:
        """Array of codes, clipped, halves away from zero."""
        lo, step = F.array(*map(F.lit, self.lo.tolist())), F.array(*map(F.lit, self.step.tolist()))
        return F.zip_with(F.zip_with(v, lo, lambda x, a: x.cast("double") - a), step, lambda x, s: F.greatest(F.lit(0), F.least(F.lit(255), F.round(x / s))).cast("int"))

    def decode(self, codes: Column) -> Column:
        lo, step = F.array(*map(F.lit, self.lo.tolist())), F.array(*map(F.lit, self.step.tolist()))
        return F.zip_with(F.zip_with(codes, step, lambda c, s: c * s), lo, lambda x, a: x + a)


def train_scalar(df: DataFrame, low: float = 0.01, high: float = 0.99, margin: float = 0.0, vec: str = "vector") -> ScalarQuantizer:
    q = dimension_quantiles(df, low, high, vec).orderBy("pos").toPandas()
    lo, hi = q["lo"].to_numpy(float), q["hi"].to_numpy(float)
    width = np.maximum(hi - lo, 1e-12)
    return ScalarQuantizer(lo - margin * width, width * (1 + 2 * margin) / 255)


# binary codes


@dataclass
class BinaryQuantizer:
    """A bit for each dimension above its upper median, after an orthonormal rotation if there is one."""

    thresholds: np.ndarray
    rotation: np.ndarray | None = None

    def bits(self, v: Column) -> Column:
        if self.rotation is not None:
            v = vector.project(v, self.rotation.T)
        return F.zip_with(v, F.array(*map(F.lit, self.thresholds.tolist())), lambda x, t: x.cast("double") > t)

    def encode(self, v: Column) -> Column:
        return vector.pack_bits(self.bits(v), len(self.thresholds))

    def reconstruct(self, codes: Column) -> Column:
        """One above or below each threshold."""
        n = len(self.thresholds)
        out = F.zip_with(vector.unpack_bits(codes, n), F.array(*map(F.lit, self.thresholds.tolist())), lambda b, t: t + F.when(b, 1.0).otherwise(-1.0))
        return out if self.rotation is None else vector.project(out, self.rotation)


def train_binary(df: DataFrame, rotate: bool = False, seed: int = 42, vec: str = "vector") -> BinaryQuantizer:
    rotation, own = None, df
    if rotate:
        dim = len(df.select(vec).first()[0])
        rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))[0]
        own = df.withColumn(vec, vector.project(F.col(vec), rotation.T))
    long = own.select(F.posexplode(vec).alias("pos", "v")).withColumn("v", F.col("v").cast("double"))
    w = Window.partitionBy("pos")
    placed = long.withColumn("i", F.row_number().over(w.orderBy("v")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    t = placed.where(F.col("i") == F.floor(F.col("n") / 2)).select("pos", "v").orderBy("pos").toPandas()
    return BinaryQuantizer(t["v"].to_numpy(float), rotation)


def hamming_search(queries: DataFrame, codes: DataFrame, k: int = 10) -> DataFrame:
    """(qid, id, score, rank) of codes (id, code) for queries (qid, code)."""
    return rank(scan.top(queries.select("qid", "code"), codes.select("id", "code"), scan.Bits(), k, key="code"), k)


# rotational bytes


@dataclass
class RotationalQuantizer:
    """Three signed Hadamard rotations, then bytes between each dimension's extremes."""

    seed: int
    lo: np.ndarray
    step: np.ndarray

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.round((vector.rotate_batch(x, self.seed) - self.lo) / self.step), 0, 255).astype(np.int16)

    def distances(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return vector.pairwise(vector.rotate_batch(q, self.seed), codes * self.step + self.lo, "l2")


def train_rotational(x: np.ndarray, seed: int = 42) -> RotationalQuantizer:
    y = vector.rotate_batch(x, seed)
    lo, hi = y.min(axis=0), y.max(axis=0)
    return RotationalQuantizer(seed, lo, np.maximum(hi - lo, 1e-12) / 255)


# the 64-dimension cascade: bits, then four-bit codes, then bytes


@dataclass
class Capq:
    """Whitening (mean, matrix), symmetric byte scale of each dimension, seeds of the bit planes."""

    mean: np.ndarray
    whiten: np.ndarray
    scale: np.ndarray
    seeds: tuple[int, ...] = (1, 2, 3)
    q4: np.ndarray | None = field(default=None)  #: learned centres, dimensions x 16

    def white(self, x: np.ndarray) -> np.ndarray:
        return (_to64(x) - self.mean) @ self.whiten

    def q8(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.round(self.white(x) / self.scale), -127, 127).astype(np.int16)

    @staticmethod
    def coarsen(q8: np.ndarray) -> np.ndarray:
        """Four bits of eight, 0..15."""
        return (q8 >> 4) + 8

    def planes(self, x: np.ndarray) -> np.ndarray:
        """Words of signs: of the vector itself, then of its transform after each seed's signed permutation."""
        w = self.white(x)
        views = [w]
        h = vector.hadamard(64)
        for s in self.seeds:
            p = vector.seeded_permutation(s)
            sign = np.where([vector.splitmix64(s + i)[1] & 1 for i in range(64)], -1.0, 1.0)
            views.append((w[:, p] * sign) @ h)
        return np.stack([np.packbits(v > 0, axis=1, bitorder="little").view(np.uint64)[:, 0] for v in views], axis=1).view(np.int64)

    def residual(self, x: np.ndarray) -> np.ndarray:
        e = ((self.white(x) - self.q8(x) * self.scale) ** 2).sum(axis=1)
        return np.minimum(np.floor(np.log1p(e)), 255).astype(np.int16)

    def encode(self, df: DataFrame, id_col: str = "id", vec: str = "vector") -> DataFrame:
        """(id, planes, q4, q8, residual)."""

        def run(p: pd.DataFrame) -> pd.DataFrame:
            x = matrix(p["vector"])
            q8 = self.q8(x)
            return pd.DataFrame({"id": p["id"], "planes": list(self.planes(x)), "q4": list(self.coarsen(q8)), "q8": list(q8), "residual": self.residual(x)})

        return _map(_rows(df, id_col, vec), run, "id bigint, planes array<bigint>, q4 array<smallint>, q8 array<smallint>, residual smallint")

    def search(self, queries: DataFrame, codes: DataFrame, k: int = 10, keep1: int | None = None, keep2: int | None = None) -> DataFrame:
        """(qid, id, score, rank): the keep1 nearest by bits, of these keep2 by four bits, of these k by bytes, each truly the nearest.

        Pools that aren't given are 8000 and 200, and beyond 80,000 codes a tenth and a four-hundredth of them.
        """
        if keep1 is None or keep2 is None:
            n = codes.count()
            keep1, keep2 = keep1 or max(8000, n // 10), keep2 or max(200, n // 400)
        scale2, columns = np.asarray(self.scale, float) ** 2, ["planes", "q4", "q8"]
        q = self.encode(queries.select(F.col("qid").alias("id"), "vector")).select(F.col("id").alias("qid"), *columns)
        rows = max(64, min(scan.QUERY_ROWS, 1_500_000 // keep2))
        found = scan.cross_twice(q, codes.select("id", *columns), lambda asked: _CapqScan(asked, scale2, keep1, keep2, k), "qid bigint, id bigint, s1 bigint, s2 double, score double", rows)
        one = rank(found, keep1, "s1", name="r1")
        two = rank(one, keep2, "s2", name="r2")
        return rank(two.select("qid", "id", "score"), k)


class _CapqScan:
    """Counts each query's distances by bits on the first pass; on the second the keep1 nearest, in the order of ids, go to the other two levels."""

    def __init__(self, asked: dict, scale2: np.ndarray, keep1: int, keep2: int, k: int):
        n = len(asked["qid"])
        self.asked, self.scale2, self.keep1, self.k, self.bits, self.four = asked, scale2, keep1, k, scan.Bits(), scan.Vectors("l2")
        self.q = self.bits.lift(asked["planes"], True)
        self.most = 64 * asked["planes"].shape[1]
        self.count = np.zeros((n, self.most + 1), np.int64)
        self.limit = self.left = None
        self.near = scan.Nearest(self.four, self.four.lift(asked["q4"], True), keep2, self._more, 2)

    def _more(self, q: dict, r: np.ndarray, x: dict, c: np.ndarray) -> np.ndarray:
        d = self.asked["q8"][r].astype(np.float64) - x["q8"][c]
        return np.stack([np.round((d * d) @ self.scale2, SCALE), self.bits.exact(self.q, r, x["bits"], c)], axis=1)

    def feed(self, block: dict) -> Iterator[dict]:
        x = self.bits.lift(block["planes"], False)
        if not block["pass"]:
            step, width = scan.TILE[0], self.most + 1
            for i in range(0, len(self.count), step):
                own = slice(i, min(i + step, len(self.count)))
                base = (np.arange(own.stop - own.start) * width)[:, None]
                for j in range(0, len(block["id"]), scan.TILE[1]):
                    d = self.bits.tile(self.q, own, x, slice(j, j + scan.TILE[1]))
                    self.count[own] += np.bincount((d + base).ravel(), minlength=base.size * width).reshape(-1, width)
            return iter(())
        if self.limit is None:  # the distance of the last that is kept, and how many at that distance are
            upto = np.cumsum(self.count, axis=1)
            self.limit = np.minimum((upto < self.keep1).sum(axis=1), self.most)
            at = np.arange(len(upto)), self.limit
            self.left = self.keep1 - (upto[at] - self.count[at])
            self.limit = self.limit.astype(np.uint16)
        near4 = self.four.lift(block["q4"], False)
        self.near.feed(block["id"], near4 | {"q8": block["q8"], "bits": x}, veto=lambda own, cut, rough: self._veto(own, cut, rough, x))
        return iter(())

    def _veto(self, own: slice, cut: slice, rough: np.ndarray, x: dict) -> None:
        d, limit, left = self.bits.tile(self.q, own, x, cut), self.limit[own, None], self.left[own]
        out, tie = d > limit, d == limit
        n = tie.sum(axis=1)
        some = np.flatnonzero(n > left)
        out[some] |= tie[some] & (np.cumsum(tie[some], axis=1) > left[some, None])
        self.left[own] -= np.minimum(n, left)
        rough[out] = np.nan

    def finish(self) -> Iterator[dict]:
        r, ids, s2, extra = self.near.found()
        keep = scan._best(r, ids, extra[:, 0], self.k)
        yield {"qid": self.asked["qid"][r[keep]], "id": ids[keep], "s1": extra[keep, 1].astype(np.int64), "s2": s2[keep], "score": extra[keep, 0]}


def _to64(x: np.ndarray) -> np.ndarray:
    """Other widths are padded with zeros, or folded through the transform of the padded power of two, to 64."""
    if x.shape[1] == 64:
        return x
    if x.shape[1] < 64:
        return np.pad(x, ((0, 0), (0, 64 - x.shape[1])))
    n = 1 << (x.shape[1] - 1).bit_length()
    return (np.pad(x, ((0, 0), (0, n - x.shape[1]))) @ vector.hadamard(n)[:, :64]) * np.sqrt(n / 64)


def train_capq(df: DataFrame, clip: float = 0.9995, ridge: float = 1e-3, zca: bool = False, sample: int = 65_536, vec: str = "vector", id_col: str = "id", asymmetric: bool = False) -> Capq:
    x = _to64(sample_matrix(df, sample, vec, id_col))
    mean, cov = x.mean(axis=0), np.cov(x.T, bias=True)
    lam = ridge * np.trace(cov) / 64
    if zca:
        val, v = np.linalg.eigh(cov + lam * np.eye(64))
        whiten = v @ np.diag(1 / np.sqrt(val)) @ v.T
    else:
        whiten = np.diag(1 / np.sqrt(np.diag(cov) + lam))
    w = (x - mean) @ whiten
    reach = np.quantile(np.abs(w), clip, axis=0)
    out = Capq(mean, whiten, np.maximum(reach, 1e-6) / 127)
    out.q4 = np.stack([np.sort(_lloyd_1d(w[:, j], 16)) for j in range(64)])
    return out


def _lloyd_1d(v: np.ndarray, k: int, iterations: int = 8) -> np.ndarray:
    c = np.quantile(v, (np.arange(k) + 0.5) / k)
    for _ in range(iterations):
        at = np.abs(v[:, None] - c[None]).argmin(axis=1)
        n = np.bincount(at, minlength=k)
        c = np.where(n > 0, np.bincount(at, v, minlength=k) / np.maximum(n, 1), c)
    return c


def learned_q4_codes(model: Capq, x: np.ndarray) -> np.ndarray:
    return np.abs(model.white(x)[:, :, None] - model.q4[None]).argmin(axis=2)


def ridge_weights(parts: np.ndarray, target: np.ndarray, lam: float = 1e-3) -> np.ndarray:
    """Weights of per-dimension distances that give the target distance, by regularised normal equations."""
    return np.linalg.solve(parts.T @ parts + lam * np.eye(parts.shape[1]), parts.T @ target)


def itq_rotation(x: np.ndarray, iterations: int = 20, seed: int = 42) -> np.ndarray:
    """The rotation that brings rows closest to their signs."""
    r = np.linalg.qr(np.random.default_rng(seed).standard_normal((x.shape[1], x.shape[1])))[0]
    for _ in range(iterations):
        u, _, vt = np.linalg.svd(x.T @ np.sign(x @ r))
        r = u @ vt
    return r


def fit_isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(breaks, values) of the non-decreasing step function nearest to y, by pooling neighbours that fall."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, first x
    for a, b in zip(np.asarray(x, float)[order], np.asarray(y, float)[order]):
        blocks.append([b, 1.0, a])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, n, _ = blocks.pop()
            p = blocks[-1]
            p[0], p[1] = (p[0] * p[1] + m * n) / (p[1] + n), p[1] + n
    return np.array([b[2] for b in blocks]), np.array([b[0] for b in blocks])


def map_isotonic(model: tuple[np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    breaks, values = model
    return values[np.maximum(np.searchsorted(breaks, x, side="right") - 1, 0)]


# prefixes


def prefix_variance(df: DataFrame, dims: tuple[int, ...], vec: str = "vector") -> DataFrame:
    """(dim, share): the share of all dimensions' population variance in the first dim."""
    var = df.select(F.posexplode(vec).alias("pos", "v")).groupBy("pos").agg(F.var_pop(F.col("v").cast("double")).alias("var"))
    sums = var.agg(F.sum("var").alias("every"), *[F.sum(F.when(F.col("pos") < d, F.col("var"))).alias(f"v{d}") for d in dims])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.round(F.col(f"v{d}") / F.col("every"), SCALE).alias("share")) for d in dims])).alias("x")).select("x.*")


def truncate(v: Column, dim: int, renormalize: bool = True) -> Column:
    short = F.slice(v, 1, dim)
    return vector.normalize(short) if renormalize else vector.doubles(short)


def progressive_search(queries: DataFrame, base: DataFrame, dims: tuple[int, ...], k: int = 10, factor: int = 10, normalized: bool = True, id_col: str = "id", vec: str = "vector") -> DataFrame:
    """(qid, id, score, rank): each prefix length keeps factor * k of what the one before kept; the full vectors rank these."""
    if min(dims, default=0) > 0:
        return _progressive(queries, base, dims, k, factor, normalized, id_col, vec)
    x = base.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec).alias("v"))
    own = x.crossJoin(queries.select(F.col("qid").cast("bigint").alias("qid"), F.col("vector").alias("q")))
    for d in dims:
        own = rank(own.withColumn("score", F.round(vector.distance_at_dimension(F.col("v"), F.col("q"), d, normalized), SCALE)), factor * k).drop("rank")
    full = F.coalesce(vector.cosine_distance(F.col("v"), F.col("q")), F.lit(1.0)) if normalized else F.sqrt(vector.l2_sq(F.col("v"), F.col("q")))
    return rank(own.select("qid", "id", F.round(full, SCALE).alias("score")), k)


def _progressive(queries: DataFrame, base: DataFrame, dims: tuple[int, ...], k: int, factor: int, normalized: bool, id_col: str, vec: str) -> DataFrame:
    score = lambda: scan.Vectors("cosine", 1.0) if normalized else scan.Vectors("root")
    prefix = lambda d: lambda x: x[:, :d]
    first = prefix(dims[0])
    stages = tuple((score(), prefix(d), "raw", factor * k) for d in dims[1:]) + ((score(), scan.same, "raw", k),)
    view = lambda block, asks: {"key": first(block["vector"]), "raw": block["vector"]}
    asked = queries.select(F.col("qid").cast("bigint").alias("qid"), "vector")
    rows = base.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec).alias("vector")).where("vector is not null")
    return rank(scan.top(asked, rows, score(), factor * k, view=view, stages=stages), k)


def measured_recall(queries: DataFrame, base: DataFrame, dims: tuple[int, ...], k: int = 10) -> DataFrame:
    """(dim, recall) of searching each prefix alone against the full vectors (queries: qid, vector; base: id, vector)."""
    from quarry.operators.metrics import recall_at_k

    truth = knn(queries, base, k, "cosine")
    out = None
    for d in dims:
        short = knn(queries.withColumn("vector", F.slice("vector", 1, d)), base.withColumn("vector", F.slice("vector", 1, d)), k, "cosine")
        row = recall_at_k(short, truth, k).select(F.lit(d).alias("dim"), "recall")
        out = row if out is None else out.unionByName(row)
    return out
