"""Every query against every row, in packed blocks: what is exact and quadratic, in bounded memory and with a linear shuffle.

Rows are packed into blocks of numpy arrays. A task holds one block of queries and reads the blocks of the base one after the
other, keeping what it has found so far; so no pair is ever a row, and the shuffle has each row once. Scores are computed
roughly by a product of matrices in single precision; pairs that could be hits within that product's error get their score in double.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 6
QUERY_ROWS = 16_384  #: of a block of queries
BASE_ROWS = 8_192  #: of a block of the base
TILE = 256, 2_048  #: queries x rows scored at a time, for the processor's cache
REFINE = 32_768  #: pairs whose exact score is computed at a time
LARGE = 1e15  #: beyond it squares leave single precision
HITS = "qid bigint, id bigint, score double"


def to_numpy(column: pa.Array) -> np.ndarray:
    """A column as an array, lists of one length as a matrix; a null list is a row of nan."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_list(column.type) or pa.types.is_large_list(column.type)):
        return column.to_numpy(zero_copy_only=False)
    lengths = column.value_lengths().drop_null().to_numpy(zero_copy_only=False)
    if not len(lengths):
        return np.full((len(column), 0), np.nan)
    if lengths.min() != lengths.max():
        raise ValueError(f"vectors of {lengths.min()} to {lengths.max()} dimensions")
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(len(lengths), lengths[0])
    if not column.null_count:
        return values
    out = np.full((len(column), lengths[0]), np.nan)
    out[column.is_valid().to_numpy(zero_copy_only=False)] = values
    return out


def packed(df: DataFrame, rows: int, low: str | None = None) -> DataFrame:
    """(data): blocks of at most so many rows of a partition, each a pickled dict of arrays by column; low: also the block's first value of a column."""

    def pack(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts)
        first = {"low": pa.array([whole[low][0].as_py()], pa.int64())} if low else {}
        return pa.record_batch({"data": pa.array([pickle.dumps({c: to_numpy(whole[c]) for c in whole.column_names}, 5)], pa.binary())} | first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, rows - n)
                held, n, batch = [*held, part], n + part.num_rows, batch.slice(part.num_rows)
                if n == rows:
                    yield pack(held)
                    held, n = [], 0
        if held:
            yield pack(held)

    return df.mapInArrow(run, "data binary, low bigint" if low else "data binary")


def cross(queries: DataFrame, base: DataFrame, start: Callable, schema: str, key: str = "qid", rows: int = QUERY_ROWS, base_rows: int = BASE_ROWS, whole: bool = False, count: int | None = None) -> DataFrame:
    """start(columns of a block of queries) gives an object with feed(columns of a block of base) and finish(), both iterators of dicts of
    columns in schema; each block of queries meets each block of base. Few queries meet the base in several parts, unless whole is asked for."""
    return _cross(queries, packed(base, base_rows), start, schema, key, rows, whole, count)


def cross_twice(queries: DataFrame, base: DataFrame, start: Callable, schema: str, rows: int) -> DataFrame:
    """As :func:`cross` over the whole base, which each block of queries reads twice, in the order of ids; blocks tell the pass, 0 or 1."""
    ordered = base.repartitionByRange("id").sortWithinPartitions("id")
    blocks = packed(ordered, BASE_ROWS, "id").withColumn("pass", F.explode(F.array(F.lit(0), F.lit(1))))
    return _cross(queries, blocks, start, schema, "qid", rows, True, None, ("pass", "low"))


def _cross(queries: DataFrame, blocks: DataFrame, start: Callable, schema: str, key: str, rows: int, whole: bool, count: int | None, order: tuple[str, ...] = ()) -> DataFrame:
    tasks = 2 * queries.sparkSession.sparkContext.defaultParallelism
    total = queries.count() if count is None else count
    n = max(1, math.ceil(total / max(1, min(rows, max(256, math.ceil(total / tasks))))))
    parts = 1 if whole else max(1, math.ceil(tasks / n))
    left = blocks.repartition(parts)
    if order:
        left = left.sortWithinPartitions(*order).mapInArrow(lambda batches: batches, blocks.schema)  # a sort right below a join would be dropped
    left = left.withColumn("head", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0)
    right = packed(queries.repartition(n, key), rows).select(F.monotonically_increasing_id().alias("block"), F.col("data").alias("asked"))
    pairs = left.hint("shuffle_replicate_nl").crossJoin(right).select("block", F.when(F.col("head"), F.col("asked")).alias("asked"), *[c for c in left.columns if c != "head"])
    types = pa.schema([(f.name, {"bigint": pa.int64(), "double": pa.float64(), "int": pa.int32()}[f.dataType.simpleString()]) for f in _schema(schema)])

    def out(found: dict) -> Iterator[pa.RecordBatch]:
        n = len(next(iter(found.values())))
        for i in range(0, n, 65_536):
            yield pa.record_batch([pa.array(found[f.name][i : i + 65_536], f.type, from_pandas=True) for f in types], schema=types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, object] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                block = row["block"].as_py()
                if row["asked"].is_valid:
                    states[block] = start(pickle.loads(row["asked"].as_buffer()))
                given = {"pass": row["pass"].as_py()} if "pass" in row else {}
                for found in states[block].feed(pickle.loads(row["data"].as_buffer()) | given):
                    yield from out(found)
        for state in states.values():
            for found in state.finish():
                yield from out(found)

    return pairs.mapInArrow(run, schema)


def _schema(text: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(text)


# scores


class Vectors:
    """Scores by a metric of vectors.py. Rough scores are products of lifted vectors, exact ones sums in double."""

    def __init__(self, metric: str, zero: float = np.nan):
        """zero: the cosine distance of a vector without a norm. Besides the metrics "root", of squared L2."""
        self.metric, self.zero = metric if metric in ("ip", "cosine", "root") else "l2", zero

    def lift(self, x: np.ndarray, asks: bool) -> dict:
        x = np.asarray(x)
        d = x.astype(np.float64)
        norm = np.sqrt(np.einsum("ij,ij->i", d, d))
        offset = np.zeros(len(d))
        if self.metric == "cosine":
            with np.errstate(divide="ignore", invalid="ignore"):
                m = d / norm[:, None]
            m[norm == 0] = 0 if self.zero == 1 else np.nan
            m, offset = (-m, offset + 1) if asks else (m, offset)
        elif self.metric == "ip":
            m = -d if asks else d
        elif asks:
            m, offset = np.hstack([-2 * d, np.ones((len(d), 1))]), norm**2
        else:
            m = np.hstack([d, norm[:, None] ** 2])
        reach = np.sqrt(np.einsum("ij,ij->i", m, m)).astype(np.float64)
        small = np.float32 if not len(m) or not (np.nanmax(np.abs(m), initial=0) > LARGE) else np.float64
        m = m.astype(small)
        return {"x": x, "norm": norm, "rough": m if asks else np.ascontiguousarray(m.T), "offset": offset, "reach": reach}

    def margin(self, q: dict, rows, x: dict) -> np.ndarray:
        """How far a rough score can be from the rounded one, for each query."""
        far = np.nanmax(x["reach"], initial=0)
        return 1e-6 + (x["rough"].shape[0] + 4) * 2.0**-22 * (q["reach"][rows] * far + q["offset"][rows])

    def tile(self, q: dict, rows, x: dict, cut: slice) -> np.ndarray:
        return q["rough"][rows] @ x["rough"][:, cut]

    def limit(self, q: dict, rows, bound: np.ndarray, margin: np.ndarray) -> np.ndarray:
        return ((bound + 1e-6) ** 2 if self.metric == "root" else bound) - q["offset"][rows] + margin

    def exact(self, q: dict, r: np.ndarray, x: dict, c: np.ndarray) -> np.ndarray:
        a, b = q["x"][r].astype(np.float64), x["x"][c].astype(np.float64)
        if self.metric in ("l2", "root"):
            a -= b
            square = np.einsum("ij,ij->i", a, a)
            return np.round(square if self.metric == "l2" else np.sqrt(square), SCALE)
        dot = np.einsum("ij,ij->i", a, b)
        if self.metric == "ip":
            return np.round(-dot, SCALE)
        scale = q["norm"][r] * x["norm"][c]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.round(np.where(scale > 0, 1 - dot / scale, self.zero), SCALE)


class Bits:
    """Differing bits of codes, matrices of 64-bit words."""

    def lift(self, x: np.ndarray, asks: bool) -> dict:
        return {"x": np.ascontiguousarray(x).astype(np.int64, copy=False).view(np.uint64)}

    def margin(self, q, rows, x):
        return 0.0

    def tile(self, q: dict, rows, x: dict, cut: slice) -> np.ndarray:
        own, other = q["x"][rows], x["x"][cut]
        out = np.zeros((len(own), len(other)), np.uint8 if own.shape[1] < 4 else np.uint16)
        for w in range(own.shape[1]):
            out += np.bitwise_count(own[:, w, None] ^ other[None, :, w])
        return out

    def limit(self, q, rows, bound, margin):
        return np.minimum(bound, 60_000)

    def exact(self, q: dict, r: np.ndarray, x: dict, c: np.ndarray) -> np.ndarray:
        return np.bitwise_count(q["x"][r] ^ x["x"][c]).sum(axis=1).astype(np.float64)


def _where(mask: np.ndarray) -> np.ndarray:
    """Flat places of a sparse boolean matrix, looked for eight at a time."""
    flat = mask.ravel()
    n = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:n].view(np.uint64))
    some = flat[:n].reshape(-1, 8)[words]
    r, c = np.nonzero(some)
    return np.concatenate([words[r] * 8 + c, np.flatnonzero(flat[n:]) + n])


def _pieces(rows: np.ndarray | None, n: int, step: int) -> list:
    return [slice(i, min(i + step, n)) for i in range(0, n, step)] if rows is None else [rows[i : i + step] for i in range(0, len(rows), step)]


class Nearest:
    """The k best of each query by (rounded score, id), with the columns that more(q, r, x, c) gives of a pair."""

    def __init__(self, scorer, q: dict, k: int, more: Callable | None = None, width: int = 0):
        n = len(next(iter(q.values())))
        self.scorer, self.q, self.k, self.more, self.width = scorer, q, k, more, width
        self.score, self.id, self.extra = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max), np.full((n, k, width), np.nan)
        self.waiting, self.size = [], 0

    def feed(self, ids: np.ndarray, x: dict, rows: np.ndarray | None = None, veto: Callable | None = None) -> None:
        """Rows with these ids, for the queries in rows or all; veto(queries, rows, rough) sets the pairs that don't count to nan."""
        s, q = self.scorer, self.q
        for j in range(0, len(ids), TILE[1]):
            cut = slice(j, min(j + TILE[1], len(ids)))
            for own in _pieces(rows, len(self.score), TILE[0]):
                margin = s.margin(q, own, x)
                rough = s.tile(q, own, x, cut)
                if veto:
                    veto(own, cut, rough)
                limit = s.limit(q, own, self.score[own, -1], margin)
                new = np.isinf(self.score[own, -1])
                if new.any() and rough.shape[1] > self.k:
                    kth = np.partition(rough[new], self.k - 1, axis=1)[:, self.k - 1].astype(np.float64)
                    limit = np.array(limit, np.float64)
                    limit[new] = np.where(np.isnan(kth), np.inf, kth + 2 * (margin if np.isscalar(margin) else margin[new]))
                if rough.dtype == np.float32:
                    limit = np.nextafter(limit.astype(np.float32), np.float32(np.inf))
                elif rough.dtype.kind == "u":
                    limit = np.floor(limit).astype(rough.dtype)
                at = _where(rough <= limit[:, None])
                if len(at):
                    r, c = np.divmod(at, rough.shape[1])
                    self._offer(np.arange(len(self.score))[own][r], c + j, ids, x)
            if self.size >= max(65_536, self.score.size // 2):
                self.merge()

    def _offer(self, r: np.ndarray, c: np.ndarray, ids: np.ndarray, x: dict) -> None:
        for i in range(0, len(r), REFINE):
            a, b = r[i : i + REFINE], c[i : i + REFINE]
            score = self.scorer.exact(self.q, a, x, b)
            keep = self.near_enough(a, score, ids[b])
            a, b, score = a[keep], b[keep], score[keep]
            self.put(a, score, ids[b], self.more(self.q, a, x, b) if self.more else None)

    def near_enough(self, r: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return np.isfinite(score) & ((score < self.score[r, -1]) | (score == self.score[r, -1]) & (ids < self.id[r, -1]))

    def put(self, r: np.ndarray, score: np.ndarray, ids: np.ndarray, extra: np.ndarray | None = None) -> None:
        self.waiting.append((r, score, ids, np.empty((len(r), 0)) if extra is None else extra))
        self.size += len(r)

    def merge(self) -> None:
        if not self.size:
            return
        r, score, ids, extra = (np.concatenate(v) for v in zip(*self.waiting))
        self.waiting, self.size = [], 0
        rows, k = np.unique(r), self.k
        r = np.concatenate([r, np.repeat(rows, k)])
        score, ids = np.concatenate([score, self.score[rows].ravel()]), np.concatenate([ids, self.id[rows].ravel()])
        order = np.lexsort((ids, score, r))
        first = order[np.searchsorted(r[order], rows)[:, None] + np.arange(k)]
        if self.width:
            self.extra[rows] = np.concatenate([extra, self.extra[rows].reshape(-1, self.width)])[first]
        self.score[rows], self.id[rows] = score[first], ids[first]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, id, score, further columns) of all that were kept."""
        self.merge()
        r, at = np.nonzero(np.isfinite(self.score))
        return r, self.id[r, at], self.score[r, at], self.extra[r, at]


def _best(r: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k lowest scores, ties by id."""
    order = np.lexsort((ids, score, r))
    own = r[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own) < k]


class Search:
    """The depth best by the scorer of what view gives of a block: {"key": matrix} and, where only some cells are searched, "cell".

    asks: the cells of each query, a boolean matrix. With stages, pairs of a scorer and the name of a matrix in view and of the
    queries, the depth best are ranked anew by each, which keeps as many as its number.
    """

    def __init__(self, asked: dict, scorer, depth: int, view: Callable, key: str = "vector", cells: Callable | None = None, stages: tuple = ()):
        self.qid, self.scorer, self.view, self.stages = asked["qid"], scorer, view, stages
        self.cells = cells(asked[key]) if cells else None
        self.own = [s.lift(f(asked[key]), True) for s, f, _, _ in stages]
        self.near = Nearest(scorer, scorer.lift(view({key: asked[key]}, True)["key"], True), depth, self._more if stages else None, len(stages))

    def _more(self, q: dict, r: np.ndarray, x: dict, c: np.ndarray) -> np.ndarray:
        return np.stack([s.exact(own, r, other, c) for (s, *_), own, other in zip(self.stages, self.own, x["stages"])], axis=1)

    def feed(self, block: dict) -> Iterator[dict]:
        seen = self.view(block, False)
        places = [np.arange(len(block["id"]))] if self.cells is None else np.split(np.argsort(seen["cell"], kind="stable"), np.cumsum(np.unique(seen["cell"], return_counts=True)[1])[:-1])
        for at in places:
            rows = None if self.cells is None else np.flatnonzero(self.cells[:, int(seen["cell"][at[0]])])
            if rows is None or len(rows):
                x = self.scorer.lift(seen["key"][at], False)
                x["stages"] = [s.lift(f(seen[name][at]), False) for s, f, name, _ in self.stages]
                self.near.feed(block["id"][at], x, rows)
        return iter(())

    def finish(self) -> Iterator[dict]:
        r, ids, score, extra = self.near.found()
        for j, (_, _, _, k) in enumerate(self.stages):
            keep = np.isfinite(extra[:, j])
            keep[keep] = np.isin(np.flatnonzero(keep), np.flatnonzero(keep)[_best(r[keep], ids[keep], extra[keep, j], k)])
            r, ids, score, extra = r[keep], ids[keep], extra[keep, j], extra[keep]
        yield {"qid": self.qid[r], "id": ids, "score": score}


def same(x: np.ndarray) -> np.ndarray:
    return x


def top(queries: DataFrame, base: DataFrame, scorer, k: int, key: str = "vector", view: Callable | None = None, cells: Callable | None = None, stages: tuple = (), count: int | None = None) -> DataFrame:
    """(qid, id, score): the k best rows of base (id, key, what view reads) for each query (qid, key), of each part of the base that a
    task read; with stages, what the last leaves of the whole."""
    see = view or (lambda block, asks: {"key": block[key]})
    rows = base.where(F.col(key).isNotNull()) if view is None else base
    return cross(queries.select("qid", key).where(F.col(key).isNotNull()), rows, lambda asked: Search(asked, scorer, k, see, key, cells, stages), HITS, whole=bool(stages), count=count)


class _Within:
    def __init__(self, scorer, radius: float, asked: dict):
        self.qid, self.scorer, self.radius = asked["qid"], scorer, radius
        self.q = scorer.lift(asked["vector"], True)

    def feed(self, block: dict) -> Iterator[dict]:
        s, x = self.scorer, self.scorer.lift(block["vector"], False)
        for own in _pieces(None, len(self.qid), TILE[0]):
            limit = s.limit(self.q, own, np.full(own.stop - own.start, self.radius), s.margin(self.q, own, x))
            for j in range(0, len(block["id"]), TILE[1]):
                cut = slice(j, min(j + TILE[1], len(block["id"])))
                r, c = np.divmod(_where(s.tile(self.q, own, x, cut) <= limit[:, None]), cut.stop - cut.start)
                for i in range(0, len(r), REFINE):
                    a, b = r[i : i + REFINE] + own.start, c[i : i + REFINE] + j
                    score = s.exact(self.q, a, x, b)
                    keep = score <= self.radius
                    yield {"qid": self.qid[a[keep]], "id": block["id"][b[keep]], "score": score[keep]}

    def finish(self) -> Iterator[dict]:
        return iter(())


def within(queries: DataFrame, base: DataFrame, scorer, radius: float) -> DataFrame:
    """(qid, id, score) of all pairs of queries (qid, vector) and base (id, vector) with a score of at most radius."""
    return cross(queries.where("vector is not null"), base.where("vector is not null"), lambda asked: _Within(scorer, radius, asked), HITS)


class _All:
    def __init__(self, f: Callable, upper: bool, asked: dict):
        self.id, self.a, self.f, self.upper = asked["a_id"], np.asarray(asked["vector"], np.float64), f, upper

    def feed(self, block: dict) -> Iterator[dict]:
        ids, b = block["id"], np.asarray(block["vector"], np.float64)
        for i in range(0, len(self.id), 16):
            a = self.id[i : i + 16]
            d = np.round(self.f(self.a[i : i + 16], b), SCALE).ravel()
            out = {"a_id": np.repeat(a, len(ids)), "b_id": np.tile(ids, len(a)), "d": d}
            if self.upper:
                keep = out["a_id"] < out["b_id"]
                out = {c: v[keep] for c, v in out.items()}
            yield out

    def finish(self) -> Iterator[dict]:
        return iter(())


def every(a: DataFrame, b: DataFrame, f: Callable, upper: bool = False) -> DataFrame:
    """(a_id, b_id, d) of all pairs, or those with a_id < b_id; f gives the matrix of d, nan where there is none."""
    return cross(a, b, lambda asked: _All(f, upper, asked), "a_id bigint, b_id bigint, d double", key="a_id", rows=2048)
