"""Near duplicates by 128-bit SimHash and BK-trees.

A document's signature is the sign of the sum, over its distinct words, of the words' hash bits. The groups are the
connected components of all pairs of signatures within the radius, at every size of the table. They are found in two searches.

The first is fast and finds most links. Distinct signatures are put into shards: a shard holds the signatures that agree on k
sampled bits, and there are several samplings. In each shard a BK-tree (children keyed by their integer Hamming distance to the
parent) is given all the shard's signatures as queries, which follow only edges within the radius. Found pairs are joined as they
are found, so that a shard gives edges that span its parts. A tree goes to the tasks that hold queries of its shard.

The second, the sweep, leaves nothing out: it looks at all pairs of signatures that the first didn't connect. Of two signatures
within the radius one half of 64 bits differs in at most half the radius, and one of that half's parts in one or two bits; so the
sweep compares signatures whose keys in a part differ in no more. It goes through pairs of blocks of signatures, a task holding two blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.llm.shared import col, cols, drop_table, fresh, join_checked, slices, type_of, written

BITS = 128
RADIUS = 23
SHARD = 1024  #: signatures in a shard, about
LEAF = 128  #: a BK node with no more signatures below it is compared as one block
GROUP = 100_000  #: rows that one call of the search gets, about
WORDS = 50_000  #: words whose hash bits are held at a time
BLOCK = 20_000  #: queries that are compared with a leaf at a time
SWEEP = 1 << 19  #: signatures in a block of the sweep, about
PARTS = (12, 12, 12, 14, 14)  #: bits of the parts of a half
ROWS, COLUMNS = 256, 1024  #: signatures that the sweep compares at a time
TASKS = 24  #: the sweep's parts go to tasks of their own if there are fewer pairs of blocks
STARS, STARS_FROM = 32, 2048  #: pivots that gather a shard's signatures first, and the size of a shard from which that pays

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def word_hashes(words: list[str]) -> np.ndarray:
    """n x 2 uint64, the same on every machine."""
    h = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    x = h + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return np.stack([h, x ^ (x >> np.uint64(31))], axis=1)


def _bit_sums(words: list[str]) -> np.ndarray:
    """For each of 128 bits the number of words that have it."""
    out = np.zeros(BITS, np.int64)
    for i in range(0, len(words), WORDS):
        out += np.unpackbits(word_hashes(words[i : i + WORDS]).view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return out


def signatures(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Signatures as n x 2 int64, and which texts have one: those with a word. No more than WORDS words' bits are held at a time."""
    out, has = np.zeros((len(texts), 2), np.uint64), np.zeros(len(texts), bool)
    places: list[int] = []
    held: list[set[str]] = []

    def flush() -> None:
        if held:
            size = np.array([len(b) for b in held])
            bits = np.unpackbits(word_hashes(list(chain.from_iterable(held))).view(np.uint8), axis=1)
            sums = np.add.reduceat(bits, np.concatenate([[0], np.cumsum(size)[:-1]]), axis=0, dtype=np.int32)
            out[places] = np.packbits(2 * sums > size[:, None], axis=1).view(np.uint64)
            places.clear()
            held.clear()

    waiting = 0
    for i, t in enumerate(texts):
        bag = set(t.lower().split()) if t else ()
        if not bag:
            continue
        has[i] = True
        if waiting + len(bag) > WORDS:
            flush()
            waiting = 0
        if len(bag) > WORDS:
            out[i] = np.packbits(2 * _bit_sums(list(bag)) > len(bag)).view(np.uint64)
            continue
        places.append(i)
        held.append(bag)
        waiting += len(bag)
    flush()
    return out.view(np.int64), has


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in slices(b, 1):
            s, has = signatures(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(has)), pa.array(s[has, 0]), pa.array(s[has, 1])], names=["doc_id", "s0", "s1"])


def plan(n: int, recall: float = 0.9, at: int = RADIUS) -> tuple[int, int]:
    """(bits sampled, samplings) of the first search: a pair at distance ``at`` meets with probability ``recall`` among n signatures, a nearer pair with a higher one."""
    k = max(0, math.ceil(math.log2(max(n, 1) / SHARD)))
    meet = (1 - at / BITS) ** k
    return k, 1 if k == 0 else math.ceil(math.log(1 - recall) / math.log(1 - meet))


def _shards(k: int, tables: int, groups: int):
    rng = np.random.default_rng(20240917)
    picks = [np.sort(rng.choice(BITS, k, replace=False)) for _ in range(tables)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, s0, s1 = batch.columns
            s = np.stack([s0.to_numpy(), s1.to_numpy()], axis=1)
            bits = np.unpackbits(np.ascontiguousarray(s).view(np.uint8), axis=1)
            for t, at in enumerate(picks):
                key = np.full(len(s), t, np.int64)
                for b in at:
                    key = key * 2 + bits[:, b]
                mixed = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                yield pa.RecordBatch.from_arrays([pa.array((mixed % np.uint64(groups)).astype(np.int32)), pa.array(key), rep, s0, s1], names=["g", "key", "rep", "s0", "s1"])

    return run


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[..., 0] ^ b[..., 0]).astype(np.int16) + np.bitwise_count(a[..., 1] ^ b[..., 1])


class BKTree:
    """A BK-tree over n x 2 uint64 signatures; nodes with few signatures below them hold these as a block."""

    def __init__(self, sig: np.ndarray, idx: np.ndarray | None = None):
        self.sig = sig
        self.root = self._grow(np.arange(len(sig)) if idx is None else idx)

    def _grow(self, idx: np.ndarray):
        if len(idx) <= LEAF:
            return idx
        d = hamming(self.sig[idx[1:]], self.sig[idx[0]])
        order = np.argsort(d, kind="stable")
        edges, starts = np.unique(d[order], return_index=True)
        return idx[0], [(int(e), self._grow(part)) for e, part in zip(edges, np.split(idx[1:][order], starts[1:]))]

    def visit(self, queries: np.ndarray, radius: int, asking: np.ndarray | None = None, still: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Indices (query, signature) of all pairs within the radius, a node or a leaf at a time.

        asking are the indices of the queries that ask, still(asking) those that have not found what they asked for.
        """
        q0, q1 = queries[:, 0].copy(), queries[:, 1].copy()
        todo = [(self.root, np.arange(len(queries)) if asking is None else asking)]
        while todo:
            node, q = todo.pop()
            if still and not len(q := still(q)):
                continue
            if isinstance(node, np.ndarray):
                s0, s1 = self.sig[node, 0], self.sig[node, 1]
                for i in range(0, len(q), BLOCK):
                    own = q[i : i + BLOCK]
                    d = np.bitwise_count(q0[own][:, None] ^ s0)
                    d += np.bitwise_count(q1[own][:, None] ^ s1)
                    at = np.flatnonzero(d <= radius)
                    yield own[at // len(node)], node[at % len(node)]
                continue
            pivot, children = node
            d = hamming(queries[q], self.sig[pivot])
            near = q[d <= radius]
            yield near, np.full(len(near), pivot)
            for edge, child in children:
                if len(own := q[np.abs(d - edge) <= radius]):
                    todo.append((child, own))

    def search(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All pairs that :meth:`visit` yields, at once."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)), *self.visit(queries, radius)]
        return tuple(np.concatenate(x) for x in zip(*found))


class Unions:
    """Which of n vertices pairs connect; only the vertices are held, not the pairs."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def tops(self, x: np.ndarray) -> np.ndarray:
        up, t = self.up, self.up[x]
        while True:
            above = up[t]
            if (above == t).all():
                break
            t = above
        up[x] = t
        return t

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Connect a[i] with b[i] for all i; each turn hangs a top under a lower one, until no pair has two."""
        while len(a):
            a, b = self.tops(a), self.tops(b)
            split = a != b
            if not split.any():
                return
            n = len(self.up)
            a, b = np.divmod(np.unique(np.maximum(a[split], b[split]) * n + np.minimum(a[split], b[split])), n)
            self.up[a[::-1]] = b[::-1]  # of several tops below a the lowest


def _linked(sig: np.ndarray, radius: int) -> np.ndarray:
    """For each signature of a shard the lowest place among those it is connected with.

    First each of some pivots takes all signatures in its radius; signatures that a pivot connected need not be compared with each
    other again. A tree of each such part, and one of what is left, is then searched by the signatures that aren't of the part.
    """
    n = len(sig)
    unions, part = Unions(n), np.full(n, -1)
    if n > STARS_FROM:
        for star in range(STARS):
            left = np.flatnonzero(part < 0)
            if not len(left):
                break
            pivot = left[len(left) // 2]
            near = left[hamming(sig[left], sig[pivot]) <= radius]
            unions.join(near, np.full(len(near), pivot))
            part[near] = star
    for star in np.unique(part):
        own = np.flatnonzero(part == star)
        top = unions.tops(np.arange(n))
        if star < 0:
            others = own if (top[own] != top[own[0]]).any() else own[:0]
        else:
            others = np.flatnonzero(((part > star) | (part < 0)) & (top != top[own[0]]))
        if len(others):
            # one link with a part that a pivot connected is enough
            apart = None if star < 0 else lambda q, one=own[:1]: q[unions.tops(q) != unions.tops(one)]
            for a, b in BKTree(sig, own).visit(sig, radius, others, apart):
                new = a < b if star < 0 else a != b
                unions.join(a[new], b[new])
    return unions.tops(np.arange(n))


def _search(radius: int, id_type: pa.DataType):
    def run(t: pa.Table) -> pa.Table:
        key = t.column("key").to_numpy()
        order = np.argsort(key, kind="stable")
        key = key[order]
        sig = np.ascontiguousarray(np.stack([t.column("s0").to_numpy(), t.column("s1").to_numpy()], axis=1)[order]).view(np.uint64)
        cuts = np.flatnonzero(np.diff(key)) + 1
        lo, hi = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in zip(lo[hi - lo > 1].tolist(), hi[hi - lo > 1].tolist()):
            top = _linked(sig[i:j], radius)
            own = np.flatnonzero(top != np.arange(j - i))
            a.append(i + top[own])
            b.append(i + own)
        rep = t.column("rep").combine_chunks()
        return pa.table({"a": rep.take(pa.array(order[np.concatenate(a)])), "b": rep.take(pa.array(order[np.concatenate(b)]))}, schema=pa.schema([("a", id_type), ("b", id_type)]))

    return run


def pieces(radius: int) -> list[tuple[int, int, int, int]]:
    """(half, shift, bits, slack): two signatures within the radius differ, in some half by at most radius // 2 bits and in some part of that half by at most slack."""
    least, more = divmod(radius // 2 + 1, len(PARTS))  # the slacks, each with one added, sum to radius // 2 + 1
    slack = [least - 1 + (n >= len(PARTS) - more) for n in range(len(PARTS))]
    return [(half, sum(PARTS[:n]), PARTS[n], slack[n]) for half in (0, 1) for n in range(len(PARTS)) if slack[n] >= 0]


def _across(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, piece: tuple[int, int, int, int], radius: int, unions: Unions) -> None:
    """Connect the labels la and lb of all pairs of signatures of a and b within the radius whose keys in the piece differ in at most its slack; if b is a, of all pairs in it.

    Signatures whose labels are connected are not compared if many of them are together.
    """
    half, shift, bits, slack = piece
    masks = np.arange(2**bits)
    masks = masks[np.bitwise_count(masks) <= slack]

    def placed(sig: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, ...]:
        key = ((sig[:, half] >> np.uint64(shift)) & np.uint64(2**bits - 1)).astype(np.int64)
        label = unions.tops(label)
        order = np.lexsort((label, key))
        sig = sig[order]
        return sig, sig[:, half].copy(), label[order], np.searchsorted(key[order], np.arange(2**bits + 1))

    same = b is a
    a, ha, la, ca = placed(a, la)
    b, hb, lb, cb = (a, ha, la, ca) if same else placed(b, lb)
    found = 0
    for key in np.flatnonzero(np.diff(ca)):
        near = key ^ masks
        if same:
            near = near[near >= key]
        count = cb[near + 1] - cb[near]
        cols = np.repeat(cb[near] - np.cumsum(count) + count, count) + np.arange(count.sum())
        for i in range(ca[key], ca[key + 1], ROWS):
            own = slice(i, min(i + ROWS, ca[key + 1]))
            one = la[own]
            others = cols if (one != one[0]).any() else cols[lb[cols] != one[0]]
            for j in range(0, len(others), COLUMNS):
                c = others[j : j + COLUMNS]
                at = np.flatnonzero(np.bitwise_count(ha[own, None] ^ hb[c]) <= radius // 2)
                if not len(at):
                    continue
                x, y = i + at // len(c), c[at % len(c)]
                new = la[x] != lb[y]
                x, y = x[new], y[new]
                new = hamming(a[x], b[y]) <= radius
                unions.join(la[x[new]], lb[y[new]])
                found += len(at)
            if found > len(la):
                la = unions.tops(la)
                lb = la if same else unions.tops(lb)
                found = 0


def _blocks(blocks: int, split: int):
    """Each signature once for each pair of blocks that its own is in, and that for each of split shares of the pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            root, s0, s1 = batch.columns
            mixed = (s0.to_numpy().view(np.uint64) ^ (s1.to_numpy().view(np.uint64) * _M1)) * _M2
            own = ((mixed >> np.uint64(33)) % np.uint64(blocks)).astype(np.int64)
            for other in range(blocks):
                pair = np.minimum(own, other) * blocks + np.maximum(own, other)
                for share in range(split):
                    yield pa.RecordBatch.from_arrays([pa.array(pair * split + share), pa.array(own > other), root, s0, s1], names=["g", "second", "root", "s0", "s1"])

    return run


def _codes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A number for each value, the same for equal ones, and of each number a place that has it. Nested values, which Arrow doesn't number, go by their text."""
    flat = pa.array([repr(v) for v in values.to_pylist()]) if pa.types.is_nested(values.type) else values
    code = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    return code, np.unique(code, return_index=True)[1]


def _sweep(radius: int, blocks: int, split: int, id_type: pa.DataType):
    def run(t: pa.Table) -> pa.Table:
        g = t.column("g")[0].as_py()
        low, high = divmod(g // split, blocks)
        roots = t.column("root").combine_chunks()
        label, first = _codes(roots)
        unions = Unions(len(first))
        sig = np.stack([t.column("s0").to_numpy(), t.column("s1").to_numpy()], axis=1).view(np.uint64)
        second = t.column("second").to_numpy()
        a, la = sig[~second], label[~second]
        b, lb = (a, la) if low == high else (sig[second], label[second])
        for piece in pieces(radius)[g % split :: split]:
            _across(a, la, b, lb, piece, radius, unions)
        top = unions.tops(np.arange(len(first)))
        own = np.flatnonzero(top != np.arange(len(top)))
        return pa.table({"a": roots.take(pa.array(first[top[own]])), "b": roots.take(pa.array(first[own]))}, schema=pa.schema([("a", id_type), ("b", id_type)]))

    return run


def sweep(labelled: DataFrame, n: int, radius: int) -> DataFrame:
    """Edges (a, b) of roots that connect whatever the n signatures of labelled (root, s0, s1) within the radius connect and their roots don't yet."""
    kind = type_of(labelled, "root")
    blocks = max(1, math.ceil(n / SWEEP))
    split = max(1, min(len(pieces(radius)), math.ceil(TASKS / (blocks * (blocks + 1) // 2))))
    pairs = labelled.select("root", "s0", "s1").mapInArrow(_blocks(blocks, split), f"g bigint, second boolean, root {kind}, s0 bigint, s1 bigint")
    return pairs.groupBy("g").applyInArrow(_sweep(radius, blocks, split, to_arrow_type(labelled.schema["root"].dataType)), f"a {kind}, b {kind}")


def components(edges: DataFrame) -> DataFrame:
    """(v, root): the lowest vertex that edges (a, b) connect v with. Lowest neighbours and jumps over them, in written rounds."""
    one = written(edges.where("a <> b").select("a", "b").distinct(), "edges")
    both = written(one.union(one.select("b", "a")).distinct(), "edges")
    drop_table(one)
    label = written(both.groupBy(F.col("a").alias("v")).agg(F.least("v", F.min("b")).alias("root")), "labels")
    while True:
        low = both.join(label.select(F.col("v").alias("b"), "root"), "b").groupBy(F.col("a").alias("v")).agg(F.min("root").alias("low"))
        step = label.join(low, "v").select("v", F.col("root").alias("was"), F.least("root", "low").alias("root"))
        jump = step.select(F.col("v").alias("root"), F.col("root").alias("next"))
        new = written(step.join(jump, "root", "left").select("v", "was", F.coalesce("next", "root").alias("root")), "labels")
        drop_table(label)
        label = new.select("v", "root")
        if new.where("root <> was").isEmpty():
            drop_table(both)
            return label


def near_duplicate_members(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, recall: float = 0.9) -> DataFrame:
    """(doc_id, group_id) of each document in a group of at least two; group_id is the group's lowest doc_id.

    Two documents are near duplicates if their signatures differ in at most ``radius`` of 128 bits; groups are the
    connected components of all such pairs, at every size. ``recall`` is what the first search is planned for; as the sweep
    finds the rest, the result doesn't depend on it. Null texts and texts without a word have no signature and are in no group; rows with a null
    id are in none either, as nothing can name them. Rows that repeat an id are one document. Texts of any length are read
    whole, in pieces of bounded memory. Ids may be of any type that orders. An empty table gives an empty
    result. Extra columns are not read, whatever their names.
    """
    kind = type_of(docs, id_col)
    rows = docs.where(col(id_col).isNotNull() & col(text).isNotNull()).select(col(id_col).alias("doc_id"), col(text).alias("text"))
    signed = written(rows.mapInArrow(_sign, f"doc_id {kind}, s0 bigint, s1 bigint"), "signed")
    unique = written(signed.groupBy("s0", "s1").agg(F.min("doc_id").alias("rep")), "unique")
    n = unique.count()
    k, tables = plan(n, recall, radius)
    groups = max(1, math.ceil(n * tables / GROUP))
    id_type = to_arrow_type(unique.schema["rep"].dataType)
    shards = unique.select("rep", "s0", "s1").mapInArrow(_shards(k, tables, groups), f"g int, key bigint, rep {kind}, s0 bigint, s1 bigint")
    edges = shards.groupBy("g").applyInArrow(_search(radius, id_type), f"a {kind}, b {kind}")
    root = components(edges.union(signed.join(unique, ["s0", "s1"]).where("doc_id <> rep").select("rep", "doc_id")))
    labelled = unique.join(root, F.col("rep") == F.col("v"), "left").select(F.coalesce("root", "rep").alias("root"), "s0", "s1")
    moved = components(sweep(labelled, n, radius)).select(F.col("v").alias("was"), F.col("root").alias("now"))
    kept = root.join(moved, F.col("root") == F.col("was"), "left").select("v", F.coalesce("now", "root").alias("root"))
    joined = moved.join(root, F.col("was") == F.col("v"), "left_anti").select(F.col("was").alias("v"), F.col("now").alias("root"))
    return kept.union(joined).select(F.col("v").alias("doc_id"), F.col("root").alias("group_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, recall: float = 0.9) -> DataFrame:
    """One row (doc_id, dup_of) for each document to drop: dup_of, the lowest id of its group, stays. Nulls, ties, long and empty texts as in :func:`near_duplicate_members`."""
    return near_duplicate_members(docs, id_col, text, radius, recall).where("doc_id <> group_id").select("doc_id", F.col("group_id").alias("dup_of"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, recall: float = 0.9) -> DataFrame:
    """docs with one document of each group, the one with the lowest id; documents in no group stay, as do rows with a null id or text.

    All columns are kept, whatever their names. Rest as in :func:`near_duplicate_members`.
    """
    drop = written(near_duplicates(docs, id_col, text, radius, recall).select(F.col("doc_id").alias(id_col)), "drop")
    return join_checked(docs, drop, [id_col], "left_anti", 40).select(*cols(docs))


def drop_near_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, recall: float = 0.9) -> DataFrame:
    """docs with one row of each group of near duplicates, where each row is a document of its own, whatever its id.

    So rows with a null id are compared too, rows that repeat an id stand for themselves, and no id connects texts that aren't near. The row with the
    lowest id stays; null ids count as the highest, and of rows that repeat the lowest id one stays. Rows with a null text or without a word
    stay. All columns are kept, whatever their names; ids may be of any type that orders. Rest as in :func:`near_duplicate_members`.
    """
    row = fresh(docs, "row")
    # a number for each row, fixed by writing it
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    members = written(near_duplicate_members(rows, row, text, radius, recall).withColumnRenamed("doc_id", row), "members")
    placed = join_checked(rows.select(row, col(id_col).isNull().alias("no"), col(id_col).alias("id")), members, [row], "inner", 40)
    first = placed.groupBy("group_id").agg(F.min(F.struct("no", "id", row)).alias("first")).select(F.col(f"first.{row}").alias(row))
    drop = written(members.join(first, row, "left_anti").select(row), "drop")
    return join_checked(rows, drop, [row], "left_anti", 40).select(*cols(docs))
