"""Resharding by minimum-cost flow: the fewest bytes move from old shards to new capacities, and only touched shards are rewritten.

A shard's rows fall into a fixed number of cells by a hash, runs of cells make blocks of about one size in all shards, and
blocks move whole. The network has a node for each shard and counts bytes: keeping one costs nothing, sending one away costs one.
Successive shortest paths give the fewest bytes that must move, and the flow is rounded to whole blocks of as few bytes as can be. Capacities are in bytes and none is exceeded.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import BROADCAST_BYTES, col, cols, fresh

CELLS = 128  #: hash cells of a shard
BLOCKS = 32  #: blocks for each shard, on average
SLACK = 0.25  #: room of the default capacities over the bytes there are
GRAINS = 1 << 16  #: resolution of the choice of blocks that leave a shard
NODES = 500_000  #: shards that the search over assignments looks at


def min_cost_flow(nodes: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int, want: int) -> tuple[int, int, list[int]]:
    """(flow, cost, flow of each arc) of the cheapest flow of up to want units over arcs (from, to, capacity, cost >= 0)."""
    to, cap, cost, head = [], [], [], [[] for _ in range(nodes)]
    for a, b, c, w in arcs:
        for x, y, z, v in ((a, b, c, w), (b, a, 0, -w)):
            head[x].append(len(to))
            to.append(y)
            cap.append(z)
            cost.append(v)
    potential, flow, spent = [0] * nodes, 0, 0
    while flow < want:
        far: list[float] = [float("inf")] * nodes
        via = [-1] * nodes
        far[source], heap = 0, [(0, source)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e in head[x]:
                if cap[e] > 0 and (new := d + cost[e] + potential[x] - potential[to[e]]) < far[to[e]]:
                    far[to[e]], via[to[e]] = new, e
                    heapq.heappush(heap, (new, to[e]))
        if far[sink] == float("inf"):
            break
        reach = max(d for d in far if d < float("inf"))
        potential = [p + (d if d < float("inf") else reach) for p, d in zip(potential, far)]
        path, x = [], sink
        while x != source:
            path.append(via[x])
            x = to[via[x] ^ 1]
        push = min(want - flow, *(cap[e] for e in path))
        for e in path:
            cap[e] -= push
            cap[e ^ 1] += push
            spent += push * cost[e]
        flow += push
    return flow, spent, [cap[2 * i + 1] for i in range(len(arcs))]


def _transfers(sizes: dict[str, int], capacities: dict[str, int]) -> int | None:
    """The fewest bytes that must move if bytes could move singly, by the flow; None if they don't fit at all."""
    old, new = sorted(sizes), sorted(capacities)
    s, t, hub = 0, 1, 2
    a = {x: 3 + i for i, x in enumerate(old)}
    b = {x: 3 + len(old) + i for i, x in enumerate(new)}
    arcs = []
    for x in old:
        arcs += [(s, a[x], sizes[x], 0), (a[x], hub, sizes[x], 1)]
        if x in b:
            arcs.append((a[x], b[x], sizes[x], 0))
    for y in new:
        arcs += [(hub, b[y], 1 << 62, 0), (b[y], t, capacities[y], 0)]
    total = sum(sizes.values())
    flow, cost, _ = min_cost_flow(3 + len(old) + len(new), arcs, s, t, total)
    return cost if flow == total else None


def _leaving(own: list[tuple[int, int]], room: int) -> set[int]:
    """Blocks that leave a shard so that the others fit in room, of the fewest bytes at a resolution of 1/GRAINS of room."""
    if sum(b for _, b in own) <= room:
        return set()
    grain = -(-room // GRAINS) or 1
    limit, reach, steps = room // grain, 1, []
    for n, size in own:
        steps.append((n, -(-size // grain), reach))
        reach |= (reach << steps[-1][1]) & ((1 << (limit + 1)) - 1)
    at, stay = reach.bit_length() - 1, set()
    for n, size, before in reversed(steps):
        if not before >> at & 1:
            at -= size
            stay.add(n)
    return {n for n, _ in own} - stay


def plan_moves(blocks: dict[str, list[tuple[int, int]]], capacities: dict[str, int]) -> list[tuple[str, int, str]]:
    """(old shard, block, new shard) of the blocks that move, from blocks (number, bytes) of each shard and bytes that each new shard may hold.

    A minimum-cost flow in bytes tells the fewest bytes that must move. It is rounded to whole blocks: each shard gives up blocks of the fewest
    bytes, the largest go first, each into the most room, or into the least that holds it if that leaves one without. If that moves more than the flow does, or leaves a block
    without room, a search over all assignments, cut by that bound and by what was found, goes on for NODES steps; within these
    the plan is the cheapest there is. No capacity is ever exceeded. ValueError if the bytes don't fit, or no whole blocks are found that do.
    """
    if not blocks:
        return []
    sizes = {x: sum(b for _, b in own) for x, own in blocks.items()}
    least = _transfers(sizes, capacities)
    if least is None:
        raise ValueError("the blocks don't fit in the capacities; give more capacity")
    each = sorted(((size, x, n) for x, own in blocks.items() for n, size in own), key=lambda e: (-e[0], e[1], e[2]))
    gone = {(x, n) for x, own in blocks.items() for n in (_leaving(own, capacities[x]) if x in capacities else {n for n, _ in own})}
    room = dict(capacities)
    for size, x, n in each:
        if (x, n) not in gone:
            room[x] -= size
    going = [e for e in each if (e[1], e[2]) in gone]
    best = _placed(going, room, False)
    if best is None:
        best = _placed(going, room, True)
    cost = sum(size for size, _, _ in going) if best is not None else 1 << 62
    if cost > least:
        best = _assign(each, dict(capacities), least, cost, best)
    if best is None:
        raise ValueError("no whole blocks were found that fit in the capacities; give more capacity or smaller blocks")
    return best


def _placed(going: list[tuple[int, str, int]], room: dict[str, int], tight: bool) -> list[tuple[str, int, str]] | None:
    """Where blocks (bytes, shard, number), largest first, go: each to the most room, or to the least that holds it; None if one has none."""
    free, out = sorted((r, y) for y, r in room.items()), []
    for size, x, n in going:
        lo = bisect_left(free, (size, ""))
        at = next((i for i in (range(lo, len(free)) if tight else range(len(free) - 1, lo - 1, -1)) if free[i][1] != x), None)
        if at is None:
            return None
        r, y = free.pop(at)
        insort(free, (r - size, y))
        out.append((x, n, y))
    return out


def _assign(each: list[tuple[int, str, int]], room: dict[str, int], least: int, cost: int, best: list | None) -> list | None:
    """The cheapest assignment of blocks, largest first, that costs less than cost, as far as NODES steps find it; else best."""
    steps, i, moved = 0, 0, 0
    chosen: list[str] = []
    options: list[list[str]] = []
    last = {x: j for j, (_, x, _) in enumerate(each)}
    while steps < NODES and cost > least:
        steps += 1
        if i == len(each):
            cost, best = moved, [(x, n, y) for (_, x, n), y in zip(each, chosen) if x != y]
        elif len(options) == i:
            size, x, _ = each[i]
            own, seen, others = [x] if room.get(x, -1) >= size else [], set(), []
            if moved + size < cost:
                steps += len(room)
                # shards with blocks still to place are told apart, of the others one of each room is enough
                for r, y in sorted(((r, y) for y, r in room.items() if r >= size and y != x), key=lambda e: (-e[0], e[1])):
                    if last.get(y, -1) >= i or r not in seen:
                        others.append(y)
                        if last.get(y, -1) < i:
                            seen.add(r)
            options.append((own + others)[::-1])
        if i < len(each) and options[i]:
            size, x, _ = each[i]
            y = options[i].pop()
            if y == x or moved + size < cost:
                room[y] -= size
                moved += size * (x != y)
                chosen.append(y)
                i += 1
                continue
            options[i].clear()
        if i < len(each):
            options.pop()
        if i == 0:
            break
        i -= 1
        size, x, _ = each[i]
        y = chosen.pop()
        room[y] += size
        moved -= size * (x != y)
    return best


def make_blocks(cells: dict[str, dict[int, int]], blocks: int = BLOCKS) -> tuple[dict[str, list[tuple[int, int]]], dict[tuple[str, int], int]]:
    """(number, bytes) of each shard's blocks, and the block of each (shard, cell), from the bytes of each shard's cells."""
    target = sum(sum(own.values()) for own in cells.values()) / max(1, blocks * len(cells))
    found: dict[str, list[tuple[int, int]]] = {}
    of: dict[tuple[str, int], int] = {}
    for s, own in cells.items():
        size, n, out = 0, 0, []
        for cell in sorted(own):
            if size and size + own[cell] > target:
                out.append((n, size))
                size, n = 0, n + 1
            of[s, cell] = n
            size += own[cell]
        found[s] = [*out, (n, size)]
    return found, of


def even_capacities(blocks: dict[str, list[tuple[int, int]]], shards: int, slack: float = SLACK) -> dict[str, int]:
    """Equal capacities for shards in number: the old ones' names from the first on, then new ones."""
    names = sorted(blocks)[:shards]
    names += [f"shard-{i:05d}" for i in range(shards - len(names))]
    unit = max((b for own in blocks.values() for _, b in own), default=1) or 1
    return dict.fromkeys(names, int(sum(b for own in blocks.values() for _, b in own) * (1 + slack)) // shards + unit)


def _shard(column: Column) -> Column:
    """The shard's name; null is the shard named by the empty string."""
    return F.coalesce(column.cast("string"), F.lit(""))


def _tagged(docs: DataFrame, id_col: str, text: str, shard: str, old: str, cell: str, size: str) -> DataFrame:
    bytes_ = F.coalesce(F.octet_length(col(text)), F.lit(0)).cast("bigint")
    return docs.withColumns({old: _shard(col(shard)), cell: F.pmod(F.xxhash64(col(id_col), col(text)), F.lit(CELLS)).cast("int"), size: bytes_})


def reshard_plan(docs: DataFrame, capacities: dict[str, int] | None = None, id_col: str = "doc_id", text: str = "text", shard: str = "source", blocks: int = BLOCKS) -> list[tuple[str, int, int, str, bool]]:
    """(old shard, cell, block, new shard, moved) of every cell that has rows. What is collected has CELLS x shards rows at most.

    Without capacities there are a quarter more shards than before, of equal capacity.
    """
    own = docs.select(col(id_col).alias("id"), col(text).alias("text"), col(shard).alias("shard"))
    cells: dict[str, dict[int, int]] = {}
    for r in _tagged(own, "id", "text", "shard", "old", "cell", "size").groupBy("old", "cell").agg(F.sum("size").alias("bytes")).collect():
        cells.setdefault(r["old"], {})[r["cell"]] = r["bytes"]
    found, of = make_blocks(cells, blocks)
    if capacities is None:
        capacities = even_capacities(found, len(found) + -(-len(found) // 4) or 1)
    to = {(s, n): t for s, n, t in plan_moves(found, capacities)} if found else {}
    return [(s, c, n, to.get((s, n), s), (s, n) in to) for (s, c), n in sorted(of.items())]


def reshard(docs: DataFrame, capacities: dict[str, int] | None = None, id_col: str = "doc_id", text: str = "text", shard: str = "source", blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, old_shard, block, new_shard, moved, n_bytes) of every row.

    A block is rows of one shard by a hash of id and text: repeated rows stay together. A null shard is the shard "", null
    and empty texts weigh nothing; texts of any length are weighed whole. ValueError if capacities are too small. An empty table gives an empty result; extra
    columns are not read, whatever their names.
    """
    plan = reshard_plan(docs, capacities, id_col, text, shard, blocks)
    own = docs.select(col(id_col).alias("doc_id"), col(text).alias("text"), col(shard).alias("shard"))
    tagged = _tagged(own, "doc_id", "text", "shard", "old_shard", "cell", "n_bytes")
    table = docs.sparkSession.createDataFrame(plan, "old_shard string, cell int, block int, new_shard string, moved boolean")
    return tagged.join(_sized(table, len(plan)), ["old_shard", "cell"]).select("doc_id", "old_shard", "block", "new_shard", "moved", "n_bytes")


def _sized(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows * 100 <= BROADCAST_BYTES else table


def rewrite_affected(docs: DataFrame, path: str, capacities: dict[str, int] | None = None, id_col: str = "doc_id", text: str = "text", shard: str = "source", blocks: int = BLOCKS) -> tuple[DataFrame, list[str]]:
    """Write, under path, the shards that a move takes from or adds to (folder shard=NAME), with all columns of docs; others are not read for it.

    Returns what was written (columns of docs and "shard" under a fresh name) and the names of shards left as they are.
    """
    plan = reshard_plan(docs, capacities, id_col, text, shard, blocks)
    touched = sorted({x for a, _, _, b, moved in plan if moved for x in (a, b)})
    old, cell, size, new = (fresh(docs, n) for n in ("old_shard", "cell", "n_bytes", "new_shard"))
    part = docs.where(_shard(col(shard)).isin(touched)) if touched else docs.limit(0)
    table = docs.sparkSession.createDataFrame([(a, c, b) for a, c, _, b, _ in plan if a in touched], f"`{old}` string, `{cell}` int, `{new}` string")
    out = _tagged(part, id_col, text, shard, old, cell, size).join(_sized(table, len(plan)), [old, cell]).select(*cols(docs), new)
    # rows of a shard go together, and a shard larger than a task should read is split
    out.hint("rebalance", new).write.partitionBy(new).parquet(path)
    # a partition column's empty string is read back as null
    back = docs.sparkSession.read.option("basePath", path).schema(out.schema).parquet(path) if touched else out
    return back.withColumn(new, F.coalesce(new, F.lit(""))), sorted({a for a, *_ in plan} - set(touched))


def resharded(docs: DataFrame, path: str, capacities: dict[str, int] | None = None, id_col: str = "doc_id", text: str = "text", shard: str = "source", blocks: int = BLOCKS) -> DataFrame:
    """Rewrite what the plan touches under path, then list the new layout: (doc_id, old_shard, new_shard, rewritten, n_bytes) of every row.

    Rows of touched shards are read from the rewritten files, the others from where they stay. Nulls and empty tables as in :func:`reshard`.
    """
    files, rest = rewrite_affected(docs, path, capacities, id_col, text, shard, blocks)
    size = F.coalesce(F.octet_length(col(text)), F.lit(0)).cast("bigint").alias("n_bytes")
    new = files.select(col(id_col).alias("doc_id"), _shard(col(shard)).alias("old_shard"), F.col(files.columns[-1]).alias("new_shard"), F.lit(True).alias("rewritten"), size)
    still = docs.where(_shard(col(shard)).isin(rest)) if rest else docs.limit(0)
    return new.unionByName(still.select(col(id_col).alias("doc_id"), _shard(col(shard)).alias("old_shard"), _shard(col(shard)).alias("new_shard"), F.lit(False).alias("rewritten"), size))
