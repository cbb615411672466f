"""Mixing sources to target weights by fitting each source's token budget exactly.

Documents are counted by source and exact length in tokens. Of each length an even share is taken first; what is left of the budget is
fitted by a bounded-knapsack search over the documents not taken and some that are given back for it, ever more of them until
the tokens sum to the budget or nothing more can be given back. The result is a number of documents for each source and length, and a seeded order says which ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.shared import BROADCAST_BYTES, col, cols, fresh, written

TEMPER = 0.75
KEEP = 0.5  #: share of the tokens that a mixture without a total has at least
SEED = 11
STRIDE = 64  #: of the search's integers, each so many steps one is held
ROOM, MOST = 4, 64  #: tokens that the search may exchange at first and at last, in longest lengths
HOT = 100_000  #: rows of one source and length that one task orders, about


def token_length(text: Column) -> Column:
    """Words between white space; 0 for null and empty texts."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("bigint")


def knapsack(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many items of each positive length sum to the largest total that is at most budget: bounded subset sum, exact.

    Reachable sums are the bits of one integer; an item class of c equal lengths is added in pieces of 1, 2, 4, ... items.
    Only each STRIDE-th integer is held, the ones between are made again on the way back. Among equal totals the choice depends on
    nothing but the arguments.
    """
    target = min(budget, sum(k * c for k, c in counts.items()))
    if target <= 0:
        return {}
    mask, reach, steps, held = (1 << (target + 1)) - 1, 1, [], [1]
    for length in sorted((k for k in counts if 0 < k <= target), reverse=True):
        left, piece = min(counts[length], target // length), 1
        while left > 0 and not reach >> target & 1:
            n = min(piece, left)
            steps.append((length, n))
            reach |= (reach << (length * n)) & mask
            if len(steps) % STRIDE == 0:
                held.append(reach)
            left -= n
            piece *= 2
        if reach >> target & 1:
            break
    at, taken = reach.bit_length() - 1, {}
    for first in range((len(steps) - 1) // STRIDE * STRIDE, -1, -STRIDE):
        part, before = steps[first : first + STRIDE], [held[first // STRIDE]]
        for length, n in part[:-1]:
            before.append(before[-1] | (before[-1] << (length * n)) & mask)
        for (length, n), sums in zip(reversed(part), reversed(before)):
            if not sums >> at & 1:
                at -= length * n
                taken[length] = taken.get(length, 0) + n
    return taken


def fit_budget(counts: dict[int, int], budget: int) -> dict[int, int]:
    """Items of each length so that the total is budget if that can be, else the largest total found below it.

    The even share floor(count * budget / total) of each length is taken; of each length, as many as make ROOM times the longest length in
    all are then given back, and what is missing is fitted by :func:`knapsack` over all that isn't taken. If the budget isn't met, twice as
    much is given back, up to MOST times the longest length. Budgets below that are thus fitted exactly; a larger one that is missed, by
    less than the shortest length's multiples allow, would need more documents exchanged than that.
    """
    counts = {k: c for k, c in counts.items() if k > 0 and c > 0}
    total = sum(k * c for k, c in counts.items())
    if budget >= total:
        return counts
    if budget <= 0:
        return {}
    unit = math.gcd(*counts)
    if unit > 1:
        return {k * unit: n for k, n in fit_budget({k // unit: c for k, c in counts.items()}, budget // unit).items()}
    share = {k: c * budget // total for k, c in counts.items()}
    longest, room, best = max(counts), ROOM, ({}, -1)
    while True:
        # give back of each length in proportion to its share, and at least one of each while there is room
        back, left = {}, room * longest
        held = sum(k * n for k, n in share.items())
        for k in sorted(counts):
            back[k] = min(share[k], max(1, -(-share[k] * room * longest // max(held, 1))), left // k)
            left -= back[k] * k
        base = {k: share[k] - back[k] for k in counts}
        rest = budget - sum(k * n for k, n in base.items())
        # an even share leaves less than one item of each length over: most of that is filled from the longest down
        cap = (room + ROOM) * longest
        for k in sorted(counts, reverse=True):
            n = min(counts[k] - base[k], max(0, (rest - cap) // k))
            base[k] += n
            rest -= n * k
        more = knapsack({k: counts[k] - base[k] for k in counts}, rest)
        got = budget - rest + sum(k * n for k, n in more.items())
        if got > best[1]:
            best = {k: n + more.get(k, 0) for k, n in base.items()}, got
        if got == budget or room >= MOST or room * longest >= 2 * budget:
            return {k: n for k, n in best[0].items() if n}
        room *= 2


def tempered_weights(tokens: dict[str | None, int], temper: float = TEMPER) -> dict[str | None, float]:
    """Weights in proportion to each source's tokens to the power temper: large sources count for less."""
    raised = {s: float(t) ** temper for s, t in tokens.items() if t > 0}
    return {s: w / sum(raised.values()) for s, w in raised.items()}


def budgets(tokens: dict[str | None, int], weights: dict[str | None, float], total: int | None = None) -> dict[str | None, int]:
    """Tokens wanted of each source; one that has fewer than its weight asks for gives all, and the others share what it lacks by their weights.

    Without a total, the largest that no source falls short of, but no less than the share KEEP of all tokens: a tiny source
    doesn't shrink the mixture to its measure. Sources without a weight get none.
    """
    live = {s: w for s, w in weights.items() if w > 0}
    if total is None:
        scale = sum(live.values())
        total = max(min((int(tokens.get(s, 0) * scale / w) for s, w in live.items()), default=0), int(KEEP * sum(tokens.get(s, 0) for s in live)))
    out: dict[str | None, int] = {}
    while True:
        scale = sum(live.values())
        wanted = {s: round(total * w / scale) for s, w in live.items()}
        short = [s for s, n in wanted.items() if tokens.get(s, 0) < n]
        if not short:
            return out | wanted
        for s in short:
            out[s] = tokens.get(s, 0)
            total -= out[s]
            del live[s]


def _chosen(docs: DataFrame, id_col: str, text: str, source: str, weights, total, seed: int, names: tuple[str, str, str, str, str]) -> DataFrame:
    """docs with columns source, length, order of the chosen rows only."""
    src, size, order, cut, key = names
    spark = docs.sparkSession
    tagged = docs.withColumns({src: col(source), size: token_length(col(text)), order: F.xxhash64(col(id_col), col(text), F.lit(seed))})
    places = written(tagged.where(F.col(size) > 0).select(src, size, order), "places")
    # one row for each source and length: bounded by the sources and the longest text, not by the number of documents
    table = places.groupBy(src, size).count().toArrow().to_pylist()
    counts: dict[str | None, dict[int, int]] = {}
    for row in table:
        counts.setdefault(row[src], {})[row[size]] = row["count"]
    tokens = {s: sum(k * c for k, c in own.items()) for s, own in counts.items()}
    wanted = budgets(tokens, tempered_weights(tokens) if weights is None else weights, total)
    fitted = {s: fit_budget(counts[s], wanted[s]) for s in wanted if s in counts}
    # a common length is cut by the first bits of its order into so many parts that a task can order one
    quota = [(s, k, n, n == counts[s][k], 64 - math.ceil(math.log2(counts[s][k] / HOT)) if counts[s][k] > HOT else 63) for s in sorted(fitted, key=str) for k, n in sorted(fitted[s].items())]
    quotas = spark.createDataFrame(quota, f"`{src}` {dict(places.dtypes)[src]}, `{size}` bigint, n bigint, every boolean, shift int")
    small = len(quota) * 64 <= BROADCAST_BYTES
    on = lambda a, b: a[src].eqNullSafe(b[src]) & (a[size] == b[size])
    partial = F.broadcast(quotas.where("not every")) if small else quotas.where("not every")
    # the order of the last row that each source and length may give; rows before it are taken where they are
    asked = places.join(partial, on(places, partial)).select(places[src], places[size], places[order], "n", F.expr(f"shiftright(`{order}`, shift)").alias("part"))
    parts = written(asked.groupBy(src, size, "part", "n").count(), "parts")
    before = F.sum("count").over(Window.partitionBy(src, size).orderBy("part")) - F.col("count")
    last_part = parts.withColumn("before", before).where("before < n and n <= before + count").select(src, size, "part", (F.col("n") - F.col("before")).alias("n"))
    last_part = F.broadcast(last_part) if small else last_part
    among = asked.drop("n").join(last_part, asked[src].eqNullSafe(last_part[src]) & (asked[size] == last_part[size]) & (asked["part"] == last_part["part"]))
    ranked = among.select(asked[src], asked[size], asked[order], asked["part"], "n").withColumn("place", F.row_number().over(Window.partitionBy(src, size, "part").orderBy(order)))
    last = ranked.where("place = n").select(F.col(src).alias(key + "s"), F.col(size).alias(key + "k"), F.col(order).alias(cut))
    whole = quotas.where("every").select(F.col(src).alias(key + "s"), F.col(size).alias(key + "k"), F.lit((1 << 63) - 1).alias(cut))
    cuts = written(last.unionByName(whole), "cuts")
    if small:
        cuts = F.broadcast(cuts)
    return tagged.join(cuts, tagged[src].eqNullSafe(F.col(key + "s")) & (tagged[size] == F.col(key + "k"))).where(F.col(order) <= F.col(cut))


def select_mixture(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: dict[str | None, float] | None = None, total: int | None = None, seed: int = SEED) -> DataFrame:
    """docs reduced to a mixture in which each source has its share of tokens, to the token where lengths allow; all columns stay.

    weights: by source, null being a source of its own; None tempers the sources' own sizes. total: tokens wanted; None
    takes the most that no source falls short of, but half of all tokens at least. A source with too few tokens gives all it has and the
    others make up for it. Null and empty texts have
    no tokens and are never chosen. The seeded order is by a hash of id and text: rows equal in both share one place, and
    are taken together if the first of them is. Texts of any length are read whole. An empty table gives an empty result. Columns may have any names.
    """
    names = tuple(fresh(docs, n) for n in ("mix_src", "mix_len", "mix_order", "mix_cut", "mix_key"))
    return _chosen(docs, id_col, text, source, weights, total, seed, names).select(*cols(docs))


def mixture(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights=None, total=None, seed: int = SEED) -> DataFrame:
    """(doc_id, source, n_tokens) of what :func:`select_mixture` chooses, with its choices for nulls, ties, empty and long texts and empty tables."""
    names = ("mix_src", "mix_len", "mix_order", "mix_cut", "mix_key")
    own = docs.select(col(id_col).alias("doc_id"), col(text).alias("text"), col(source).alias("source"))
    return _chosen(own, "doc_id", "text", "source", weights, total, seed, names).select("doc_id", "source", F.col("mix_len").alias("n_tokens"))
