"""Items of varying length put into containers of fixed capacity, little space unused.

Only sizes matter to a packing, and there are no more of them than the largest capacity, so the
packing is worked out on the histogram of sizes (bounded by the capacity, not by the data): best fit,
sizes from large to small, alike containers handled as one group with a count. Where several capacities
are permitted, a new container takes the one of least cost; each rule of opening is tried and the best
kept; at the end every container is downsized to the smallest capacity that holds its contents.
Items then find their container from their rank among the items of their size.

An item larger than the largest capacity is divided, into pieces of that capacity and a rest; no
other item is. Items without tokens (null, empty texts) take no space and lie in the first container.
Ties in size are ordered by id; repeated ids are items of their own.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatum.functions.arrow import arrow
from probatum.operators.ranking import numbered


def _open_least_waste(size: int, count: int, capacities: list[int]) -> int:
    """The capacity that leaves the least share unused when filled with items of this size; the larger at a tie."""
    fits = [c for c in capacities if c >= size]
    return min(fits, key=lambda c: (1 - min(count, c // size) * size / c, -c))


def _open_largest(size: int, count: int, capacities: list[int]) -> int:
    return capacities[-1]


def _open_smallest(size: int, count: int, capacities: list[int]) -> int:
    return next(c for c in capacities if c >= size)


OPENINGS = (_open_least_waste, _open_largest, _open_smallest)


def _pack(histogram: dict[int, int], capacities: list[int], opening) -> list[tuple[int, int, tuple]]:
    """(containers, room left, contents) of each group; contents is a chain (size, items of it, what was in before)."""
    groups: dict[int, list[tuple[int, tuple]]] = defaultdict(list)
    rooms: list[int] = []

    def put(room: int, count: int, contents: tuple) -> None:
        if not groups[room]:
            insort(rooms, room)
        groups[room].append((count, contents))

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            at = bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                count, contents = groups[room].pop()
                if not groups[room]:
                    rooms.pop(at)
            else:
                room = opening(size, left, capacities)
                count, contents = -(-left // (room // size)), (room, 0, ())
            each = room // size
            full = min(count, left // each)
            rest = left - full * each if full < count else 0
            if full:
                put(room - full // full * each * size, full, (size, each, contents))
                left -= full * each
            if 0 < rest < each and full < count:
                put(room - rest * size, 1, (size, rest, contents))
                left -= rest
                full += 1
            if count > full:
                put(room, count - full, contents)
    return [(count, room, contents) for room in rooms for count, contents in groups[room]]


def plan(histogram: dict[int, int], capacities: list[int]) -> tuple[dict[int, np.ndarray], dict]:
    """Slots per size (rows: first rank, first container, items a container, capacity) and totals of the best packing."""
    capacities = sorted(set(capacities))
    best = None
    for opening in OPENINGS if len(capacities) > 1 else OPENINGS[1:2]:
        groups, cost = [], 0
        for count, room, contents in _pack(histogram, capacities, opening):
            items, chain = [], contents
            while chain[2]:
                items.append((chain[0], chain[1]))
                chain = chain[2]
            used = chain[0] - room
            capacity = next(c for c in capacities if c >= used)
            groups.append((count, capacity, used, items))
            cost += count * capacity
        if best is None or cost < best[0]:
            best = (cost, groups)
    slots: dict[int, list] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    number = 0
    for count, capacity, used, items in sorted(best[1], key=lambda g: (-g[2], -g[0], g[3])):
        for size, each in items:
            slots[size].append((taken[size], number, each, capacity))
            taken[size] += count * each
        number += count
    return {s: np.array(rows, dtype=np.int64) for s, rows in slots.items()}, {"containers": number, "cost": best[0]}


def pack(items: DataFrame, specs: dict[int, list[int]]) -> DataFrame:
    """The containers of items(doc_id, tokens) for each pack of specs (pack id to its capacities).

    (pack_id, container_id, capacity_tokens, doc_id, piece, n_pieces, tokens): one row per piece.
    """
    packs = F.array(*[F.struct(F.lit(p).cast("int").alias("pack_id"), F.lit(max(c)).cast("int").alias("most")) for p, c in specs.items()])
    each = (
        items.select("doc_id", "tokens", F.explode(packs).alias("pack"))
        .select("doc_id", "tokens", "pack.*")
        .withColumn("n_pieces", F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("most"))).cast("int"))
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
        .withColumn("size", F.least(F.col("most"), F.col("tokens") - F.col("piece") * F.col("most")).cast("int"))
        .select("pack_id", "doc_id", "piece", "n_pieces", "size")
    )
    ranked = numbered(each, ["pack_id", "size"], ["doc_id", "piece"], "rank")
    counts: dict[int, dict[int, int]] = {p: {} for p in specs}
    for r in ranked.groupBy("pack_id", "size").agg(F.max("rank").alias("last")).collect():  # at most a row per size and pack
        if r["size"]:
            counts[r["pack_id"]][r["size"]] = r["last"] + 1
    plans = {p: plan(h, specs[p])[0] if h else {} for p, h in counts.items()}
    smallest = {p: min(c) for p, c in specs.items()}

    @arrow("struct<container:long,capacity:int>")
    def place(pack_ids: pd.Series, sizes: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(sizes), 2), dtype=np.int64)
        frame = pd.DataFrame({"p": pack_ids.to_numpy(), "s": sizes.to_numpy()})
        for (p, s), at in frame.groupby(["p", "s"]).indices.items():
            if not s:
                out[at] = (0, max(smallest[p], 0))
                continue
            slots = plans[p][s]
            rank = ranks.to_numpy()[at]
            row = slots[np.searchsorted(slots[:, 0], rank, side="right") - 1]
            out[at, 0] = row[:, 1] + (rank - row[:, 0]) // row[:, 2]
            out[at, 1] = row[:, 3]
        return pd.DataFrame({"container": out[:, 0], "capacity": out[:, 1].astype(np.int32)})

    placed = ranked.withColumn("at", place("pack_id", "size", "rank"))
    first = {p: int(next((r[3] for s in plans[p].values() for r in s if r[1] == 0), smallest[p])) for p in specs}
    capacity = F.coalesce(*[F.when((F.col("pack_id") == p) & (F.col("size") == 0), c) for p, c in first.items()], F.col("at.capacity"))
    return placed.select(
        "pack_id", F.col("at.container").alias("container_id"), capacity.cast("int").alias("capacity_tokens"),
        "doc_id", (F.col("piece") + 1).alias("piece"), "n_pieces", F.col("size").alias("tokens"),
    )
