"""Best-fit packing into sequences of several permitted lengths.

Pieces (documents, or parts of one that exceeds the longest sequence) go longest first into
the open bin with the least room that still holds them. Where none does, a bin of the
permitted length with the least cost per token is opened. A sequence of c tokens costs
c + c * c / `ATTENTION` + `OVERHEAD`: padding costs as much as text, and attention makes long
sequences dearer, so short ones win where pieces fill them and long ones where pieces would
leave them half empty. What a new bin is likely to hold is read from the pieces still to come:
the longest that fit its room, one after another. At the end each bin shrinks to the shortest
permitted length that holds its contents. Bins that opened by such a forecast compete for the
same pieces, so a group is also packed with each least length in its place, and the cheapest
of these packings is kept.

Pieces are dealt by hash into groups of a bounded size, each packed by itself; the number of
groups grows with the pieces, and only ids and lengths are shuffled.

Defined results
* null text: length 0 plus the end mark. Longer than the longest sequence: split, not cut.
* repeated rows: each is packed; equal lengths go in the order of id, part.
* empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skeinworks.session import reach_workers, stored

#: Permitted sequence lengths, in tokens.
CAPACITIES = (2048, 4096, 8192, 16384, 32768)
#: What a sequence costs besides its tokens, and the length at which attention costs as much
#: as all else.
OVERHEAD, ATTENTION = 64, 1 << 17
#: Pieces to a group; groups to a task once there are more than so many tasks.
GROUP_PIECES, TASKS, TASK_GROUPS = 8192, 8192, 64

SCHEMA = "{key} long, part int, part_start long, n_tokens long, bin string, bin_capacity int, bin_used int, bin_offset int"


def sequence_cost(capacity: int, overhead: int = OVERHEAD, attention: int = ATTENTION) -> float:
    return capacity + capacity * capacity / attention + overhead


def likely_used(lengths: list[int], at: int, capacity: int) -> int:
    """Tokens that a bin opened for lengths[at] holds, if the longest of the later ones that
    fit go there in turn. lengths: longest first."""
    room, place = capacity - lengths[at], at + 1
    while room and (place := bisect_left(lengths, -room, lo=place, key=int.__neg__)) < len(lengths):
        room -= lengths[place]
        place += 1
    return capacity - room


def opening_capacity(lengths: list[int], at: int, capacities=CAPACITIES, cost: Callable[[int], float] = sequence_cost) -> int:
    """The capacity with the least cost per token likely to be held; the smaller of equals."""

    def price(capacity: int) -> tuple[float, int]:
        used = likely_used(lengths, at, capacity)
        return cost(next(c for c in capacities if c >= used)) / used, capacity

    return min((c for c in capacities if c >= lengths[at]), key=price)


def _packed(lengths: list[int], capacities: list[int], opening: Callable[[int], int]) -> tuple[list[int], list[int], list[int]]:
    room: list[tuple[int, int]] = []  # (free, bin), ascending
    used, bins, offsets = [], [], []
    for k, n in enumerate(lengths):
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            b, free = len(used), opening(k)
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        if free > n:
            insort(room, (free - n, b))
    return bins, offsets, [next(c for c in capacities if c >= u) for u in used]


def best_fit(lengths: list[int], capacities=CAPACITIES, cost: Callable[[int], float] = sequence_cost) -> tuple[list[int], list[int], list[int]]:
    """lengths: in the order to pack, longest first, none above the largest capacity.
    Returns each piece's bin and offset, and each bin's capacity after downsizing."""
    capacities = sorted(capacities)
    rules = [lambda k: opening_capacity(lengths, k, capacities, cost)]
    rules += [lambda k, least=c: next(c for c in capacities if c >= max(least, lengths[k])) for c in capacities]
    found = [_packed(lengths, capacities, rule) for rule in rules]
    return min(found, key=lambda f: sum(map(cost, f[2])))


def pack(docs: DataFrame, length, key: str = "doc_id", capacities=CAPACITIES, cost: Callable[[int], float] = sequence_cost, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """length: a column, the tokens of a row without its end mark, which adds one.
    One row per piece: where it starts in its document, its bin, the bin's final capacity
    and fill, and its offset there."""
    reach_workers(docs.sparkSession)
    top = max(capacities)
    # Stored, so that a row that is read again by a retry has the same number.
    rows = stored(docs.select(F.col(key).cast("long").alias(key), (F.coalesce(length, F.lit(0)).cast("long") + 1).alias("__n")), "packing")
    count = rows.agg(F.sum(F.ceil(F.col("__n") / top))).first()[0] or 0
    groups = max(1, math.ceil(count / group_pieces))
    tasks = min(groups, max(TASKS, groups // TASK_GROUPS))
    pieces = (
        rows.withColumn("part", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("__n") / top) - 1).cast("int"))))
        .withColumn("part_start", F.col("part").cast("long") * top)
        .withColumn("n_tokens", F.least(F.lit(top), F.col("__n") - F.col("part_start")))
        # The row's number parts the copies of one id.
        .withColumn("__g", F.pmod(F.xxhash64(F.col(key), F.col("part"), F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
        .drop("__n")
    )

    def group(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        lengths = rows.column("n_tokens").to_numpy()
        bins, offsets, sizes = (np.array(x, np.int32) for x in best_fit(lengths.tolist(), capacities, cost))
        used = np.bincount(bins, lengths).astype(np.int32)
        names = pa.array([f"{number}-{b}" for b in bins.tolist()])
        return pa.RecordBatch.from_arrays([*(rows.column(c) for c in (key, "part", "part_start", "n_tokens")), names, pa.array(sizes[bins]), pa.array(used[bins]), pa.array(offsets)], names=[key, "part", "part_start", "n_tokens", "bin", "bin_capacity", "bin_used", "bin_offset"])

    def run(batches):
        """A task's groups, one after another, as they come sorted."""
        held, now = [], None
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column("__g").to_numpy()
            edge = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            for a, z in zip(edge, edge[1:]):
                if held and g[a] != now:
                    yield group(now, held)
                    held = []
                now = int(g[a])
                held.append(b.slice(a, z - a))
        if held:
            yield group(now, held)

    dealt = pieces.repartitionById(tasks, F.col("__g") % tasks).sortWithinPartitions("__g", F.desc("n_tokens"), F.asc_nulls_first(key), "part")
    return dealt.mapInArrow(run, SCHEMA.format(key=key))
