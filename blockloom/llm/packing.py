"""Filling containers of fixed capacity: sum-of-squares online packing.

Containers are kept by how full they are. Each item goes to the level where it keeps the sum of the squared numbers of
partly filled containers of every level least; full containers do not count. Ties go to the fullest level.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


class SumOfSquares:
    def __init__(self, capacity: int):
        if capacity < 1:
            raise ValueError("the capacity must be positive")
        self.capacity = capacity
        self.level = np.zeros(capacity + 1, dtype=np.int64)  # open containers by fill; full ones stay 0
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, size: int, new: int) -> int:
        """The container for an item of ``size``; ``new`` is the name of a container that is opened for it."""
        cap, n = self.capacity, self.level
        if not 0 < size <= cap:
            raise ValueError("the item must fit a container")
        # change of the sum of squares, by the fill before: 2 (N[h+s] - N[h]) + 2, without what does not count
        cost = 2 * (n[size:] - n[: cap - size + 1]) + 2
        cost[-1] -= 1  # fills up: the container leaves the sum
        cost[0] = 2 * n[size] + 1 if size < cap else 0
        free = n[: cap - size + 1] > 0
        free[0] = True
        cost = np.where(free, cost, np.iinfo(np.int64).max)
        h = len(cost) - 1 - int(np.argmin(cost[::-1]))
        name = new
        if h:
            name = self.open[h].pop()
            n[h] -= 1
        if h + size < cap:
            self.open[h + size].append(name)
            n[h + size] += 1
        return name


#: Containers that one packer is meant to fill, whatever the session; their number decides how many packers there are.
CONTAINERS = 2_000
#: Share of a container that is good enough; what is filled less by one packer is packed once more with that of others.
GOOD = 0.985
ROUNDS = 3

COLUMNS = ("id", "piece_no", "n_pieces", "size", "container_item", "container_piece", "open")
TYPES = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())
SCHEMA = "id long, piece_no int, n_pieces int, size long, container_item long, container_piece int, open boolean"


def _pack(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, rows, filled = SumOfSquares(capacity), [], Counter()
        for b in batches:  # about CONTAINERS containers' worth of pieces
            for i, k, pieces, n in zip(*(c.to_pylist() for c in b.columns)):
                # a container is named after the item that opened it and the number of its piece
                named = packer.place(n, (i, k)) if n < capacity else (i, k)
                filled[named] += n
                rows.append((i, k, pieces, n, named))
        for a in range(0, len(rows), 50_000):
            cols = zip(*((i, k, pieces, n, *named, filled[named] < GOOD * capacity) for i, k, pieces, n, named in rows[a : a + 50_000]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, TYPES)], names=list(COLUMNS))

    return run


def pack(sizes: DataFrame, capacity: int) -> DataFrame:
    """Items to containers of ``capacity``.

    ``sizes`` has ``id`` (long, unique) and ``size``. An item that exceeds the capacity, and no other, is split: into
    full containers and one rest, which is packed like any item. Items of size 0 or null need no room and do not come
    out. A container is named by the item and piece that opened it.

    Only ids and sizes are shuffled. The number of packers follows from the total size and the capacity, and which item
    goes to which packer from its id, so that the result depends on neither partitions nor cores. What a packer leaves
    in containers that are not well filled is a small part of its share; these pieces are packed again, by as many
    packers as they need, and so once more.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    items = sizes.where("size > 0").select(F.col("id").cast("long").alias("id"), F.col("size").cast("long").alias("size"))
    n_pieces = F.ceil(F.col("size") / capacity).cast("int")
    pieces = items.select("id", "size", n_pieces.alias("n_pieces"), F.explode(F.sequence(F.lit(0), n_pieces - 1)).alias("piece_no"))
    pieces = stored(pieces.select("id", "piece_no", "n_pieces", F.least(F.lit(capacity), F.col("size") - F.col("piece_no") * F.lit(capacity).cast("long")).alias("size")), "pieces")
    closed = None
    for k in range(ROUNDS):
        total = pieces.agg(F.sum("size")).first()[0] or 0
        packers = max(-(-total // (capacity * CONTAINERS)), 1)
        own = F.xxhash64("id", F.lit(k))  # items meet others in every round
        rows = pieces.repartition(packers, own).sortWithinPartitions(own, "id", "piece_no").mapInArrow(_pack(capacity), SCHEMA)
        last = k == ROUNDS - 1 or packers == 1
        rows = rows if last else stored(rows, "packed")
        good = rows.drop("open") if last else rows.where("not open").drop("open")
        closed = good if closed is None else closed.unionByName(good)
        if last:
            return closed
        pieces = rows.where("open").select("id", "piece_no", "n_pieces", "size")


def fill(packed: DataFrame) -> DataFrame:
    """One row per container: number of items and size."""
    return packed.groupBy("container_item", "container_piece").agg(F.count("*").alias("n_items"), F.sum("size").alias("filled"))
