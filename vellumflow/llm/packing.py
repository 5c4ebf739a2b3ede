"""First-fit decreasing packing of items into containers of a fixed capacity.

Items are spread over randomised groups by a hash of their id; each group is packed on its
own, so nothing but ``(id, size)`` is shuffled and no group grows with the corpus: their
number is the number of rows over ``group_rows``. A group leaves at most a few containers
half empty, which among ``group_rows`` items is a small fraction of a percent.

Inside a group the containers are the leaves of a tournament tree whose inner nodes hold
the largest room below them; the first container with enough room is found in one descent.

Results for odd input: an item of size 0, NULL or below counts as size 0 and is placed in a
container; an item above the capacity is cut into full pieces and a rest (``piece_no`` from
0, ``item_start`` and ``item_end`` say which part); an id delivered several times is packed
once, with its largest size; a NULL id is an id of its own; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_ROWS = 20_000


class RoomTree:
    """Rooms of ``n`` containers; finds the first with at least ``size`` free."""

    def __init__(self, n: int, capacity: int):
        self.leaves = 1 << max(0, (n - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def take(self, size: int) -> int:
        room, node = self.room, 1
        if room[1] < size:
            raise ValueError("no container has that much room")
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        place = node - self.leaves
        room[node] -= size
        node //= 2
        while node:
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
            node //= 2
        return place


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item. Equal sizes keep their order; no size may exceed ``capacity``."""
    sizes = np.asarray(sizes, dtype=np.int64)
    places = np.zeros(len(sizes), dtype=np.int64)
    if not len(sizes):
        return places
    tree = RoomTree(len(sizes), capacity)
    for item in np.argsort(-sizes, kind="stable"):
        places[item] = tree.take(int(sizes[item]))
    return places


def pack(sizes: DataFrame, capacity: int, id_col: str = "doc_id", size_col: str = "n_tokens", n_rows: int | None = None, group_rows: int = GROUP_ROWS, seed: int = 17) -> DataFrame:
    """``id_col, piece_no, item_start, item_end, size, container_id`` of every item.

    ``n_rows`` is the number of rows of ``sizes`` if it is known more cheaply than by
    counting it.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    n_rows = sizes.count() if n_rows is None else n_rows
    groups = max(1, -(-n_rows // group_rows))
    once = sizes.groupBy(F.col(id_col).alias("id")).agg(F.greatest(F.lit(0), F.coalesce(F.max(size_col), F.lit(0))).cast("bigint").alias("whole"))
    pieces = (
        once.withColumn("group", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(groups)))
        .withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("whole") - 1) / capacity)).cast("int"))))
        .withColumn("item_start", (F.col("piece_no") * F.lit(capacity).cast("bigint")))
        .withColumn("item_end", F.least(F.col("whole"), F.col("item_start") + capacity))
        .select("group", "id", "piece_no", "item_start", "item_end")
    )
    kind = once.schema["id"].dataType.simpleString()

    def run(key: tuple, items: pa.Table) -> pa.Table:
        items = items.take(pc.sort_indices(items, sort_keys=[("id", "ascending"), ("piece_no", "ascending")]))
        size = pc.subtract(items["item_end"], items["item_start"])
        container = (key[0].as_py() << 32) + first_fit_decreasing(size.to_numpy(), capacity)
        names = ["id", "piece_no", "item_start", "item_end", "size", "container_id"]
        return pa.table([items["id"], items["piece_no"], items["item_start"], items["item_end"], size, pa.array(container)], names=names)

    packed = pieces.groupBy("group").applyInArrow(run, f"id {kind}, piece_no int, item_start bigint, item_end bigint, size bigint, container_id bigint")
    return packed.withColumnRenamed("id", id_col)
