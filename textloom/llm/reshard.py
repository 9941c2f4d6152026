"""Resharding by minimum-cost flow.

Documents lie in old shards. Each old shard is cut into ``BLOCKS`` blocks by a hash of its
rows and their places in the input; the sizes of all blocks (shards times ``BLOCKS`` numbers, whatever the size of the
corpus) go to the driver. There a flow network from old to new shards is solved: staying
costs nothing, moving a byte costs one, every new shard takes an equal share. The flow says
how many bytes go from which shard to which; blocks are chosen to match it. The map from
blocks to shards is small and is broadcast, so a document finds its shard without a
shuffle, and ``rewrite`` writes only shards whose contents change.

The law is ``bytes``: sizes are near equal, apart by about a block. Groups (equal texts)
need not stay together. A null text has no bytes; a null doc_id is an id like any other;
repeated rows are rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window, functions as F

from textloom.sources.tables import checkpoint, checkpoint_folder

BLOCKS = 1024
#: Bytes of text that one task writes of a shard.
TASK_BYTES = 256 << 20
ROW_BYTES = 16


def min_cost_flow(supply: dict[int, int], room: dict[int, int], cost=lambda i, j: int(i != j)) -> dict[tuple[int, int], int]:
    """Cheapest flow of all supply into the room, by successive shortest paths.

    Nodes are shards, so the network is small; each path fills a supply, a room or an arc.
    """
    left, free, flow = dict(supply), dict(room), {}
    while any(left.values()):
        # Bellman-Ford from all old shards with supply; arcs back undo earlier flow.
        dist = {("old", i): 0 for i in supply if left[i] > 0}
        come: dict = {}
        for _ in range(len(supply) + len(room)):
            changed = False
            for i in supply:
                if ("old", i) not in dist:
                    continue
                for j in room:
                    d = dist["old", i] + cost(i, j)
                    if d < dist.get(("new", j), float("inf")):
                        dist["new", j], come["new", j], changed = d, ("old", i), True
            for (i, j), f in flow.items():
                if f > 0 and ("new", j) in dist and dist["new", j] - cost(i, j) < dist.get(("old", i), float("inf")):
                    dist["old", i], come["old", i], changed = dist["new", j] - cost(i, j), ("new", j), True
            if not changed:
                break
        ends = [(dist["new", j], j) for j in room if free[j] > 0 and ("new", j) in dist]
        if not ends:
            raise ValueError("the new shards have too little room")
        node = ("new", min(ends)[1])
        path = [node]
        while node in come:
            node = come[node]
            path.append(node)
        path.reverse()
        amount = min(left[path[0][1]], free[path[-1][1]])
        for a, b in zip(path, path[1:]):
            if a[0] == "new":
                amount = min(amount, flow[b[1], a[1]])
        for a, b in zip(path, path[1:]):
            if a[0] == "old":
                flow[a[1], b[1]] = flow.get((a[1], b[1]), 0) + amount
            else:
                flow[b[1], a[1]] -= amount
        left[path[0][1]] -= amount
        free[path[-1][1]] -= amount
    return {k: v for k, v in flow.items() if v}


def choose_blocks(blocks: dict[tuple[int, int], int], shards: int) -> dict[tuple[int, int], int]:
    """New shard of every block (old shard, block): size; follows the cheapest flow.

    Of each old shard, blocks are taken largest first into the arc with the most room
    left; what fits nowhere goes to the new shard that has most room.
    """
    supply: dict[int, int] = {}
    for (old, _), size in blocks.items():
        supply[old] = supply.get(old, 0) + size
    total = sum(supply.values())
    room = {j: total // shards + (j < total % shards) for j in range(shards)}
    flow = min_cost_flow(supply, room)
    place, rest = {}, []
    for old in sorted(supply):
        arcs = {j: f for (i, j), f in flow.items() if i == old}
        for block, size in sorted(((b, s) for (i, b), s in blocks.items() if i == old), key=lambda x: (-x[1], x[0])):
            j = old if arcs.get(old, 0) >= size else max(arcs, key=lambda k: (arcs[k], -k))
            if arcs[j] < size:
                rest.append((size, old, block))
                continue
            arcs[j] -= size
            room[j] -= size
            place[old, block] = j
    for size, old, block in sorted(rest, key=lambda x: (-x[0], x[1:])):
        j = max(room, key=lambda k: (room[k], k == old, -k))
        room[j] -= size
        place[old, block] = j
    return place


def size_of(text) -> "F.Column":
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def reshard(docs: DataFrame, old, shards: int, blocks: int = BLOCKS) -> DataFrame:
    """Documents with ``size``, ``old_shard``, ``block``, ``shard``, ``slot_base`` and ``part``.

    ``old`` is the column of old shard numbers. ``slot_base`` is the first slot of the
    row's block in its shard, ``part`` the piece of the shard that a task writes.
    Columns of these names are replaced.
    """
    spark = docs.sparkSession
    names = ("size", "old_shard", "block", "shard", "slot_base", "part")
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        # A shuffle may deal its rows anew when it runs again; a written table does not.
        docs = checkpoint(docs)
    # The place of a row in the input tells repeated rows apart, so that no block outgrows others.
    block = F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    rows = docs.select(
        *(F.col(f"`{c}`") for c in docs.columns if c not in names), size_of(F.col("text")).alias("size"), old.cast("int").alias("old_shard"), block.alias("block")
    )
    sizes = rows.groupBy("old_shard", "block").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    place = choose_blocks({(r.old_shard, r.block): r.size for r in sizes}, shards)
    totals: dict[int, int] = {}
    for r in sizes:
        shard = place[r.old_shard, r.block]
        totals[shard] = totals.get(shard, 0) + r.size
    parts = {shard: -(-size // TASK_BYTES) for shard, size in totals.items()}
    base: dict[int, int] = {}
    table = []
    for r in sorted(sizes, key=lambda r: (r.old_shard, r.block)):
        shard = place[r.old_shard, r.block]
        table.append((r.old_shard, r.block, shard, base.get(shard, 0), r.block % parts[shard]))
        base[shard] = base.get(shard, 0) + r.n
    moves = spark.createDataFrame(table, "old_shard int, block int, shard int, slot_base long, part int")
    return rows.join(F.broadcast(moves), ["old_shard", "block"])


def with_slots(moved: DataFrame) -> DataFrame:
    """``slot``: rows of a shard numbered from 0, block after block."""
    order = Window.partitionBy("shard", "part", "old_shard", "block").orderBy("doc_id", F.xxhash64("text"))
    spread = moved.repartition("shard", "part")
    return spread.withColumn("slot", F.col("slot_base") + F.row_number().over(order) - 1).drop("slot_base")


def rewrite(moved: DataFrame, path: str, all_shards: bool = False) -> DataFrame:
    """Write the shards whose contents change to ``path/shard=N``; return them read back.

    A shard that gains and loses nothing keeps its file, unless ``all_shards``.
    """
    rows = moved
    if not all_shards:
        crossing = moved.where(F.col("shard") != F.col("old_shard"))
        touched = crossing.select(F.explode(F.array("shard", "old_shard")).alias("shard")).distinct()
        rows = moved.join(F.broadcast(touched), "shard", "left_semi")
    rows = with_slots(rows)
    rows.write.partitionBy("shard").parquet(path)
    return moved.sparkSession.read.schema(rows.schema).parquet(path)


def scratch(spark) -> str:
    """A new folder that all executors share."""
    return f"{checkpoint_folder(spark)}/shards-{uuid.uuid4()}"
