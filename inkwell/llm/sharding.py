"""Resharding that moves the fewest bytes, by minimum-cost flow.

Documents lie in old shards. Given the capacities of the new shards, a minimum-cost flow between old
sizes and new capacities (staying costs nothing, moving costs a unit per byte) says how many bytes go
from each shard to each other. Within an old shard, groups of equal texts lie in a fixed order, the
heaviest first, the rest by block and hash; the flow's amounts cut this order into runs: first what
stays, then what goes to each target. So equal texts stay together, heavy groups don't move, and whole
blocks move except those that hold a cut. Only shards that gain or lose documents are rewritten.

Defined cases: a null text has no bytes and equals an empty one; repeated rows are rows of their own;
other columns stay with their row; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from inkwell.llm.common import Scratch, n_partitions, table, text_or_empty

#: Blocks of an old shard; parts in which slots are numbered.
BLOCKS, SLOT_PARTS = 1024, 1024
#: A group is heavy from this share of a new shard; there are at most new shards / this of them.
HEAVY_SHARE = 0.0005


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Amounts from each source to each sink, all supply placed at the least cost.

    Successive shortest paths with potentials. ``cost(i, j)`` is a unit's cost and not negative.
    """
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("capacities are smaller than what is there")
    left, room = list(supply), list(capacity)
    flow: dict[tuple[int, int], int] = {}
    pot = [0] * (n + m)
    while any(left):
        dist, came = [None] * (n + m), [None] * (n + m)
        heap = [(0 - pot[i], i) for i in range(n) if left[i]]
        base = min(h[0] for h in heap)
        heap = [(d - base, i) for d, i in heap]
        for d, i in heap:
            dist[i] = d
        heapq.heapify(heap)
        end = None
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            if u >= n and room[u - n]:
                end = u
                break
            if u < n:
                steps = [(n + j, cost(u, j)) for j in range(m)]
            else:
                steps = [(i, -cost(i, u - n)) for i in range(n) if flow.get((i, u - n))]
            for v, c in steps:
                nd = d + c + pot[u] - pot[v]
                if dist[v] is None or nd < dist[v]:
                    dist[v], came[v] = nd, u
                    heapq.heappush(heap, (nd, v))
        for v in range(n + m):
            pot[v] += min(dist[v], dist[end]) if dist[v] is not None else dist[end]
        path = [end]
        while came[path[-1]] is not None:
            path.append(came[path[-1]])
        path.reverse()
        push = min([left[path[0]], room[end - n]] + [flow[(v, u - n)] for u, v in zip(path, path[1:]) if u >= n])
        for u, v in zip(path, path[1:]):
            if u < n:
                flow[(u, v - n)] = flow.get((u, v - n), 0) + push
            else:
                flow[(v, u - n)] -= push
        left[path[0]] -= push
        room[end - n] -= push
    return {k: v for k, v in flow.items() if v}


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (k < total % shards) for k in range(shards)]


def old_shard_of(text: str, n_old: int) -> Column:
    """Where a row lies before, if nothing else is said: a hash of its text."""
    return F.pmod(F.xxhash64(text_or_empty(text), F.lit("shard")), F.lit(n_old))


def _sized(docs: DataFrame, old_shard: Column, text: str) -> DataFrame:
    body = text_or_empty(text)
    return docs.withColumns({"size": (F.octet_length(body) + 1).cast("long"), "group": F.xxhash64(body), "old_shard": old_shard.cast("int")}).withColumn("block", F.pmod(F.col("group"), F.lit(BLOCKS)).cast("int"))


def plan_moves(sized: DataFrame, capacities: list[int] | None, n_new: int, scratch: Scratch) -> tuple[DataFrame, dict]:
    """(cuts: old_shard, from block and group, new_shard; facts). The driver holds shards, blocks and heavy groups, never documents."""
    spark = scratch.spark
    groups = sized.groupBy("old_shard", "block", "group").agg(F.sum("size").alias("bytes"))
    totals = {r.old_shard: r.bytes for r in sized.groupBy("old_shard").agg(F.sum("size").alias("bytes")).collect()}
    total = sum(totals.values())
    capacities = capacities or equal_capacities(total, n_new)
    least = max(1, int(HEAVY_SHARE * max(capacities)))
    heavy = [(r.old_shard, r.group, r.bytes) for r in groups.filter(F.col("bytes") >= least).collect()]
    light = groups.filter(F.col("bytes") < least)
    blocks: dict[int, list] = {}
    for r in light.groupBy("old_shard", "block").agg(F.sum("bytes").alias("bytes")).orderBy("old_shard", "block").collect():
        blocks.setdefault(r.old_shard, []).append((r.block, r.bytes))
    olds = sorted(totals)
    flow = min_cost_flow([totals[o] for o in olds], capacities, lambda i, j: int(olds[i] != j))
    moves = {(olds[i], j): f for (i, j), f in flow.items()}
    heavy_rows, wanted, starts = [], [], []
    for o in olds:
        runs = sorted(((j, f) for (x, j), f in moves.items() if x == o), key=lambda r: (r[0] != o, r[0]))
        room = [[j, f] for j, f in runs]
        mine = sorted((h for h in heavy if h[0] == o), key=lambda h: (-h[2], h[1]))
        for _, g, b in mine:  # a heavy group goes where most room is left: its own shard first, if it fits
            k = next((k for k, r in enumerate(room) if r[1] >= b), max(range(len(room)), key=lambda k: room[k][1]))
            heavy_rows.append((o, g, room[k][0]))
            room[k][1] -= b
        over = sum(-r[1] for r in room if r[1] < 0)
        room = [[j, max(0, f)] for j, f in room]
        for r in reversed(room):  # what heavy groups took too much of comes off the last runs
            take = min(over, r[1])
            r[1], over = r[1] - take, over - take
        room = [r for r in room if r[1]] or room[:1]
        starts.append((o, -1, -(2**63), room[0][0]))
        edge, at, mine = 0, 0, blocks.get(o, [])
        k = 0
        for j, f in zip(room, room[1:]):
            edge += j[1]
            while k < len(mine) and at + mine[k][1] <= edge:
                at += mine[k][1]
                k += 1
            if k < len(mine):
                wanted.append((o, mine[k][0], edge - at, f[0]))
    cuts = list(starts)
    if wanted:
        w = spark.createDataFrame(wanted, "old_shard int, block int, within long, new_shard int")
        order = Window.partitionBy("old_shard", "block").orderBy("group")
        held = light.join(F.broadcast(w.select("old_shard", "block").distinct()), ["old_shard", "block"], "left_semi").withColumn("before", F.sum("bytes").over(order) - F.col("bytes") / 2)
        found = held.join(F.broadcast(w), ["old_shard", "block"]).groupBy("old_shard", "block", "within", "new_shard").agg(F.min(F.when(F.col("before") >= F.col("within"), F.col("group"))).alias("group"))
        cuts += [(r.old_shard, r.block if r.group is not None else r.block + 1, r.group if r.group is not None else -(2**63), r.new_shard) for r in found.collect()]
    cut_schema = T.StructType([T.StructField("old_shard", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("group", T.LongType()), T.StructField("new_shard", T.IntegerType())])
    facts = {"moves": moves, "capacities": capacities, "cuts": cuts, "heavy": heavy_rows, "moved": sum(f for (o, j), f in moves.items() if o != j)}
    return spark.createDataFrame(cuts, cut_schema), facts


def _new_shard(facts: dict) -> Column:
    """The target by old shard, block and group: as many comparisons as there are cuts, which shards bound."""
    target = None
    for o in sorted({c[0] for c in facts["cuts"]}):
        col = F.lit(None).cast("int")
        for _, b, g, j in sorted(c for c in facts["cuts"] if c[0] == o):
            here = F.lit(True) if b < 0 else (F.col("block") > b) | ((F.col("block") == b) & (F.col("group") >= g))
            col = F.when(here, F.lit(j)).otherwise(col)
        target = F.when(F.col("old_shard") == o, col) if target is None else target.when(F.col("old_shard") == o, col)
    return target


def reshard(docs: DataFrame, n_old: int, n_new: int, scratch: Scratch, text: str = "text", old_shard: Column | None = None, capacities: list[int] | None = None) -> tuple[DataFrame, dict]:
    """(docs with size, old_shard, shard; facts on the moves).

    ``old_shard``: where a row lies now; a hash of its text over ``n_old`` by default. It must be a
    function of the text if equal texts are to stay together.
    """
    old = old_shard_of(text, n_old) if old_shard is None else old_shard
    sized = _sized(docs, old, text)
    meta = scratch.cut(sized.select("size", "group", "old_shard", "block"), "sizes")
    if meta.isEmpty():
        return sized.withColumn("shard", F.lit(0)), {"moves": {}, "capacities": [], "cuts": [], "heavy": [], "moved": 0}
    _, facts = plan_moves(meta, capacities, n_new, scratch)
    shard = _new_shard(facts)
    if facts["heavy"]:
        # bounded: heavy groups are at least HEAVY_SHARE of a shard each
        h = scratch.spark.createDataFrame(facts["heavy"], "old_shard int, group long, heavy_shard int")
        sized = sized.join(F.broadcast(h), ["old_shard", "group"], "left")
        return sized.withColumn("shard", F.coalesce("heavy_shard", shard)).drop("heavy_shard"), facts
    return sized.withColumn("shard", shard), facts


def with_slots(placed: DataFrame, scratch: Scratch, key: str = "doc_id") -> DataFrame:
    """Adds slot: gapless from 0 in every shard. Numbered in parts by a hash of the key, so no task has a whole shard."""
    p = placed.withColumn("part", F.pmod(F.xxhash64(F.col(key), F.col("group")), F.lit(SLOT_PARTS)).cast("int"))
    counts = p.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))  # shards x SLOT_PARTS rows
    first = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("first"))
    at = F.row_number().over(Window.partitionBy("shard", "part").orderBy(key, "group")) - 1
    return p.withColumn("at", at).join(F.broadcast(first), ["shard", "part"]).withColumn("slot", (F.col("first") + F.col("at")).cast("long")).drop("part", "at", "first")


def rewrite(placed: DataFrame, facts: dict, out_dir: str, files_per_shard: int = 8) -> list[int]:
    """Writes the shards that gain or lose documents as Parquet, each by several tasks; returns their numbers."""
    touched = sorted({x for (o, j) in facts["moves"] if o != j for x in (o, j)})
    if touched:
        rows = placed.filter(F.col("shard").isin(touched)).drop("group", "block", "old_shard", "size").withColumn("shard", F.col("shard").cast("int"))
        rows.repartition(len(touched) * files_per_shard, "shard", F.pmod(F.hash(*[c for c in rows.columns if c != "shard"][:1]), F.lit(files_per_shard))).write.mode("overwrite").partitionBy("shard").option("compression", "zstd").parquet(out_dir)
    return touched


def resharded(placed: DataFrame, facts: dict, scratch: Scratch) -> DataFrame:
    """The documents with shard as they lie after the move: touched shards read from the files written for them, the others where they were."""
    rows = placed.drop("group", "block", "old_shard", "size").withColumn("shard", F.col("shard").cast("int"))
    out_dir = f"{scratch.dir}/shards"
    # files enough that a task's share doesn't grow with the input
    touched = rewrite(placed, facts, out_dir, -(-n_partitions(scratch.spark) // max(1, len(facts["capacities"]))))
    if not touched:
        return rows
    written = scratch.spark.read.schema(rows.schema).parquet(out_dir).select(*rows.columns)
    return written.unionByName(rows.filter(~F.col("shard").isin(touched)))


OLD, NEW = 5, 8


def op1_min_cost_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five old shards to eight of equal bytes. What is returned comes from the shards' files."""
    scratch = Scratch(spark, "reshard")
    docs = table(spark, sf_dir, "documents")
    placed, facts = reshard(docs, OLD, NEW, scratch)
    found = resharded(placed, facts, scratch)
    sized = _sized(found, old_shard_of("text", OLD), "text")
    meta = scratch.cut(sized.select("doc_id", "size", "group", F.crc32(text_or_empty().cast("binary")).alias("text_crc32"), "shard", "old_shard"), "placed")
    return with_slots(meta, scratch).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
