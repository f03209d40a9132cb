"""Mixing sources to target weights by blocks.

The words of a source stand in one stream, documents in hash order, cut into blocks of a fixed number
of words. The mix has output shards of a fixed number of slots. The shards' source counts are multinomial
draws given the totals, made by halves: the first half of a range of shards draws its counts without replacement
from what the range has to give, the second takes what is left, down to single shards. So the totals are the targets to the block,
and any task finds the counts of its shards, and those of all before them, from the seed. A source's slots are numbered through all shards; slot number
i takes block perm(i mod n) of its n blocks, perm being a pseudorandom permutation, a new one for
every pass over the source. Slots join blocks by index.

Defined cases: a null or blank text has size 0 and is never taken; a null source is a source, the last;
repeated rows are rows of their own; an empty table gives an empty mix. Sources are assumed to number
thousands at most: the driver holds their sizes and targets, and nothing for a shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.llm.common import WORD, Scratch, free_name, table, text_or_empty

BLOCK_WORDS, SHARD_SLOTS, SEED = 64, 4096, 17
#: Parts of a source in which its stream is measured.
PARTS = 256
MAX_REPEATS = 3


def targets(sizes: list[int], weights: list[float], most: float = MAX_REPEATS) -> list[float]:
    """Shares by weight of the sum of sizes; none above ``most`` times its size, the excess shared again by weight."""
    total, out, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        w = sum(weights[k] for k in open_)
        full = {k for k in open_ if total * weights[k] / w > most * sizes[k]}
        if not full:
            for k in open_:
                out[k] = total * weights[k] / w
            break
        for k in full:
            out[k] = float(most * sizes[k])
        total -= sum(out[k] for k in full)
        open_ -= full
    return out


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(i: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A pseudorandom permutation of range(n) at the places ``i``: a Feistel network, walked until inside."""
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    mask = np.uint64((1 << half) - 1)
    keys = _mix64(np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    x = i.astype(np.uint64).copy()
    todo = np.arange(len(x))
    while len(todo):
        a, b = x[todo] >> np.uint64(half), x[todo] & mask
        for k in keys:
            a, b = b, a ^ (_mix64(b + k) & mask)
        x[todo] = (a << np.uint64(half)) | b
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


#: Beyond it numpy has no hypergeometric draws; a normal one, rounded, is as good there.
LARGE = 10**9


def _draw(left: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """``n`` of what is left, without replacement: source by source, each against those after it."""
    out, rest = np.zeros_like(left), int(left.sum())
    for s, own in enumerate(left.tolist()):
        every, rest = rest, rest - own
        if own < LARGE > rest:
            got = int(rng.hypergeometric(own, rest, n)) if every else 0
        else:
            share = own / every
            spread = (n * share * (1 - share) * ((every - n) / (every - 1))) ** 0.5
            got = min(max(round(n * share + spread * float(rng.standard_normal())), n - rest, 0), own, n)
        out[s] = got
        n -= got
    return out


def n_shards(quota: list[int], shard_slots: int) -> int:
    return -(-sum(quota) // shard_slots)


def shard_draws(quota: list[int], shard_slots: int, first: int, last: int, seed: int = SEED) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, counts, sums of all counts before it) of the shards from ``first`` to before ``last``."""

    def within(lo: int, hi: int, counts: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if hi <= first or lo >= last:
            return
        if hi - lo == 1:
            yield lo, counts, before
            return
        mid = (lo + hi) // 2
        half = _draw(counts, (mid - lo) * shard_slots, np.random.default_rng([seed, lo, hi]))
        yield from within(lo, mid, half, before)
        yield from within(mid, hi, counts - half, before + half)

    every = n_shards(quota, shard_slots)
    if every:
        yield from within(0, every, np.array(quota, np.int64), np.zeros(len(quota), np.int64))


def _slots(quota: list[int], blocks: list[int], shard_slots: int):
    """Shard numbers to slots (shard, slot, src, block, pass)."""

    def run(batches):
        for b in batches:
            shards = b.column(0).to_numpy()  # numbers of a range follow each other
            for shard, counts, firsts in shard_draws(quota, shard_slots, int(shards.min()), int(shards.max()) + 1) if len(shards) else ():
                src = np.repeat(np.arange(len(counts)), counts)
                np.random.default_rng([SEED, shard]).shuffle(src)
                block, turn = np.zeros(len(src), np.int64), np.zeros(len(src), np.int64)
                for s, n in enumerate(counts):
                    if n:
                        i, size = firsts[s] + np.arange(n), blocks[s]
                        here = np.flatnonzero(src == s)
                        turn[here] = i // size
                        for e in np.unique(turn[here]):
                            at = here[turn[here] == e]
                            block[at] = permuted((i % size)[i // size == e], size, SEED * 1_000_003 + s * 1009 + int(e))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(src), shard, np.int64)), pa.array(np.arange(len(src))), pa.array(src.astype(np.int32)), pa.array(block), pa.array(turn)], names=["shard", "slot", "src", "block", "turn"])

    return run


def measure(docs: DataFrame, scratch: Scratch, source: str = "source", max_repeats: float = MAX_REPEATS) -> tuple[DataFrame, list[dict]]:
    """(rid, doc_id, src, size, start: place in the source's stream; sources in code-point order, null last)."""
    spark = scratch.spark
    sized = docs.select("doc_id", F.xxhash64("text").alias("same"), F.monotonically_increasing_id().alias("rid"), F.col(source).cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    meta = scratch.cut(sized.withColumn("order", F.xxhash64("doc_id", "rid")).withColumn("part", F.pmod("order", F.lit(PARTS)).cast("int")), "sizes")
    parts = meta.groupBy("source", "part").agg(F.sum("size").alias("words")).collect()  # sources x PARTS rows
    names = sorted({r.source for r in parts}, key=lambda s: (s is None, s or ""))
    size = {s: sum(r.words for r in parts if r.source == s) for s in names}
    goal = targets([size[s] for s in names], [k % 3 + 1 for k in range(len(names))], max_repeats)
    sources = [{"src": k, "source": s, "size": size[s], "target": goal[k]} for k, s in enumerate(names)]
    rows = []
    for k, s in enumerate(names):
        at = 0
        for r in sorted((r for r in parts if r.source == s), key=lambda r: r.part):
            rows.append((k, s, r.part, at))
            at += r.words
    first = spark.createDataFrame(rows, "src int, fsource string, fpart int, first long")
    run = Window.partitionBy("source", "part").orderBy("order", "rid")
    placed = meta.withColumn("before", F.sum("size").over(run) - F.col("size"))
    on = placed["source"].eqNullSafe(first["fsource"]) & (placed["part"] == first["fpart"])
    return placed.join(F.broadcast(first), on).select("rid", "doc_id", "same", "src", "size", (F.col("first") + F.col("before")).alias("start")), sources


def slot_table(spark: SparkSession, sources: list[dict], block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """Every slot of the mix: shard, slot, src, block, turn."""
    blocks = [-(-s["size"] // block_words) for s in sources]
    quota = [min(round(s["target"] / block_words * (b * block_words / s["size"])), MAX_REPEATS * b) if s["size"] else 0 for s, b in zip(sources, blocks)]
    every = n_shards(quota, shard_slots)
    shards = spark.range(0, every, 1, max(1, min(every, 256), every // 256))
    return shards.mapInArrow(_slots(quota, blocks, shard_slots), "shard long, slot long, src int, block long, turn long")


def pieces(placed: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The part of every document in every block it touches: rid, doc_id, same, src, size, block, at (in the document), words."""
    end = F.col("start") + F.col("size")
    spread = placed.filter("size > 0").select("*", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((end - 1) / block_words))).alias("block"))
    low = F.greatest(F.col("start"), F.col("block") * block_words)
    return spread.select("rid", "doc_id", "same", "src", "size", "block", (low - F.col("start")).alias("at"), (F.least(end, (F.col("block") + 1) * block_words) - low).alias("words"))


def mix(docs: DataFrame, scratch: Scratch, source: str = "source") -> tuple[DataFrame, DataFrame, list[dict]]:
    """(mix: a row for every piece of a document in every slot that takes it; measured documents; sources)."""
    placed, sources = measure(docs, scratch, source)
    placed = scratch.cut(placed, "placed")
    slots = slot_table(scratch.spark, sources)
    # the slots come out of a small table of shards, so Spark would take them for small and broadcast them
    return slots.hint("merge").join(pieces(placed), ["src", "block"]), placed, sources


def with_text(mixed: DataFrame, docs: DataFrame, turn: str = "turn") -> DataFrame:
    """The mix as documents: for every pass over its source a row with what the mix takes of a document.

    A document taken whole keeps its text; of others the words taken are joined by spaces. ``docs`` must be what was
    mixed; rows that repeat both doc_id and text are taken each for itself. ``docs`` may have columns of any names
    but ``turn``, which numbers the passes.
    """
    same, hashed, own_id, spans, taken, size = (free_name(docs, x) for x in ("same", "hashed", "own_id", "spans", "taken", "size"))
    took = mixed.groupBy("doc_id", "same", "rid", "turn").agg(F.sort_array(F.collect_list(F.struct("at", "words"))).alias(spans), F.sum("words").alias(taken), F.max("size").alias(size))
    own = docs.withColumn(same, F.xxhash64("text")).dropDuplicates(["doc_id", same])
    took = took.select(F.col("doc_id").alias(own_id), F.col("same").alias(hashed), F.col("turn").alias(turn), spans, taken, size)
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    parts = F.flatten(F.transform(spans, lambda s: F.slice(words, (s["at"] + 1).cast("int"), s["words"].cast("int"))))
    out = own.join(took, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(same) == F.col(hashed)))
    return out.withColumn("text", F.when(F.col(taken) >= F.col(size), F.col("text")).otherwise(F.array_join(parts, " "))).select(*docs.columns, turn)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "mix")
    mixed, placed, sources = mix(table(spark, sf_dir, "documents"), scratch)
    taken = mixed.groupBy("rid").agg(F.sum("words").alias("taken"))
    goals = spark.createDataFrame([(s["src"], s["source"], s["size"], s["target"]) for s in sources], "src int, source string, source_size long, target double")
    return placed.join(F.broadcast(goals), "src").join(taken, "rid", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")


ORACLE = None
