"""Packing token sequences into as few windows as possible, by a configuration linear program.

The driver sees the length histogram only. The program's columns are configurations, multisets of
lengths that fit one sequence; its rows are lengths. Multiplicative weights solve it: every length
carries a weight that falls as it is covered, a knapsack dynamic program prices the best completion of
every length at once, and near-best configurations advance; what they have used up leaves the prices and
the program is priced again. Any weights give a lower bound (their total by the best configuration's value),
so the gap is known. The solution is rounded down, what is left is priced and covered again by whole
configurations, and only the remainder is packed best fit, longest first.

Pieces find their sequence by rank. A task numbers its own pieces of each length; the numbers of tasks are
summed per length; a table of rank intervals, one per item of a configuration, gives sequence and offset. Pieces
as long as the window are sequences by themselves and take part in none of this.

Defined cases: a null text is an empty one, the end token alone; only documents longer than the window
are cut, the first piece takes the remainder; repeated rows are rows of their own; extra columns are left
out; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.llm.common import Scratch, table, text_or_empty
from inkwell.llm.tokens import tokenizer_path, worker_pieces

WINDOW, END_ID = 2048, 0
#: Ways to solve: rounds of multiplicative weights, prices a round, their rate, and by what part of a token's weight a
#: configuration may miss the best. Low rates suit histograms that fill windows to the brim, high ones those that can't.
WAYS = ((12, 6, 0.00002, 0.6), (40, 4, 0.02, 1.0))
#: The second way is tried if the first leaves more than this over the lower bound.
GAP = 0.001


def price(weights: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack: (best value by capacity, the last length of a best filling or 0). weights[l] < 0: not there."""
    lengths = np.flatnonzero(weights >= 0)
    worth = weights[lengths]
    best, last = np.zeros(window + 1), np.zeros(window + 1, np.int64)
    for c in range(1, window + 1):
        k = np.searchsorted(lengths, c, "right")
        best[c] = best[c - 1]
        if k:
            got = best[c - lengths[:k]] + worth[:k]
            at = int(got.argmax())
            if got[at] > best[c]:
                best[c], last[c] = got[at], lengths[at]
    return best, last


def _column(first: int, weights: np.ndarray, best: np.ndarray, room: np.ndarray, window: int, near: float) -> list[int]:
    """A near-best configuration with ``first``, each next length near-best and the one with most room; or empty."""
    out, capacity, value = [first], window - first, weights[first]
    while capacity > 0:
        top = best[capacity]
        if top <= 0:
            break
        w = weights[1 : capacity + 1]
        good = (w >= 0) & (w + best[capacity - 1 :: -1] >= top * (1 - near))
        k = int(np.where(good, room[1 : capacity + 1], -1.0).argmax()) + 1
        if room[k] <= 1e-9 or not good[k - 1]:
            break
        out.append(k)
        value += weights[k]
        capacity -= k
    return out if value >= (1 - near) * best[window] else []


def _advance(room: np.ndarray, weights: np.ndarray, best: np.ndarray, used: dict[tuple[int, ...], float], window: int, near: float) -> bool:
    """Near-best configurations, longest length first, take what room there is; ``room`` and ``used`` change."""
    moved = False
    for length in np.flatnonzero(weights >= 0)[::-1]:
        while room[length] > 1e-9:
            kinds, times = np.unique(np.array(_column(int(length), weights, best, room, window, near), np.int64), return_counts=True)
            step = float((room[kinds] / times).min()) if len(kinds) else 0.0
            if step <= 1e-9:
                break
            a = tuple(np.repeat(kinds, times)[::-1].tolist())
            used[a] = used.get(a, 0.0) + step
            room[kinds] -= step * times
            moved = True
    return moved


def configuration_lp(counts: np.ndarray, window: int = WINDOW, way: tuple[int, int, float, float] = WAYS[0]) -> tuple[dict[tuple[int, ...], float], float]:
    """(configurations, lengths longest first, and how often each is used; a lower bound on their number).

    No length is covered beyond its count. A round covers its part of every length, as far as configurations
    near the best of the round's prices do; it prices again without the lengths that have no room left in it. A
    length's weight grows with every round that it lags behind.
    """
    (rounds, prices, rate, near), n = way, counts.astype(float)
    near /= window
    there = np.flatnonzero(n > 0)
    used: dict[tuple[int, ...], float] = {}
    covered, bound = np.zeros(len(n)), 0.0
    for t in range(rounds if len(there) else 0):
        room = n * (t + 1) / rounds - covered
        lag = rounds * room / np.maximum(n, 1) - 1
        worth = np.arange(window + 1) / window * np.exp(rate * lag)
        top = 0.0
        for _ in range(prices):
            live = there[room[there] > 1e-9]
            weights = np.full(window + 1, -1.0)
            weights[live] = worth[live]
            best, _ = price(weights, window)
            if not top:
                top, bound = best[window], max(bound, float((n[there] * worth[there]).sum() / best[window]))
            if best[window] < (1 - near) * top or not _advance(room, weights, best, used, window, near):
                break
        covered = n * (t + 1) / rounds - room
    return used, bound


def rounded(solution: dict[tuple[int, ...], float], counts: np.ndarray) -> tuple[dict[tuple[int, ...], int], np.ndarray]:
    """(whole numbers of configurations, the remainder): rounded down, then up by falling fraction while they fit."""
    left, out = counts.astype(np.int64).copy(), {}
    for up in (False, True):
        for a, x in sorted(solution.items(), key=lambda ax: (-(ax[1] % 1), ax[0])):
            kinds, times = np.unique(a, return_counts=True)
            y = int(x % 1 >= 0.5 and (left[kinds] >= times).all()) if up else int(x + 1e-6)
            if y:
                left[kinds] -= y * times
                out[a] = out.get(a, 0) + y
    return out, left


def best_fit(counts: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, over a histogram: equal bins move together."""
    bins: dict[int, list] = {}  # free space: [(lengths, number)]
    for length in range(len(counts) - 1, 0, -1):
        m = int(counts[length])
        while m:
            free = min((f for f in bins if f >= length), default=None)
            if free is None:
                per = window // length
                if m >= per:
                    bins.setdefault(window - per * length, []).append(((length,) * per, m // per))
                if m % per:
                    bins.setdefault(window - m % per * length, []).append(((length,) * (m % per), 1))
                break
            items, number = bins[free].pop()
            take = min(m, number)
            if number > take:
                bins[free].append((items, number - take))
            elif not bins[free]:
                del bins[free]
            bins.setdefault(free - length, []).append(((*items, length), take))
            m -= take
    return [x for group in bins.values() for x in group]


def plan(counts: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(configuration, number of sequences): together they hold exactly the histogram."""
    found, least = None, 0.0
    for way in WAYS:
        solution, bound = configuration_lp(counts, window, way)
        out, left = rounded(solution, counts)
        made = list(out.items()) + best_fit(left, window)
        size, least = sum(y for _, y in made), max(least, bound)
        found = min(found or (size, made), (size, made), key=lambda f: f[0])
        if found[0] <= least * (1 + GAP) + 1:
            break
    return found[1]


def intervals(configurations: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """(key: length << 40 | first rank, first sequence, offset), sorted by key."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for a, y in configurations:
        at = 0
        for length in a:
            r = rank.get(length, 0)
            rows.append((length << 40 | r, sequence, at))
            rank[length] = r + y
            at += length
        sequence += y
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3


def cut_pieces(n: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    head = n % window
    starts = ([0] if head else []) + list(range(head, n, window))
    return [(s, head if s == 0 and head else window) for s in starts]


def _pieces(path: str, window: int):
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        coder, task, rank, full = worker_pieces(path, False), TaskContext.get().partitionId(), [0] * (window + 1), 0
        for b in batches:
            rows = []
            for doc, text in zip(*(c.to_pylist() for c in b.columns)):
                ids = coder.ids(text) + end
                for k, (s, n) in enumerate(cut_pieces(len(ids) // 4, window)):
                    rows.append((doc, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)]), task, rank[n]))
                    rank[n] += 1
            cols = list(zip(*rows)) if rows else [()] * 7
            types = (b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    return run


def _placing(packed, keep: int):
    def run(batches):
        key, first, at = packed.value
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            want = (length << 40) | rank
            k = np.searchsorted(key, want, "right") - 1
            got = [pa.array(first[k] + want - key[k], pa.int64()), pa.array(at[k], pa.int64())] if b.num_rows else [pa.array([], pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([*b.columns[:keep], *got], names=[*b.schema.names[:keep], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, scratch: Scratch, path: str, window: int = WINDOW, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id (negative: a full piece), offset."""
    spark = scratch.spark
    rows = docs.select(F.col(key).alias("doc_id"), text_or_empty(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    cols = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    parts = scratch.cut(rows.mapInArrow(_pieces(path, window), f"{cols}, task long, rank long"), "pieces")
    alone = parts.filter(F.col("length") == window)
    number = -1 - (F.shiftleft("task", 40) + F.col("rank"))
    full = alone.select(*columns, number.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    shorter = parts.filter(F.col("length") < window)
    cells = shorter.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = scratch.cut(cells.select("length", "task", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "firsts")
    counts = np.zeros(window + 1, np.int64)
    for r in firsts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # fewer rows than the window
        counts[r.length] = r.n
    # an interval per item of a configuration; there are as many configurations as prices and lengths can make
    table_ = spark.sparkContext.broadcast(intervals(plan(counts, window)))
    # a row per length and task grows with the input, but stays small on disk: without the hint Spark would broadcast it
    ranked = shorter.join(firsts.select("length", "task", "first").hint("merge"), ["length", "task"]).select(*columns, (F.col("first") + F.col("rank")).alias("rank"))
    return ranked.mapInArrow(_placing(table_, 5), f"{cols}, sequence_id long, offset long").unionByName(full)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), Scratch(spark, "pack"), tokenizer_path("byte_bpe_50k.json"))
