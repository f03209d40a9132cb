"""Similarity join on word shingles: rare-first prefix filtering, each pair verified once.

1. Every text becomes a set of shingle hashes and a set id; texts of equal sets are one node.
2. A count sketch of fixed size, summed over all texts, orders shingles rare first. Any order gives exact
   results; this one keeps frequent shingles out of prefixes.
3. Each set posts the shingles of its prefix. Sets that link share one of these. Postings of one set
   only are dropped.
4. Shingles with few postings: joined on the shingle. Pairs must pass the length filter, the positional
   filter at their first common shingle and the suffix filter (common prefix shingles plus what can be
   common behind the prefixes must reach the overlap needed), then are verified once.
5. Shingles with many postings: their sets fall into clusters. A cluster is compared in blocks by length
   band, first within random blocks, twice, then between blocks, leaving out blocks that are
   known to be one component. A block pair emits a spanning forest of its links, never all pairs.
6. Links become components.

Defined cases: a null or blank text has the empty set and links with nothing; repeated rows are rows of
their own; extra columns are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import Scratch, free_shuffles, n_partitions, table
from inkwell.llm.components import components
from inkwell.llm.shingles import mix64, shingle_sets

SHINGLE, PERCENT = 5, 80
#: Counters of the sketch, in chunks; postings of a shingle beyond which blocks are used; sets of a block.
SKETCH_BITS, CHUNKS = 21, 64
HOT, BLOCK = 64, 256
#: Bits of the filter that preselects sets to be read again; false positives are removed by a join.
FILTER_BITS = 26


def set_id(s: np.ndarray) -> int:
    x = mix64(s ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64, keepdims=True) + np.array([len(s)], np.uint64)
    return int(mix64(x).view(np.int64)[0])


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _texts(batch: pa.RecordBatch, k: int):
    return shingle_sets(batch.column(batch.schema.get_field_index("text")).to_pylist(), k)


def _describe(k: int):
    """(rid, doc_id, ...) -> n, sid for every row; then the partition's sketch in chunks."""

    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        seen = False
        for b in batches:
            n, sid = [], []
            for s in _texts(b, k):
                n.append(len(s))
                sid.append(set_id(s) if len(s) else None)
                np.add.at(counts, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            seen = True
            nothing = [pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary())]
            rest = [c for c, f in zip(b.columns, b.schema.names) if f != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(n, pa.int64()), pa.array(sid, pa.int64()), *nothing], names=[*(f for f in b.schema.names if f != "text"), "n", "sid", "chunk", "sketch"])
        if seen:
            parts = [zlib.compress(c.tobytes(), 1) for c in counts.reshape(CHUNKS, -1)]
            rest = [pa.nulls(CHUNKS, f.type) for f in b.schema if f.name != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.nulls(CHUNKS, pa.int64()), pa.nulls(CHUNKS, pa.int64()), pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary())], names=[*(f.name for f in b.schema if f.name != "text"), "n", "sid", "chunk", "sketch"])

    return run


def _sum_sketches(batches):
    """A running sum per chunk, so memory doesn't grow with the partitions that were read."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for chunk, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            got = np.frombuffer(zlib.decompress(raw), np.uint32).astype(np.uint64)
            total[chunk] = total[chunk] + got if chunk in total else got
    rank = [zlib.compress(np.minimum(255, 8 * np.log2(1.0 + c)).astype(np.uint8).tobytes()) for c in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(rank, pa.binary())], names=["chunk", "sketch"])


def _post(k: int, percent: int, packed):
    def run(batches):
        rank = np.frombuffer(zlib.decompress(packed.value), np.uint8)
        for b in batches:
            token, sid, size, pos = [], [], [], []
            for s in _texts(b, k):
                n = len(s)
                if n:
                    p = prefix_size(n, percent)
                    r = rank[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                    token.append(s[np.argsort(r, kind="stable")[:p]])  # ties by hash, as s is sorted
                    sid.append(np.full(p, set_id(s), np.int64))
                    size.append(np.full(p, n, np.int32))
                    pos.append(np.arange(p, dtype=np.int32))
            if token:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (sid, size, pos))], names=["token", "sid", "n", "pos"])

    return run


def _filter_bits(sid: np.ndarray) -> list[np.ndarray]:
    x = mix64(sid.astype(np.int64).view(np.uint64))
    return [(x >> np.uint64(64 - FILTER_BITS)).astype(np.int64), ((x << np.uint64(FILTER_BITS)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]


def _make_filter(batches):
    bits = np.zeros(1 << FILTER_BITS, bool)
    for b in batches:
        for at in _filter_bits(b.column(0).to_numpy(zero_copy_only=False)):
            bits[at] = True
    yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())], names=["bits"])


def _read_sets(k: int, packed):
    def run(batches):
        bits = np.frombuffer(zlib.decompress(packed.value), np.uint8)
        for b in batches:
            rows = []
            for s in _texts(b, k):
                if len(s):
                    sid = set_id(s)
                    if all(bits[at[0] >> 3] >> (7 - (at[0] & 7)) & 1 for at in _filter_bits(np.array([sid]))):
                        rows.append((sid, s.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["sid", "elements"])

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted sets, by products of incidence matrices."""
    both = left + right
    owner = np.repeat(np.arange(len(both)), [len(s) for s in both])
    values, inverse, count = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    keep = (count > 1)[inverse]
    owner, column = owner[keep], number[inverse[keep]]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for a in range(0, int((count > 1).sum()), columns):
        lo, hi = np.searchsorted(column, [a, a + columns])
        m = np.zeros((len(both), columns), np.float32)
        m[owner[lo:hi], column[lo:hi] - a] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out


def _forest(n: int, pairs) -> list[tuple[int, int]]:
    up = list(range(n))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for a, b in pairs:
        x, y = find(int(a)), find(int(b))
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append((int(a), int(b)))
    return out


def _compare(percent: int):
    """One block pair: the links between its two sides (or within, if they are one), as a spanning forest."""

    def run(group: pa.Table) -> pa.Table:
        sid = group.column("sid").to_numpy()
        side = group.column("side").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in group.column("elements").to_pylist()]
        one = np.flatnonzero(side != 1)
        two = np.flatnonzero(side != 0)
        if len(one) and len(two):
            got = overlaps([sets[i] for i in one], [sets[i] for i in two])
            size = np.array([len(s) for s in sets], np.float64)
            hit = (got * 100 >= percent * (size[one][:, None] + size[two][None, :] - got)) & (one[:, None] != two[None, :])
            edges = _forest(len(sets), ((one[i], two[j]) for i, j in zip(*np.nonzero(hit))))
        else:
            edges = []
        return pa.table({"a": pa.array([sid[i] for i, _ in edges], pa.int64()), "b": pa.array([sid[j] for _, j in edges], pa.int64())})

    return run


def _verify(percent: int):
    def run(batches):
        for b in batches:
            a, z = b.column(0).to_numpy(), b.column(1).to_numpy()
            keep = []
            for i, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.searchsorted(x, y)
                both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(z[keep])], names=["a", "b"])

    return run


def _band(percent: int):
    """Sets that may link lie in the same band of sizes or in neighbouring ones."""
    return F.floor(F.log("n") / float(np.log(100.0 / percent)) + 1e-9).cast("int")


def _cold_pairs(live: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets that share an infrequent prefix shingle and pass the filters."""
    x = live.select("token", *(F.col(c).alias(f"{c}_x") for c in ("sid", "n", "pos")))
    y = live.select("token", *(F.col(c).alias(f"{c}_y") for c in ("sid", "n", "pos")))
    fit = (F.col("sid_x") < F.col("sid_y")) & (100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y"))
    pairs = x.join(y, "token").filter(fit).groupBy("sid_x", "sid_y", "n_x", "n_y").agg(F.count(F.lit(1)).alias("c"), F.min("pos_x").alias("i"), F.min("pos_y").alias("j"))
    behind = lambda n: F.ceil(F.col(n) * percent / 100.0) - 1
    need = F.ceil((F.col("n_x") + F.col("n_y")) * percent / (100.0 + percent) - 1e-9)
    positional = F.least(F.col("n_x") - F.col("i"), F.col("n_y") - F.col("j")) >= need
    suffix = F.col("c") + F.greatest(behind("n_x"), behind("n_y")) >= need
    return pairs.filter(positional & suffix).select(F.col("sid_x").alias("a"), F.col("sid_y").alias("b"))


def _block_links(members: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """``members``: block, sid, elements; ``pairs``: pair, one, two (blocks)."""
    same = pairs.filter("one = two").select("pair", F.col("one").alias("block"), F.lit(2).alias("side"))
    left = pairs.filter("one <> two").select("pair", F.col("one").alias("block"), F.lit(0).alias("side"))
    right = pairs.filter("one <> two").select("pair", F.col("two").alias("block"), F.lit(1).alias("side"))
    rows = members.join(same.unionByName(left).unionByName(right), "block").select("pair", "side", "sid", "elements")
    return rows.groupBy("pair").applyInArrow(_compare(percent), "a long, b long")


def _hot_links(hot: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links among the sets of frequent prefix shingles. ``hot``: token, sid, n."""
    first = hot.groupBy("sid").agg(F.min("token").alias("first"), F.min("n").alias("n"))
    star = hot.join(first.select("sid", "first"), "sid").select("token", "first").distinct()
    joined = components(star, scratch, "clusters")
    cluster = first.join(joined, F.col("first") == F.col("node"), "left").select("sid", "n", F.coalesce("root", "first").alias("cluster"), _band(percent).alias("band"))
    cluster = scratch.cut(cluster, "cluster")
    counts = cluster.groupBy("cluster", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))

    found = None
    for seed in (1, 2):
        placed = cluster.join(counts, ["cluster", "band"]).select("sid", F.xxhash64("cluster", "band", F.pmod(F.xxhash64("sid", F.lit(seed)), F.col("blocks"))).alias("block")).join(sets, "sid")
        pairs = placed.select(F.col("block").alias("pair"), F.col("block").alias("one"), F.col("block").alias("two")).distinct()
        links = _block_links(placed, pairs, percent)
        found = links if found is None else found.union(links)
    found = scratch.cut(found, "within")

    known = components(found, scratch, "known")
    marked = cluster.join(known, F.col("sid") == F.col("node"), "left").select("sid", "n", "cluster", "band", F.coalesce("root", "sid").alias("comp"))
    large = marked.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= HOT).select("cluster", "comp", F.lit(True).alias("large"))
    marked = scratch.cut(marked.join(large, ["cluster", "comp"], "left").withColumn("label", F.when(F.col("large"), F.col("comp"))).drop("large"), "marked")
    sizes = marked.groupBy("cluster", "band", "label").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    blocks = sizes.select("cluster", "band", "label", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("k")).withColumn("block", F.xxhash64("cluster", "band", "label", "k"))
    blocks = scratch.cut(blocks, "blocks")
    other = blocks.select("cluster", *(F.col(c).alias(f"{c}_2") for c in ("band", "label", "block")))
    near = (F.col("band_2") == F.col("band") + 1) | ((F.col("band_2") == F.col("band")) & (F.col("block_2") >= F.col("block")))
    done = F.coalesce(F.col("label") == F.col("label_2"), F.lit(False))
    pairs = blocks.join(other, "cluster").filter(near & ~done).select(F.xxhash64("block", "block_2").alias("pair"), F.col("block").alias("one"), F.col("block_2").alias("two"))
    mine = sizes.select(F.col("cluster").alias("c2"), F.col("band").alias("b2"), F.col("label").alias("l2"), "blocks")
    placed = marked.join(mine, (F.col("cluster") == F.col("c2")) & (F.col("band") == F.col("b2")) & F.col("label").eqNullSafe(F.col("l2")))
    placed = placed.select("sid", F.xxhash64("cluster", "band", "label", F.pmod(F.xxhash64("sid", F.lit(3)), F.col("blocks").cast("long"))).alias("block")).join(sets, "sid")
    return found.union(scratch.cut(_block_links(placed, pairs, percent), "between"))


def similarity_groups(docs: DataFrame, scratch: Scratch, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, same (hash of the text), n_shingles, component_id, rid, first (the rid that stands for the component)."""
    spark = scratch.spark
    rows = docs.select("doc_id", F.xxhash64("text").alias("same"), F.monotonically_increasing_id().alias("rid"), F.col("text").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    described = scratch.cut(rows.mapInArrow(_describe(shingle), f"doc_id {kind}, same long, rid long, n long, sid long, chunk int, sketch binary"), "described")
    meta = described.filter("chunk IS NULL").select("doc_id", "same", "rid", "n", "sid")

    sums = described.filter("chunk IS NOT NULL").select("chunk", "sketch").repartition(min(CHUNKS, n_partitions(spark)), "chunk").mapInArrow(_sum_sketches, "chunk int, sketch binary").collect()  # 2^SKETCH_BITS bytes
    if not sums:
        return meta.select("doc_id", "same", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), "rid", F.col("rid").alias("first"))
    rank = spark.sparkContext.broadcast(zlib.compress(b"".join(zlib.decompress(r.sketch) for r in sorted(sums, key=lambda r: r.chunk))))
    posted = scratch.cut(docs.select("text").mapInArrow(_post(shingle, percent, rank), "token long, sid long, n int, pos int"), "posted")
    heads = posted.groupBy("token").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).filter("lo <> hi").select("token")
    live = scratch.cut(posted.join(heads, "token").distinct(), "live")
    scratch.drop("posted")
    free_shuffles(spark)

    width = live.groupBy("token").agg(F.count(F.lit(1)).alias("width"))
    cold = live.join(width.filter(F.col("width") <= HOT).select("token"), "token", "left_semi")
    hot = scratch.cut(live.join(width.filter(F.col("width") > HOT).select("token"), "token", "left_semi").select("token", "sid", "n"), "hot")
    pairs = scratch.cut(_cold_pairs(cold, percent), "pairs")
    wanted = scratch.cut(pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).union(hot.select("sid")).distinct(), "wanted")
    bits = 0
    for r in wanted.coalesce(8).mapInArrow(_make_filter, "bits binary").collect():
        bits = np.frombuffer(zlib.decompress(r.bits), np.uint8) | bits
    packed = spark.sparkContext.broadcast(zlib.compress(np.broadcast_to(bits, ((1 << FILTER_BITS) // 8,)).astype(np.uint8).tobytes()))
    sets = docs.select("text").mapInArrow(_read_sets(shingle, packed), "sid long, elements binary").join(wanted, "sid", "left_semi")
    sets = scratch.cut(sets.groupBy("sid").agg(F.first("elements").alias("elements")), "sets")

    x, y = sets.select(F.col("sid").alias("a"), F.col("elements").alias("x")), sets.select(F.col("sid").alias("b"), F.col("elements").alias("y"))
    links = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_verify(percent), "a long, b long")
    links = scratch.cut(links, "links")
    free_shuffles(spark)
    if not hot.isEmpty():
        links = links.union(_hot_links(hot, sets, percent, scratch))
    roots = components(links, scratch, "components")

    keyed = scratch.cut(meta.join(roots, F.col("sid") == F.col("node"), "left").select("doc_id", "same", "rid", "n", F.coalesce("root", "sid").alias("key")), "keyed")
    firsts = keyed.filter("key IS NOT NULL").groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "rid")).alias("f")).select(F.col("key").alias("k"), F.col("f.doc_id").alias("component_id"), F.col("f.rid").alias("first"))
    out = keyed.join(firsts, F.col("key") == F.col("k"), "left")
    return out.select("doc_id", "same", F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "rid", F.coalesce("first", "rid").alias("first"))


def one_per_group(docs: DataFrame, scratch: Scratch, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` of which each component keeps the one with the least doc_id; of rows that repeat it, one."""
    marks = similarity_groups(docs, scratch, shingle, percent).filter("rid = first").select(F.col("doc_id").alias("_id"), F.col("same").alias("_same")).distinct()
    marks = scratch.cut(marks, "kept")
    own = docs.withColumn("_h", F.xxhash64("text"))
    kept = own.join(marks, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_same")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_h"]).select(*docs.columns)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_groups(table(spark, sf_dir, "documents"), Scratch(spark, "jaccard"), 4, 85).select("doc_id", "n_shingles", "component_id")
