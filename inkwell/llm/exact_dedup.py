"""Exact deduplication by counting quotient filters.

Each partition puts the 64-bit fingerprints of its texts into a counting quotient filter: the leading
bits name a slot, the rest is the remainder, remainders of a slot are sorted, and a counter stands
beside those that occurred more than once. As whole fingerprints are kept, filters merge without loss,
by merging sorted remainders and adding counters. The merge runs per segment of the fingerprint space.
Fingerprints with a count above one are routed to byte verification: their texts are grouped as
bytes, so a fingerprint that two texts share makes two groups.

Defined cases: a null text counts as empty; of equal texts the row with the largest doc_id stays (null
below all), and of rows that repeat that doc_id exactly one; other columns are left alone; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import Scratch, table, text_or_empty

#: Fingerprints per segment, about, and segments at least.
SEGMENT_ROWS, MIN_SEGMENTS = 1 << 20, 64


class CountingQuotientFilter:
    """Fingerprints of ``bits`` bits with counts, as sorted remainders in runs by quotient."""

    def __init__(self, runs: np.ndarray, remainders: np.ndarray, counts: np.ndarray, bits: int):
        self.runs, self.remainders, self.counts, self.bits = runs, remainders, counts, bits

    @property
    def remainder_bits(self) -> int:
        return self.bits - (len(self.runs).bit_length() - 1)

    @classmethod
    def of(cls, values: np.ndarray, counts: np.ndarray, bits: int) -> CountingQuotientFilter:
        """``values``: sorted and distinct. About as many slots as values."""
        q = min(bits, max(0, (max(len(values), 1) - 1).bit_length()))
        rem = bits - q
        quotients = (values >> np.uint64(rem)).astype(np.int64) if rem < 64 else np.zeros(len(values), np.int64)
        mask = np.uint64((1 << rem) - 1)
        return cls(np.bincount(quotients, minlength=1 << q).astype(np.uint32), values & mask, counts.astype(np.uint64), bits)

    def values(self) -> np.ndarray:
        q = np.repeat(np.arange(len(self.runs), dtype=np.uint64), self.runs)
        return (q << np.uint64(self.remainder_bits)) | self.remainders if self.remainder_bits < 64 else self.remainders

    def merged(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        return merge_filters([self, other])

    def to_bytes(self) -> bytes:
        width = max(1, -(-self.remainder_bits // 8))
        packed = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        many = np.flatnonzero(self.counts > 1)
        head = np.array([self.bits, len(self.runs), len(self.remainders), len(many)], "<u8")
        runs = np.minimum(self.runs, 255).astype(np.uint8)
        wide = self.runs[self.runs >= 255].astype("<u4")
        return b"".join(x.tobytes() for x in (head, runs, wide, packed, many.astype("<u4"), self.counts[many].astype("<u8")))

    @classmethod
    def from_bytes(cls, raw: bytes) -> CountingQuotientFilter:
        bits, slots, n, n_many = (int(x) for x in np.frombuffer(raw, "<u8", 4))
        at = 32
        runs = np.frombuffer(raw, np.uint8, slots, at).astype(np.uint32)
        at += slots
        wide = int((runs == 255).sum())
        runs[runs == 255] = np.frombuffer(raw, "<u4", wide, at)
        at += 4 * wide
        rem = bits - (slots.bit_length() - 1)
        width = max(1, -(-rem // 8))
        full = np.zeros((n, 8), np.uint8)
        full[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(n, width)
        at += n * width
        counts = np.ones(n, np.uint64)
        counts[np.frombuffer(raw, "<u4", n_many, at)] = np.frombuffer(raw, "<u8", n_many, at + 4 * n_many)
        return cls(runs, full.reshape(-1).view("<u8").astype(np.uint64), counts, bits)


def merge_filters(filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
    values = np.concatenate([f.values() for f in filters])
    counts = np.concatenate([f.counts for f in filters])
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    total = np.add.reduceat(counts, first) if len(values) else counts
    return CountingQuotientFilter.of(values[first], total, filters[0].bits)


def _build(bits: int, batch_rows: int = 1 << 20):
    """One filter per segment and partition; a partition of many rows gives several, which merge alike."""

    def run(batches):
        held, n = [], 0

        def flush():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            seg = (values >> np.uint64(64 - bits)).astype(np.int64)
            low = values & np.uint64((1 << (64 - bits)) - 1)
            cuts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            ends = np.r_[cuts[1:], len(seg)]
            blobs = [CountingQuotientFilter.of(low[a:z], counts[a:z], 64 - bits).to_bytes() for a, z in zip(cuts, ends)]
            return pa.RecordBatch.from_arrays([pa.array(seg[cuts], pa.int64()), pa.array(blobs, pa.binary())], names=["segment", "filter"])

        for b in batches:
            if b.num_rows:
                held.append(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
                n += b.num_rows
                if n >= batch_rows:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    return run


def _merge(bits: int):
    def run(group: pa.Table) -> pa.Table:
        seg = group.column("segment")[0].as_py()
        f = merge_filters([CountingQuotientFilter.from_bytes(x) for x in group.column("filter").to_pylist()])
        many = f.counts > 1
        fp = f.values()[many] | np.uint64(seg << (64 - bits))
        return pa.table({"fp": pa.array(fp.view(np.int64), pa.int64()), "n": pa.array(f.counts[many].astype(np.int64), pa.int64())})

    return run


def repeated_fingerprints(fps: DataFrame, n_rows: int) -> DataFrame:
    """(fp, n) of every fingerprint that occurs more than once; ``fps`` has the one column fp."""
    bits = max(MIN_SEGMENTS, n_rows // SEGMENT_ROWS + 1).bit_length()
    filters = fps.mapInArrow(_build(bits), "segment long, filter binary")
    return filters.groupBy("segment").applyInArrow(_merge(bits), "fp long, n long")


def exact_groups(docs: DataFrame, scratch: Scratch, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: its key, keep_id, group_size, kept, text_sha256."""
    body = text_or_empty(text)
    meta = scratch.cut(docs.select(F.col(key).alias("doc_id"), F.xxhash64(body).alias("fp"), F.sha2(body.cast("binary"), 256).alias("text_sha256"), F.monotonically_increasing_id().alias("rid")), "meta")
    dups = scratch.cut(repeated_fingerprints(meta.select("fp"), meta.count()), "repeated").select("fp")
    suspects = docs.select(body.alias("body")).withColumn("fp", F.xxhash64("body")).join(dups, "fp", "left_semi")
    verified = suspects.groupBy("fp", F.col("body").cast("binary").alias("body")).agg(F.count(F.lit(1)).alias("group_size")).select("fp", F.sha2("body", 256).alias("text_sha256"), "group_size")
    winners = meta.join(dups, "fp", "left_semi").groupBy("fp", "text_sha256").agg(F.max(F.struct("doc_id", "rid")).alias("w"))
    groups = scratch.cut(verified.join(winners, ["fp", "text_sha256"]).select("fp", "text_sha256", "group_size", F.col("w.doc_id").alias("keep_id"), F.col("w.rid").alias("keep_rid")), "groups")
    found = meta.join(groups, ["fp", "text_sha256"], "left")
    alone = F.col("keep_rid").isNull()
    return found.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (alone | (F.col("keep_rid") == F.col("rid"))).alias("kept"), "text_sha256")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), Scratch(spark, "exact"))


ORACLE = """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
