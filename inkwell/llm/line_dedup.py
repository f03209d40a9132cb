"""Fuzzy line deduplication by MinHash, in DataFrame operations only.

Lines are normalised (lower case, no white space at the ends) and known by a 64-bit hash, so equal lines are one.

1. Signatures: every line is cut into character shingles; the least of its shingle hashes under each of
   MINIMA reorderings (a part of the hashes first, there by exclusive-or with a constant) is its signature, made next
   to the scan and aggregated before the shuffle, so a very common line costs no more than others.
2. Banding: the minima are put together in WAYS ways, ROWS at a time, and in one more way among the lines that
   then share a band. A pair of Jaccard similarity 0.8 meets in one of the WAYS with a probability of 0.991, of 0.85
   with 0.998, of 0.5 with 0.49; where both lines share bands with any, of 0.996, 0.999 and 0.60. Band keys of one
   line only go; a bitmap of fixed size finds the others' lines when signatures are read again.
3. Each line of a band is paired with PIVOTS lines of it, chosen by hash: linear in the band, never all pairs.
   Pairs that their lines' marks (size and parities of the set, a few bytes) rule out go without their sets being
   moved. The rest is verified by the exact Jaccard similarity of the shingle sets, each pair once: on sets of 32-bit
   hashes, and where one or two equal hashes of different shingles could turn the verdict, on the lines themselves.
   One pair a line goes first; then those whose lines lie in one component already need no verifying.
4. Verified pairs become components by distributed union-find. Lines of bands that now lie in one component, or
   of which all pairs were seen, are done.
5. In the other bands the lines of different components are compared pair by pair on their marks. Where these pairs
   are more than DIRECT a line, lines are joined by prefixes instead: rare shingles first, a pair must share a shingle
   of both prefixes and pass the positional filter, too. Both are exact, and what is verified joins components. So
   pivots save work and lose no link between lines that meet in a band.
6. Of each component the first occurrence stays, by doc_id and line number.

Defined cases: blank lines are never compared and stay; a line shorter than a shingle is one shingle; a
null text has no lines; rows that repeat both doc_id and text are one document; null doc_ids come last; extra
columns stay whatever their names, but for the count that ``dedup_lines`` adds under a name of the caller's choice.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import ceil
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm.common import Scratch, among, free_name, free_shuffles, likely, table, text_or_empty
from inkwell.llm.components import components

SHINGLE, PERCENT = 8, 80
MINIMA, ROWS, WAYS = 24, 4, 2
PIVOTS = 4
#: A minimum is taken of the shingles of one part, by the last bits of their hashes.
PARTS = 8
#: Bands of n lines with at most DIRECT * n pairs across components are compared pair by pair; any number loses no link.
DIRECT = 512
#: Bands whose keys are counted at once; bounds the shuffle files.
BANDS_AT_ONCE = 6
#: Pairs of which the sets, and pairs or cells of which the marks, are moved at once, as parts of the number of lines, but LEAST
#: at least; both bound the shuffle files, and any number gives the same links.
SETS_AT_ONCE, MARKS_AT_ONCE, LEAST = 1 / 16, 1 / 2, 1 << 15
#: Counters of the table that orders shingles rare first; any order gives the same links.
RARITY_BITS = 18
#: 64-bit words of a line's parities, 2 ** 4; any number gives the same links.
WORDS = 16
_EACH = MINIMA // ROWS
_GROUPS = [[r * ROWS + k for k in range(ROWS)] if w == 0 else [(r + w * k) % _EACH * ROWS + k for k in range(ROWS)] for w in (*range(WAYS), _EACH - 1) for r in range(_EACH)]
#: The last way is for lines that share a band of another one.
BANDS = WAYS * _EACH


def _constants(n: int, bits: int) -> list[int]:
    """Fixed signed constants from a multiplicative sequence."""
    out, x = [], 1
    for _ in range(n):
        x = x * 6364136223846793005 + 1442695040888963407 & (1 << 64) - 1
        y = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
        out.append(((y ^ y >> 32) >> 64 - bits) - (1 << bits - 1))
    return out


_BLANKS = " \t\n\x0b\x0c\r"


def trimmed(line: Column) -> Column:
    """Trimming a set of characters walks the whole line, so only lines with one of them at an end are trimmed."""
    ends = reduce(or_, [line.startswith(c) | line.endswith(c) for c in _BLANKS])
    return F.when(ends, F.btrim(line, F.lit(_BLANKS))).otherwise(line)


def document_key() -> Column:
    return F.xxhash64("doc_id", text_or_empty())


def _norms(docs: DataFrame, *keys: Column) -> DataFrame:
    """One row per line that isn't blank: ``keys``, line_no, norm, lid."""
    each = docs.select(*keys, F.posexplode(F.split(text_or_empty(), "\n")).alias("line_no", "line"))
    line = trimmed(F.col("line"))  # asked before the lower case, which a filter would work out twice
    return each.filter(line != "").select(*each.columns[:-1], F.lower(line).alias("norm")).withColumn("lid", F.xxhash64("norm"))


def _units(norm: str = "norm") -> Column:
    return F.encode(norm, "UTF-16BE")


def _n_shingles(units: Column) -> Column:
    return F.greatest(F.lit(1), (F.octet_length(units) / 2).cast("int") - SHINGLE + 1)


def _starts(units: Column) -> Column:
    """Where in the bytes of ``units`` its shingles start."""
    return F.sequence(F.lit(1), 2 * _n_shingles(units) - 1, F.lit(2))


def _cut_at(units: Column, start: Column) -> Column:
    return F.substring(units, start, F.lit(2 * SHINGLE))


def _shingle_set(norm: str) -> Column:
    """Bound through a one-element array, so the text is encoded once and not for every shingle."""
    return F.transform(F.array(_units(norm)), lambda u: F.array_distinct(F.transform(_starts(u), lambda p: F.xxhash64(_cut_at(u, p)))))[0]


def signatures(norms: DataFrame) -> DataFrame:
    """(lid, minima: array<int>) of every distinct line; the shingles of a line never leave its task.

    Minimum k is over one part's shingles, or where a line has none there, over those of the next part that it has
    in an order of k's own. So it is the least of the whole set under a fixed order of all shingles, like any
    minimum, and a shingle is compared for MINIMA / PARTS of the minima only.
    """
    units = norms.select("lid", _units().alias("units"))
    each = units.select("lid", "units", F.explode(_starts(F.col("units"))).alias("p")).select("lid", F.hash(_cut_at(F.col("units"), F.col("p"))).alias("s"))
    own = MINIMA // PARTS
    least = [F.expr(f"min(s ^ ({c})) filter (where part = {k // own})").alias(f"m{k}") for k, c in enumerate(_constants(MINIMA, 32))]
    found = each.withColumn("part", F.col("s").bitwiseAND(F.lit(PARTS - 1))).groupBy("lid").agg(*least)
    minima = [F.coalesce(*[F.col(f"m{(k // own ^ d) * own + k % own}") for d in range(PARTS)]) for k in range(MINIMA)]
    return found.select("lid", F.array(*minima).alias("minima"))


def _cells(signed: DataFrame, first: int, n: int) -> DataFrame:
    """(band, lid): the keys of some bands."""
    keys = [F.xxhash64(F.lit(b), *[F.col("minima")[k] for k in _GROUPS[b]]) for b in range(first, first + n)]
    return signed.select("lid", F.explode(F.array(*keys)).alias("band"))


def _shared_cells(signed: DataFrame, scratch: Scratch, places: range) -> DataFrame:
    """(band, lid) of the bands that hold more than one line; ``places``: where each turn starts in _GROUPS."""
    out = None
    for k in places:
        cells = _cells(signed, k, places.step)
        shared = cells.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("band")
        shared = scratch.cut(shared, f"shared-{k}")
        free_shuffles(scratch.spark)
        live = scratch.cut(among(cells, "band", shared), f"live-{k}")
        out = live if out is None else out.union(live)
    return out


def _in_turns(rows: DataFrame, keys: list[str], most: float, work: Callable[[DataFrame, str], DataFrame], scratch: Scratch) -> DataFrame:
    """What ``work`` makes of ``rows``, dealt by ``keys`` into parts of about ``most`` rows. A part's shuffle files go before the next one's come.

    ``work`` gets a part and what its tables' names end with, and returns a written table.
    """
    out, turns = None, max(1, ceil(rows.count() / max(most, LEAST)))
    for t in range(turns):
        part = rows.filter(F.pmod(F.xxhash64(*keys), F.lit(turns)) == t) if turns > 1 else rows
        done = work(part, f"-{t}" if t else "")
        free_shuffles(scratch.spark)
        out = done if out is None else out.union(done)
    return out


def _sets(texts: DataFrame) -> DataFrame:
    """(lid, n, set): the distinct 32-bit hashes of each line's shingles."""
    hashed = F.transform(F.array(_units()), lambda u: F.array_distinct(F.transform(_starts(u), lambda p: F.hash(_cut_at(u, p)))))[0]
    return texts.repartition("lid").select("lid", hashed.alias("set")).select("lid", F.size("set").alias("n"), "set")


def _marks(sets: DataFrame) -> DataFrame:
    """(lid, n, w0_, w1_, ...): the size of each line's set, and for every bit whether an odd number of shingles falls on it."""
    each = sets.select("lid", "n", F.explode("set").alias("s")).select("lid", "n", F.expr(f"s & {WORDS - 1}").alias("word"), F.expr("shiftleft(1L, shiftright(s, 4) & 63)").alias("bit"))
    words = [F.expr(f"coalesce(bit_xor(bit) filter (where word = {k}), 0L)").alias(f"w{k}_") for k in range(WORDS)]
    return each.groupBy("lid", "n").agg(*words)


def _other(df: DataFrame, *same: str) -> DataFrame:
    """The columns of ``df`` under the names of a pair's second line, but for ``same``."""
    return df.select(*same, *[F.col(c).alias(f"{c}2") for c in df.columns if c not in same])


def _least_difference() -> Column:
    """Shingles that two lines don't share are at least as many as the bits in which their parities differ."""
    return reduce(lambda a, b: a + b, [F.bit_count(F.col(f"w{k}_").bitwiseXOR(F.col(f"w{k}_2"))) for k in range(WORDS)])


def _hopeful() -> Column:
    """Whether a pair with its marks can reach the similarity.

    If d shingles at least aren't shared, the overlap is at most (m + n - d) / 2; this is asked with room for the
    two equal hashes of different shingles that ``_verified`` allows for.
    """
    both = F.col("n") + F.col("n2")
    return (100 * F.least("n", "n2") >= PERCENT * F.greatest("n", "n2")) & ((100 + PERCENT) * (both + 4 - _least_difference()) >= 2 * PERCENT * both)


def _verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, scratch: Scratch, name: str, most: float) -> DataFrame:
    """The pairs (a, b) of which the shingle sets are similar enough; the sets of ``most`` pairs are moved at once."""
    return _in_turns(pairs, ["a", "b"], most, lambda part, end: _verified_part(part, sets, texts, scratch, name + end), scratch)


def _verified_part(pairs: DataFrame, sets: DataFrame, texts: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    own = lambda k: likely(sets, "lid", pairs.select(k).distinct()).select(F.col("lid").alias(k), F.col("n").alias(f"n{k}"), F.col("set").alias(f"set{k}"))
    near = pairs.join(own("b"), "b").join(own("a"), "a")
    over = (100 + PERCENT) * F.size(F.array_intersect("seta", "setb")) - PERCENT * (F.col("na") + F.col("nb"))
    found = scratch.cut(near.select("a", "b", over.alias("over")), f"{name}-near")  # a filter here would count twice
    tight = found.filter(F.abs("over") <= 2 * (100 + PERCENT)).select("a", "b")
    p, q = texts.select(F.col("lid").alias("a"), F.col("norm").alias("p")), texts.select(F.col("lid").alias("b"), F.col("norm").alias("q"))

    def similar(s: Column) -> Column:
        common = F.size(F.array_intersect(s["x"], s["y"]))
        return 100 * common >= PERCENT * (F.size(s["x"]) + F.size(s["y"]) - common)

    both = F.array(F.struct(_shingle_set("p").alias("x"), _shingle_set("q").alias("y")))
    exact = tight.join(q, "b").join(p, "a").filter(F.transform(both, similar)[0]).select("a", "b")
    return scratch.cut(found.filter(F.col("over") > 2 * (100 + PERCENT)).select("a", "b").union(exact), f"{name}-links")


def _pivot_components(pairs: DataFrame, sets: DataFrame, texts: DataFrame, scratch: Scratch, most: float) -> DataFrame:
    """(node, root): the components that the similar ones of ``pairs`` (a < b, distinct) make.

    A pair for each line is verified first. Of the others only those whose lines don't yet lie in one component need be.
    """
    lead = scratch.cut(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "lead")
    known = components(_verified(lead, sets, texts, scratch, "first", most), scratch, "led")
    root = lambda k: known.select(F.col("node").alias(k), F.col("root").alias(f"r{k}"))
    others = pairs.join(lead, ["a", "b"], "left_anti").join(root("a"), "a", "left").join(root("b"), "b", "left")
    others = scratch.cut(others.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b"), "others")
    scratch.drop("lead")
    free_shuffles(scratch.spark)
    more = _verified(others, sets, texts, scratch, "second", most)
    return components(known.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more), scratch, "known")


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _with_pivots(live: DataFrame) -> DataFrame:
    """(band, n, pivots): lines of each band that the others meet, least under reorderings of the band's own."""
    ways = [F.col("band").bitwiseXOR(F.lit(c)) for c in _constants(PIVOTS + 1, 64)[1:]]
    least = live.groupBy("band").agg(F.count(F.lit(1)).alias("n"), *[F.min(F.col("lid").bitwiseXOR(w)).alias(f"p{k}") for k, w in enumerate(ways)])
    return least.select("band", "n", F.array_distinct(F.array(*[F.col(f"p{k}").bitwiseXOR(w) for k, w in enumerate(ways)])).alias("pivots"))


def direct_pairs(cells: DataFrame, marks: DataFrame, scratch: Scratch, most: float) -> DataFrame:
    """(a, b): the pairs of lines of one band and different components that can reach the similarity. ``cells``: band, lid, comp."""
    across = (F.col("comp") != F.col("comp2")) & (F.col("lid") < F.col("lid2"))

    def meet(part: DataFrame, end: str) -> DataFrame:
        met = scratch.cut(part.join(marks, "lid"), f"cells{end}")
        near = met.join(_other(met, "band"), "band").filter(across & _hopeful()).select(F.col("lid").alias("a"), F.col("lid2").alias("b")).distinct()
        near = scratch.cut(near, f"direct{end}")
        scratch.drop(f"cells{end}")
        return near

    return _in_turns(cells, ["band"], most, meet, scratch)


def prefix_pairs(opened: DataFrame, marks: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): all pairs of different components that can reach the similarity. ``opened``: lid, comp, n, set.

    A pair of sizes m and n needs an overlap of PERCENT * (m + n) / (100 + PERCENT); sharing a shingle at
    the places p and q, counted from 1 in the rare-first order of both, it can have 1 + min(m - p, n - q) from
    the first such place on. Lines of a shingle's largest component are met by the others only, never by each other.
    """
    each = opened.repartition("lid").select("lid", "comp", "n", F.explode("set").alias("s"))
    slot = F.pmod("s", F.lit(1 << RARITY_BITS))
    seen = scratch.cut(each.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("seen")), "rarity")
    order = Window.partitionBy("lid").orderBy("seen", "s")
    placed = each.withColumn("slot", slot).join(F.broadcast(seen), "slot").withColumn("p", F.row_number().over(order))
    words = [f"w{k}_" for k in range(WORDS)]
    prefix = placed.filter(100 * (F.col("p") - 1) <= (100 - PERCENT) * F.col("n")).join(marks.drop("n"), "lid")
    posts = scratch.cut(prefix.select("s", "seen", "lid", "comp", "n", "p", *words), "posts")
    each = posts.groupBy("s", "comp").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("lid")).alias("who"), F.min("seen").alias("seen"))
    shares = each.groupBy("s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("c"), F.bit_xor("who").alias("who"), F.min("seen").alias("seen"))
    # shingles of one edit stand in the prefixes of the same lines: the first in order speaks for all
    first = shares.filter("lo <> hi").groupBy("c", "who").agg(F.min(F.struct("seen", "s", F.col("top.comp").alias("top"))).alias("f"))
    mixed = scratch.cut(first.select("f.s", "f.top"), "mixed")
    met = scratch.cut(likely(posts.drop("seen"), "s", mixed.select("s")).join(mixed, "s"), "met")
    scratch.drop("posts", "rarity", "mixed")
    free_shuffles(scratch.spark)
    x = met.filter("comp <> top")
    y = _other(met.drop("top"), "s")
    near = (
        (F.col("comp") != F.col("comp2"))
        & ((F.col("comp2") == F.col("top")) | (F.col("lid") < F.col("lid2")))
        & ((100 + PERCENT) * (1 + F.least(F.col("n") - F.col("p"), F.col("n2") - F.col("p2"))) >= PERCENT * (F.col("n") + F.col("n2")))
        & _hopeful()
    )
    return x.join(y, "s").filter(near).select(*_ordered(F.col("lid"), F.col("lid2"))).distinct()


def line_links(norms: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): the component of every distinct line that is similar to another, but for the roots. ``norms``: the table of that name."""
    spark = scratch.spark
    signed = scratch.cut(signatures(norms), "signed")
    n_lines = signed.count()
    free_shuffles(spark)
    live = _shared_cells(signed, scratch, range(0, BANDS, BANDS_AT_ONCE))
    again = scratch.cut(among(signed, "lid", live.select("lid").distinct()), "again")
    scratch.drop("signed")
    live = live.union(_shared_cells(again, scratch, range(BANDS, len(_GROUPS), _EACH)))
    texts = scratch.cut(among(norms.select("lid", "norm"), "lid", live.select("lid").distinct()).groupBy("lid").agg(F.max("norm").alias("norm")), "texts")
    scratch.drop("norms")
    free_shuffles(spark)
    sets = scratch.cut(_sets(texts), "sets")
    marks = scratch.cut(_marks(sets), "marks")
    bands = scratch.cut(_with_pivots(live), "bands")
    star = live.join(bands.select("band", F.explode("pivots").alias("pivot")), "band").filter("lid <> pivot")
    star = scratch.cut(star.select(*_ordered(F.col("lid"), F.col("pivot"))).distinct(), "star")
    free_shuffles(spark)
    marked = lambda part: part.join(marks.withColumnRenamed("lid", "a"), "a").join(_other(marks).withColumnRenamed("lid2", "b"), "b")
    pairs = _in_turns(star, ["a", "b"], MARKS_AT_ONCE * n_lines, lambda part, end: scratch.cut(marked(part).filter(_hopeful()).select("a", "b"), f"pairs{end}"), scratch)
    scratch.drop("star")
    known = _pivot_components(pairs, sets, texts, scratch, SETS_AT_ONCE * n_lines)
    free_shuffles(spark)

    comp = F.coalesce("root", "lid").alias("comp")
    partly = bands.filter(F.size("pivots") < F.col("n") - 1).select("band")
    marked = scratch.cut(live.join(partly, "band", "left_semi").join(known, F.col("lid") == F.col("node"), "left").select("band", "lid", comp), "marked")
    counts = marked.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("band").agg(F.sum("c").alias("n"), F.sum(F.col("c").cast("double") * F.col("c")).alias("within"))
    split = scratch.cut(counts.filter("within < double(n) * n").select("band", (F.col("n").cast("double") * F.col("n") - F.col("within") <= 2 * DIRECT * F.col("n")).alias("direct")), "split")
    scratch.drop("again", "bands", "pairs", *[f"{t}-{k}" for t in ("shared", "live") for k in range(0, len(_GROUPS))])
    rest = direct_pairs(marked.join(split.filter("direct").select("band"), "band", "left_semi"), marks, scratch, MARKS_AT_ONCE * n_lines).distinct()
    opened = marked.join(split.filter("not direct").select("band"), "band", "left_semi").select("lid", "comp").distinct()
    if not opened.isEmpty():
        opened = scratch.cut(opened.join(sets, "lid"), "opened")
        rest = rest.union(prefix_pairs(opened, marks, scratch)).distinct()
    rest = scratch.cut(rest, "rest")
    scratch.drop("marked", "split", "opened", "met", "marks")
    free_shuffles(spark)
    late = _verified(rest, sets, texts, scratch, "late", SETS_AT_ONCE * n_lines)
    scratch.drop("sets", "rest", "texts")
    free_shuffles(spark)
    if late.isEmpty():
        return known
    return components(known.select(F.col("node").alias("a"), F.col("root").alias("b")).union(late), scratch, "all")


def line_classes(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per line that isn't blank: doc_id, dk, line_no (from 0), keep_doc_id, keep_line_no, kept."""
    norms = scratch.cut(_norms(docs, F.col("doc_id"), document_key().alias("dk")), "norms")
    own = scratch.cut(norms.select("doc_id", "dk", "line_no", "lid").distinct(), "lines")
    free_shuffles(scratch.spark)
    roots = line_links(norms, scratch)
    free_shuffles(scratch.spark)
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "dk", "line_no")
    once = scratch.cut(own.groupBy("lid").agg(F.min(place).alias("f"), F.count(F.lit(1)).alias("n")).join(roots, F.col("lid") == F.col("node"), "left").select("lid", "f", "n", F.coalesce("root", "lid").alias("key")), "once")
    group = once.groupBy("key").agg(F.min("f").alias("f"), F.sum("n").alias("n")).filter("n > 1").select("key", "f")
    first = scratch.cut(once.select("lid", "key").join(group, "key").select("lid", "f"), "first")
    free_shuffles(scratch.spark)
    out = own.join(first, "lid", "left")
    alone = F.col("f").isNull()
    return out.select(
        "doc_id", "dk", "line_no", F.when(alone, F.col("doc_id")).otherwise(F.col("f.doc_id")).alias("keep_doc_id"), F.when(alone, F.col("line_no")).otherwise(F.col("f.line_no")).alias("keep_line_no"),
        (alone | ((F.col("f.dk") == F.col("dk")) & (F.col("f.line_no") == F.col("line_no")))).alias("kept"),
    )


def dedup_lines(docs: DataFrame, scratch: Scratch, count: str = "n_lines_removed") -> DataFrame:
    """``docs`` with the lines that don't stay taken out of text; the column ``count`` says how many."""
    gone = line_classes(docs, scratch).filter(~F.col("kept")).groupBy("dk").agg(F.collect_list("line_no").alias("gone"))
    gone = scratch.cut(gone, "gone")
    free_shuffles(scratch.spark)
    key, out_of = free_name(docs, "key"), free_name(docs, "out_of")
    gone = gone.select(F.col("dk").alias(key), F.col("gone").alias(out_of))
    left = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(out_of, i))
    out = docs.withColumn(key, document_key()).join(gone, key, "left")
    return out.withColumns({"text": F.when(F.col(out_of).isNull(), F.col("text")).otherwise(F.array_join(left, "\n")), count: F.coalesce(F.size(out_of), F.lit(0))}).drop(key, out_of)


def op4_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_classes(table(spark, sf_dir, "documents"), Scratch(spark, "linededup")).select("doc_id", "line_no", "keep_doc_id", "keep_line_no", "kept")
