"""Exact dedup, sharding, line frequency and mixing against brute force."""

import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import exact_dedup, line_frequency, mixing, sharding
from inkwell.llm.common import Scratch, free_shuffles
from tests.llm.fixtures import docs, empty, rows

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_filter_round_trip_and_merge():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        a = rng.integers(0, 2**40, n, dtype=np.uint64)
        parts = [exact_dedup.CountingQuotientFilter.of(*np.unique(x, return_counts=True), 40) for x in (a, a[: n // 2], np.repeat(a[:1], 300))]
        parts = [exact_dedup.CountingQuotientFilter.from_bytes(p.to_bytes()) for p in parts]
        f = exact_dedup.merge_filters(parts)
        want = Counter(np.concatenate([a, a[: n // 2], np.repeat(a[:1], 300)]).tolist())
        assert dict(zip(f.values().tolist(), f.counts.tolist())) == want
        assert exact_dedup.CountingQuotientFilter.from_bytes(f.to_bytes()).values().tolist() == f.values().tolist()


def test_exact_groups(spark):
    got = exact_dedup.exact_groups(docs(spark), Scratch(spark, "t")).collect()
    by = defaultdict(list)
    for r in rows():
        by[r[1] or ""].append(r[0])
    assert len(got) == len(rows())
    want = {i: (max(x for x in g if x is not None) if any(x is not None for x in g) else None, len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in by.items() for i in g}
    assert {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in got} == want
    assert sum(r.kept for r in got) == len(by) and all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.exact_groups(empty(spark), Scratch(spark, "t")).count() == 0


def test_fingerprints_shared_by_two_texts(spark):
    same = spark.createDataFrame([(1,), (1,), (2,)], "fp long")
    assert [tuple(r) for r in exact_dedup.repeated_fingerprints(same, 3).collect()] == [(1, 2)]


def test_flow_moves_the_fewest_bytes():
    rng = np.random.default_rng(2)
    for _ in range(20):
        have = rng.integers(0, 1000, 5).tolist()
        cap = sharding.equal_capacities(sum(have), 7)
        flow = sharding.min_cost_flow(have, cap, lambda i, j: int(i != j))
        assert [sum(f for (i, _), f in flow.items() if i == k) for k in range(5)] == have
        assert all(sum(f for (_, j), f in flow.items() if j == k) <= cap[k] for k in range(7))
        assert sum(f for (i, j), f in flow.items() if i != j) == sum(max(0, h - c) for h, c in zip(have, cap))
    with pytest.raises(ValueError):
        sharding.min_cost_flow([5], [4], lambda i, j: 0)


def test_reshard(spark, tmp_path):
    base = docs(spark, 400).drop("size", "block")
    placed, facts = sharding.reshard(base, 3, 4, Scratch(spark, "t"))
    got = sharding.with_slots(placed, Scratch(spark, "t")).collect()
    assert len(got) == len(rows(400))
    size = Counter()
    for r in got:
        size[r.shard] += len((r.text or "").encode()) + 1
    biggest = max(len(t.encode()) * n for t, n in Counter(r[1] or "" for r in rows(400)).items())
    assert max(size.values()) - min(size.values()) <= 2 * biggest
    assert len({(r.text or "", r.shard) for r in got}) == len({r.text or "" for r in got})
    for s in size:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    touched = sharding.rewrite(placed, facts, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == sum(r.shard in touched for r in got)
    assert sharding.with_slots(sharding.reshard(empty(spark), 3, 4, Scratch(spark, "t"))[0], Scratch(spark, "t")).count() == 0


def test_resharding_returns_what_the_files_hold(spark, tmp_path, monkeypatch):
    base = docs(spark, 400).drop("size", "block")
    base.write.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    real = sharding.rewrite

    def rewrite(placed, facts, out_dir, *more):
        seen.append((out_dir, real(placed, facts, out_dir, *more)))
        return seen[-1][1]

    monkeypatch.setattr(sharding, "rewrite", rewrite)
    got = sharding.op1_min_cost_resharding(spark, str(tmp_path)).collect()
    (out_dir, touched), = seen
    files = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()), r.shard) for r in spark.read.parquet(out_dir).collect())
    mine = Counter((r.doc_id, r.size, r.text_crc32, r.shard) for r in got)
    assert touched and files == Counter({k: n for k, n in mine.items() if k[3] in touched})
    assert sorted(map(str, (r[0] for r in got))) == sorted(str(r[0]) for r in rows(400))
    placed, _ = sharding.reshard(base, sharding.OLD, sharding.NEW, Scratch(spark, "t"))
    key = lambda r: (r.doc_id, r.old_shard, r.shard, r.slot)
    assert Counter(map(key, got)) == Counter(map(key, sharding.with_slots(placed, Scratch(spark, "t")).collect()))


def test_untouched_shards_are_not_written(spark):
    base = docs(spark, 400).drop("size", "block")
    size = sum(len((r[1] or "").encode()) + 1 for r in rows(400))
    placed, facts = sharding.reshard(base, 3, 3, scratch := Scratch(spark, "t"), capacities=[1, size, size])
    touched = {x for (o, j) in facts["moves"] if o != j for x in (o, j)}
    got = sharding.resharded(placed, facts, scratch)
    shards = lambda df: {r.shard for r in df.select("shard").distinct().collect()}
    assert len(touched) == 2 and shards(spark.read.parquet(f"{scratch.dir}/shards")) <= touched and shards(got) - touched
    same = lambda df: Counter((r.doc_id, r.text, r.shard) for r in df.collect())
    assert got.columns == [*base.columns, "shard"] and same(got) == same(placed)
    stay, facts = sharding.reshard(base, 2, 2, Scratch(spark, "t"), capacities=[size, size])
    assert facts["moved"] == 0 and sharding.resharded(stay, facts, Scratch(spark, "t")).count() == len(rows(400))
    none, facts = sharding.reshard(empty(spark), 3, 4, Scratch(spark, "t"))
    assert sharding.resharded(none, facts, Scratch(spark, "t")).count() == 0


def brute_counts(text):
    words = WORDS.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    win = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    n = Counter(win)
    covered = {k + d for k, w in enumerate(win) if n[w] > 1 for d in range(3)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def letters(*n):
    return "".join(chr(97 + k % 26) + chr(97 + k // 26) for k in n)


def test_line_frequency(spark):
    extra = [(1000 + k, f"Shared  line {k}\n" + " ".join(letters(k, j) for j in range(60)), "en", "big", 1, None, None, None, None) for k in range(30)]
    extra += [(2000, "shared line 7\n" * 30 + "x y z", "en", "big", 1, None, None, None, None)]
    df = docs(spark).union(spark.createDataFrame(extra, docs(spark).schema))
    got = {r.doc_id: r for r in line_frequency.line_frequency(df, Scratch(spark, "t"), min_docs=5).collect()}
    for r in rows() + extra:
        g = got[r[0]]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == brute_counts(r[1])
        assert g.base_failed == (g.n_words < 50 or 100 * g.n_repeat_words > 50 * g.n_words)
    assert all(got[1000 + k].kept and got[1000 + k].words_left == 60 and len(got[1000 + k].removed_lines) == 1 for k in range(30))
    assert not got[2000].kept and got[2000].words_left == 3
    assert all(got[60 + 3 + k].words_left == got[63].n_words for k in range(7))
    joined = df.filter("doc_id = 1003").select(line_frequency.without_lines(F.col("text"), F.array(F.lit(got[1003].removed_lines[0])))).first()[0]
    assert joined.startswith(letters(3, 0)) and line_frequency.line_frequency(empty(spark), Scratch(spark, "t")).count() == 0


def test_line_verdict_against_brute_force(spark):
    """Removal and depletion at their limits, with a null host, copies and repeated lines; ASCII lines, so lower case is plain."""
    rng = np.random.default_rng(4)
    own = lambda k, n: " ".join(letters(k // 26, k, j) for j in range(n))
    data = []
    for k in range(160):
        host = ["a", "b", None][k % 3]
        shared = [f"Common  {letters(j)} line" for j in range(6) if rng.random() < 0.06 + 0.1 * j]
        data.append((k, "\n".join([*shared, *shared[:1], own(k, int(rng.integers(40, 60))), ""]), host))
    data += [(1000 + k, data[0][1], "a") for k in range(40)] + [(2000, None, "a"), (2001, "", None)]
    for extra in (20, 21):  # exactly at the limit and one above
        data += [(3000 + 100 * extra + k, f"edge {letters(extra, extra)}\n" + own(500 + 30 * extra + k, 60), f"edge{extra}") for k in range(extra)]
    norm = lambda line: " ".join(re.sub("[0-9]+", "0", " ".join(WORDS.findall(line)).lower()).split())
    seen = defaultdict(set)
    for _, t, h in data:
        for line in (t or "").split("\n"):
            if WORDS.search(line):
                seen[h, norm(line)].add(t)
    want = {}
    for k, t, h in data:
        lines = [x for x in (t or "").split("\n") if WORDS.search(x)]
        gone = [x for x in lines if len(seen[h, norm(x)]) > 20]
        n, rep = brute_counts(t)[0], brute_counts(t)[4]
        left = n - sum(len(WORDS.findall(x)) for x in gone)
        want[k] = (left, len({norm(x) for x in gone}), not (n < 50 or 100 * rep > 50 * n) and not (gone and (left < 50 or left < 0.5 * n)))
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(5)
    got = {r.doc_id: (r.words_left, len(r.removed_lines), r.kept) for r in line_frequency.line_frequency(df, Scratch(spark, "t")).collect()}
    assert got == want and {want[k][1] for k in range(5000, 5020)} == {0} and {want[k][1] for k in range(5100, 5121)} == {1}
    assert len({v[2] for k, v in want.items() if v[1]}) == 2  # lines are removed from kept and from rejected documents


def test_line_limit_of_a_hot_source(spark):
    own = lambda k, n: " ".join(letters(k, j) for j in range(n))
    passage = " ".join(f"passage{letters(j, j)}" for j in range(60))
    data = []
    for k in range(600):  # a footer in 4 %, a line in 20 documents, a passage in 25 of which 5 have little else
        extra = "footer line\n" * (k < 24) + "rare line\n" * (100 <= k < 120) + (passage + "\n") * (200 <= k < 225)
        data.append((k, extra + f"x{letters(k // 26, k)} " + own(k, 12 if 220 <= k < 225 else 60), "hot"))
    data += [(1000 + k, f"footer line\n{letters(k, k)} " + own(k, 60), "cold") for k in range(20)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(4)
    got = {r.doc_id: r for r in line_frequency.line_frequency(df, Scratch(spark, "t")).collect()}
    assert {k for k, r in got.items() if r.removed_lines} == set(range(24)) | set(range(200, 225))
    assert {k for k, r in got.items() if not r.kept} == set(range(220, 225))
    assert all(got[k].words_left == 61 for k in range(24)) and got[220].words_left == 13


def test_targets_and_counts():
    assert mixing.targets([100, 100], [1, 3]) == [50, 150]
    assert mixing.targets([10, 1000, 0], [10, 1, 5]) == [30, 980, 0]
    quota = [100, 5000, 0, 9000]
    draws = list(mixing.shard_draws(quota, 64, 0, 10**6))
    c, before = np.array([d[1] for d in draws]), np.array([d[2] for d in draws])
    assert [d[0] for d in draws] == list(range(221)) and c.min() >= 0
    assert c.sum(axis=0).tolist() == quota and (c.sum(axis=1)[:-1] == 64).all() and (before == np.cumsum(c, axis=0) - c).all()
    some = list(mixing.shard_draws(quota, 64, 37, 90))  # as a task that has only these
    assert [d[0] for d in some] == list(range(37, 90)) and all((d[1] == c[d[0]]).all() and (d[2] == before[d[0]]).all() for d in some)
    assert list(mixing.shard_draws([], 64, 0, 5)) == list(mixing.shard_draws([0, 0], 64, 0, 5)) == []
    spread = c[:-1, 3].var() / (64 * (9000 / 14100) * (5100 / 14100))
    assert 0.6 < spread < 1.6  # about that of a multinomial draw
    great = [3 * 10**10, 5, 7 * 10**10, 0]
    half = mixing._draw(np.array(great), 5 * 10**10, np.random.default_rng(1))
    assert half.sum() == 5 * 10**10 and (half >= 0).all() and (half <= great).all()
    assert abs(half[0] - 1.5 * 10**10) < 5 * (5 * 10**10 * 0.3 * 0.7 / 2) ** 0.5
    assert mixing._draw(np.array(great), sum(great), np.random.default_rng(1)).tolist() == great
    for n in (1, 2, 3, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 5).tolist()) == list(range(n))


def test_mixing(spark):
    mixed, placed, sources = mixing.mix(docs(spark), Scratch(spark, "t"))
    size = Counter()
    for r in rows():
        size[r[3]] += len(WORDS.findall(r[1] or ""))
    assert {s["source"]: s["size"] for s in sources} == size and [s["source"] for s in sources] == ["s0", "s1", "é", None]
    took, each = Counter(), Counter()
    for r in mixed.collect():
        took[r.src] += r.words
        each[r.rid] += r.words
    full = {r.rid: r["size"] for r in placed.collect()}
    assert all(each[k] <= 3 * full[k] for k in each)
    for s in sources:
        assert abs(took[s["src"]] - s["target"]) <= 3 * mixing.BLOCK_WORDS and s["target"] <= 3 * s["size"]
    text = {r[0]: WORDS.findall(r[1] or "") for r in rows()}
    taken = Counter()
    for r in mixing.with_text(mixed, docs(spark)).collect():
        got = WORDS.findall(r.text)
        taken[r.doc_id] += len(got)
        assert set(got) <= set(text[r.doc_id]) and len(got) <= 2 * len(text[r.doc_id])
    assert sum(taken.values()) == sum(took.values())
    clash = docs(spark).selectExpr("*", "doc_id AS _same", "doc_id AS _hashed", "doc_id AS _SIZE", "doc_id AS turn", "doc_id AS at")
    odd = mixing.with_text(mixed, clash, "pass").collect()
    assert Counter((r.doc_id, r.text) for r in odd) == Counter((r.doc_id, r.text) for r in mixing.with_text(mixed, docs(spark)).collect())
    assert all(r._same == r._hashed == r._SIZE == r.turn == r.doc_id for r in odd)
    again, _, _ = mixing.mix(docs(spark), Scratch(spark, "t"))
    assert again.count() == mixed.count()
    m, p, s = mixing.mix(empty(spark), Scratch(spark, "t"))
    assert m.count() == 0 and p.count() == 0 and s == []


def test_crc():
    assert zlib.crc32(b"") == 0


def test_freed_native_memory_goes_back(spark):
    """What the driver's JVM freed outside its heap doesn't stay with the C library, though a few pieces in between are in use."""
    jvm = spark.sparkContext._jvm
    status = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup")
    held = lambda: int(re.search(r"Pss_Anon:\s+(\d+)", status.read_text())[1]) / 1024
    pieces = [jvm.java.nio.ByteBuffer.allocateDirect(1 << 16) for _ in range(4000)]
    free_shuffles(spark)
    before, pieces = held(), pieces[::50]
    for _ in range(8):  # the JVM learns a little later what Python holds no more
        free_shuffles(spark)
        if held() < before - 120:
            break
        time.sleep(0.5)
    assert len(pieces) == 80 and held() < before - 120
