"""Jaccard join, line dedup and the pipeline against brute force on small tables."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkwell.llm import jaccard_join, line_dedup
from inkwell.llm.common import Scratch
from inkwell.llm.components import components
from inkwell.llm.shingles import shingle_sets
from tests.llm.fixtures import docs, empty, rows

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def groups(sets, percent):
    """Least member of each linked group, by brute force."""
    up = {k: k for k in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(sets)
    for a in keys:
        for b in keys:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def word_set(text, k):
    w = [x.lower() for x in WORDS.findall((text or "").encode())]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near_copies(n=90, seed=4):
    """A group of near copies larger than HOT, some too far off to link."""
    rng = random.Random(seed)
    base = [f"b{k}" for k in range(80)]
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(80)] = f"e{rng.randrange(1000)}"
        out.append((1000 + k, " ".join(w), "en", "s0", 1, None, None, None, None))
    return out


def test_shingles_count_as_tuples():
    texts = ["a b c d e", "A B  c\td e", None, "", "a b", "x" * 3000000, "a a a a a a", "é ü ß 那 b", "a b c d e f g h " * 50000]
    for t, s in zip(texts, shingle_sets(texts, 4)):
        assert len(s) == len(word_set(t, 4)) and (s[1:] > s[:-1]).all()
    a, b, *_ = shingle_sets(texts, 4)
    assert a.tolist() == b.tolist()


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 7), (3, 2)] + [(k, k + 1) for k in range(100, 140)] + [(500, k) for k in range(501, 540)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "c").collect()}
    want = {2: 1, 3: 1, 9: 7, 8: 7} | {k: 100 for k in range(101, 141)} | {k: 500 for k in range(501, 540)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t"), "c").count() == 0


@pytest.mark.parametrize("block", [256, 16])
def test_jaccard_groups(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    data = [r for r in rows() if r[0] is not None] + near_copies()
    df = spark.createDataFrame(data, docs(spark).schema).repartition(4)
    sets = {r[0]: word_set(r[1], 4) for r in data}
    want = groups(sets, 85)
    got = jaccard_join.similarity_groups(df, Scratch(spark, "t"), 4, 85).collect()
    assert len(got) == len(data)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {k: (len(sets[k]), want[k]) for k in sets}
    kept = jaccard_join.one_per_group(df, Scratch(spark, "t"), 4, 85)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert jaccard_join.similarity_groups(empty(spark), Scratch(spark, "t")).count() == 0


def line_set(line):
    s, k = line.strip(" \t\n\x0b\x0c\r").lower(), line_dedup.SHINGLE
    return {s[i : i + k] for i in range(max(1, len(s) - k + 1))}


def test_line_classes(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(200)).strip() for _ in range(12)]
    texts = []
    for k in range(60):
        lines = []
        for _ in range(3):
            line = list(rng.choice(base))
            if rng.random() < 0.5:
                line[rng.randrange(len(line))] = "#"
            lines.append("".join(line))
        texts.append((k, "\n".join([*lines, "", "tiny", f"own {'xyz' * (k % 3)} {k}"])))
    texts += [(60, None), (61, ""), (62, "Tiny\n\n \t\nTINY")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"lid": F.lit(1), "band": F.lit("x")})
    lines = {(d, n): line for d, t in texts for n, line in enumerate((t or "").split("\n")) if line.strip()}
    want = groups({k: line_set(v) for k, v in lines.items()}, line_dedup.PERCENT)
    got = line_dedup.line_classes(df, Scratch(spark, "t")).collect()
    assert {(r.doc_id, r.line_no): (r.keep_doc_id, r.keep_line_no) for r in got} == want
    assert all(r.kept == ((r.doc_id, r.line_no) == (r.keep_doc_id, r.keep_line_no)) for r in got)
    out = {r.doc_id: r for r in line_dedup.dedup_lines(df, Scratch(spark, "t")).collect()}
    for d, t in texts:
        stay = [x for n, x in enumerate((t or "").split("\n")) if want.get((d, n), (d, n)) == (d, n)]
        assert out[d].text == (None if t is None else "\n".join(stay))
    assert line_dedup.line_classes(df.limit(0), Scratch(spark, "t")).count() == 0


def test_line_recall(spark):
    """Similarities from 0.7 to 0.95, and a family of a few hundred lines that share bands but not a component."""
    rng, letters = random.Random(11), "abcdefghijklmnopqrstuvwxyz    "
    text = lambda n: "".join(rng.choice(letters) for _ in range(n)).strip() + "."

    def edited(line, n):
        out = list(line)
        for _ in range(n):
            out[rng.randrange(len(out))] = rng.choice(letters)
        return "".join(out)

    bases = [text(rng.choice((60, 150, 400))) for _ in range(150)]
    lines = [x for b in bases for x in (b, edited(b, max(1, len(b) // rng.choice((60, 80, 110)))))]
    family = text(300)
    lines += [edited(family, rng.randint(0, 6)) for _ in range(250)] + [text(30000)] * 2
    lines.append(edited(lines[-1], 100))
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id long, text string")
    want = groups({k: line_set(x) for k, x in enumerate(lines) if x.strip()}, line_dedup.PERCENT)
    got = {r.doc_id: r.keep_doc_id for r in line_dedup.line_classes(df, Scratch(spark, "t")).collect()}
    assert set(got) == set(want) and all(want[k] == want[v] for k, v in got.items())  # nothing joined that isn't linked
    gone = sum(k != v for k, v in want.items())
    assert gone > 100 and sum(k != v for k, v in got.items()) >= 0.97 * gone


def counted_tables(monkeypatch):
    """The rows of every table that a run writes, by name."""
    made, cut = {}, Scratch.cut

    def counting(self, df, name):
        out = cut(self, df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "cut", counting)
    return made


def family(n, edits, length=400, seed=12):
    """Lines that are each some edits away from one text."""
    rng, letters = random.Random(seed), "abcdefghijklmnopqrstuvwxyz    "
    base = [rng.choice(letters) for _ in range(length - 1)] + ["."]
    lines = []
    for _ in range(n):
        line = list(base)
        for at in rng.sample(range(1, length - 1), rng.choice(edits)):
            line[at] = "#"
        lines.append("".join(line))
    return lines


def test_unlike_pairs_move_no_sets(spark, monkeypatch):
    """Lines that share bands but are far from similar are told apart by their marks, without their shingle sets."""
    made = counted_tables(monkeypatch)
    df = spark.createDataFrame(list(enumerate(family(100, [8]))), "doc_id long, text string")
    assert all(r.kept for r in line_dedup.line_classes(df, Scratch(spark, "t")).collect())
    assert made["sets"] > 50 and made["first-near"] + made["late-near"] < 20


def test_marks(spark):
    """Parities against brute force; a shingle changes its own word only, the others aren't worked out for it."""
    rng = random.Random(14)
    sets = [[], [0], [-1, -(1 << 31)], *[rng.sample(range(-(1 << 31), 1 << 31), n) for n in (3, 40, 700)]]
    df = spark.createDataFrame([(k, len(x), x) for k, x in enumerate(sets)], "lid long, n int, set array<int>")
    marks = line_dedup._marks(df)
    got = {r.lid: r for r in marks.collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    for k, r in got.items():
        odd = Counter((x % line_dedup.WORDS, x >> 4 & 63) for x in sets[k])
        assert r.n == len(sets[k])
        for w in range(line_dedup.WORDS):
            assert r[f"w{w}_"] % (1 << 64) == sum(1 << b for (v, b), c in odd.items() if v == w and c % 2)
    assert marks._jdf.queryExecution().optimizedPlan().toString().count("FILTER (WHERE") == line_dedup.WORDS


@pytest.mark.parametrize("direct", [0, 512])
def test_bands_of_many_components(spark, monkeypatch, direct):
    """The rest of a band, pair by pair and by prefixes, against brute force."""
    monkeypatch.setattr(line_dedup, "DIRECT", direct, raising=False)
    monkeypatch.setattr(line_dedup, "PIVOTS", 1)
    made = counted_tables(monkeypatch)
    lines = family(150, range(1, 6))
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    want = groups({k: line_set(x) for k, x in enumerate(lines)}, line_dedup.PERCENT)
    got = {r.doc_id: r.keep_doc_id for r in line_dedup.line_classes(df, Scratch(spark, "t")).collect()}
    assert got == want and 10 < sum(k != v for k, v in want.items())
    assert made["late-links"] and (made["cells"] > 0) == (direct > 0) and ("opened" in made) == (direct == 0)


def test_pairs_move_in_turns(spark, monkeypatch):
    """However many pairs meet, what they need is moved for a bounded number at once, and every pair has its turn."""
    monkeypatch.setattr(line_dedup, "LEAST", 1)
    scratch, made = Scratch(spark, "t"), {}
    pairs = spark.range(1000).select((F.col("id") % 7).alias("a"), F.col("id").alias("b"))

    def work(part, end):
        out = scratch.cut(part, f"part{end}")
        made[end] = out.count()
        return out

    got = line_dedup._in_turns(pairs, ["a", "b"], 400, work, scratch)
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in pairs.collect())
    assert list(made) == ["", "-1", "-2"] and max(made.values()) < 400
    assert line_dedup._in_turns(pairs.limit(0), ["a", "b"], 400, work, scratch).count() == 0


def test_one_component_is_verified_once(spark, monkeypatch):
    """Lines that all are similar meet several pivots, but the sets of about one pair a line are moved."""
    made = counted_tables(monkeypatch)
    df = spark.createDataFrame(list(enumerate(family(120, [1, 2]))), "doc_id long, text string")
    got = {r.keep_doc_id for r in line_dedup.line_classes(df, Scratch(spark, "t")).collect()}
    assert got == {0} and made["pairs"] > 2 * 120
    assert sum(n for k, n in made.items() if k.endswith("-near")) < 1.5 * 120


def test_minima_agree_as_sets_do(spark):
    """Two lines share a minimum as often as a shingle of both is one of both, however short they are; nothing depends on copies."""
    rng, letters = random.Random(8), "abcdefghijklmnopqrstuvwxyz"
    for n in (9, 14, 40, 300):
        lines = []
        for _ in range(150):
            line = [rng.choice(letters) for _ in range(n)]
            lines += ["".join(line), "".join([*line[:-2], "#", "#"])]
        df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)] * 2, "lid long, norm string")
        got = {r.lid: r.minima for r in line_dedup.signatures(df.repartition(3)).collect()}
        assert len(got) == 300 and all(len(m) == line_dedup.MINIMA and None not in m for m in got.values())
        same = sum(a == b for k in range(0, 300, 2) for a, b in zip(got[k], got[k + 1])) / (150 * line_dedup.MINIMA)
        x, y = line_set(lines[0]), line_set(lines[1])
        assert abs(same - len(x & y) / len(x | y)) < 0.06


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "some line of text here"), (1, "some line of text here"), (2, "some line of text here\nown line"), (None, "some line of text here")], "doc_id long, text string")
    df = df.withColumns({c: F.lit("mine") for c in ("_key", "_out_of", "dk", "gone", "n_lines_removed", "lid", "norm", "bit", "word", "set")})
    out = line_dedup.dedup_lines(df, Scratch(spark, "t"), "removed_here")
    assert out.columns == [*df.columns, "removed_here"]
    rows = sorted((r.doc_id or 9, r.text, r._key, r.n_lines_removed, r.removed_here) for r in out.collect())
    first = (1, "some line of text here", "mine", "mine", 0)
    assert rows == [first, first, (2, "own line", "mine", "mine", 1), (9, "", "mine", "mine", 1)]


def test_pipeline(spark):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120)
    odd = spark.createDataFrame([(9001, None, "en", "s", None), (9002, "", None, None, 0), (9003, "12 34", "en", "s", 5)], source.schema)
    now, scratch = scratch_start = source.union(odd), Scratch(spark, "t")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, now = now, scratch.cut(stage(spark, now, ""), f"{k}")
        if k < 4:
            assert now.columns == scratch_start[0].columns
        ids = {r.doc_id for r in now.select("doc_id").collect()}
        assert ids and ids <= {r.doc_id for r in before.select("doc_id").collect()}
        if k == 0:
            assert not ids & {9001, 9002, 9003}
    assert corpus_pipeline.STAGES[0][1](spark, source.limit(0), "").count() == 0
