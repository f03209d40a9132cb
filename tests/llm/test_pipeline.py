"""Every stage of the pipeline against brute force: kept ids, texts and all other columns."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from inkwell.llm import mixing, packing
from inkwell.llm.common import Scratch
from inkwell.llm.tokens import tokenizer_path
from tests.llm.test_similarity import groups, line_set, word_set


def flowed(words, first):
    """Lines of 18 words, the first of ``first``."""
    at = [0, *range(first, len(words), 18), len(words)]
    return "\n".join(" ".join(words[a:b]) for a, b in zip(at, at[1:]) if a < b)


def corpus(seed=6):
    """(rows, ids to be rejected): two languages, near copies, chains of them, similar lines, and what is no language."""
    rng = random.Random(seed)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 8)))
    vocabulary = {"en": [word("abcdefghiklm") for _ in range(150)], "de": [word("nopqrstuäöü") for _ in range(150)]}
    texts = []
    for lang, own in vocabulary.items():
        said = lambda n: [rng.choice(own) for _ in range(n)]  # noqa: B023, E731
        base = [said(72) for _ in range(40)]
        texts += [(flowed(w, 18), lang) for w in base]
        for k, w in enumerate(base[:18]):  # one word differs: a near copy; one more: a chain; two at once: neither
            one = [*w[:20], "zz", *w[21:]]
            texts.append((flowed(one, 9), lang))
            if k % 3 == 0:
                texts.append((flowed([*one[:50], "yy", *one[51:]], 5), lang))
            if k % 3 == 1:
                texts[-1] = (flowed([*one[:50], "yy", *one[51:]], 9), lang)
        footer = " ".join(said(24))
        changed = lambda n: "".join("#" if i % 40 in range(20, 21) and i // 40 in n else c for i, c in enumerate(footer))  # noqa: B023, E731
        texts += [(x + ("\n\n" if k % 2 else "\n") + flowed(said(36), 18), lang) for k, x in enumerate([footer, changed({0}), changed({1}), changed({0, 1, 2}), footer.upper()])]
        texts += [(footer + "\n \n" + changed({1}), lang)]
    rng.shuffle(texts)
    rows = [(k, t, lang, rng.choice(["s0", "s1"]), len(t)) for k, (t, lang) in enumerate(texts)]
    odd = [" ".join(word("bcdfghjklmnpqrstvwxz") for _ in range(60)) for _ in range(4)] + [None, "", "12 34\n5"]
    rows += [(9000 + k, t, None if k < 4 else "en", "s0", len(t or "")) for k, t in enumerate(odd)]
    return rows, set(range(9000, 9000 + len(odd)))


def test_stages_equal_brute_force(spark):
    rows, rejected = corpus()
    scratch = Scratch(spark, "t")
    table = lambda df: Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect())
    stage = lambda k, df: scratch.cut(corpus_pipeline.STAGES[k][1](spark, df, ""), f"{k}")
    now = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4, "doc_id")

    now, want = stage(0, now), [r for r in rows if r[0] not in rejected]
    assert table(now) == Counter(want)

    now = stage(1, now)
    first = groups({(r[0], n): line_set(x) for r in want for n, x in enumerate(r[1].split("\n")) if x.strip()}, 80)
    before, want = want, []
    for i, text, lang, source, _ in before:
        lines = text.split("\n")
        left = [x for n, x in enumerate(lines) if first.get((i, n), (i, n)) == (i, n)]
        if len(left) == len(lines) or "".join(left).strip():
            want.append((i, "\n".join(left), lang, source, len("\n".join(left))))
    assert len(want) < len(before) and len(set(want) - set(before)) > 4
    assert table(now) == Counter(want)

    now = stage(2, now)
    before, least = want, groups({r[0]: word_set(r[1], 5) for r in want}, 80)
    want = [r for r in want if least[r[0]] == r[0]]
    assert 20 < len(before) - len(want) < len(before) - 80 and 3 in Counter(least.values()).values()
    assert table(now) == Counter(want)

    placed, sources = mixing.measure(now, Scratch(spark, "t"))
    slots = mixing.slot_table(spark, sources).collect()
    now, words, stream, spans = stage(3, now), {r[0]: r[1].split() for r in want}, defaultdict(list), defaultdict(list)
    for r in sorted(placed.collect(), key=lambda r: r.start):
        assert r.start == sum(n for _, n, _ in stream[r.src]) and r["size"] == len(words[r.doc_id])
        stream[r.src].append((r.start, r["size"], r.doc_id))
    took, b = Counter(), mixing.BLOCK_WORDS
    for s in slots:
        for start, n, i in stream[s.src]:
            low, high = max(start, s.block * b), min(start + n, (s.block + 1) * b)
            if low < high:
                spans[i, s.turn].append((low - start, high - low))
                took[s.src] += high - low
    total = sum(map(len, words.values()))
    assert sorted(i for x in stream.values() for *_, i in x) == sorted(words) and len(sources) == 2
    assert all(abs(took[k] - total * (k + 1) / 3) <= 3 * b for k in range(2))
    rest, before, want = {r[0]: r[1:] for r in want}, want, []
    for (i, _), parts in spans.items():
        text, lang, source, _ = rest[i]
        if sum(n for _, n in parts) < len(words[i]):
            text = " ".join(w for at, n in sorted(parts) for w in words[i][at : at + n])
        want.append((i, text, lang, source, len(text)))
    assert table(now) == Counter(want)

    got = stage(4, now).collect()
    t, pieces = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), []
    for r in want:
        ids = np.array([*t.encode(r[1], add_special_tokens=False).ids, packing.END_ID], "<u4")
        assert len(ids) < 2048
        pieces.append((r[0], 0, 0, len(ids), zlib.crc32(ids.tobytes())))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == Counter(pieces)
    lies, room = defaultdict(list), []
    for r in got:
        lies[r.sequence_id].append((r.offset, r.length))
    for x in lies.values():
        assert all(at == sum(n for _, n in sorted(x)[:k]) for k, (at, _) in enumerate(sorted(x))) and sum(n for _, n in x) <= 2048
    for n in sorted((p[3] for p in pieces), reverse=True):  # best fit, the longest first
        k = min((k for k in range(len(room)) if room[k] >= n), key=lambda k: room[k], default=None)
        if k is None:
            room.append(2048 - n)
        else:
            room[k] -= n
    assert sorted(lies) == list(range(len(lies))) and len(lies) <= len(room)
