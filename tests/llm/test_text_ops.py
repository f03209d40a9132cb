"""Tokens, packing, chat and language against the libraries and brute force."""

import hashlib
import json
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkwell.llm import chat, language, packing, token_count
from inkwell.llm.common import Scratch
from inkwell.llm.tokens import Pieces, tokenizer_path, worker_pieces
from tests.llm.fixtures import docs, empty, rows

WORD, BYTE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")
ODD = ["İstanbul ſ ǅ ß", "a<|endoftext|>b", "<|startoftext|> x", " \t\n x", "ﬀ 那🦀", "", "éé", "x y\x1cz", "'S it'll  a  \n\n b", "½²ª", "é", "a\u0085b", "x" * 5000, " " * 3000 + "x", "\n \t" * 999]


@pytest.mark.parametrize("path, word", [(WORD, True), (BYTE, False)])
def test_pieces_equal_the_library(path, word):
    p, t = Pieces(path, word), Tokenizer.from_file(path)
    for text in ODD + [r[1] or "" for r in rows()]:
        ids = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(p.ids(text), "<u4").tolist() == ids and p.count(text) == len(ids)


def test_byte_vocabulary_is_encoded_by_rank(tmp_path):
    assert Pieces(BYTE, False).fast is not None
    spec = json.loads(Path(BYTE).read_text(encoding="utf-8"))
    spec["model"]["merges"] = spec["model"]["merges"][::-1]  # tokens that their own bytes no longer merge to
    (other := tmp_path / "other.json").write_text(json.dumps(spec), encoding="utf-8")
    p, t = Pieces(str(other), False), Tokenizer.from_file(str(other))
    assert p.fast is None
    assert np.frombuffer(p.ids("some words here"), "<u4").tolist() == t.encode("some words here").ids


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("ab the'sré 12½²\n\t.,-—<|>Ⱥİ"), max_size=80))
def test_any_plain_text_equals_the_library(text):
    for path, word in ((WORD, True), (BYTE, False)):
        p = worker_pieces(path, word)
        assert np.frombuffer(p.ids(text), "<u4").tolist() == p.tok.encode(text, add_special_tokens=False).ids
        assert p.count(text) == len(p.ids(text)) // 4


def test_count_tokens(spark):
    got = token_count.count_tokens(docs(spark), WORD, True).collect()
    t = Tokenizer.from_file(WORD)
    want = sorted((r[0] is not None, r[0], len((r[1] or "").encode()), len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows())
    assert sorted((r.doc_id is not None, r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert token_count.count_tokens(empty(spark), WORD, True).count() == 0


def test_plan_holds_the_histogram():
    rng = np.random.default_rng(0)
    for n in (0, 1, 30, 20000):
        h = np.bincount(np.minimum(256, rng.lognormal(4, 1, n).astype(int) + 1), minlength=257)
        plan, back = packing.plan(h, 256), np.zeros(257, int)
        for a, y in plan:
            assert sum(a) <= 256 and y > 0
            for x in a:
                back[x] += y
        assert (back == h).all()
        least = -(-int((h * np.arange(257)).sum()) // 256)
        assert sum(y for _, y in plan) <= least * 1.01 + 1
        if n == 20000:
            used, bound = packing.configuration_lp(h, 256)
            assert bound <= sum(y for _, y in plan) and sum(packing.rounded(used, h)[0].values()) > 0.8 * bound


def test_program_beats_best_fit():
    rng, ours, plain = np.random.default_rng(1), 0, 0
    for _ in range(6):
        h = np.zeros(101, int)
        for x in rng.choice(np.arange(20, 60), 12, replace=False):
            h[x] = rng.integers(5, 60)
        ours += sum(y for _, y in packing.plan(h, 100))
        plain += sum(y for _, y in packing.best_fit(h, 100))
    assert ours < plain


def test_packing_reaches_the_least_number():
    """Small cases against an exhaustive search."""

    def least(items, free):
        if not items:
            return 0
        x, rest, tried, out = items[0], items[1:], set(), len(items)
        for k, f in enumerate(free):
            if f >= x and f not in tried:
                tried.add(f)
                out = min(out, least(rest, free[:k] + (f - x,) + free[k + 1 :]))
        return min(out, 1 + least(rest, (*free, 20 - x)))

    rng, over = np.random.default_rng(2), 0
    for _ in range(40):
        items = sorted(rng.integers(3, 16, 7).tolist(), reverse=True)
        n, best = sum(y for _, y in packing.plan(np.bincount(items, minlength=21), 20)), least(items, ())
        assert best <= n <= best + 1
        over += n > best
    assert over <= 4


def test_pack(spark):
    got = packing.pack(docs(spark), Scratch(spark, "t"), BYTE, 256).collect()
    t, want = Tokenizer.from_file(BYTE), []
    for r in rows():
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        for k, (s, n) in enumerate(packing.cut_pieces(len(ids), 256)):
            want.append((str(r[0]), k, s, n, zlib.crc32(ids[s : s + n].tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for seq in by.values():
        at = 0
        for o, n in sorted(seq):
            assert o == at
            at += n
        assert at <= 256
    assert len(by) <= -(-sum(r.length for r in got) // 256) + 2
    assert packing.pack(empty(spark), Scratch(spark, "t"), BYTE).count() == 0
    assert packing.cut_pieces(4096, 2048) == [(0, 2048), (2048, 2048)] and packing.cut_pieces(2049, 2048) == [(0, 1), (1, 2048)]


@given(st.text(alphabet="<>|[]\\/sINTSY_imend\n", max_size=60) | st.sampled_from(["<|im_start|>", "<\\|im_end|>", "<</SYS>>", chat.PLANTED]), st.text(max_size=10))
def test_template_round_trip(text, role):
    for c in chat.CONTROL:
        assert c not in chat.escape(text)
    formatted, spans = chat.format_turns([(role, text, True), ("user", text, False)])
    assert chat.parse_turns(formatted) == [(role, text), ("user", text)]
    assert chat.unescape(formatted[spans[0][0] : spans[0][1]]) == text


def test_chat(spark):
    talk = [(1, 0, "system", "be kind"), (1, 1, "user", "hi " * 30), (1, 2, "assistant", None), (1, 3, "user", "<s>"), (2, 0, "system", "alone"), (3, -5, "user", "second"), (3, None, "assistant", "first"), (3, 5, "user", "x"), (3, -1, None, "y"), (-7, 0, "user", chat.PLANTED), (-7, 1, "assistant", chat.PLANTED)]
    talk += [(4, k, ["user", "assistant"][k % 2], f"word{k} " * (700 if k in (5, 20) else 12)) for k in range(1, 700)] + [(4, 0, "system", "rules")]
    talk += [(5, 0, "system", "stay calm " * 120)] + [(5, k, "a role of many words " * 3, "<s>[INST] " * 4) for k in range(1, 40)]
    df = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash"))
    made = Scratch(spark, "t").cut(chat.windows(df, Scratch(spark, "t"), BYTE, 400, 200, 60), "w")
    by = defaultdict(list)
    for k, r in enumerate(talk):
        by[r[0]].append((r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{t[2]}\n{t[3]}\n" for t in turns)
        assert got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    ws = sorted((w for w in made.collect() if w.conv_id == 4), key=lambda w: w.window)
    coder = Tokenizer.from_file(BYTE)
    coder.encode_special_tokens = True
    for w in made.collect():
        assert w.n_tokens == len(coder.encode(w.formatted, add_special_tokens=False).ids) and (w.n_tokens <= 400 or w.over_budget)
        assert not (w.conv_id == 5 and w.over_budget)
    assert len(ws) > 5 and all(w.n_tokens <= 400 or w.over_budget for w in ws) and sum(w.over_budget for w in ws) == 2
    assert all(chat.parse_turns(w.formatted)[0] == ("system", "rules") for w in ws) and any(w.n_context > 1 for w in ws)
    assert chat.windows(df.limit(0), Scratch(spark, "t"), BYTE).count() == 0


def test_kneser_ney_sums_to_one():
    text = "the cat sat on the mat and the hat "
    alphabet = language.make_alphabet({ord(c): text.count(c) for c in set(text) if c != " "})
    c = language.codes(alphabet[language.lowered(text)], language.ORDER)
    m = language.Models.fit(["x"], alphabet, [np.unique(c, return_counts=True)])
    symbols = np.arange(language.ALPHABET + 3, dtype=np.uint8)
    for context in ("the", "zzz", "  t", "at "):
        h = language.codes(alphabet[language.lowered(context)], 3)[-1]
        code = (np.full(len(symbols), h, np.uint32) << np.uint32(language.BITS)) | symbols
        assert abs(np.exp(m.log_probs(symbols, code)).sum() - 1) < 1e-3


def test_language(spark):
    sf = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    models = language.train(language.training_rows(sf, ~language.held_out()), Scratch(spark, "t"))
    got = language.identify(sf.withColumn("held", language.held_out()), models, "doc_id", "lang", "held").collect()
    held = [r for r in got if r.held]
    assert len(got) == sf.count() and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert sum(not r.accepted for r in got) <= 0.01 * len(got) and all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "那那那 那那"), (5, "a"), (6, ("the and of " * 30000)), (7, "½ ²"), (8, "① Ⅷ")], "doc_id long, text string")
    out = {r.doc_id: r for r in language.identify(odd, models, "doc_id").collect()}
    assert [out[k].lang_pred for k in (1, 2, 3, 7, 8)] == ["und"] * 5 and not out[4].accepted and out[6].lang_pred == "en"
    none = language.train(language.training_rows(empty(spark), F.lit(True)), Scratch(spark, "t"))
    assert {r.lang_pred for r in language.identify(odd, none, "doc_id").collect()} == {"und"}
    assert language.identify(empty(spark), models, "doc_id").count() == 0
    a, b = models.cross_entropies(["the cat " * 200000, "the cat "]), models.cross_entropies(["the cat "])
    assert np.allclose(a[1], b[0]) and abs(a[0, 1] - models.cross_entropies(["the cat " * 1000])[0, 1]) < 0.01


def test_language_batches_are_small(spark):
    """A worker turns few rows at once into Python strings, and keeps the models once, not packed as well."""
    import pyarrow as pa

    parts = list(language._parts([pa.RecordBatch.from_arrays([pa.array(range(n))], names=["k"]) for n in (0, 1, 5000)]))
    assert max(p.num_rows for p in parts) <= 512 and [x for p in parts for x in p.column(0).to_pylist()] == [0, *range(5000)]


def test_language_scores_in_little_memory():
    """What a worker takes while it scores depends on no batch's or text's length, and neither do the results."""
    import tracemalloc

    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz "))
    texts = ["".join(letters[rng.integers(0, 27, n)]) for n in [4000] * 500 + [1_500_000, 5]]
    alphabet = language.make_alphabet({ord(c): 9 for c in letters if c != " "})
    own = [np.unique(language.codes(alphabet[language.lowered(texts[k])], language.ORDER), return_counts=True) for k in range(6)]
    m = language.Models.fit([f"l{k}" for k in range(6)], alphabet, own)
    m.cross_entropies(texts[:1])
    tracemalloc.start()
    got = m.cross_entropies(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    for k in (0, 499, 500, 501):
        s = alphabet[language.lowered(texts[k])]
        whole = -m.log_probs(s, language.codes(s, language.ORDER)).astype(float).mean(axis=0)
        assert np.allclose(got[k], whole)
