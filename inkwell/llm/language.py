"""Language identification by interpolated Kneser-Ney character models.

One model of order ORDER per language over a reduced alphabet: lower-cased letters that are frequent
in the training texts, one symbol each for white space, other signs and other letters. The models share sorted
arrays of n-gram codes, one per order, with a log-probability per language beside every code: an n-gram
that some language has seen carries the interpolated probability under all of them; for one that none
has seen, the next lower order applies, with each language's back-off weight of the context. A text's
language is the one of lowest cross-entropy per character; a text is rejected if that exceeds the
language's limit, set from labelled texts that the models haven't learned from.

Training rows are chosen by hash, ``max_docs`` per language about (a documented bound); every row is scored,
over its whole text.

Defined cases: a null text or one without a letter is ``und`` with score 0, rejected; without training
rows every text is ``und``; a null language is never learned from; repeated rows are rows of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import Scratch, table

ORDER, ALPHABET = 4, 61
#: Training documents per language, about; characters of one that are learned from come from its whole text.
MAX_DOCS = 1500
#: A text is rejected if its cross-entropy exceeds this quantile of its language's texts set apart by this factor.
QUANTILE, SLACK = 0.999, 1.3
#: Rows, and characters, scored at once; a character takes some tens of bytes a language while it is scored.
ROWS = 512
CHUNK_CHARS = 1 << 16
#: Entries of n-gram counts that a worker gathers before it merges them.
MERGE = 1 << 20
#: Of the training rows one in so many sets limits and isn't learned from, where a language has FEW of them at least.
APART, FEW = 5, 20
BITS = 6
_SPACE, _SIGN, _RARE = 0, 1, 2


def has_letter(text: str | None) -> bool:
    """Numbers of other kinds (fractions, circled or Roman ones) are no letters."""
    return any(map(str.isalpha, text or ""))


def _lower_map() -> np.ndarray:
    """Single-character lower case of the basic plane."""
    return np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 and ord(chr(c).lower()) < 65536 else c for c in range(65536)], np.uint16)


_lower: np.ndarray | None = None


def lowered(text: str) -> np.ndarray:
    """Lower-cased code points, those beyond the basic plane as 65535."""
    global _lower
    if _lower is None:
        _lower = _lower_map()
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return _lower[np.minimum(cp, 65535).astype(np.uint16)]


def make_alphabet(counts: dict[int, int]) -> np.ndarray:
    """Symbol by code point: the most frequent letters get their own, other letters share one, all signs another."""
    table_ = np.array([_SPACE if chr(c).isspace() else _RARE if chr(c).isalpha() or c == 65535 else _SIGN for c in range(65536)], np.uint8)
    common = [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0])) if chr(c).isalpha()][:ALPHABET]
    for k, c in enumerate(common):
        table_[c] = k + 3
    return table_


def codes(symbols: np.ndarray, order: int) -> np.ndarray:
    """The code of the ``order`` symbols that end at each place; before the text stands white space."""
    s = np.concatenate([np.zeros(order - 1, np.uint32), symbols.astype(np.uint32)])
    out = np.zeros(len(symbols), np.uint32)
    for k in range(order):
        out = (out << np.uint32(BITS)) | s[k : k + len(symbols)]
    return out


class Models:
    """Kneser-Ney models of all languages in shared sorted arrays, one per order."""

    def __init__(self, langs: list[str], alphabet: np.ndarray, grams: list[np.ndarray], logp: list[np.ndarray], backoff: list[np.ndarray], limits: np.ndarray):
        self.langs, self.alphabet, self.grams, self.logp, self.backoff, self.limits = langs, alphabet, grams, logp, backoff, limits

    @classmethod
    def fit(cls, langs: list[str], alphabet: np.ndarray, counts: list[tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> Models:
        """``counts``: per language the sorted codes of order ``order`` and how often they occur."""
        n_sym = ALPHABET + 3
        per = []
        for code, n in counts:
            # raw counts for the highest order; for lower ones, in how many contexts an n-gram occurs
            levels = [None] * (order + 1)
            levels[order] = (code.astype(np.uint32), n.astype(float))
            for k in range(order - 1, 0, -1):
                short = levels[k + 1][0] & np.uint32((1 << (BITS * k)) - 1)
                levels[k] = tuple(x.astype(t) for x, t in zip(np.unique(short, return_counts=True), (np.uint32, float)))
            per.append(levels)
        grams = [None] + [np.unique(np.concatenate([p[k][0] for p in per])) for k in range(1, order + 1)]
        logp, backoff = [None] * (order + 1), [None] * (order + 1)
        prob = np.full((len(langs), n_sym), 1.0 / n_sym)  # order 0
        low_codes, low = np.arange(n_sym, dtype=np.uint32), prob
        for k in range(1, order + 1):
            p_k = np.zeros((len(langs), len(grams[k])))
            contexts = np.unique(grams[k] >> np.uint32(BITS))
            gamma = np.ones((len(langs), len(contexts)))
            ctx_of = np.searchsorted(contexts, grams[k] >> np.uint32(BITS))
            suffix = grams[k] & np.uint32((1 << (BITS * (k - 1))) - 1) if k > 1 else grams[k]
            at = np.searchsorted(low_codes, suffix)
            for i, levels in enumerate(per):
                code, n = levels[k]
                ones, twos = float((n == 1).sum()), float((n == 2).sum())
                d = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5
                where = np.searchsorted(grams[k], code)
                full = np.zeros(len(grams[k]))
                full[where] = n
                total = np.bincount(ctx_of, full, len(contexts))
                kinds = np.bincount(ctx_of, full > 0, len(contexts))
                seen = total > 0
                gamma[i, seen] = d * kinds[seen] / total[seen]
                lower = low[i][suffix] if k == 1 else low[i][at]
                p_k[i] = np.where(total[ctx_of] > 0, np.maximum(full - d, 0) / np.maximum(total[ctx_of], 1), 0) + gamma[i][ctx_of] * lower
            logp[k], backoff[k] = np.log(p_k).astype(np.float32).T.copy(), (contexts, np.log(gamma).astype(np.float32).T.copy())
            low_codes, low = grams[k], p_k
        floor = np.log(prob).astype(np.float32).T.copy()
        logp[0] = floor
        return cls(langs, alphabet, grams, logp, backoff, np.full(len(langs), np.inf))

    def log_probs(self, symbols: np.ndarray, code: np.ndarray) -> np.ndarray:
        """chars x languages."""
        order = len(self.grams) - 1
        out = np.zeros((len(code), len(self.langs)), np.float32)
        todo = np.arange(len(code))
        for k in range(order, 0, -1):
            c = code[todo] & np.uint32((1 << (BITS * k)) - 1)
            at = np.minimum(np.searchsorted(self.grams[k], c), len(self.grams[k]) - 1)
            hit = self.grams[k][at] == c
            if len(todo) == len(code) and hit.all():
                return self.logp[k][at]
            out[todo[hit]] += self.logp[k][at[hit]]
            miss = ~hit
            ctx, gamma = self.backoff[k]
            h = c[miss] >> np.uint32(BITS)
            w = np.minimum(np.searchsorted(ctx, h), len(ctx) - 1)
            known = ctx[w] == h
            todo = todo[miss]
            out[todo[known]] += gamma[w[known]]
            if not len(todo):
                return out
        out[todo] += self.logp[0][symbols[todo]]
        return out

    def cross_entropies(self, texts: list[str]) -> np.ndarray:
        """texts x languages, in nats per character; long texts and many short ones go in chunks alike."""
        sums = np.zeros((len(texts), len(self.langs)))
        sizes = np.ones(len(texts))
        held, n = [], 0

        def flush():
            symbols = np.concatenate([s for _, s, _ in held])
            code = np.concatenate([c for _, _, c in held])
            p = self.log_probs(symbols, code)
            starts = np.cumsum([0] + [len(s) for _, s, _ in held[:-1]])
            for (i, _, _), row in zip(held, np.add.reduceat(p, starts, axis=0, dtype=np.float64)):
                sums[i] -= row

        for i, text in enumerate(texts):
            s = self.alphabet[lowered(text)]
            if not len(s):
                continue
            sizes[i] = len(s)
            c = codes(s, len(self.grams) - 1)
            for a in range(0, len(s), CHUNK_CHARS):
                held.append((i, s[a : a + CHUNK_CHARS], c[a : a + CHUNK_CHARS]))
                n += len(held[-1][1])
                if n >= CHUNK_CHARS:
                    flush()
                    held, n = [], 0
        if held:
            flush()
        return sums / sizes[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language or und, score in 0..1, accepted)."""
        ok = np.array([has_letter(t) for t in texts], bool) & bool(self.langs)
        lang, score, accepted = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        at = np.flatnonzero(ok)
        if len(at):
            h = self.cross_entropies([texts[i] for i in at])
            best = h.argmin(axis=1)
            low = h[np.arange(len(at)), best]
            score[at] = 1.0 / np.exp(np.minimum(0, -10 * (h - low[:, None]))).sum(axis=1)
            accepted[at] = low <= self.limits[best]
            for i, b in zip(at, best):
                lang[i] = self.langs[b]
        return lang, score, accepted


def _char_counts(batches):
    total = np.zeros(65536, np.int64)
    for b in batches:
        for t in b.column(0).to_pylist():
            total += np.bincount(lowered(t), minlength=65536)
    c = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(total[c])], names=["c", "n"])


def _gram_counts(alphabet: np.ndarray, order: int):
    def run(batches):
        held: dict[str, list] = {}  # per language: the counts so far and those of texts since, few million entries
        for b in batches:
            for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parts = held.setdefault(lang, [])
                parts.append(np.unique(codes(alphabet[lowered(t)], order), return_counts=True))
                if len(parts) > 1 and sum(len(u) for u, _ in parts[1:]) > MERGE:
                    held[lang] = [_merged(parts)]
        for lang, parts in held.items():
            yield _gram_batch(lang, *_merged(parts))

    return run


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    u, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return u, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)


def _gram_batch(lang: str, code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "code", "n"])


def training_rows(docs: DataFrame, usable: Column, max_docs: int = MAX_DOCS, lang: str = "lang") -> DataFrame:
    """(text, lang): rows whose id's hash is small enough to leave about ``max_docs`` per language."""
    rows = docs.filter(usable & F.col(lang).isNotNull() & F.col("text").isNotNull()).select("text", F.col(lang).alias("lang"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).alias("u"))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))  # a row per language
    return rows.join(F.broadcast(sizes), "lang").filter(F.col("u") * F.col("docs") < max_docs * float(1 << 30)).select("text", "lang")


def train(rows: DataFrame, scratch: Scratch) -> Models:
    """``rows``: (text, lang), bounded. The driver gets n-gram counts, which the alphabet bounds per language."""
    rows = scratch.cut(rows.select("text", "lang", (F.pmod(F.xxhash64("text"), F.lit(APART)) == 0).alias("apart")), "training")
    learned = rows.filter(~F.col("apart")).select("text", "lang")
    if learned.isEmpty():
        learned = rows.select("text", "lang")
    chars = {r.c: r.n for r in learned.select("text").mapInArrow(_char_counts, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()}
    alphabet = make_alphabet(chars)
    got = learned.mapInArrow(_gram_counts(alphabet, ORDER), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    lang, code, n = (got.column(k).to_numpy() for k in ("lang", "code", "n"))
    langs = sorted(set(lang.tolist()))
    counts = []
    for x in langs:
        at = np.flatnonzero(lang == x)
        at = at[np.argsort(code[at])]
        counts.append((code[at], n[at]))
    models = Models.fit(langs, alphabet, counts) if langs else Models([], alphabet, [None], [None], [None], np.zeros(0))
    if langs:
        packed = scratch.spark.sparkContext.broadcast(models)

        def own(batches):
            m = packed.value
            index = {x: k for k, x in enumerate(m.langs)}
            for b in _parts(batches):
                texts, names, apart = (b.column(k).to_pylist() for k in range(3))
                keep = [k for k, t in enumerate(texts) if has_letter(t) and names[k] in index]
                h = m.cross_entropies([texts[k] for k in keep]) if keep else np.zeros((0, len(m.langs)))
                yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in keep], pa.string()), pa.array([apart[k] for k in keep], pa.bool_()), pa.array([float(h[j, index[names[k]]]) for j, k in enumerate(keep)], pa.float64())], names=["lang", "apart", "h"])

        scored = rows.mapInArrow(own, "lang string, apart boolean, h double").groupBy("lang", "apart").agg(F.percentile_approx("h", QUANTILE, 10000).alias("q"), F.count(F.lit(1)).alias("n"))
        # a language with few texts set apart takes its other ones
        limits = {r.lang: r.q for r in sorted(scored.collect(), key=lambda r: r.apart and r.n >= FEW)}
        models.limits = np.array([limits.get(x, np.inf) * SLACK for x in langs])
    return models


def _parts(batches):
    """Batches of few rows, as each one's texts become Python strings at once."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def _predicting(packed, keep: int):
    def run(batches):
        models = packed.value
        for b in _parts(batches):
            lang, score, accepted = models.predict(b.column(keep).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:keep], pa.array(lang, pa.string()), pa.array(score), pa.array(accepted)], names=[*b.schema.names[:keep], "lang_pred", "score", "accepted"])

    return run


def identify(docs: DataFrame, models: Models, *keep: str) -> DataFrame:
    """The columns ``keep``, lang_pred, score, accepted."""
    packed = docs.sparkSession.sparkContext.broadcast(models)  # bounded by the alphabet to the power of the order
    rows = docs.select(*keep, "text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep), "lang_pred string, score double, accepted boolean"])
    return rows.mapInArrow(_predicting(packed, len(keep)), schema)


def accepted_rows(docs: DataFrame, models: Models) -> DataFrame:
    """The rows whose text has an accepted language, with their own columns."""
    packed = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        own = packed.value
        for b in _parts(batches):
            yield b.filter(pa.array(own.predict(b.column(b.schema.get_field_index("text")).to_pylist())[2]))

    return docs.mapInArrow(run, docs.schema)


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = train(training_rows(docs, ~held_out()), Scratch(spark, "language"))
    return identify(docs.withColumn("held_out", held_out()), models, "doc_id", "held_out")
