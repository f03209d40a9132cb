"""Token ids and counts by a public tokenizer.

For word-end vocabularies a text is split into pre-tokens, whose ids don't depend on what stands around
them. Pre-tokens go through a worker's cache; misses go to the library. Byte-level vocabularies are
loaded into a faster encoder, which merges by the rank of what comes out instead of by pair. Both give the
same ids if every token is what its own bytes merge to: two neighbours that together are a token's
bytes are then the last step of merging these bytes, hence the listed pair. That is checked on loading.
A text with characters beyond Latin script and common punctuation, with control characters, or with one
of the tokenizer's special strings goes to the library whole, as do all texts if the check fails, so
results are the library's in every case.
"""

from __future__ import annotations

import json
import os

import numpy as np
import regex

#: Entries of a generation of a worker's cache, and the longest piece that is kept.
CACHE_ENTRIES, CACHE_CHARS = 1 << 18, 48
#: Characters that Python's regex and the library's classify alike: Latin script and general punctuation.
_PLAIN = regex.compile("[\t\n\r -~¡-ɏ‐-‧‰-⁞€]*")
_BYTE_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class _Cache(dict):
    """Two generations beside a fixed part: when the young one is full it becomes the old one, so what is used stays."""

    def __init__(self, make, fixed: dict | None = None):
        super().__init__(fixed or {})
        self.make, self.fixed, self.old = make, fixed or {}, {}

    def __missing__(self, piece: str):
        out = self.old.get(piece)
        if out is None:
            out = self.make(piece)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES + len(self.fixed):
                self.old = dict(self)
                self.clear()
                self.update(self.fixed)
            self[piece] = out
        return out


def _byte_of() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 itself, the rest from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def rank_encoder(path: str, tok):
    """(encoder, id of each rank) for a byte-level tokenizer file, or None where results could differ from the library's."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    if not plain or spec.get("normalizer") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    byte, vocab = _byte_of(), model["vocab"]
    made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    tokens = [*byte, *made]
    if any(c not in vocab for c in tokens) or len(set(tokens)) < len(tokens) or any(len(tok.model.tokenize(m)) != 1 for m in made):
        return None
    ranks = {bytes(byte[c] for c in t): k for k, t in enumerate(tokens)}
    return tiktoken.Encoding("ranks", pat_str=_BYTE_PIECES, mergeable_ranks=ranks, special_tokens={}), np.array([vocab[t] for t in tokens], "<u4")


class Pieces:
    """One tokenizer file; ``word`` is for lower-casing, word-end vocabularies, else byte-level."""

    def __init__(self, path: str, word: bool, lengths: dict[str, int] | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok, self.word = Tokenizer.from_file(path), word
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = tuple(t.content for t in self.tok.get_added_tokens_decoder().values())
        self.fast = None if word else rank_encoder(path, self.tok)
        self._counts = _Cache(lambda p: len(self.tok.encode(p, add_special_tokens=False).ids), lengths)

    def plain(self, text: str) -> bool:
        """Whether the text need not go to the library whole."""
        return _PLAIN.fullmatch(text) is not None and not any(s in text for s in self.special)

    def pieces(self, text: str) -> list[str] | None:
        """The pre-tokens of a word-end vocabulary, or None if the text must go to the library whole."""
        return _WORD_PIECES.findall(text.lower()) if self.word and self.plain(text) else None

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.fast and self.plain(text):
            encoder, id_of = self.fast
            return id_of[np.array(encoder.encode_ordinary(text), np.int64)].tobytes()
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def count(self, text: str) -> int:
        parts = self.pieces(text)
        if parts is None:
            return len(self.ids(text)) // 4
        return sum(map(self._counts.__getitem__, parts))


_workers: dict[tuple, Pieces] = {}


def worker_pieces(path: str, word: bool, key: str = "", lengths=None) -> Pieces:
    """One per worker process and table; ``lengths`` is called to make the table's dictionary."""
    k = (path, word, key)
    if k not in _workers:
        while len(_workers) > 1:
            del _workers[next(iter(_workers))]
        _workers[k] = Pieces(path, word, lengths() if lengths else None)
    return _workers[k]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
