"""Token ids of whole texts with the public tokenizers library, made fast by encoding each distinct word once.

The word-level shortcut is taken only for tokenizers whose pre-tokenizer never lets a token touch white space; any other
tokenizer encodes whole texts. Either way the ids are those the library gives for the whole text.
"""

from __future__ import annotations

import json
import string
import unicodedata
from functools import lru_cache

import numpy as np

#: Distinct words kept per Python worker before the memory is emptied (some 150 MB), and the longest that is kept; they bound
#: memory, never the words encoded.
WORD_CACHE, LONGEST_KEPT = 1_000_000, 64
#: Pre-tokenizer patterns none of whose matches holds white space (fixed values).
SPACELESS = {r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
TAIL = string.punctuation


def words_are_independent(config: dict) -> bool:
    """Whether the ids of a text are the ids of its blank-separated parts, one after another."""
    pre = config.get("pre_tokenizer") or {}
    parts = pre.get("pretokenizers") or [pre]
    first = parts[0]
    split = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
    exact = not any(t.get("lstrip") or t.get("rstrip") for t in config.get("added_tokens", []))
    model = config.get("model") or {}
    # words are lower-cased and composed, and their bytes written as letters, before the model sees them
    steps = config.get("normalizer") or {}
    named = [n.get("type") for n in steps.get("normalizers") or [steps]]
    plain = named == ["NFC", "Replace", "Lowercase"] and any(p.get("type") == "ByteLevel" and not p.get("add_prefix_space") for p in parts[1:])
    return bool(plain and model.get("type") == "BPE" and not model.get("ignore_merges") and not model.get("dropout") and split and exact and (first.get("pattern") or {}).get("Regex") in SPACELESS and not config.get("truncation") and not config.get("padding"))


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level models write each byte: printable Latin-1 stands for itself, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


def is_latin(word: str) -> bool:
    """Letters that lower-case one by one and alike everywhere, already in composed form."""
    return word.isascii() or (max(word) < "\u0250" and "\u0130" not in word and unicodedata.is_normalized("NFC", word))


class Words(dict):
    """Word -> its ids as bytes; a missing word is encoded when it is asked for."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model, self.letters = tokenizer, tokenizer.model, byte_letters()

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(TAIL)
        if core.isalpha() and is_latin(core):
            # letters, then ASCII punctuation: separate pre-tokens, so the ids add up, and only the model is left to run
            low = core.lower()
            ids = self._piece(low) if core != word or low != word else self._model(low)
            if tail := word[len(core) :]:
                ids += self._piece(tail)
        else:
            ids = np.asarray(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) <= LONGEST_KEPT:
            self[word] = ids
        return ids

    def _model(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(piece)])

    def _piece(self, piece: str) -> bytes:
        if (ids := self.get(piece)) is None:
            ids = self._model(piece)
            if len(piece) <= LONGEST_KEPT:
                self[piece] = ids
        return ids


class Encoder:
    """Encodes lists of texts to little-endian unsigned 32-bit ids, as bytes, without special tokens."""

    def __init__(self, path: str, most: int = WORD_CACHE):
        from tokenizers import Tokenizer

        self.most = most
        with open(path, encoding="utf-8") as f:
            self.by_word = words_are_independent(json.load(f))
        self.tokenizer = Tokenizer.from_file(path)
        self.known = Words(self.tokenizer)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self.whole(texts)
        look, out = self.known.__getitem__, []
        for text in texts:
            parts = text.replace("\n", " ").split(" ")
            for at in range(0, len(parts), self.most):
                if len(self.known) > self.most:
                    self.known.clear()
                parts[at : at + self.most] = map(look, parts[at : at + self.most])
            out.append(b"".join(parts))
        return out


@lru_cache(maxsize=2)
def encoder(path: str, most: int = WORD_CACHE) -> Encoder:
    """One encoder for each Python worker and vocabulary file."""
    return Encoder(path, most)
