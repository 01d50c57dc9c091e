"""Exact token ids of the word-level BPE tokenizer, with repeated words encoded once.

The tokenizer drops white space and never joins text across it, so the ids of a text are the ids of
its white-space-separated words in order. Words are encoded by the tokenizers library; a bounded
table per worker keeps what it gave for words seen lately. A vocabulary file with other rules than
those this rests on is read whole text by whole text."""

from __future__ import annotations

import json
import os
import re
from array import array
from itertools import chain

import public_tokenizers

VOCABULARY = "word_bpe_49k.json"
#: Control characters that str.split() takes for white space and the tokenizer does not.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[ \t\n\x0b\x0c\r]+")
_LONG = 48
#: A word of Latin-1 letters with at most one mark behind it: two pre-tokens whose ids the BPE model
#: gives directly; lower case and the composed form of these letters are plain.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)").fullmatch


def _byte_letters() -> dict[int, str]:
    """Each of those letters as its UTF-8 bytes in the byte-level alphabet: printable Latin-1 bytes
    stand for themselves, the others for 256, 257, ... in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    char = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return {c: "".join(char[b] for b in chr(c).encode()) for c in range(0xDF, 0x100) if c != 0xF7}


#: Texts of other characters, or with a full stop or comma beside another mark, stay as they are.
#: In all others a lower-cased text with those two set apart has the same ids and fewer words.
_KEEP = re.compile("[^\x00-\x1b -\x7fÀ-ÖØ-öø-ÿ]|_|[.,][^\\w\\s]|[^\\w\\s][.,]").search


#: What the shortcuts of this module rest on, as the vocabulary file states it: fixed values of its format.
_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


def by_words(path: str) -> bool:
    """Whether a vocabulary file has the rules that allow a text to be encoded word by word."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    return all(told.get(k) == v for k, v in _RULES.items()) and told["model"]["type"] == "BPE" and not told["model"].get("dropout")


class _Words(dict):
    """Word -> its ids, worked out when first asked for."""

    def __init__(self, tokenizer):
        self.old: dict[str, bytes] = {}
        self.long: list[str] = []
        self.tokenizer, self.tokenize, self.letters = tokenizer, tokenizer.model.tokenize, _byte_letters()
        self.marks = {"": b"", ".": self.library("."), ",": self.library(",")}

    def library(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            m = _PLAIN(word)
            if m is None:
                ids = self.library(word)
            else:
                core, mark = m.groups()
                core = core.lower()
                if not core.isascii():
                    core = core.translate(self.letters)
                ids = array("I", [t.id for t in self.tokenize(core)]).tobytes() + self.marks[mark]
            if len(word) > _LONG:
                self.long.append(word)
        self[word] = ids
        return ids


class WordEncoder:
    """encode(texts) -> one bytes object per text: its ids as little-endian unsigned 32-bit."""

    def __init__(self, path: str, most_words: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.most = most_words // 2
        self.words = _Words(self.tokenizer) if by_words(path) else None

    def _split(self, text: str) -> list[str]:
        if _KEEP(text) is None:
            return text.lower().replace(".", " . ").replace(",", " , ").split()
        return [w for w in _SPACE.split(text) if w] if _ODD_SPACE.search(text) else text.split()

    def encode(self, texts: list[str]) -> list[bytes]:
        words = self.words
        if words is None:
            return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        out = [b"".join(map(words.__getitem__, self._split(t))) for t in texts]
        for w in words.long:
            del words[w]
        words.long.clear()
        if len(words) > self.most:
            words.old = dict(words)
            words.clear()
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str | None = None) -> WordEncoder:
    """The worker's encoder for a vocabulary file; kept between tasks."""
    path = path or public_tokenizers.path(VOCABULARY)
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
