"""Exact token ids by pre-token: split as the tokenizer does, look each pre-token up, encode only those not seen yet.

BPE never crosses pre-tokens, so the ids of a text are the ids of its pre-tokens in order. The split below is used
only for tokenizers whose file states the very rule it follows, and there for texts whose every character behaves alike
in Python's and the tokenizer's Unicode tables (Latin-1 without control characters) and that hold no special string.
Every other text, and every text under another rule, goes through the library whole.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

#: The normaliser and pre-tokeniser that the split below follows, as a tokenizer's file states them.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: The same for lower-case Latin-1.
LETTERS = "a-zªµº\xdf-\xf6\xf8-\xff"
NUMBERS = "0-9²³¹¼½¾"
SPACES = " \t\n\r\x0b\x0c\xa0"
WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")
SAFE = bytes([*range(0x09, 0x0E), *range(0x20, 0x7F), *range(0xA0, 0x100)])

#: Pre-tokens a worker's cache holds at most; beyond it the newer half is forgotten (the frequent ones were met early) and encoded anew when met again.
CACHE_ENTRIES = 300_000
#: Longest pre-token that is remembered beyond the texts it was met in.
LONGEST = 128
#: Characters whose pre-tokens are looked up together.
CHUNK_CHARS = 1 << 19


def load(tokenizer_json: str):
    """The tokenizer of a .json text, single-threaded: a task has one core."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(tokenizer_json)
    tok.no_truncation()
    tok.no_padding()
    return tok


def follows_rule(tokenizer_json: str) -> bool:
    """Whether a text's ids are those of `words` in order: a BPE model without dropout behind the rule above."""
    found = json.loads(tokenizer_json)
    model, added = found["model"], found.get("added_tokens") or []
    plain = model.get("type", "BPE") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("ignore_merges")
    exact = not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
    return plain and exact and found.get("normalizer") == NORMALIZER and found.get("pre_tokenizer") == PRE_TOKENIZER


def byte_alphabet() -> dict[int, str]:
    """How the byte-level pre-tokeniser spells each Latin-1 character beyond ASCII."""
    from tokenizers.pre_tokenizers import ByteLevel

    spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
    return {c: spell(chr(c))[0][0] for c in range(0xA1, 0x100)}


class PretokenCache:
    """Values of pre-tokens, remembered per worker. `value` makes one from a list of ids and `join` combines them."""

    def __init__(self, tokenizer_json: str, value: Callable, join: Callable, entries: int = CACHE_ENTRIES):
        self.tok, self.value, self.join, self.entries = load(tokenizer_json), value, join, entries
        self.model, self.bytes = self.tok.model, byte_alphabet()
        self.split = follows_rule(tokenizer_json)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.known: dict[str, object] = {}
        self.passing: list[str] = []
        self.frequent: dict[str, object] = {}

    def words(self, text: str) -> list[str] | None:
        """The pre-tokens, or None where only the library itself may split."""
        if not self.split:
            return None
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        if raw.translate(None, SAFE) or any(s in text for s in self.special):
            return None
        return WORD.findall(text.lower())

    def encode_text(self, text: str):
        return self.value(self.tok.encode(text, add_special_tokens=False).ids)

    def encode_word(self, word: str):
        """A pre-token from `words`: normalised and split already, so only its bytes are mapped and merged."""
        return self.value([t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.bytes))])

    def _chunk(self, texts: list[str]) -> Iterator:
        split = [self.words(t) for t in texts]
        for k in self.passing:
            del self.known[k]
        if len(self.known) > self.entries:
            for k in list(islice(self.known, len(self.known) // 2, None)):
                del self.known[k]
        new = set().union(*(words for words in split if words is not None)).difference(self.known)
        if self.frequent:
            new = new.difference(self.frequent)
        self.known.update(zip(new, map(self.encode_word, new), strict=True))
        self.passing = [w for w in new if len(w) > LONGEST]
        get = Tiers(self.frequent, self.known).__getitem__ if self.frequent else self.known.__getitem__
        for text, words in zip(texts, split, strict=True):
            yield self.join(map(get, words)) if words is not None else self.encode_text(text)

    def values(self, texts: Iterable[str]) -> Iterator:
        """The joined value of each text, in order."""
        if not self.split:
            yield from map(self.encode_text, texts)
            return
        held, chars = [], 0
        for t in texts:
            held.append(t)
            chars += len(t)
            if chars >= CHUNK_CHARS:
                yield from self._chunk(held)
                held, chars = [], 0
        yield from self._chunk(held)


def texts_of(column, rows: int = 256) -> Iterator[str]:
    """The strings of an Arrow column, a few at a time."""
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).to_pylist()


class Tiers(dict):
    """Two tiers as one mapping: the broadcast table first, the worker's cache for what it lacks."""

    def __init__(self, frequent: dict, rest: dict):
        super().__init__(frequent)
        self.rest = rest

    def __missing__(self, word: str):
        return self.rest[word]


_CACHES: dict = {}


def packed_ids(tokenizer_json: str, dtype: str) -> PretokenCache:
    """A cache of ids as bytes of `dtype` (little-endian), kept while the worker lives."""
    key = ("ids", dtype, hash(tokenizer_json))
    if key not in _CACHES:
        code = {"<u2": "H", "<u4": "I"}[dtype]

        def packed(ids: list[int]) -> bytes:
            out = array(code, ids)
            if sys.byteorder == "big":
                out.byteswap()
            return out.tobytes()

        _CACHES[key] = PretokenCache(tokenizer_json, packed, b"".join)
    return _CACHES[key]


def lengths(tokenizer_json: str, frequent: dict[str, int]) -> PretokenCache:
    """A cache of token counts behind a table of frequent pre-tokens."""
    key = ("lengths", hash(tokenizer_json))
    if key not in _CACHES:
        _CACHES[key] = PretokenCache(tokenizer_json, len, sum)
    _CACHES[key].frequent = frequent
    return _CACHES[key]
