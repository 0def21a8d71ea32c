"""Ids as the tokenizers library gives them, through the word cache. One encoder is kept in each
Python worker for each file."""

from __future__ import annotations

import functools
import json
from struct import pack

import numpy as np

from loomcast.llm.words import CACHE_LIMIT, WordCache, byte_symbols

#: The split of byte-level vocabularies (tokenizers' ByteLevel with use_regex); a fixed value.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class LibraryEncoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes, equal to
    ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    Byte-level files without a normalizer are split by the byte-level pattern, and files whose
    normalizer collapses white space and lower-cases are split by their own pattern; in both, each
    distinct word goes through the library's BPE model once. Texts that hold an added token's
    string, and words beyond Latin-1 in normalized files, go through the library as they are. ``limit`` is the word cache's; it changes no id."""

    def __init__(self, path: str, limit: int = CACHE_LIMIT):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.symbols = byte_symbols()
        self.space = self.symbols[ord(" ")]
        self.tokenize = self.tokenizer.model.tokenize
        self.inner: dict[str, bytes] = {}
        pre = spec["pre_tokenizer"]
        self.normalized = spec["normalizer"] is not None
        if not self.normalized and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
            self.cache = WordCache(BYTE_LEVEL_PATTERN, self._ids, limit=limit)
        elif self.normalized:
            import regex

            self.split = regex.compile(pre["pretokenizers"][0]["pattern"]["Regex"]).findall
            self.cache = WordCache(r"\S+", self._normalized, limit=limit, space="")
        else:
            raise ValueError(f"{path}: unknown pre-tokenizer")

    def _ids(self, word: str) -> bytes:
        if word.isascii() and word[1:].isalpha():
            shown = self.space + word[1:] if word[0] == " " else word
        else:
            shown = word.encode().decode("latin-1").translate(self.symbols)
        tokens = self.tokenize(shown)
        return pack(f"<{len(tokens)}I", *[t.id for t in tokens])

    def _normalized(self, w: str) -> bytes:
        if w.isascii() and w.isalpha():
            return self._ids(w.lower())
        if max(w) > "\xff":
            return np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.inner) > self.cache.limit:
            self.inner.clear()
        return b"".join(self._part(p) for p in self.split(w.lower()))

    def _part(self, p: str) -> bytes:
        if (ids := self.inner.get(p)) is None:
            ids = self.inner[p] = self._ids(p)
        return ids

    def forget(self) -> None:
        self.cache.forget()
        self.inner.clear()

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [not any(a in t for a in self.added) for t in texts]
        found = iter(self.cache.encode([t for t, p in zip(texts, plain, strict=True) if p]))
        return [next(found) if p else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t, p in zip(texts, plain, strict=True)]


@functools.cache
def library_encoder(path: str, limit: int = CACHE_LIMIT) -> LibraryEncoder:
    return LibraryEncoder(path, limit)
