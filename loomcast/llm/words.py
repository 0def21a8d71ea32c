"""Encoding whole texts word by word with a bounded cache.

A byte-level BPE never merges across the cuts of its split pattern, so the ids of a text are the
ids of its pattern matches in order. Texts are first cut before single spaces, which C code does
fast; such a cut is also a cut of the pattern unless white space stands on both sides of the
space, and texts that have that go through the pattern as a whole. A cache that reaches its
limit keeps only its first entries, so memory is bounded however many distinct words there are.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterable

import regex

#: Entries in the caches of one Python worker, about 200 bytes each: pieces up to this, words up to twice this.
CACHE_LIMIT = 600_000
RARE_SPACE = re.compile("[\x0b\x0c\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def unsafe(text: str) -> bool:
    """Whether white space may stand on both sides of a space; also true for some texts where none does."""
    return "  " in text or " \n" in text or " \t" in text or " \r" in text or text[-1:] == " " or RARE_SPACE.search(text) is not None


#: Letters up to here are the same to ``str.isalpha`` and to any version of ``\p{L}``.
LATIN = "\u0250"
MARKS = frozenset(".,;:!?")


def plain(piece: str) -> bool:
    """Whether ``piece`` is letters alone, and not beyond LATIN."""
    return piece.isalpha() and (piece.isascii() or max(piece) < LATIN)


class Pieces(dict):
    """A cache of what ``resolve`` gives for a piece."""

    def __init__(self, resolve: Callable[[str], bytes]):
        super().__init__()
        self.resolve = resolve

    def __missing__(self, piece: str) -> bytes:
        self[piece] = found = self.resolve(piece)
        return found

    def keep(self, n: int) -> None:
        """Keep the first n entries: frequent pieces come early."""
        if len(self) > n:
            first = list(itertools.islice(self.items(), n))
            self.clear()
            self.update(first)


class WordCache:
    """Byte strings (any fixed form) of texts, from those of the pattern's matches. Either ``encode_word``
    gives a match's string, or ``encode_words`` the strings of a list of matches, which is asked once for
    all new ones of a call.

    The pattern must match letters together, with ``space`` before them if it is there, and a mark after
    them alone, or at least the strings must be as if it did: such pieces need no search."""

    def __init__(self, pattern: str, encode_word: Callable[[str], bytes] | None = None, encode_words: Callable[[list[str]], list[bytes]] | None = None, limit: int = CACHE_LIMIT, space: str = " "):
        self.find = regex.compile(pattern).findall
        self.encode_words = encode_words
        self.encode_word = encode_word
        self.limit = limit
        self.words = Pieces(encode_word)
        self.space = space
        self.heads = Pieces(lambda piece: self.piece(piece, "", self.heads))
        self.tails = Pieces(lambda piece: self.piece(piece, space, self.tails))  # keys without the space that they begin with

    def forget(self) -> None:
        """Keep only what came first: workers outlive their tasks."""
        for cache in (self.words, self.heads, self.tails):
            cache.keep(self.limit // 5)

    def piece(self, piece: str, space: str, cache: Pieces) -> bytes:
        """The string of a piece, which is to be kept in ``cache``."""
        if plain(piece):
            return self.encode_word(space + piece)
        if piece[-1:] in MARKS and plain(piece[:-1]):
            return cache[piece[:-1]] + self.words[piece[-1]]
        return self.joined(self.find(space + piece))

    def joined(self, words: list[str]) -> bytes:
        return b"".join(map(self.words.__getitem__, words))

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """One byte string for each text: the words' strings, joined."""
        for cache, limit in ((self.words, 2 * self.limit), (self.heads, self.limit // 4), (self.tails, self.limit)):
            if len(cache) > limit:
                cache.keep(limit // 4)
        if self.encode_words:
            return self._encode_together(texts)
        head, tail = self.heads.__getitem__, self.tails.__getitem__
        out = []
        for text in texts:
            if unsafe(text):
                out.append(self.joined(self.find(text)))
            else:
                first, *pieces = text.split(" ")
                out.append(head(first) + b"".join(map(tail, pieces)))
        return out

    def _encode_together(self, texts: Iterable[str]) -> list[bytes]:
        """The same with ``encode_words``: all pieces are looked up, what is missing is encoded, and texts are joined."""
        out: list[bytes | list[str]] = []
        late: list[tuple[int, str, list[bytes | None], list[int], list[str]]] = []  # texts with new pieces, and where
        firsts: set[str] = set()
        rests: set[str] = set()
        words: set[str] = set()
        get = self.tails.get
        for k, text in enumerate(texts):
            if unsafe(text):
                out.append(self.find(text))
                words.update(out[-1])
                continue
            first, *rest = text.split(" ")
            found = list(map(get, rest))
            at = [i for i, f in enumerate(found) if f is None]
            if at or first not in self.heads:
                late.append((k, first, found, at, [rest[i] for i in at]))
                rests.update(late[-1][-1])
                firsts.add(first)
                out.append(b"")
            else:
                out.append(self.heads[first] + b"".join(found))
        wanted = [(self.heads, "", {p for p in firsts if p not in self.heads}), (self.tails, self.space, rests)]
        letters: dict[tuple[str, str], Pieces] = {}  # (space, letters) and where they belong
        later: list[tuple[Pieces, str, list[str] | None]] = []
        for cache, space, some in wanted:
            for p in some:
                if plain(p):
                    letters[space, p] = cache
                elif p[-1:] in MARKS and plain(p[:-1]):
                    words.add(p[-1])
                    later.append((cache, p, None))
                    if p[:-1] not in cache:
                        letters[space, p[:-1]] = cache
                else:
                    later.append((cache, p, ws := self.find(space + p)))
                    words.update(ws)
        new = [w for w in words if w not in self.words]
        if letters or new:
            ids = self.encode_words([*map("".join, letters), *new])
            for ((_, p), cache), x in zip(letters.items(), ids, strict=False):
                cache[p] = x
            self.words.update(zip(new, ids[len(letters) :], strict=True))
        for cache, p, ws in later:
            cache[p] = cache[p[:-1]] + self.words[p[-1]] if ws is None else self.joined(ws)
        for k, first, found, at, some in late:
            for i, p in zip(at, some, strict=True):
                found[i] = self.tails[p]
            out[k] = self.heads[first] + b"".join(found)
        return [self.joined(x) if isinstance(x, list) else x for x in out]


def byte_symbols() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others, in order, for code points from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
