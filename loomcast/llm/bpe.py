"""Operator 8: byte-level BPE encoding and decoding by DuckDB recursive queries.

In each Python worker, distinct words (matches of the split pattern) become token-position rows
in DuckDB. A recursive query joins neighbours with the merge table and contracts each word's
leftmost pair of least rank until no pair merges. Decoding joins ids with the vocabulary and
aggregates the bytes in order. Words are cached within a bound (see words.py).

A query contracts a bounded number of times; what is not done then starts the next one, so the rows
that the recursion holds are bounded. Words over ``LONG_WORD`` bytes, whose steps would grow with the
square, are encoded in pieces, by the same queries: see ``encode_long``.
"""

from __future__ import annotations

import base64
import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcast.llm.shared import append_column, text_of, with_columns
from loomcast.llm.words import WordCache

LONG_WORD = 256
#: Bytes of a piece of a long word.
PIECE = 192
#: Pieces and decoded segments that a worker keeps, about 200 bytes each.
CACHE_LIMIT = 900_000
SEGMENT_LIMIT = 500_000
#: Rows that one recursive query holds, about.
ROWS_HELD = 2_000_000

#: A row is a token: its word, its place, its id, and the id and place of the token after it in the
#: word (-1 and 0 at the end). Each step finds each word's least (rank, place) among the pairs that
#: merge and rewrites the tokens on both sides; a word without one is done.
ENCODE = """
WITH RECURSIVE state AS (
    SELECT w, p, id, next_id, next_p, false AS done, 0 AS step FROM start
    UNION ALL
    SELECT * FROM (
        WITH least AS (
            SELECT l.w, min((m.merged::BIGINT << 40) + (l.p::BIGINT << 16) + (l.next_p - l.p)) AS k
            FROM state l JOIN merges m ON m.pair_key = l.id * 1048576::BIGINT + l.next_id
            WHERE NOT l.done AND l.step < $most GROUP BY l.w
        ), merge AS (
            SELECT w, (k >> 40)::INTEGER AS merged, ((k >> 16) & 16777215)::INTEGER AS left_p, (((k >> 16) & 16777215) + (k & 65535))::INTEGER AS right_p FROM least
        ), found AS (
            SELECT m.*, r.next_id AS right_next_id, r.next_p AS right_next_p FROM merge m JOIN state r ON r.p = m.right_p WHERE NOT r.done
        )
        SELECT s.w, s.p, if(s.p = left_p, merged, s.id),
            if(s.p = left_p, right_next_id, if(s.next_p = left_p, merged, s.next_id)),
            if(s.p = left_p, right_next_p, s.next_p), merged IS NULL, s.step + 1
        FROM state s LEFT JOIN found USING (w)
        WHERE NOT s.done AND s.step < $most AND (merged IS NULL OR s.p <> right_p)
    )
)
SELECT w, p, id, next_id, next_p, done FROM state WHERE done OR step = $most ORDER BY p
"""

DECODE = """
SELECT t.d, coalesce(string_agg(v.hex, '' ORDER BY t.p), '') AS hex
FROM tokens t JOIN vocabulary v USING (id) GROUP BY t.d ORDER BY t.d
"""


def ranks_of(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _database(memory: str):
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": memory, "preserve_insertion_order": False})


def _table(db, name: str, **columns) -> None:
    db.register("given", pa.table(columns))
    db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
    db.unregister("given")


class Encoder:
    """The merge table of a tiktoken file in a DuckDB database of this process.

    Ranks are unsigned 20-bit numbers, every byte is a token and tokens have up to 65,535 bytes."""

    def __init__(self, path: str, pattern: str, memory: str = "150MB"):
        ranks = self.ranks = ranks_of(path)
        if max(ranks.values(), default=0) >= 1 << 20 or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError(f"{path}: ranks over 20 bits, or bytes without one")
        pairs = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.db = _database(memory)
        left, right, merged = np.array(pairs, "i8").reshape(-1, 3).T
        _table(self.db, "merges", pair_key=(left << 20) + right, merged=merged.astype("i4"))
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], "i4")
        self.cache = WordCache(pattern, encode_words=self.encode_words, limit=CACHE_LIMIT)

    @functools.cached_property
    def lengths(self) -> dict[int, int]:
        return {r: len(t) for t, r in self.ranks.items()}

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Each word's ids, little-endian unsigned 32-bit."""
        raws = [word.encode() for word in words]
        out = self._contracted([raw if len(raw) <= LONG_WORD else b"" for raw in raws])
        for k, raw in enumerate(raws):
            if len(raw) > LONG_WORD:
                out[k] = self.encode_long(raw)
        return out

    def _contracted(self, raws: list[bytes], rows_at_once: int = 100_000) -> list[bytes]:
        """The ids of byte strings, contracted in batches. One that is a token is that token."""
        out = [r.to_bytes(4, "little") if (r := self.ranks.get(raw)) is not None else b"" for raw in raws]
        todo = [k for k, ids in enumerate(out) if not ids and raws[k]]
        at = 0
        while at < len(todo):
            n, end = 0, at
            while end < len(todo) and n < rows_at_once:
                n += len(raws[todo[end]])
                end += 1
            for k, ids in zip(todo[at:end], self._contract([raws[k] for k in todo[at:end]]), strict=True):
                out[k] = ids
            at = end
        return out

    def _contract(self, part: list[bytes]) -> list[bytes]:
        """One batch: recursive queries until no pair merges."""
        sizes = np.array([len(raw) for raw in part])
        word_of = np.repeat(np.arange(len(part), dtype="i4"), sizes)
        place = np.arange(1, len(word_of) + 1, dtype="i4")
        ids = self.byte_ids[np.frombuffer(b"".join(part), "u1")]
        ends = np.r_[word_of[1:] != word_of[:-1], True]
        rows = {"w": word_of, "p": place, "id": ids, "next_id": np.where(ends, -1, np.r_[ids[1:], 0]).astype("i4"), "next_p": np.where(ends, 0, place + 1).astype("i4")}
        done = []
        while len(rows["w"]):
            self.db.register("start", pa.table(rows))
            found = self.db.execute(ENCODE, {"most": max(8, ROWS_HELD // len(rows["w"]))}).fetchnumpy()
            self.db.unregister("start")
            over = found.pop("done")
            done.append((found["w"][over], found["id"][over]))
            rows = {c: v[~over] for c, v in found.items()}
        words, tokens = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(words, kind="stable")  # a word's tokens are done at once, in order
        raw = tokens[order].astype("<u4").tobytes()
        stops = (np.cumsum(np.bincount(words, minlength=len(part))) * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def encode_long(self, raw: bytes) -> bytes:
        """The ids of one long word. A sequence of tokens is a text's ids if, and only if, each pair of
        neighbours is what its own bytes are encoded to. So pieces are encoded, the pairs where they
        meet are tried, and around a pair that fails, a growing number of tokens is encoded anew, until
        all pairs hold. At worst the word is encoded as a whole, by queries that hold bounded rows."""
        pieces = self._contracted([raw[k : k + PIECE] for k in range(0, len(raw), PIECE)])
        runs = [np.frombuffer(ids, "<u4").tolist() for ids in pieces]
        starts = list(range(0, len(raw), PIECE))  # where each run begins in raw
        open_at, reach = list(range(1, len(runs))), 4  # runs whose meeting with the one before is untried

        def size(tokens: list[int]) -> int:
            return sum(map(self.lengths.__getitem__, tokens))

        while open_at:
            pairs = [(runs[k - 1][-1], runs[k][0]) for k in open_at]
            tried = self._contracted([raw[starts[k] - self.lengths[a] : starts[k] + self.lengths[b]] for k, (a, b) in zip(open_at, pairs, strict=True)])
            failed = {k for k, pair, ids in zip(open_at, pairs, tried, strict=True) if ids != np.array(pair, "<u4").tobytes()}
            if not failed:
                break
            # Runs are cut beside the pairs that failed; what lies between the cuts is encoded anew. A run
            # too short to be cut on both sides joins all its neighbours.
            new: list[list[int] | None] = []  # None: to be encoded
            begins: list[int] = []

            def add(run: list[int] | None, begin: int, new=new, begins=begins) -> None:
                if run is None and new and new[-1] is None:
                    return
                new.append(run)
                begins.append(begin)

            for k, run in enumerate(runs):
                head, tail = (reach if k in failed else 0), (reach if k + 1 in failed else 0)
                if head + tail >= len(run) and head + tail:
                    add(None, starts[k])
                    continue
                at = starts[k]
                if head:
                    add(None, at)
                    at += size(run[:head])
                add(run[head : len(run) - tail], at)
                if tail:
                    add(None, starts[k] + size(run[: len(run) - tail]))
            anew = [k for k, run in enumerate(new) if run is None]
            bounds = [*begins, len(raw)]
            for k, ids in zip(anew, self._contracted([raw[bounds[k] : bounds[k + 1]] for k in anew]), strict=True):
                new[k] = np.frombuffer(ids, "<u4").tolist()
            touched = set(anew) | {k + 1 for k in anew}
            runs, starts = new, begins
            open_at = [k for k in sorted(touched) if 0 < k < len(runs)]
            reach *= 2
        return np.array([t for run in runs for t in run], "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.cache.encode(texts)


class Decoder:
    """The vocabulary of a tiktoken file in a DuckDB database of this process."""

    def __init__(self, path: str, memory: str = "150MB"):
        bytes_of = {v: k for k, v in ranks_of(path).items()}
        ids = sorted(bytes_of)
        self.db = _database(memory)
        _table(self.db, "vocabulary", id=np.array(ids, "i8"), hex=pa.array([bytes_of[i].hex() for i in ids]))
        self.lengths = np.zeros(ids[-1] + 1, "i8")
        self.lengths[ids] = [len(bytes_of[i]) for i in ids]
        #: Where a segment of ids may begin: at tokens that begin with a space.
        self.begins = np.zeros(ids[-1] + 1, bool)
        self.begins[[i for i in ids if bytes_of[i][:1] == b" "]] = True
        self.segments: dict[bytes, bytes] = {}

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each id sequence. Sequences are cut before tokens that begin with a space;
        each distinct segment is aggregated once, as long as the bounded cache holds it."""
        if len(self.segments) > SEGMENT_LIMIT:
            self.segments.clear()
        get, new, out = self.segments.get, set(), []
        late: list[tuple[int, list[bytes | None], list[int], list[bytes]]] = []  # sequences with new segments, and where
        for k, raw in enumerate(ids):
            starts = self.begins[np.frombuffer(raw, "<u4")]
            starts[:1] = True
            bounds = [*(np.flatnonzero(starts) * 4).tolist(), len(raw)]
            cut = [raw[a:b] for a, b in itertools.pairwise(bounds)]
            found = list(map(get, cut))
            if at := [i for i, f in enumerate(found) if f is None]:
                late.append((k, found, at, [cut[i] for i in at]))
                new.update(late[-1][-1])
                out.append(b"")
            else:
                out.append(b"".join(found))
        segments = list(new)
        self.segments.update(zip(segments, self.decode_segments(segments), strict=True))
        for k, found, at, some in late:
            for i, s in zip(at, some, strict=True):
                found[i] = self.segments[s]
            out[k] = b"".join(found)
        return out

    def decode_segments(self, ids: list[bytes], tokens_at_once: int = 500_000, group: int = 5_000) -> list[bytes]:
        """Joins the tokens with the vocabulary and aggregates their bytes in order. The segments go
        in as one sequence, in groups of ``group`` tokens, and come out cut by their lengths in bytes."""
        tokens = np.frombuffer(b"".join(ids), "<u4").astype("i8")
        found = []
        for at in range(0, len(tokens), tokens_at_once):
            part = tokens[at : at + tokens_at_once]
            place = np.arange(len(part))
            self.db.register("tokens", pa.table({"d": place // group, "p": place, "id": part}))
            found += [bytes.fromhex(text) for _, text in self.db.execute(DECODE).fetchall()]
            self.db.unregister("tokens")
        raw = b"".join(found)
        ends = np.r_[0, np.cumsum(self.lengths[tokens])][np.cumsum([len(s) // 4 for s in ids])].tolist() if ids else []
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


@functools.cache
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


@functools.cache
def decoder(path: str) -> Decoder:
    return Decoder(path)


def encode(df: DataFrame, ranks: str, pattern: str, text_column: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with ``out``: the ids of its whole texts as little-endian unsigned 32-bit bytes.

    Null and empty texts have no ids. A column that is named like ``out`` is replaced; all others stay."""
    return append_column(df, text_of(text_column), lambda texts: pa.array(encoder(ranks, pattern).encode(texts), pa.binary()), out, "binary")


def decode(df: DataFrame, ranks: str, ids_column: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``: the bytes that the ids stand for. Null ids give null."""

    def run(ids: list[bytes | None]) -> pa.Array:
        found = decoder(ranks).decode([x or b"" for x in ids])
        return pa.array([None if i is None else x for i, x in zip(ids, found, strict=True)], pa.binary())

    return append_column(df, F.col(ids_column), run, out, "binary")


def round_trip(df: DataFrame, ranks: str, pattern: str, text_column: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``ids`` and ``out``, as ``encode`` and then ``decode`` give them, by one Python worker a task."""

    def run(texts: list[str]) -> pa.Array:
        found = encoder(ranks, pattern).encode(texts)
        return pa.StructArray.from_arrays([pa.array(found, pa.binary()), pa.array(decoder(ranks).decode(found), pa.binary())], names=["ids", "decoded"])

    both = append_column(df, text_of(text_column), run, "loom_round_trip", "struct<ids: binary, decoded: binary>")
    made = F.col("loom_round_trip")
    return with_columns(both, {ids: made["ids"], out: made["decoded"]}).drop("loom_round_trip")
