"""Operator 1: hierarchical multi-length packing.

Documents are routed by length to context tiers of 2048, 1024, ... 1 tokens. Tiers are packed from
the longest down: a sequence opens with the longest document of its tier, its gap is filled from
shorter tiers, best fit first, and the last gap by the head of one more document, whose rest goes
back to a shorter tier. So each sequence is filled to its tier, and what is left at the end of a
partition is cut into powers of two. Sequences of a tier form step groups of the same number of
tokens, dealt so that their attention cost (squares of the pieces' lengths) is even.

Each partition is packed alone, a window of tokens at a time, so there is no shuffle and memory is
bounded whatever the size of the table or of a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcast.llm.shared import giving_back, text_of
from loomcast.llm.words import CACHE_LIMIT

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class TierPacker:
    """Packs (document number, start, ids) items. ``out`` gets one row for each piece."""

    def __init__(self, context: int, first_id: int, step_tokens: int):
        self.context, self.step_tokens = context, step_tokens
        self.next_sequence = self.next_group = first_id
        self.stacks: list[list] = [[] for _ in range(context + 1)]  # by length
        self.lengths = 0  # a bit for each length that has items
        self.waiting = 0
        self.done: list[tuple[int, list]] = []  # (tier, pieces) of sequences without a step group

    def add(self, doc, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= self.context:
            self.done.append((self.context, [(doc, at, ids[at : at + self.context], total)]))
            at += self.context
        self._put((doc, at, ids[at:], total))

    def _put(self, item) -> None:
        if n := len(item[2]):
            self.stacks[n].append(item)
            self.lengths |= 1 << n
            self.waiting += n

    def _take(self, n: int):
        item = self.stacks[n].pop()
        if not self.stacks[n]:
            self.lengths &= ~(1 << n)
        self.waiting -= n
        return item

    def pack(self, last: bool) -> None:
        """Fill sequences as long as there is enough to fill them; at the end, with what there is."""
        while self.lengths:
            longest = self.lengths.bit_length() - 1
            tier = 1 << (longest - 1).bit_length()
            if self.waiting < tier:
                if not last:
                    return
                tier = 1 << (self.waiting.bit_length() - 1)
            pieces, gap = [], tier
            while gap:
                if fit := self.lengths & ((2 << gap) - 1):
                    item = self._take(fit.bit_length() - 1)
                else:  # the shortest of the longer ones gives its head
                    longer = self.lengths >> (gap + 1)
                    doc, at, ids, total = self._take(gap + (longer & -longer).bit_length())
                    item = (doc, at, ids[:gap], total)
                    self._put((doc, at + gap, ids[gap:], total))
                pieces.append(item)
                gap -= len(item[2])
            self.done.append((tier, pieces))

    def rows(self) -> Iterator[tuple]:
        """The pieces of all filled sequences, with step groups."""
        by_tier: dict[int, list] = {}
        for tier, pieces in self.done:
            by_tier.setdefault(tier, []).append(pieces)
        self.done = []
        for tier, found in sorted(by_tier.items(), reverse=True):
            groups = -(-len(found) * tier // self.step_tokens)
            found.sort(key=lambda pieces: -sum(len(p[2]) ** 2 for p in pieces))
            for k, pieces in enumerate(found):
                turn, place = divmod(k, groups)
                group = self.next_group + (groups - 1 - place if turn % 2 else place)
                offset = 0
                for doc, at, ids, total in pieces:
                    yield doc, at, len(ids), ids.tobytes(), total, self.next_sequence, offset, tier, group
                    offset += len(ids)
                self.next_sequence += 1
            self.next_group += groups


def pack(docs: DataFrame, tokenizer: str, context: int = 2048, end_id: int = 1, step_tokens: int = 32_768, window_tokens: int = 2_000_000, id_column: str = "doc_id", text_column: str = "text", cache_limit: int = CACHE_LIMIT) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset, tier, step_group.

    ``context`` is a power of two. Null or empty texts have the end id alone; null ids and repeated
    rows are packed like others; other columns are left out; an empty table gives no rows. ``cache_limit`` bounds the
    word cache of each worker; a smaller one takes less memory and more time, and gives the same ids."""
    if context < 1 or context & (context - 1):
        raise ValueError("context must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from loomcast.llm.tokenizers_lib import library_encoder

        encoder = library_encoder(tokenizer, cache_limit)
        packer = TierPacker(context, TaskContext.get().partitionId() << 40, step_tokens)
        end = np.array([end_id], "<u4").tobytes()

        def out() -> Iterator[pa.RecordBatch]:
            rows = list(packer.rows())
            for k in range(0, len(rows), 4096):
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 4096], strict=True), TYPES, strict=True)], names=NAMES)

        fresh = 0
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                for doc, ids in zip(part[0].to_pylist(), encoder.encode(part[1].to_pylist()), strict=True):
                    packer.add(doc, ids := np.frombuffer(ids + end, "<u4"))
                    fresh += len(ids)
                if fresh >= window_tokens:
                    packer.pack(last=False)
                    fresh = 0
                    yield from out()
        encoder.forget()
        packer.pack(last=True)
        yield from out()

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text")).mapInArrow(giving_back(run), SCHEMA)


NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
TYPES = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]] for c in SCHEMA.split(", ")]
