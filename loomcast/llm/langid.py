"""Operator 4: language identification by error-correcting output codes.

Each language gets a codeword; each bit of the codewords is a two-way question between the languages
whose bit is 1 and the others, answered by a naive Bayes classifier over hashed byte trigrams. A
text's bits are the classifiers' mean log odds; the language is the codeword of least logistic loss,
each bit weighted by how well it separates, and a text whose best two codewords are nearly as good
is flagged. Training counts trigrams over all labelled rows on the executors; the driver gets one
row for each language and block of buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcast.llm.shared import append_column, giving_back

UNDETERMINED = "und"
BUCKETS = 1 << 15
#: More labels than this are an error, as the driver holds a row of counts for each.
MAX_LANGUAGES = 256
BLOCK = 1 << 20
LETTER = regex.compile(r"\p{L}")
#: A-Z become a-z; other ASCII bytes than letters become spaces.
FOLD = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def buckets_of(raw: bytes) -> np.ndarray:
    """The bucket of each byte trigram of ``raw``, which has one space before and after the text."""
    b = np.frombuffer(raw.translate(FOLD), "u1").astype("u4")
    return ((b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))) * np.uint32(0x27D4EB2F) >> np.uint32(17)


def blocks_of(text: str) -> Iterator[np.ndarray]:
    raw = b" " + text.encode() + b" "
    for at in range(0, len(raw) - 2, BLOCK):
        yield buckets_of(raw[at : at + BLOCK + 2])


def codewords(n: int, most: int = 31) -> np.ndarray:
    """n codewords of +1 and -1. Up to five languages get every split of them once (the exhaustive
    code); more get the columns, out of pseudo-random ones, that keep the codewords furthest apart."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 5:
        return np.array([[1 if (c << 1 | 1) >> k & 1 else -1 for c in range(2 ** (n - 1) - 1)] for k in range(n)], float)
    rng, best, far = np.random.default_rng(7), None, -1
    for _ in range(200):
        m = rng.choice((-1.0, 1.0), (n, min(most, 2 * n + 4)))
        d = ((m[:, None] != m[None]).sum(2) + 1000 * np.eye(n)).min()
        if d > far and (np.abs(m.sum(0)) < n).all():
            best, far = m, d
    return best


@dataclass
class Model:
    """languages in order, codewords (languages x bits), weights (buckets x bits), bias and scale for each bit."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    scale: np.ndarray
    ambiguity: float

    def margins(self, texts: list[str]) -> np.ndarray:
        """Mean log odds of the bits, for each text; texts must not be empty."""
        out = np.zeros((len(texts), self.weights.shape[1]))
        pending, docs, size = [], [], 0

        def flush() -> None:
            if pending:
                sums = np.add.reduceat(self.weights[np.concatenate(pending)], np.r_[0, np.cumsum([len(p) for p in pending])[:-1]], axis=0)
                np.add.at(out, docs, sums)

        for k, text in enumerate(texts):
            for block in blocks_of(text):
                pending.append(block)
                docs.append(k)
                size += len(block)
                if size >= BLOCK:
                    flush()
                    pending, docs, size = [], [], 0
        flush()
        return out / np.array([len(t.encode()) for t in texts])[:, None]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, ambiguous) of each text; `und`, 0, false for nulls, texts without a letter and a model without languages."""
        out: list[tuple[str, float, bool]] = [(UNDETERMINED, 0.0, False)] * len(texts)
        known = [k for k, t in enumerate(texts) if t and LETTER.search(t)] if self.languages else []
        if not known:
            return out
        margin = (self.margins([texts[k] for k in known]) - self.bias) * self.scale
        # The logistic loss of each codeword, and the codewords' shares by it.
        loss = np.logaddexp(0, -self.codes[None] * margin[:, None]).sum(2)
        share = np.exp(loss.min(1, keepdims=True) - loss)
        share /= share.sum(1, keepdims=True)
        order = np.sort(share, axis=1)
        best = share.argmax(1)
        for k, b, s, second in zip(known, best.tolist(), order[:, -1].tolist(), (order[:, -2] if len(self.languages) > 1 else np.zeros(len(known))).tolist(), strict=True):
            out[k] = (self.languages[b], s, s - second < self.ambiguity)
        return out


def train(docs: DataFrame, text_column: str = "text", label_column: str = "lang", keep: Column | None = None, ambiguity: float = 0.02) -> Model:
    """A model of all rows with a label and a letter for which ``keep`` holds. No such row: a model
    that answers `und`; one language only: that language for every text with a letter."""
    rows = docs.where(F.coalesce(keep, F.lit(False)) if keep is not None else F.lit(True)).select(F.col(label_column).cast("string").alias("label"), F.col(text_column).alias("text")).where("label IS NOT NULL AND text IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if LETTER.search(text):
                    if label not in sums:
                        if len(sums) == MAX_LANGUAGES:
                            raise ValueError(f"more than {MAX_LANGUAGES} labels")
                        sums[label] = np.zeros(BUCKETS)
                    for block in blocks_of(text):
                        np.add.at(sums[label], block, 1.0)
        for label, s in sums.items():
            for k in range(0, BUCKETS, 4096):
                yield pa.RecordBatch.from_pydict({"label": [label], "at": [k], "counts": [s[k : k + 4096].tolist()]})

    one = F.transform(F.sequence(F.lit(0), F.lit(4095)), lambda k: F.lit(0.0))
    found = (
        rows.mapInArrow(giving_back(count), "label string, at long, counts array<double>")
        .groupBy("label", "at")
        .agg(F.aggregate(F.collect_list("counts"), one, lambda a, b: F.zip_with(a, b, lambda x, y: x + y)).alias("counts"))
        .orderBy("label", "at")
        .collect()
    )
    languages = sorted({r.label for r in found})
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels")
    counts = np.zeros((len(languages), BUCKETS))
    for r in found:
        counts[languages.index(r.label), r["at"] : r["at"] + 4096] = r.counts
    return fit(languages, counts, ambiguity)


def fit(languages: list[str], counts: np.ndarray, ambiguity: float, smoothing: float = 0.5) -> Model:
    codes = codewords(len(languages))
    rates = (counts + smoothing) / (counts + smoothing).sum(1, keepdims=True)
    if len(languages) < 2:
        return Model(languages, codes, np.zeros((BUCKETS, codes.shape[1]), "f4"), np.zeros(codes.shape[1]), np.ones(codes.shape[1]), ambiguity)
    sides = [np.stack([rates[codes[:, b] == s].mean(0) for b in range(codes.shape[1])], 1) for s in (1, -1)]
    weights = np.log(sides[0]) - np.log(sides[1])
    # Each language's mean margin, bit by bit: the boundary lies between the two sides' nearest ones,
    # and a bit weighs more the further apart they are.
    means = rates @ weights
    low = np.array([means[codes[:, b] == 1, b].min() for b in range(codes.shape[1])])
    high = np.array([means[codes[:, b] == -1, b].max() for b in range(codes.shape[1])])
    return Model(languages, codes, weights.astype("f4"), (low + high) / 2, 4 / np.maximum(low - high, 1e-3), ambiguity)


def identify(docs: DataFrame, model: Model, text_column: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with ``out``: lang_pred, score (0 to 1, the codeword's share) and ambiguous, from the whole
    text alone. Null texts and texts without a letter are `und` with score 0. A column of that name is
    replaced; all others stay."""
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])

    def run(texts: list[str | None]) -> pa.Array:
        return pa.array([{"lang_pred": a, "score": s, "ambiguous": u} for a, s, u in model.predict(texts)], kind)

    return append_column(docs, F.col(text_column), run, out, "struct<lang_pred: string, score: double, ambiguous: boolean>")
