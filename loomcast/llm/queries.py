"""The queries of this subpackage: each applies one operator to its whole table and derives digests of its output."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcast.llm import bpe, embeddings, langid, lines, mpeg, oracles, packing, records, simhash, substrings, warc
from loomcast.llm.shared import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
MULTI_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE, context=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.98."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each document that an earlier line is at least 0.8 similar to."""
    found = lines.removed_lines(table(spark, sf_dir, "documents"), threshold=0.8, shingle=5)
    return found.withColumn("removed", F.concat_ws(",", F.col("removed").cast("array<string>")))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, keep=~held_out)
    return langid.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "language.*")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without words that repeated windows of 35 words cover."""
    found = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), window=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as they are read back from the archives."""
    back = warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages"), min_bytes=0))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 3-word shingles of all documents, linked at 3 or fewer differing bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents by the merge ranks, and what they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe.round_trip(docs, MULTI_BPE, public_tokenizers.PATTERN)
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_mpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as MPEG audio, and what is read back from it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")
    back = mpeg.read_media(mpeg.write_media(docs).drop("text"))
    payload = F.col("audio.payload")
    return back.select(
        "doc_id", "n_bytes", F.length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"), F.crc32(F.substring(payload, -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.col("audio.feature").alias("feature"),
    )


def op10_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents as they are read back from the record files."""
    manifest = records.write_records(table(spark, sf_dir, "documents"), WORD_BPE, end_id=2)
    back = records.read_records(manifest)
    return back.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_embeddings, op3_lines, op4_language, op5_substrings, op6_warc, op7_simhash, op8_bpe, op9_mpeg, op10_records)}


def oracle_sql() -> dict[str, str]:
    """Statements for what SQL can state; tests/llm compares the other queries with other implementations."""
    return {"op2_embeddings": oracles.EMBEDDINGS, "op3_lines": oracles.LINES, "op5_substrings": oracles.SUBSTRINGS, "op6_warc": oracles.WARC}
