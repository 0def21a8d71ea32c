"""The training-data pipeline: language ID, line dedup, SimHash near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``. ``run`` writes each stage's rows in the shared folder and reads them again as the
next one's documents, so a lost executor never goes back more than one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcast.llm import langid, lines, near_documents, packing, substrings
from loomcast.llm.shared import FOLDERS, discard, table, written

#: Several stages iterate or sample hashes, which SQL cannot state; tests compare them with brute force.
ORACLE_SQL = None

#: Packing's word cache, a quarter of op1's: the stages before leave executors with fully grown heaps.
PACK_CACHE = 150_000


def _with_text(found: DataFrame, columns: list[str], text: Column, changed: Column) -> DataFrame:
    """``columns`` of ``found``, with the new text and, where it is ``changed``, its length."""
    new = {"text": text, "n_chars": F.when(changed, F.length(text).cast("long")).otherwise(F.col("`n_chars`"))}
    return found.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is learnable from the labelled ones; texts without a letter and texts
    between two languages go.

    Null and empty texts go, whatever their other columns; null labels and ids only teach nothing. Ties
    between languages count as ambiguous. Repeated rows are judged alike, each for itself. Without any
    labelled text, and of an empty table, nothing stays. Other columns stay, whatever their names."""
    verdict = "loom_language_of_text"
    found = langid.identify(docs, langid.train(docs), out=verdict)
    kept = found.where((F.col(verdict)["lang_pred"] != langid.UNDETERMINED) & ~F.col(verdict)["ambiguous"])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier line is at least 0.8 similar to, by doc_id, then row, then place.

    Null and empty texts and lines without a word stay. Null ids come last; of rows that repeat an id, or
    have none, any order among themselves holds. Of equal lines the first stays. An empty table stays
    empty. Other columns stay, whatever their names."""
    kept = lines.dedup_lines(docs, threshold=0.8, shingle=5, changed="loom_lines_went")
    return _with_text(kept, docs.columns, F.col("text"), F.col("loom_lines_went"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: 5-word shingles, similarity 0.8 or more.

    The smallest doc_id stays, null ids last; of rows with that same id one. All null, empty and wordless
    texts are one group. An empty table stays empty. Other columns stay, whatever their names."""
    return near_documents.distinct_documents(docs, width=5, similarity=0.8)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 35 words or more that are anywhere else too; others stay as they are.

    Null, empty and shorter texts stay. All copies of a passage go, also those in repeated rows or in one
    text. Ids take no part. An empty table stays empty. Other columns stay; those that are named like the
    operator's results (n_words, n_removed, removed, kept) are carried beside them."""
    inner = [f"c{k}" for k in range(len(docs.columns))]
    text = inner[docs.columns.index("text")]
    found = substrings.remove_repeats(docs.toDF(*inner), window=35, text_column=text)
    changed = F.col("n_removed") > 0
    new = F.when(changed, F.col("kept")).otherwise(F.col(text))
    back = found.select(*inner, new.alias("new_text"), changed.alias("changed"))
    return _with_text(back.toDF(*docs.columns, "loom_new_text", "loom_changed"), docs.columns, F.col("loom_new_text"), F.col("loom_changed"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens, with their ids.

    Null and empty texts have the end id alone; null ids and repeated rows are packed like others; other
    columns are left out; an empty table gives no rows."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), context=2048, end_id=1, cache_limit=PACK_CACHE)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over the documents of ``sf_dir``. Once a stage is written, what it left in the shared folder and
    what it read, an earlier stage's rows, are deleted; its own rows stay until the next stage is written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        begun = set(FOLDERS)
        docs = written(stage(spark, docs, sf_dir), name)
        left = [f for f in FOLDERS if f not in begun and f != docs.loom_folder]
        discard(spark, *left, *before)
        before = [docs.loom_folder]
    return STAGES[-1][1](spark, docs, sf_dir)
