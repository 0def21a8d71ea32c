"""Work items: validation, prompts, routing, chunks, retrieval."""

from __future__ import annotations

import functools
import math
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def work_items(rows: DataFrame, item_id: Column, prompt: Column, *context: str) -> DataFrame:
    """item_id, prompt and the context columns as they are."""
    return rows.select(item_id.cast("string").alias("item_id"), F.coalesce(prompt, F.lit("")).alias("prompt"), *context)


def id_is_valid(item_id: Column) -> Column:
    """Not null, not empty, not only white space."""
    return F.coalesce(F.length(F.regexp_replace(item_id, r"\s", "")) > 0, F.lit(False))


def validated(items: DataFrame) -> DataFrame:
    """``items``; a row with an invalid id fails the job."""
    checked = F.when(id_is_valid(F.col("item_id")), F.col("item_id")).otherwise(F.raise_error(F.lit("item_id must not be blank")).cast("string"))
    return items.withColumn("item_id", checked)


def duplicate_ids(items: DataFrame) -> DataFrame:
    return items.groupBy("item_id").agg(F.count("*").alias("n")).where("n > 1")


def route(items: DataFrame, rules: list[tuple[Column, str]], otherwise: str) -> DataFrame:
    """``strategy`` by the first rule that holds."""
    if not rules:
        return items.withColumn("strategy", F.lit(otherwise))
    (first, name), *rest = rules
    return items.withColumn("strategy", functools.reduce(lambda c, r: c.when(r[0], r[1]), rest, F.when(first, name)).otherwise(otherwise))


def template(text: str, *columns: str) -> Column:
    """A prompt from a format string with one %s for each column."""
    return F.format_string(text, *[F.col(c).cast("string") for c in columns])


def chunks(rows: DataFrame, text: str = "text", size: int = 100) -> DataFrame:
    """``rows`` with chunk_no and chunk, pieces of ``size`` characters; null and empty texts have none."""
    n = F.ceil(F.length(text) / size).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1))
    return rows.withColumn("chunk_no", F.explode(at)).withColumn("chunk", F.expr(f"substring({text}, chunk_no * {size} + 1, {size})"))


def cosine(a: str, b: str) -> Column:
    """In double precision; null for zero vectors."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = [F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))) for c in (a, b)]
    return F.try_divide(dot, norm[0] * norm[1])


#: Vectors of a tile, and queries of a tile that meet another tile's vectors at a time.
TILE, BLOCK = 4096, 512
#: Scores that are this near to where rounding changes are computed anew, in the order of ``cosine``.
NEAR = 1e-5


def _rounded(scores: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``scores`` in millionths, half up by their decimal form as Spark rounds; ``left`` and ``right`` are the vectors of each."""
    scaled = np.abs(scores) * 1e6
    out = np.floor(scaled + 0.5) * np.sign(scores)
    for k in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < NEAR):
        dot, a, b = (float(np.cumsum(x)[-1]) for x in (left[k] * right[k], left[k] * left[k], right[k] * right[k]))
        out[k] = float((Decimal(repr(dot / (math.sqrt(a) * math.sqrt(b)))) * 1_000_000).to_integral_value(ROUND_HALF_UP))
    return out


def _best(ids: np.ndarray, left: np.ndarray, own: np.ndarray, right: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of queries and of vectors, and their scores in millionths, of the ``k`` best of ``right`` for each of ``left``,
    by score and then id; NaN comes before all, as in SQL, and pairs with a zero vector count for nothing."""
    with np.errstate(all="ignore"):
        norms = [np.sqrt((x * x).sum(1)) for x in (left, right)]
        product = norms[0][:, None] * norms[1][None, :]
        scores = left @ right.T / product
    scores[np.isnan(scores) & (product != 0)] = np.inf
    scores[(product == 0) | (own[:, None] == ids[None, :])] = -np.inf
    n = min(k, len(ids))
    least = np.partition(scores, len(ids) - n, axis=1)[:, len(ids) - n]
    q, v = np.nonzero((scores >= least[:, None] - 2e-6) & (scores > -np.inf))  # all that may round to the least
    found = scores[q, v]
    finite = np.flatnonzero(np.isfinite(found))
    found[finite] = _rounded(found[finite], left[q[finite]], right[v[finite]])
    order = np.lexsort((ids[v], -found, q))
    q, v, found = q[order], v[order], found[order]
    first = np.searchsorted(q, q)  # where the rows of each one's query begin
    top = np.arange(len(q)) - first < k
    return q[top], v[top], found[top]


def _vectors(ids: pa.Array, lists: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length, ids and vectors in double precision, without those that are null or hold nulls."""
    out: dict[int, list] = {}
    for i, x in zip(ids.to_pylist(), lists, strict=True):
        if i is not None and x.is_valid and len(x) and not x.values.null_count:
            out.setdefault(len(x), []).append((i, x.values.to_numpy(zero_copy_only=False)))
    return {n: (np.array([i for i, _ in rows], np.int64), np.array([x for _, x in rows], np.float64)) for n, rows in out.items()}


def _tiles(rows: DataFrame, key: str, vector: str, name: str) -> DataFrame:
    """One row for each tile of ``rows``: arrays of keys and vectors."""
    n = max(1, -(-rows.count() // TILE))
    tile = F.pmod(F.xxhash64(key, vector), F.lit(n))
    return rows.groupBy(tile.alias("tile")).agg(F.collect_list(F.struct(F.col(key).cast("long").alias("id"), F.col(vector).alias("x"))).alias(name)).drop("tile")


def nearest(queries: DataFrame, base: DataFrame, k: int = 2) -> DataFrame:
    """query_id, vec_id, score, rank of the k nearest vectors of ``base`` (vec_id, embedding; ids are whole numbers) to each of
    ``queries`` (query_id, query): a stated set of queries against all rows. All pairs are compared, as pairs
    of tiles of up to some TILE rows; each pair of tiles leaves k rows for a query, and a task holds one at a time."""
    spark = base.sparkSession
    pairs = _tiles(base, "vec_id", "embedding", "v").join(_tiles(queries, "query_id", "query", "q"))
    pairs = pairs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))

    def compare(batches):
        for batch in batches:
            for row in range(len(batch)):
                v, q = (_vectors(x.field("id"), x.field("x")) for x in (batch.column(c)[row].values for c in ("v", "q")))
                for n in sorted(set(v) & set(q)):
                    for at in range(0, len(q[n][0]), BLOCK):
                        own, left = q[n][0][at : at + BLOCK], q[n][1][at : at + BLOCK]
                        i, j, score = _best(v[n][0], left, own, v[n][1], k)
                        score = np.where(np.isinf(score), np.nan, score / 1e6) + 0.0
                        yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(v[n][0][j]), pa.array(score, from_pandas=False)], names=["query_id", "vec_id", "score"])

    scored = pairs.select("v", "q").mapInArrow(compare, "query_id long, vec_id long, score double")
    kinds = {"query_id": queries.schema["query_id"].dataType, "vec_id": base.schema["vec_id"].dataType}
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return scored.select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()], "score").withColumn("rank", rank).where(F.col("rank") <= k)


def conversation_prompts(turns: DataFrame) -> DataFrame:
    """conv_id, system_prompt, prompt (the other turns in order, one line each)."""
    said = F.array_sort(F.collect_list(F.when(F.col("role") != "system", F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line")))))
    system = F.array_sort(F.collect_list(F.when(F.col("role") == "system", F.struct("turn", "text"))))
    found = turns.groupBy("conv_id").agg(said.alias("said"), system.alias("system"))
    return found.select("conv_id", F.array_join(F.col("system.text"), "\n").alias("system_prompt"), F.array_join(F.col("said.line"), "\n").alias("prompt"))
