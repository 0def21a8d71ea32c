"""Operator 3: line dedup by an exact set-similarity join, in DataFrame functions only.

A line's tokens are the set of its word shingles (of all its words, if it has fewer than a shingle).
Each row is a document. A line goes if an earlier line, by doc_id, row and then place, has a Jaccard similarity of at least the
threshold, whether that one goes itself or not; equal token sets are similarity 1.

1. Rarity: a pass over all lines counts shingles by cell of their hash; the driver gets the counts of
   a fixed number of cells. A token is a long whose leading bits are its cell's rank and whose others
   are its hash, so sorting a line's tokens orders them from rare to frequent.
2. Lines with equal sets are one set, known by two 64-bit hashes, with its first line. A set keeps
   its prefix: the |s| - ceil(t |s|) + 1 rarest tokens, one of which any similar set must share.
3. Postings (token, line, size, position) of the sets' prefixes meet by token. Each line is first
   compared with the first line of each token that it shares; only lines that this does not remove
   are then compared with all earlier lines they share a token with. So a group of n similar lines
   makes about n pairs. Pairs pass the length filter, the positional filter and that of the sets'
   sketches before their whole token sets are made again and compared: lines that share a token by
   chance, whose part grows with the table, take a pair of numbers each, and no tokens.
4. A set whose first line goes, goes whole; of any other set the first line stays.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomcast.llm.shared import discard, each, written, written_in_parts

CELLS = 1 << 14
HASH_BITS = 56
#: Sets of more tokens have a sketch of two longs.
WIDE = 64
#: Shuffles of whole rows are done in so many parts, one after the other, each freed before the next.
SET_PARTS, POSTING_PARTS, TEXT_PARTS = 2, 4, 2


def with_words(lines: DataFrame) -> DataFrame:
    """``lines`` with ``words``, the words of ``line``. A column of its own: inside an expression for each
    shingle the line would be split anew."""
    line = F.col("line")
    other = line.contains("\t") | line.contains("\r") | line.contains("\x0b") | line.contains("\x0c")
    spaced = F.when(other, F.translate("line", "\t\r\x0b\x0c", "    ")).otherwise(line)
    words = F.array_remove(F.split(spaced, " "), "")
    return lines.withColumn("words", words).drop("line")


def with_hashes(lines: DataFrame, shingle: int) -> DataFrame:
    """``lines`` with ``hashes``, the hashes of the shingles of ``words``; repeats included. No word, no hash."""
    # Each word is hashed once; a shingle's hash is that of its words' hashes.
    n = F.size("coded")
    starts = F.sequence(F.lit(0), F.greatest(n - shingle, F.lit(0)))
    runs = each(starts, "integer", lambda i: F.xxhash64(*[F.get("coded", i + k) for k in range(shingle)]))
    whole = F.array(F.xxhash64("coded"))
    hashes = F.when(n > shingle, runs).when(n > 0, whole).otherwise(F.array().cast("array<bigint>"))
    return _coded(lines).withColumn("hashes", hashes).drop("coded")


def _coded(lines: DataFrame) -> DataFrame:
    """``lines`` with ``coded``, the hashes of ``words``, in their place."""
    return lines.withColumn("coded", each(F.col("words"), "string", lambda word: F.xxhash64(word))).drop("words")


def rarity_counts(docs: DataFrame, shingle: int, text_column: str = "text") -> dict[int, int]:
    """The number of shingles of all lines in each cell."""
    lines = docs.select(F.explode_outer(F.split(F.coalesce(text_column, F.lit("")), "\n")).alias("line"))
    # One row a shingle, hashed by compiled code; the hashes are those of with_hashes. The arrays have at
    # least one element; the outer form spares the filters that Spark infers, for which it splits again.
    starts = _coded(with_words(lines)).select("coded", F.explode_outer(F.sequence(F.lit(0), F.greatest(F.size("coded") - shingle, F.lit(0)))).alias("i"))
    h = F.when(F.size("coded") > shingle, F.xxhash64(*[F.get("coded", F.col("i") + n) for n in range(shingle)])).when(F.size("coded") > 0, F.xxhash64("coded"))
    cells = starts.groupBy(h.bitwiseAND(CELLS - 1).alias("cell")).count().where("cell is not null")
    return {r["cell"]: r["count"] for r in cells.collect()}  # CELLS rows at most


def rarity_ranks(found: dict[int, int]) -> bytes:
    """A rank from 0 to 127 for each cell, by its count."""
    most = math.log1p(max(found.values(), default=1))
    return bytes(int(127 * math.log1p(found.get(k, 0)) / most) for k in range(CELLS))


def hot_cells(found: dict[int, int], times: int = 4) -> list[int]:
    """Cells with over ``times`` the mean count, which are CELLS / ``times`` at most. A token of any other
    cell has at most that share of all shingles."""
    limit = times * sum(found.values()) / CELLS
    return sorted(k for k, n in found.items() if n > limit)


def _by_rarity(ranks: bytes) -> Column:
    """The token set of ``hashes`` as an array of longs from rare to frequent."""
    table = F.split(F.lit(",".join(str(r << HASH_BITS) for r in ranks)), ",").cast("array<bigint>")  # folded to one literal

    def token(h: Column) -> Column:
        rank = F.coalesce(F.get(table, h.bitwiseAND(CELLS - 1)), F.lit(0))  # never null, which sorts as primitive longs
        return rank.bitwiseOR(h.bitwiseAND((1 << HASH_BITS) - 1))

    return F.sort_array(F.array_distinct(each(F.col("hashes"), "long", token)))  # compiled, unlike array_sort


def _least_shared(n: Column, m: Column, threshold: float) -> Column:
    """How many tokens sets of n and m tokens must share; a margin keeps rounding on the safe side."""
    return F.ceil((n + m) * (threshold / (1 + threshold)) - 1e-9)


def _parity(tokens: Column, bit: Column | None = None) -> Column:
    """A long whose bit k tells whether an odd number of ``tokens`` have k as their last six bits (of those without ``bit``)."""
    one = F.lit(1).cast("bigint")

    def mark(t: Column) -> Column:
        own = F.call_function("shiftleft", one, t.bitwiseAND(63).cast("int"))
        return own if bit is None else F.when(t.bitwiseAND(bit) == 0, own).otherwise(F.lit(0).cast("bigint"))

    return F.aggregate(each(tokens, "long", mark), F.lit(0).cast("bigint"), lambda s, t: s.bitwiseXOR(t))


def _sketch(tokens: Column, n: Column) -> list[Column]:
    """``b`` and, of sets of over WIDE tokens, ``h``: parities of 64 and half of those of 128 cells. Each bit in which
    two sets' parities differ is a token that only one of them has."""
    return [_parity(tokens).alias("b"), F.when(n > WIDE, _parity(tokens, F.lit(64).cast("bigint"))).alias("h")]


def _differing() -> Column:
    """At least so many tokens are in one of the sets x and y alone, by their sketches."""
    both, half = F.col("xb").bitwiseXOR(F.col("yb")), F.col("xh").bitwiseXOR(F.col("yh"))
    return F.when(half.isNotNull(), F.bit_count(half) + F.bit_count(both.bitwiseXOR(half))).otherwise(F.bit_count(both))


def numbered(docs: DataFrame, id_column: str) -> DataFrame:
    """``docs`` with ``loom_row``, a number of each row: its id where all rows have ids of their own, or else
    one that is written once with the rows, so that it stays."""
    ids = F.col(id_column).cast("long").alias("loom_row")
    if docs.select(ids).groupBy("loom_row").count().where("count > 1 or loom_row is null").isEmpty():
        return docs.withColumn("loom_row", ids)
    return written(docs.withColumn("loom_row", F.monotonically_increasing_id()), "numbered")


def _n_and_pos(npos: str) -> tuple[Column, Column]:
    return F.shiftright(npos, 32).cast("int"), F.col(npos).bitwiseAND((1 << 32) - 1).cast("int")


def _shared(postings: DataFrame, hot: list[int]) -> DataFrame:
    """token, doc, place, n, pos of the postings of tokens with two or more, and ``first``, the token's first posting.

    Tokens of hot cells are aggregated before they are shuffled, and joined, which Spark splits where
    they are many. All others are sorted by token."""
    is_hot = F.col("token").bitwiseAND(CELLS - 1).isin(hot) if hot else F.lit(False)
    at = F.struct("doc", "place", "npos")
    same = Window.partitionBy("token").orderBy("doc", "place", "npos")
    found = postings.where(~is_hot).withColumn("first", F.first(at).over(same.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found = found.withColumn("before", F.lag("token").over(same)).withColumn("after", F.lead("token").over(same))
    found = found.where("before is not null or after is not null").drop("before", "after")
    if hot:
        firsts = postings.where(is_hot).groupBy("token").agg(F.min(at).alias("first"), F.count("*").alias("many")).where("many > 1").drop("many")
        found = found.union(postings.where(is_hot).join(written(firsts, "first-postings"), "token"))
    (n, pos), (first_n, first_pos) = _n_and_pos("npos"), _n_and_pos("first.npos")
    first = F.struct(F.col("first.place").alias("place"), first_n.alias("n"), first_pos.alias("pos"))
    return found.select("token", "doc", "place", n.alias("n"), pos.alias("pos"), first.alias("first"))


def removed_lines(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed, removed (sorted line numbers from 0) of each row.

    Lines end at newlines. Lines without a word are never removed and null texts are one such line. A
    null id comes after all others. Rows that repeat an id, or have none, are documents of their own, in
    any order among themselves. An empty table gives no rows; other columns take no part."""
    rows = numbered(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")), "doc_id")
    found = _removed(rows, threshold, shingle).drop("row")
    discard(docs.sparkSession, *([rows] if "loom_folder" in vars(rows) else []))
    return found


def _removed(rows: DataFrame, threshold: float, shingle: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """row, doc_id, n_lines, n_removed, removed of each row of ``rows``, which have numbers."""
    spark = rows.sparkSession
    counts = rarity_counts(rows, shingle, text_column)
    ranks = rarity_ranks(counts)
    # A null id sorts last.
    docs = rows.select(F.col("loom_row").alias("row"), F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    base = docs.select("row", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc"), "doc_id", F.posexplode_outer(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    with_tokens = with_hashes(with_words(base), shingle).withColumn("tokens", _by_rarity(ranks))
    n = F.size("tokens")
    prefix = F.slice("tokens", 1, F.greatest(n - F.ceil(n * threshold - 1e-9).cast("int") + 1, F.lit(1)))
    # A line's place is its number in the order they are written in, in which lines of a row follow each other.
    # Lines are known by their places and ordered by doc and place.
    lines = with_tokens.select("row", "doc", "doc_id", "line_no", n.alias("n"), prefix.alias("prefix"), *_sketch(F.col("tokens"), n), F.xxhash64("tokens").alias("k1"), F.xxhash64(F.lit(1), "tokens").alias("k2"))
    lines = written(lines.withColumn("place", F.monotonically_increasing_id()), "lines")

    # A place has at most 62 bits: the partition's number and 33 bits.
    step = F.lit(1 << 62).cast("decimal(19,0)")
    place = f"pmod(at, {1 << 62}BD)"

    def some_sets(k: int) -> DataFrame:
        """Sets of the lines whose k1 leaves k."""
        found = lines.where((F.col("n") > 0) & (F.pmod("k1", F.lit(SET_PARTS)) == k)).groupBy("k1", "k2", "n", "prefix", "b", "h")
        found = found.agg(F.min(F.col("doc").cast("decimal(38,0)") * step + F.col("place")).alias("at"))
        return found.select("k1", "k2", "n", "prefix", "b", "h", F.expr(f"(at - {place}) div {1 << 62}BD").alias("doc"), F.expr(f"cast({place} as long)").alias("place"))

    sets = written_in_parts([some_sets(k) for k in range(SET_PARTS)], "line-sets")
    # Of the lines only the sets they belong to are needed from here on, and of the sets, once postings are made, their keys and sketches.
    wide, lines = lines, written(lines.select("row", "doc_id", "line_no", "place", "k1", "k2"), "lines-of-sets")
    discard(spark, wide)
    keys = written(sets.select("k1", "k2", "place", "n", "b", "h"), "set-keys")

    postings = sets.select("doc", "place", "n", F.posexplode("prefix").alias("pos", "token"))
    postings = postings.select("token", "doc", "place", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("pos").cast("long")).alias("npos"))
    hot = hot_cells(counts)
    # The part is taken from bits above those of the cell.
    part = F.shiftright("token", 20).bitwiseAND((1 << 30) - 1) % POSTING_PARTS
    shared = written_in_parts((_shared(postings.where(part == k), hot) for k in range(POSTING_PARTS)), "shared-postings")
    discard(spark, sets)

    def likely(pairs: DataFrame) -> DataFrame:
        """Pairs x, y (y earlier) that pass the length and positional filters and that of the sketches, once each."""
        least = _least_shared(F.col("xn"), F.col("yn"), threshold)
        rest = F.least(F.col("xn") - F.col("xpos"), F.col("yn") - F.col("ypos"))  # positions from 0, this token included
        near = (F.least("xn", "yn") >= F.ceil(F.greatest("xn", "yn") * threshold - 1e-9)) & (rest >= least)
        found = pairs.where(near).select("xplace", "yplace").distinct()
        for side in "xy":
            found = found.join(keys.select(*[F.col(c).alias(f"{side}{c}") for c in ("place", "n", "b", "h")]), f"{side}place")
        return found.where(_differing() <= F.col("xn") + F.col("yn") - 2 * least).select("xplace", "yplace")

    def whole_lines(pairs: DataFrame) -> DataFrame:
        """place and whole token set of the lines of ``pairs``, made again from the texts."""
        places = pairs.select(F.col("xplace").alias("place")).union(pairs.select(F.col("yplace").alias("place"))).distinct()
        involved = written(lines.join(places, "place", "left_semi").select("row", "line_no", "place"), "involved")
        discard(spark)

        def some_lines(k: int) -> DataFrame:
            """Those of the rows whose hash leaves k."""
            own = F.pmod(F.xxhash64("row"), F.lit(TEXT_PARTS)) == k
            some = docs.where(own).join(involved.where(own).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("line_no", "place"))).alias("wanted")), "row")
            wanted = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line, k: F.struct(F.element_at("wanted", k).alias("place"), line.alias("line"))), lambda x: x.place.isNotNull())
            return with_hashes(with_words(some.select(F.inline(wanted))), shingle).select("place", _by_rarity(ranks).alias("tokens"))

        whole = written_in_parts((some_lines(k) for k in range(TEXT_PARTS)), "whole-lines")
        discard(spark, involved)
        return whole

    def verified(pairs: DataFrame, what: str) -> DataFrame:
        """place of the x of pairs that are similar."""
        pairs = written(pairs, "pairs")
        discard(spark)
        whole = whole_lines(pairs)
        left = whole.select(F.col("place").alias("xplace"), F.col("tokens").alias("a"))
        right = whole.select(F.col("place").alias("yplace"), F.col("tokens").alias("b"))
        both = pairs.join(left, "xplace").join(right, "yplace")
        common = F.size(F.array_intersect("a", "b"))
        found = written(both.where(common >= _least_shared(F.size("a"), F.size("b"), threshold)).select(F.col("xplace").alias("place")).distinct(), what)
        discard(spark, pairs, whole)
        return found

    x = [F.col("place").alias("xplace"), F.col("n").alias("xn"), F.col("pos").alias("xpos")]
    y = [F.col(f"first.{c}").alias(f"y{d}") for c, d in (("place", "place"), ("n", "n"), ("pos", "pos"))]
    first_gone = verified(likely(shared.select(*x, *y).where("xplace <> yplace")), "gone")

    open_lines = shared.join(first_gone, "place", "left_anti")
    # The first line of each token has been compared; lines that are the first of all their tokens have nothing earlier.
    open_lines = open_lines.where("place <> first.place").select(*x, F.col("doc").alias("xdoc"), "token")
    earlier = shared.where("place <> first.place").select(F.col("doc").alias("ydoc"), F.col("place").alias("yplace"), F.col("n").alias("yn"), F.col("pos").alias("ypos"), F.col("token"))
    to_all = open_lines.join(earlier, "token").where("ydoc < xdoc or ydoc = xdoc and yplace < xplace")
    later_gone = verified(likely(to_all), "gone")
    gone = written(first_gone.union(later_gone).distinct().select(F.col("place").alias("gplace")), "gone")
    discard(spark, first_gone, later_gone, shared)

    verdict = keys.select(F.col("k1").alias("s1"), F.col("k2").alias("s2"), F.col("place").alias("fplace")).join(gone, F.col("fplace") == F.col("gplace"), "left").select("s1", "s2", "fplace", F.col("gplace").isNotNull().alias("goes"))
    judged = lines.join(verdict, (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2")))
    goes = judged.where(F.col("goes") | (F.col("place") != F.col("fplace")))
    removed = goes.groupBy(F.col("row").alias("gone_row")).agg(F.sort_array(F.collect_list("line_no")).alias("removed"))
    counted = lines.groupBy("row", "doc_id").agg((F.max("line_no") + 1).cast("long").alias("n_lines"))
    gone_at = F.coalesce("removed", F.array().cast("array<int>"))
    found = counted.join(removed, F.col("row") == F.col("gone_row"), "left")
    found = written(found.select("row", "doc_id", "n_lines", F.size(gone_at).cast("long").alias("n_removed"), gone_at.alias("removed")), "removed-lines")
    discard(spark, lines, keys, gone)
    return found


def dedup_lines(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, id_column: str = "doc_id", text_column: str = "text", changed: str | None = None) -> DataFrame:
    """``docs`` with its removed lines cut out of the texts. Texts that lose nothing, null ones too, stay
    as they are; all columns, whatever their names, and all rows stay, and an empty table stays empty.
    ``changed`` names a column to add: whether a text lost lines."""
    inner = [f"c{k}" for k in range(len(docs.columns))]
    key, text = inner[docs.columns.index(id_column)], inner[docs.columns.index(text_column)]
    rows = numbered(docs.toDF(*inner), key)
    gone = _removed(rows, threshold, shingle, key, text).where("n_removed > 0").select(F.col("row").alias("gone_row"), F.col("removed").alias("gone"))
    kept = F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda line, k: F.when(~F.array_contains("gone", k), line)), lambda line: line.isNotNull()), "\n")
    both = rows.join(gone, F.col("loom_row") == F.col("gone_row"), "left")
    out = both.select(*[F.when(F.col("gone").isNull(), F.col(c)).otherwise(kept).alias(c) if c == text else F.col(c) for c in inner], F.col("gone").isNotNull().alias("changed"))
    return out.toDF(*docs.columns, changed) if changed else out.drop("changed").toDF(*docs.columns)
