"""Sharding by extendible hashing.

The directory is indexed by the leading bits of a 64-bit hash. One pass adds up
bytes per cell of a few more bits than the expected number of shards needs; only
a bucket over the limit is split on its next bit. Cells that stay too large are
read again with more bits. Rows that share all 64 bits (repeated rows) are dealt
to numbered pieces, so every shard fits unless a single row does not.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import text_of
from marketloom.operators.ranks import global_rank
from marketloom.session import stored

LIMIT = 16 << 20  # bytes of a shard
SPARE_BITS, MORE_BITS, ALL_BITS = 4, 8, 64


def _prefix(hashed: Column, bits: int) -> Column:
    return F.shiftrightunsigned(hashed, ALL_BITS - bits) if bits else F.lit(0).cast("bigint")


def _bits(prefix: Column, depth: Column) -> Column:
    """The prefix as ``depth`` binary digits; the root is the empty string."""
    return F.when(depth == 0, F.lit("")).otherwise(F.expr("lpad(bin(leaf), depth, '0')"))


def _leaves(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """cell -> depth and leaf: the first bucket on its way down, from ``low`` bits, that fits."""
    up = F.col("depth")
    ways = cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high))))
    ways = ways.withColumn("leaf", F.expr(f"shiftrightunsigned(cell, cast({high} - depth AS int))"))
    if high == ALL_BITS:  # a shift by 64 is none
        ways = ways.withColumn("leaf", F.when(up == 0, F.lit(0).cast("bigint")).otherwise(F.col("leaf")))
    sums = ways.groupBy("depth", "leaf").agg(F.sum("bytes").alias("b"), F.sum("rows").alias("r"))
    fits = sums.filter((F.col("b") <= limit) | (F.col("r") == 1)).select("depth", "leaf")
    first = ways.join(fits, ["depth", "leaf"]).groupBy("cell").agg(F.min(F.struct("depth", "leaf")).alias("at"))
    return first.select("cell", "at.depth", "at.leaf")


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per input row: doc_id, n_bytes, shard (hash bits, and ``.piece`` for repeated rows), depth.

    The bytes of a shard are at most ``limit``, unless it holds one larger row
    alone. Null text counts as empty, a null identifier is a value of its own.
    Repeated rows share all their bits and are cut into pieces of as many rows as
    fit. An empty table gives no rows; other columns are ignored.
    """
    return _placed(_rows(docs, id_col, text_col), limit)


def _rows(docs: DataFrame, id_col: str, text_col: str, *payload: Column) -> DataFrame:
    text = text_of(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.octet_length(text).cast("bigint").alias("n_bytes"),
        F.xxhash64(F.col(id_col), text).alias("hash"),
        *payload,
    )


def _placed(rows: DataFrame, limit: int) -> DataFrame:
    """The rows with shard and depth in place of their hash."""
    rows = stored(rows, "shard-rows")
    kept = [c for c in rows.columns if c != "hash"]
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    low, high = 0, min(ALL_BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + SPARE_BITS)
    done, left = [], rows
    while True:
        celled = left.withColumn("cell", _prefix(F.col("hash"), high))
        cells = celled.groupBy("cell").agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        leaves = stored(_leaves(cells, low, high, limit), "shard-directory")
        placed = celled.join(leaves, "cell")
        done.append(placed.select(*kept, _bits(F.col("leaf"), F.col("depth")).alias("shard"), "depth"))
        left = stored(celled.join(leaves, "cell", "left_anti").select(*rows.columns), "shard-rest")
        if left.isEmpty():
            break
        if high == ALL_BITS:
            done.append(_pieces(left, kept, limit))
            break
        low, high = high + 1, min(ALL_BITS, high + MORE_BITS)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _pieces(left: DataFrame, kept: list[str], limit: int) -> DataFrame:
    """Rows of one full hash, in pieces of as many rows as fit; ranked by range, not in one task."""
    ranked = global_rank(left, [F.col("hash"), F.col("n_bytes"), F.col("doc_id")], "rank")
    first = ranked.groupBy("hash").agg(F.min("rank").alias("first"), F.max("n_bytes").alias("most"))
    per = F.greatest(F.lit(1).cast("bigint"), F.floor(F.lit(limit) / F.col("most")))
    piece = F.floor((F.col("rank") - F.col("first")) / per).cast("string")
    name = F.concat(F.lpad(F.bin("hash"), ALL_BITS, "0"), F.lit("."), piece)
    joined = ranked.join(first, "hash")
    return joined.select(*kept, name.alias("shard"), F.lit(ALL_BITS).alias("depth"))


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> None:
    """The documents, all their rows and columns, as one folder per shard.

    A row is carried to its shard, so null and repeated identifiers lose and add
    nothing. Folders are named by ``shard``, or ``shard_`` if the documents have a
    column of that name. An empty table writes no folder.
    """
    placed = _placed(_rows(docs, id_col, text_col, F.struct("*").alias("row")), limit)
    name = "shard" if "shard" not in docs.columns else "shard_"
    out = placed.select("row.*", F.col("shard").alias(name))
    out.repartition(F.col(name)).write.partitionBy(name).parquet(path)
