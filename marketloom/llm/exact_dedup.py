"""Exact duplicates by content sort.

Sampled splitters range-partition the normalised texts, an external sort places
equal texts next to each other, and rows that stand next to each other are
compared in full. Texts are equal when identical after deleting every character
of ``[\\x20\\x09-\\x0D]``; null counts as empty, so all empty texts are equal.

A text with very many copies ("hot") is cut into pieces by a salt in the sort
key. Each piece is compared in full like any other run; the pieces' best rows
are then merged by the SHA-256 of the normalised text. No row is dropped, capped
or sampled; only the splitters come from a sample (Spark's own).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.llm.common import SPACE, shuffle_partitions, text_of

# Characters of the normalised text that take part in the splitters. The driver
# holds a sample of splitter keys, so they must be short; a hash orders texts
# with one beginning.
HEAD = 32
# A text is hot when its copies exceed one PARTth of a partition's fair share.
# So there are at most PART * partitions hot texts, whatever the input.
PART = 10


def _normal(text: Column) -> Column:
    return F.regexp_replace(text, SPACE + "+", "")


def _keyed(docs: DataFrame, id_col: str, text_col: str, payload: Column) -> DataFrame:
    """The payload with its sort key: head and hash of the text, and the salt (0 if not hot)."""
    n = shuffle_partitions(docs.sparkSession)
    text = text_of(text_col)
    plain = docs.select(
        payload.alias("row"),
        F.col(id_col).alias("id"),
        text.alias("text"),
        F.length(text).alias("chars"),
        F.substring(_normal(text), 1, HEAD).alias("head"),
        F.xxhash64(_normal(text)).alias("hash"),
    )
    fair = max(2, docs.count() // (n * PART))
    copies = plain.groupBy("hash").agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > fair)
    hot = copies.select("hash", F.ceil(F.col("copies") / fair).cast("bigint").alias("pieces"))
    salt = F.coalesce(F.pmod(F.xxhash64("id", "chars"), F.col("pieces")), F.lit(0).cast("bigint"))
    # Proven bound: at most PART * n + 1 rows can each hold more than ``fair`` of the rows.
    return plain.join(F.broadcast(hot), "hash", "left").withColumn("salt", salt)


def _compared(keyed: DataFrame) -> DataFrame:
    """Rows of equal text side by side, with their place, count and best row.

    The range exchange clusters what the window groups by, so sort and
    comparison need no further shuffle. The text travels once; it is normalised
    again behind the exchange instead of travelling twice.
    """
    ranged = keyed.repartitionByRange(shuffle_partitions(keyed.sparkSession), "head", "hash", "salt")
    same = W.partitionBy("head", "hash", "salt", "normal")
    # Most code points, then the smallest identifier; a null one last.
    ordered = same.orderBy(F.col("chars").desc(), F.col("id").asc_nulls_last())
    best = F.first(F.struct("chars", "id", "salt")).over(ordered)
    return (
        ranged.withColumn("normal", _normal(F.col("text")))
        .withColumn("place", F.row_number().over(ordered))
        .withColumn("copies", F.count(F.lit(1)).over(same))
        .withColumn("best", best)
        .withColumn("sha", F.sha2(F.col("normal").cast("binary"), 256))
    )


def _merged(keyed: DataFrame) -> DataFrame:
    """One row per hot text: the pieces' counts added, and the best of their best rows."""
    pieces = _compared(keyed.filter(F.col("pieces").isNotNull())).filter(F.col("place") == 1)
    order = F.struct(-F.col("best.chars"), F.col("best.id").isNull(), F.col("best.id"), F.col("best.salt"))
    return pieces.groupBy("sha").agg(
        F.sum("copies").alias("all_copies"),
        F.min_by("best", order).alias("all_best"),
    )


def _decided(docs: DataFrame, id_col: str, text_col: str, payload: Column) -> DataFrame:
    keyed = _keyed(docs, id_col, text_col, payload)
    # As many rows as there are hot texts: the bound above.
    joined = _compared(keyed).join(F.broadcast(_merged(keyed)), "sha", "left")
    best = F.coalesce("all_best", "best")
    return joined.select(
        "row",
        "id",
        "sha",
        best["id"].alias("best_id"),
        F.coalesce("all_copies", "copies").alias("group_size"),
        ((F.col("place") == 1) & (best["salt"] == F.col("salt"))).alias("kept"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points stays, then the one with the
    smallest identifier; a null identifier comes last. Repeated rows count, and
    exactly one row of each group is kept. An empty table gives no rows. Other
    columns, whatever their names, are ignored.
    """
    done = _decided(docs, id_col, text_col, F.lit(None))
    return done.select(
        F.col("id").alias("doc_id"),
        F.col("best_id").alias("keep_id"),
        "group_size",
        "kept",
        F.col("sha").alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows ``exact_dedup`` keeps, with all their columns."""
    return _decided(docs, id_col, text_col, F.struct("*")).filter("kept").select("row.*")


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS body,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents
), r AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place
  FROM t WINDOW w AS (PARTITION BY norm ORDER BY length(body) DESC, doc_id ASC NULLS LAST)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""
