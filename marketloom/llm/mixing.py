"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same expected number of copies, its source's
target over its size. The whole part is certain; the fraction is rounded in
duels: two documents' fractions exchange mass, weighted by their words, in a
random direction until one of them is 0 or 1. Expected copies and the source's
words stay what they were at every step. One document per bucket stays
fractional; these residuals meet in the next level of a reduction tree until one
per source is left, which is rounded to the nearer side. So a source's words miss
its target by at most half a document.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import text_of, words_of
from marketloom.operators.ranks import global_rank
from marketloom.session import stored

WEIGHTS = (5, 2, 1)  # by rank of the source, repeating
MOST = 3  # copies of a document, and so of a source
FAN = 1024  # documents of one bucket, residuals of one node of the tree
SEED = 20


def source_targets(sized: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """source, rank, source_size, docs, target: shares by weight, none above ``most`` times its size.

    Sources are ranked by code point, null last. The excess of capped sources is
    shared again by weight until none is above; each round is one aggregate.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    ranked = global_rank(sums, [F.col("source").asc_nulls_last()], "rank")
    turn = F.pmod(F.col("rank") - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    table = stored(ranked.withColumn("weight", weight), "mix-sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    cap, level, capped = F.col("source_size") * most, 0.0, -1
    while True:
        over = cap < F.col("weight") * level
        got = table.agg(
            F.count_if(over), F.coalesce(F.sum(F.when(over, cap)), F.lit(0)), F.sum(F.when(~over, F.col("weight")))
        ).first()
        if got[0] == capped or not got[2]:
            break
        capped, level = got[0], (total - got[1]) / got[2]
    target = F.least(cap.cast("double"), F.col("weight") * F.lit(float(level)))
    return table.select("source", "rank", "source_size", "docs", target.alias("target"))


def _duels(size: np.ndarray, p: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Fractions after sequential duels in the given order: all 0 or 1 but at most one."""
    out, hold = p.copy(), -1
    for i in range(len(p)):
        if hold < 0:
            hold = i
            continue
        a, b = out[hold] * size[hold], (1 - out[hold]) * size[hold]
        c, d = out[i] * size[i], (1 - out[i]) * size[i]
        up, down = min(b, c), min(a, d)  # words from i to the holder, or back
        if draws[i] * (up + down) < down:
            full, none = b <= c, c <= b
            out[hold] = 1.0 if full else out[hold] + up / size[hold]
            out[i] = 0.0 if none else out[i] - up / size[i]
        else:
            none, full = a <= d, d <= a
            out[hold] = 0.0 if none else out[hold] - down / size[hold]
            out[i] = 1.0 if full else out[i] + down / size[i]
        open_ = [j for j in (hold, i) if 0.0 < out[j] < 1.0]
        hold = open_[0] if open_ else -1
    return out


def _settle(level: int, seed: int):
    def settle(group: pd.DataFrame) -> pd.DataFrame:
        # Large documents first: the one left over is then likely a small one.
        group = group.sort_values(["size", "draw", "doc"], ascending=[False, True, True], kind="stable")
        key = [seed, level, int(group["rank"].iloc[0]), int(group["bucket"].iloc[0])]
        draws = np.random.Generator(np.random.Philox(np.random.SeedSequence(key))).random(len(group))
        group["p"] = _duels(group["size"].to_numpy(float), group["p"].to_numpy(float), draws)
        return group

    return settle


def _rounded(parts: DataFrame, largest: int, seed: int) -> DataFrame:
    """The rows with ``extra`` 0 or 1, by the tree. ``largest`` is the highest bucket of any source."""
    schema, settled, level = parts.schema, [], 0
    while True:
        fought = parts.groupBy("rank", "bucket").applyInPandas(_settle(level, seed), schema)
        fought = stored(fought, f"mix-level-{level}")
        whole = F.col("p").isin(0.0, 1.0)
        settled.append(fought.filter(whole).withColumn("extra", F.col("p").cast("bigint")))
        parts = fought.filter(~whole)
        if largest == 0:
            settled.append(parts.withColumn("extra", (F.col("p") >= 0.5).cast("bigint")))
            break
        parts = parts.withColumn("bucket", F.floor(F.col("bucket") / FAN))
        largest, level = largest // FAN, level + 1
    out = settled[0]
    for one in settled[1:]:
        out = out.unionByName(one)
    return out


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    most: int = MOST,
    seed: int = SEED,
) -> DataFrame:
    """One row per input row: doc_id, size, source, source_size, target, copies, taken (size * copies).

    Size is the number of words (null or empty text: 0). A null source is a source
    of its own, ranked last. A source without words has target 0 and no copies.
    Draws depend on identifier and size, so reruns agree; repeated rows are rows
    of their own. An empty table gives no rows; other columns are ignored.
    """
    size = F.size(words_of(text_of(text_col))).cast("bigint").alias("size")
    one = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size)
    sized = stored(one, "mix-sizes")
    sources = stored(source_targets(sized, weights, most), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    named = sources.withColumn("rate", rate).withColumnRenamed("source", "its")
    rated = sized.join(named, F.col("source").eqNullSafe(F.col("its")), "left").drop("its")
    rated = rated.withColumn("base", F.floor("rate")).withColumn("p", F.col("rate") - F.col("base"))
    open_ = (F.col("p") > 0) & (F.col("size") > 0)
    fixed = rated.filter(~open_).withColumn("extra", F.lit(0).cast("bigint"))
    draw = F.xxhash64("doc_id", "size", F.lit(seed))
    bucket = F.pmod(F.xxhash64("doc_id", "size", F.lit(seed + 1)), F.floor(F.col("docs") / FAN) + 1)
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    parts = rated.filter(open_).withColumns({"draw": draw, "bucket": bucket, "doc": doc})
    largest = (sources.agg(F.max("docs")).first()[0] or 0) // FAN
    done = _rounded(parts, largest, seed).drop("draw", "bucket", "doc").unionByName(fixed)
    copies = F.col("base") + F.col("extra")
    return done.select(
        "doc_id", "size", "source", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken")
    )


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The input rows, each as often as the mix takes it, with all their columns.

    Rows of one (identifier, size, source) are interchangeable: the copies of all
    of them are dealt evenly, the rest in order of their text.
    """
    taken = mix(docs, id_col, text_col, source_col, **how)
    keys = taken.groupBy("doc_id", "size", "source").agg(F.sum("copies").alias("all"), F.count(F.lit(1)).alias("same"))
    size = F.size(words_of(text_of(text_col))).cast("bigint")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("i"), size.alias("n"), F.col(source_col).alias("s"))
    on = F.col("i").eqNullSafe(F.col("doc_id")) & (F.col("n") == F.col("size")) & F.col("s").eqNullSafe(F.col("source"))
    found = rows.join(stored(keys, "mix-copies").filter("all > 0"), on)
    alone = found.filter("same = 1").select("row", F.col("all").alias("times"))
    place = F.expr("row_number() OVER (PARTITION BY i, n, s ORDER BY to_json(row))")
    several = found.filter("same > 1").withColumn("place", place)
    share = F.floor(F.col("all") / F.col("same")) + (F.col("place") <= F.col("all") % F.col("same")).cast("bigint")
    dealt = alone.unionByName(several.select("row", share.alias("times"))).filter("times > 0")
    return dealt.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), "times"))).select("row.*")
