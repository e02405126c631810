"""Which cards a job covers: distinct names and their set algebra."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def names_in_all(*sources: DataFrame, name: str = "cardname") -> DataFrame:
    """Distinct names present in every source.

    One aggregation over the tagged union: names are combined before the only
    shuffle, whatever the number of sources.
    """
    tagged = [s.select(F.col(name), F.lit(1 << i).alias("_bit")) for i, s in enumerate(sources)]
    merged = reduce(DataFrame.unionAll, tagged).filter(F.col(name).isNotNull())
    everywhere = (1 << len(sources)) - 1
    return merged.groupBy(name).agg(F.bit_or("_bit").alias("_bits")).filter(F.col("_bits") == everywhere).select(name)


def only_names(df: DataFrame, names: DataFrame, name: str = "cardname") -> DataFrame:
    """Rows whose name is listed. Spark broadcasts the list only if it is small."""
    return df.join(names, name, "left_semi")


def rare_in(cards: DataFrame, codes: DataFrame) -> DataFrame:
    """Names with a rare printing in one of the sets ``codes``."""
    wanted = codes.select(F.col("code").alias("setcode"))
    return cards.filter(F.col("rarity") == "rare").join(wanted, "setcode", "left_semi").select("name").distinct()


def rarity_of(names: DataFrame, cards: DataFrame, codes: DataFrame) -> DataFrame:
    """``name, rarity``: ``rare`` if one of the sets ``codes`` has that printing, else ``mythic``."""
    rare = rare_in(cards, codes).withColumn("_rare", F.lit(True))
    return names.join(rare, "name", "left").select(
        "name", F.when(F.col("_rare"), "rare").otherwise("mythic").alias("rarity")
    )


def set_release(sets: DataFrame, alias: str) -> DataFrame:
    """Release date of the set known by ``alias``: one row, one column."""
    return sets.filter(F.col("mcmname") == alias).select("releasedate")


def sets_since(sets: DataFrame, alias: str) -> DataFrame:
    """Codes of expansion and core sets released no earlier than the named set.

    The date is a scalar subquery: Spark raises an error if the alias names
    more than one set.
    """
    since = set_release(sets, alias).scalar()
    return sets.filter(F.col("type").isin("expansion", "core") & (F.col("releasedate") >= since)).select("code")


def target_names(
    cards: DataFrame, sets: DataFrame, formats: list[DataFrame], since_alias: str
) -> DataFrame:
    """Names to collect sales for: rare and mythic cards of recent sets that are played.

    Two-faced cards count under their face name.
    """
    codes = sets_since(sets, since_alias).withColumnRenamed("code", "setcode")
    eligible = cards.filter(F.col("rarity").isin("mythic", "rare")).join(codes, "setcode", "left_semi")
    two_faced: Column = F.col("name").ilike("%//%")
    single = eligible.filter(~two_faced).select("name")
    faces = eligible.filter(two_faced).select(F.col("facename").alias("name"))
    played = names_in_all(*formats).withColumnRenamed("cardname", "name")
    return single.unionAll(faces).distinct().join(played, "name")
