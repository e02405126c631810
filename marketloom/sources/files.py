"""Files on shared storage: daily price files and zip archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.sources.documents import card_price_rows


def price_files(spark: SparkSession, folder: str) -> DataFrame:
    """``price-history-YYYY-MM-DD.txt`` files below ``folder`` as price rows."""
    docs = (
        spark.read.option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "price-history-*.txt")
        .text(folder)
        .select("value", F.col("_metadata.file_name").alias("file_name"))
    )
    return card_price_rows(docs)


def zip_files(spark: SparkSession, folder: str) -> DataFrame:
    """Members of the zip archives below ``folder``."""
    archives = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.zip")
        .load(folder)
        .select(F.col("path").alias("archive"), "content")
    )
    return zip_members(archives)


def zip_members(archives: DataFrame) -> DataFrame:
    """``archive, content`` (bytes) to one row ``archive, member, text`` per member."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # One output frame per archive keeps the memory held to one archive.
            for archive, content in zip(batch["archive"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = [n for n in z.namelist() if not n.endswith("/")]
                    for name in names:
                        text = z.read(name).decode("utf-8", "replace")
                        yield pd.DataFrame({"archive": [archive], "member": [name], "text": [text]})

    return archives.select("archive", "content").mapInPandas(unpack, "archive string, member string, text string")
