"""Shared-folder tables that cut lineage, and small helpers common to the operators."""

from __future__ import annotations

import gc
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import shared_dir

#: Folders of this session's shelves.
SHELVES: list[str] = []


class Shelf:
    """Tables written for one operator call. Each is Parquet in the shared folder, so a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = os.path.join(shared_dir(spark), f"shelf-{uuid.uuid4().hex}")
        self.n = 0
        SHELVES.append(self.root)

    def put(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """Write df, a folder for each value of by if given, and return it as read back."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path, partitionBy=by)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._shelf_path = path
        return out

    def drop(self, df: DataFrame, part: str = "") -> None:
        """Delete a table, or a folder of it, that nothing will read again."""
        _delete(self.spark, f"{df._shelf_path}/{part}".rstrip("/"))

    def clean(self) -> None:
        """Let Spark delete the shuffle files of finished steps: it does so when the driver collects their plans."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete all tables that operators of this session have written. Results that were not written or collected are lost."""
    while SHELVES:
        _delete(spark, SHELVES.pop())


def unused(df: DataFrame, *stems: str) -> list[str]:
    """Column names like these that df doesn't have, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in stems:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """A base table, only the named columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def text_bytes(df: DataFrame, col: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, UTF-8 bytes of the text, null as empty): what the Arrow tasks read."""
    return df.select(F.col(key), F.coalesce(F.col(col), F.lit("")).cast("binary").alias("_bytes"))
