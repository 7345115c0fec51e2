"""Tables of the library: keys seen, upserts, deletes in dependent tables, samples per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_of(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row per key, the first in order; rows whose key is null are kept."""
    rows = df.where(F.col(key).isNotNull()).withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_k = 1").drop("_k")
    return rows.unionByName(df.where(F.col(key).isNull()))


def not_yet_imported(files: DataFrame, books: DataFrame, keys: list[str]) -> DataFrame:
    """Files none of whose keys is known; an anti join per key instead of one with OR."""
    for key in keys:
        files = files.join(books.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return files


def upserted(df: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or ignore: the rows of both, each once."""
    return df.unionByName(new).distinct()


def without(df: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """df without the rows whose key is in the one column of gone; rows with a null key stay."""
    return df.join(gone.toDF(key).distinct(), key, "left_anti")


def sample_per_group(df: DataFrame, group: str, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n rows per group in an order that depends on the seed and the ids only."""
    w = W.partitionBy(group).orderBy(F.md5(F.concat(F.lit(str(seed)), F.col(id_col))), id_col)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def counted(df: DataFrame, key: str) -> DataFrame:
    """(key, n, share): rows per value, and their part of all."""
    per = df.groupBy(key).agg(F.count("*").alias("n"))
    return per.select(key, "n", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6).alias("share"))
