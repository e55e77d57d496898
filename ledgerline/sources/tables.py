"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the folder, read lazily so that pruning and pushdown reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_VIEWS: dict[tuple, str] = {}


def register(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Expose tables as temporary views for SQL queries; a view that already stands for the folder is left alone."""
    session = (spark.sparkContext.applicationId, spark._jsparkSession.hashCode())
    for name in names:
        if _VIEWS.get((*session, name)) != sf_dir or not spark.catalog.tableExists(name):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
            _VIEWS[(*session, name)] = sf_dir
