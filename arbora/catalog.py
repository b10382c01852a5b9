"""Tables of a data folder as temporary views, and an information-schema frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def load_tables(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> None:
    for name in names or TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def columns_frame(spark: SparkSession, names: list[str]) -> DataFrame:
    """table_name, column_name and ordinal_position of views, from the catalog alone; no data is read."""
    rows = [(t, c.name, i) for t in names for i, c in enumerate(spark.catalog.listColumns(t), 1)]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal_position int")
