"""Table scans of the driver tables.

Parquet scans only: Catalyst pushes filters into the reader and prunes
columns, so each operator reads just what it uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region nation customer supplier part orders lineitem events "
               "documents embeddings pages benchmark labels conversations").split()


class Tables:
    """Lazy readers of ``{sf_dir}/{name}.parquet``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def register_views(self) -> None:
        """Temp views for SQL users (`spark.sql("select ... from orders")`)."""
        for name in BASE_TABLES:
            self(name).createOrReplaceTempView(name)
