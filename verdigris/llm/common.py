"""Shared plumbing of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdigris.session import scratch, ship, table  # noqa: F401  (table is used by the queries)

#: Rows and bytes of an Arrow batch, so that long texts do not fill a Python worker.
ARROW_ROWS, ARROW_BYTES = 1000, 32 << 20


def workers_ready(spark: SparkSession) -> None:
    """Ship the package to the Python workers and bound what one Arrow batch carries.

    This lowers two settings of the session, the rows and the bytes of an Arrow batch.
    """
    ship(spark)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= ARROW_ROWS:
        spark.conf.set(rows, ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again, which survives a lost executor."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pii_key(spark: SparkSession) -> str:
    """The key of surrogates: the session's ``spark.verdigris.pii.key``, else one for invented data only."""
    return spark.conf.get("spark.verdigris.pii.key", None) or "for invented data"


class Memo(dict):
    """A dictionary that computes what it lacks; when full, it keeps one generation to draw from."""

    def __init__(self, of, most: int = 250_000):
        super().__init__()
        self.of, self.most, self.old = of, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.of(key)
        self[key] = value
        return value
