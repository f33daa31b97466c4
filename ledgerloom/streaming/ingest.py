"""Statement rows as a stream: monthly sums that follow files as they arrive.

The batch operators don't need this; it is an extra for continuously delivered statements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.ledger import side_sum, valid_only

LEDGER = "account long, seq long, ts timestamp, amount decimal(18,2), type string"


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(LEDGER).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def daily_totals(rows: DataFrame, late: str = "3 days") -> DataFrame:
    """Sums per account and day; a day is closed once the watermark has passed it, and repeats of a row within the delay count once."""
    once = rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["account", "seq"])
    return valid_only(once).groupBy("account", F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("n"), side_sum("DEBIT").alias("debit"), side_sum("CREDIT").alias("credit")).select("account", F.col("window.start").cast("date").alias("day"), "n", "debit", "credit")
