"""What a board means where a record doesn't say: its registered settings as columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONFIG = "token string, tz string, date_order string, pay struct<currency:string,period:string>"


def board_settings(job_source: DataFrame) -> DataFrame:
    """``source, tz, date_order, currency, period`` of each source; malformed or missing settings are NULL."""
    c = F.from_json("adapter_config", CONFIG)
    return job_source.select(F.col("source_id").alias("source"), c.alias("c")).select(
        "source", "c.tz", F.lower("c.date_order").alias("date_order"), F.upper("c.pay.currency").alias("currency"), F.lower("c.pay.period").alias("period")
    )
