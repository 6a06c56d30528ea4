"""Stand-in inputs built from the driver's tables.

The tables hold no missing values, so the missing-value operators get gaps
injected by a fixed rule; everything else reads the tables as they are.
These helpers only shape input rows; the operators do all the work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statsmith.sources.io import read_parquet


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


# Fixed rule: rows with event_id % 7 in (0, 1) lose their value (gaps of two,
# the first rows missing); event_type loses rows with event_id % 5 = 0.
GAP_RULE_V = "CASE WHEN event_id % 7 IN (0, 1) THEN NULL ELSE value END"
GAP_RULE_T = "CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END"


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", F.expr(GAP_RULE_T).alias("event_type"),
                     F.expr(GAP_RULE_V).alias("v"))


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (for order-insensitive value comparison)."""
    out = []
    for f in df.schema.fields:
        if f.dataType.simpleString() in ("double", "float"):
            out.append(F.round(F.col(f"`{f.name}`").cast("double"), digits).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(out)
