"""Table sources and sinks (operators A1-A4).

``read_table`` reproduces the type behaviour of a plain ``pandas.read_csv``
(header row, comma separator, default NA tokens, long/double/boolean/string
inference, dates left as text) but runs as Spark jobs: the file is read with
every column as string, the NA tokens become NULL, and ONE aggregate pass
decides each column's type with ``try_cast`` counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statsmith.functions.columns import column, python_float_text
from statsmith.sources.csv_blocks import read_csv_blocks


# The strings pandas.read_csv treats as missing by default.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
             "n/a", "nan", "null"]

# The spellings pandas parses as booleans.
TRUE_TOKENS = ["True", "TRUE", "true"]
FALSE_TOKENS = ["False", "FALSE", "false"]


def _check_names(cols: list[str]) -> None:
    seen = {}
    for c in cols:
        k = c.lower()
        if k in seen:
            raise ValueError(f"columns {seen[k]!r} and {c!r} differ only by case; "
                             "Spark resolves names case-insensitively")
        seen[k] = c


def read_table(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Load a table.  CSV gets pandas-compatible NA handling and type inference;
    parquet keeps its own schema and values.  Files are split over many tasks,
    also where quoted fields hold line breaks (``csv_blocks``)."""
    fmt = fmt or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")
    if fmt == "parquet":
        return read_parquet(spark, path)
    # a line with an odd number of quotes opens or closes a field with a line break in it
    broken = spark.read.text(path).filter(F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1)
    if broken.isEmpty():
        # quotes inside quoted fields are doubled ("") as in pandas / RFC 4180
        header = spark.read.option("header", False).option("escape", '"').csv(path).first()   # one row
        if header is not None:
            _check_names([str(v) for v in header])   # Spark would silently rename duplicates
        raw = (spark.read.option("header", True).option("inferSchema", False).option("escape", '"')
               .option("mode", "PERMISSIVE").option("nullValue", None).csv(path))
    else:
        raw = read_csv_blocks(spark, path)
        _check_names(raw.columns)
    tokens = F.array(*[F.lit(t) for t in NA_TOKENS])
    cleaned = raw.select([
        F.when(column(c).isNull() | F.array_contains(tokens, column(c)), F.lit(None))
         .otherwise(column(c)).alias(c) for c in raw.columns])
    infer = _infer_types(cleaned)
    out = []
    for c in cleaned.columns:
        t = infer[c]
        if t == "long":
            out.append(column(c).cast("long").alias(c))
        elif t == "double":
            out.append(column(c).cast("double").alias(c))
        elif t == "boolean":
            out.append(F.when(column(c).isin(TRUE_TOKENS), F.lit(True))
                        .when(column(c).isin(FALSE_TOKENS), F.lit(False)).alias(c))
        else:
            out.append(column(c))
    return cleaned.select(out)


# numbers as pandas reads them: no type suffix such as 5D or 7f
_INTEGER = r"^\s*[+-]?\d+\s*$"
_NUMBER = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"


def _infer_types(df: DataFrame) -> dict[str, str]:
    aggs = []
    for i, c in enumerate(df.columns):
        x = column(c)
        aggs += [F.count(x).alias(f"n{i}"),
                 F.count(F.when(x.rlike(_INTEGER), x.try_cast("bigint"))).alias(f"l{i}"),
                 F.count(F.when(x.rlike(_NUMBER), x.try_cast("double"))).alias(f"d{i}"),
                 F.count(F.when(x.isin(TRUE_TOKENS + FALSE_TOKENS), 1)).alias(f"b{i}")]
    row = df.agg(*aggs).first()
    types = {}
    for i, c in enumerate(df.columns):
        n = row[f"n{i}"]
        if n == 0:
            types[c] = "double"          # an all-missing column reads as float64 in pandas
        elif row[f"l{i}"] == n:
            types[c] = "long"
        elif row[f"d{i}"] == n:
            types[c] = "double"
        elif row[f"b{i}"] == n:
            types[c] = "boolean"
        else:
            types[c] = "string"
    return types


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet as stored.  NaN in float columns is left in place so filters on
    the raw columns still reach the scan (row-group skipping); every operator
    reads missingness through ``functions.columns.present`` / ``dbl``, which
    treat NaN as missing."""
    df = spark.read.parquet(path)
    _check_names(df.columns)
    return df


def preview(df: DataFrame, n: int = 20) -> DataFrame:
    """First ``n`` rows for display (A2/A3).  The limit is the feature here."""
    return df.limit(n)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV sink (A4): header, no index, missing (NULL or NaN) written as an
    empty field, and values in pandas' text forms: floats as Python prints
    them (10000000.0, 1e-05), booleans True/False, timestamps
    'yyyy-MM-dd HH:mm:ss'."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.when(c.isNull() | F.isnan(c), F.lit(None))
                        .otherwise(python_float_text(f.name)).alias(f.name))
        elif isinstance(f.dataType, T.BooleanType):
            out.append(F.when(c, F.lit("True")).when(~c, F.lit("False")).alias(f.name))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            out.append(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(f.name))
        else:
            out.append(c)
    (df.select(out).write.mode(mode).option("header", True).option("nullValue", "")
       .option("escape", '"').option("emptyValue", "\"\"")
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
