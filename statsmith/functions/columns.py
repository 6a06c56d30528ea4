"""Column-expression helpers shared by all operators (JVM-side, codegen-able)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Prefix for helper columns the library adds and removes again.
TMP = "__sm_"


def column(name: str) -> Column:
    """The column of that literal name: dots, blanks and backticks are part of
    it.  Every operator reads user columns through this helper."""
    return F.col("`" + name.replace("`", "``") + "`")


def safe_div(num: Column, den: Column) -> Column:
    """``num / den`` that yields NULL instead of raising on a zero divisor."""
    return F.try_divide(num, den)


def dbl(c: str | Column) -> Column:
    """The column as double with NaN read as missing (NULL)."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)


def _floating(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))


def present(df: DataFrame, c: str) -> Column:
    """True where ``c`` holds a value: not NULL and, for float columns, not NaN.
    Sources keep NaN as stored (so filters on raw columns still push down to
    parquet); every operator reads missingness through this test."""
    col = F.col(f"`{c}`")
    return col.isNotNull() & ~F.isnan(col) if _floating(df, c) else col.isNotNull()


def value(df: DataFrame, c: str) -> Column:
    """``c`` with NaN turned into NULL for float columns (any type)."""
    col = F.col(f"`{c}`")
    return F.when(F.isnan(col), F.lit(None)).otherwise(col) if _floating(df, c) else col


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def numeric_columns(df: DataFrame, exclude: str | list[str] | None = None) -> list[str]:
    """Numeric columns in schema order; booleans are not numeric."""
    ex = {exclude} if isinstance(exclude, str) else set(exclude or [])
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in ex]


def string_columns(df: DataFrame, exclude: str | list[str] | None = None) -> list[str]:
    ex = {exclude} if isinstance(exclude, str) else set(exclude or [])
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in ex]


def require_columns(df: DataFrame, cols) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"unknown column(s): {missing}")


def require_numeric(df: DataFrame, cols) -> None:
    require_columns(df, cols)
    types = {f.name: f.dataType for f in df.schema.fields}
    bad = [c for c in cols if not is_numeric(types[c])]
    if bad:
        raise ValueError(f"column(s) must be numeric: {bad}")


def python_float_text(col: str) -> Column:
    """Python's ``str(float)``: plain decimals for 1e-4 <= |x| < 1e16 (at
    least one decimal), otherwise ``<mantissa>e<sign><2+ digit exponent>``,
    e.g. 10000000.0, 0.0001, 1e+16, 1.5e-05, inf, nan, -0.0.  Built from
    Spark's own shortest digits (its ``1.5E-5`` form), not a fixed scale."""
    c = F.col(f"`{col}`").cast("double")
    a = F.abs(c)
    sci = c.cast("string")                                    # e.g. 1.5E-5, 1.0E16, 123.25, -0.0
    pat = r"^(-?[0-9.]+)(E(-?[0-9]+))?$"
    mant = F.regexp_replace(F.regexp_extract(sci, pat, 1), r"\.0$", "")
    expo = F.regexp_extract(sci, pat, 3)
    e = F.when(expo == "", F.lit(0)).otherwise(expo.cast("int"))
    exp_txt = F.concat(mant, F.lit("e"), F.when(e < 0, F.lit("-")).otherwise(F.lit("+")),
                       F.when(F.abs(e) < 10, F.concat(F.lit("0"), F.abs(e).cast("string")))
                        .otherwise(F.abs(e).cast("string")))
    plain = F.regexp_replace(F.expr(f"try_cast(abs(CAST(`{col}` AS DOUBLE)) AS DECIMAL(38, 20))")
                             .cast("string"), r"0+$", "")
    plain = F.concat(F.when(c < 0, F.lit("-")).otherwise(F.lit("")), F.regexp_replace(plain, r"\.$", ".0"))
    return (F.when(F.isnan(c), F.lit("nan"))
             .when(c == float("inf"), F.lit("inf")).when(c == float("-inf"), F.lit("-inf"))
             .when(a == 0, sci)
             .when((a >= 1e-4) & (a < 1e16), plain)
             .otherwise(exp_txt))


# Wichura (1988), Algorithm AS 241 (PPND16), coefficients of the
# rational approximations to the inverse normal CDF, highest power first.
AS241_CENTRAL_NUM = [2509.0809287301226727, 33430.575583588128105, 67265.770927008700853,
                     45921.953931549871457, 13731.693765509461125, 1971.5909503065514427,
                     133.14166789178437745, 3.387132872796366608]
AS241_CENTRAL_DEN = [5226.495278852854561, 28729.085735721942674, 39307.89580009271061,
                     21213.794301586595867, 5394.1960214247511077, 687.1870074920579083,
                     42.313330701600911252, 1.0]
AS241_MID_NUM = [7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177,
                 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055,
                 4.6303378461565452959, 1.42343711074968357734]
AS241_MID_DEN = [1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966,
                 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494,
                 2.05319162663775882187, 1.0]
AS241_TAIL_NUM = [2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386,
                  0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358,
                  5.4637849111641143699, 6.6579046435011037772]
AS241_TAIL_DEN = [2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5,
                  7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531,
                  0.59983220655588793769, 1.0]


def _horner(coeffs, x: Column) -> Column:
    acc = F.lit(coeffs[0])
    for c in coeffs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def ndtri(p: Column) -> Column:
    """Inverse standard-normal CDF as a Column expression (AS 241)."""
    q = p - F.lit(0.5)
    r_c = F.lit(0.180625) - q * q
    central = q * _horner(AS241_CENTRAL_NUM, r_c) / _horner(AS241_CENTRAL_DEN, r_c)
    r = F.sqrt(-F.log(F.when(q <= 0, p).otherwise(F.lit(1.0) - p)))
    rm = r - F.lit(1.6)
    rt = r - F.lit(5.0)
    mag = F.when(r <= 5.0, _horner(AS241_MID_NUM, rm) / _horner(AS241_MID_DEN, rm)) \
        .otherwise(_horner(AS241_TAIL_NUM, rt) / _horner(AS241_TAIL_DEN, rt))
    tail = F.when(q < 0, -mag).otherwise(mag)
    return F.when(F.abs(q) <= 0.425, central).otherwise(tail)
