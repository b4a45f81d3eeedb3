"""Reading study files and landing them for repeated use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwise.functions.numeric import nan_to_null


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, missing: str | list[str] = "NA", by_position: bool = False
) -> DataFrame:
    """Read (gzip) CSV with a header into the declared types.

    Columns are found by their header, whatever their order in the file; with ``by_position`` the header's names do not
    count, but the number of columns must agree. Empty text, the markers in ``missing`` and NaN become null. Whole
    numbers may be written like ``1.0``. A value that its type cannot hold, and a malformed row, is an error.
    """
    markers = [missing] if isinstance(missing, str) else list(missing)
    raw = spark.read.option("header", True).option("emptyValue", "").option("mode", "FAILFAST").csv(path)
    if by_position:
        if len(raw.columns) != len(schema.fields):
            raise ValueError(f"{len(raw.columns)} columns in the file, {len(schema.fields)} declared")
        raw = raw.toDF(*schema.names)
    return raw.select(*[_clean(F.col(f"`{f.name}`"), f, markers).alias(f.name) for f in schema.fields])


def _clean(text: Column, field: T.StructField, markers: list[str]) -> Column:
    known = F.when(~text.isin("", *markers), text)
    if isinstance(field.dataType, T.StringType):
        return known
    if isinstance(field.dataType, T.IntegralType):
        whole = known.rlike(r"^\s*[+-]?\d+\s*$")
        decimal = known.cast("double")
        checked = F.when(decimal == F.floor(decimal), decimal.cast(field.dataType)).otherwise(
            F.when(known.isNotNull() & ~F.isnan(decimal), F.raise_error(F.concat(F.lit(f"no whole number in {field.name}: "), known)))
        )
        return F.when(whole, known.cast(field.dataType)).otherwise(checked)
    value = known.cast(field.dataType)
    return nan_to_null(value) if isinstance(field.dataType, (T.DoubleType, T.FloatType)) else value


def write_csv(df: DataFrame, path: str) -> None:
    """Gzip CSV with a header, one file per task."""
    df.write.option("header", True).option("compression", "gzip").option("nullValue", "NA").csv(path)


def land(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """Write as Parquet and read back.

    A gzip file is one task however large it is; the landed copy splits, prunes columns and skips row groups.
    """
    writer = df.write.mode("error")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def first_rows(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def last_rows(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """The last ``n`` rows in the given order, shown in descending order."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)
