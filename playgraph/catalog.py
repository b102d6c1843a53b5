"""Reading tables by name; absent optional tables become empty DataFrames with the right schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` (a file or a folder of files) under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_or_empty(spark: SparkSession, sf_dir: str, name: str, schema: T.StructType) -> DataFrame:
    """FLT-11: the table, or an empty DataFrame of ``schema`` when it is absent; missing columns are added as nulls."""
    try:
        df = table(spark, sf_dir, name)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return ensure_columns(df, schema)


def ensure_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """DML-09: add the columns of ``schema`` that ``df`` lacks, as typed nulls; existing columns stay as they are."""
    have = set(df.columns)
    new = {f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in have}
    return df.withColumns(new) if new else df
