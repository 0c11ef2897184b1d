"""Loaders with explicit schemas, NaN as null, and writers that never overwrite what they read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType, StructField, StructType


def nan_to_null(df: DataFrame) -> DataFrame:
    """Every NaN of a floating column becomes null, so that aggregates skip it."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, DoubleType | FloatType)]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def read_table(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table, pruned to the named columns at the scan."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return nan_to_null(df.select(*columns) if columns else df)


def table_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """An optional input: None where the path doesn't exist, through Spark's own file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else None


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    """CSV with a header; the separator is a semicolon where the header has more of them than commas."""
    head = spark.read.text(path).first()
    line = head[0] if head else ""
    sep = ";" if line.count(";") > line.count(",") else ","
    return nan_to_null(spark.read.schema(schema).option("header", True).option("sep", sep).csv(path))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames; columns that one lacks are null there."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """CSV with a header; with bom each file begins with the UTF-8 mark spreadsheets look for."""
    if bom:
        first = df.columns[0]
        df = df.withColumnRenamed(first, "﻿" + first)
    df.write.option("header", True).option("quoteMode", "MINIMAL").csv(path)


def write_version(df: DataFrame, path: str, version: int) -> str:
    """Parquet under a new version folder, so that a table can be rebuilt from itself."""
    target = f"{path}/v{version:06d}"
    df.write.mode("errorifexists").parquet(target)
    return target


def scaled(df: DataFrame, columns: list[str], scale: float) -> DataFrame:
    """Whole numbers as stored, decoded to shares."""
    return df.withColumns({c: F.col(c) / scale for c in columns})


def schema_of(df: DataFrame) -> DataFrame:
    """A row for each column: its name, type and place."""
    return df.sparkSession.createDataFrame([(n, t, i) for i, (n, t) in enumerate(df.dtypes)], "column_name string, column_type string, place int")


def read_csv_files(spark: SparkSession, paths: list[str], schema: StructType) -> DataFrame:
    """CSV files whose headers and separators may differ: each file's columns by name and typed by schema, absent ones null."""
    parts = []
    for path in paths:
        line = (spark.read.text(path).first() or [""])[0].lstrip("\ufeff")
        sep = ";" if line.count(";") > line.count(",") else ","
        names = [n.strip().strip('"') for n in line.split(sep)]
        own = StructType([schema[n] if n in schema.names else StructField(n, StringType()) for n in names])
        parts.append(read_csv(spark, path, own).select(*[n for n in names if n in schema.names]))
    found = union_all(parts)
    return found.select(*[F.col(f.name) if f.name in found.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def write_once(df: DataFrame, path: str) -> bool:
    """Parquet at path, unless a finished table is there already: a lot that was written before isn't computed again."""
    p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(p):
        return False
    df.write.mode("overwrite").parquet(path)
    return True
