"""Readers and writers of the text formats that the command line takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_lines(spark: SparkSession, path: str, keep_blank: bool = False, encoding: str = "UTF-8") -> DataFrame:
    """(value) for each line of text files."""
    if encoding.upper().replace("-", "") == "UTF8":
        df = spark.read.text(path)
    else:
        df = spark.read.option("encoding", encoding).option("sep", "\1").option("quote", "").schema("value string").csv(path)
    return df if keep_blank else df.where(F.trim("value") != "")


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(value) for each file."""
    return spark.read.text(path, wholetext=True)


def read_pairs(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """(text1, text2) of lines cut at the first delimiter; lines without one are left out."""
    parts = F.split("value", "\\Q" + delimiter + "\\E", 2)
    return read_lines(spark, path).where(F.contains("value", F.lit(delimiter))).select(F.trim(parts[0]).alias("text1"), F.trim(parts[1]).alias("text2"))


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", schema: str | None = None) -> DataFrame:
    """CSV with a header; all columns strings unless a schema is given."""
    r = spark.read.option("header", True).option("sep", delimiter).option("multiLine", True).option("escape", '"')
    return (r.schema(schema) if schema else r).csv(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = True) -> DataFrame:
    """JSON objects, arrays of objects, or (multi_line=False) one object a line."""
    r = spark.read.option("multiLine", multi_line)
    return (r.schema(schema) if schema else r).json(path)


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """text (one string column), csv, json, orc or parquet."""
    w = df.write.mode(mode)
    if fmt == "text":
        w.text(path)
    elif fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    elif fmt in ("json", "orc", "parquet"):
        getattr(w, fmt)(path)
    else:
        raise ValueError(f"unknown format: {fmt}")
