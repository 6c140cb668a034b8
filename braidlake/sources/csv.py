"""CSV source with the engine's rules for bad values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBERS = ("int", "bigint", "double")


def read_csv(spark: SparkSession, path: str, columns: list[dict], header: bool = False, delimiter: str = ",") -> DataFrame:
    """Rows of a CSV file (also .gz): quotes double inside quotes, fields may hold line ends; empty or bad numbers and other bad values become null.

    Lines with too few fields read as null at their end. Multi-line fields bind each file to one task, so large loads
    should come as many files.
    """
    text = ", ".join(f"`{c['name']}` string" for c in columns)
    raw = spark.read.csv(path, schema=text, header=header, sep=delimiter, quote='"', escape='"', multiLine=True, mode="PERMISSIVE", enforceSchema=True)
    return raw.select(*[F.expr(f"try_cast(trim(`{c['name']}`) as {c['type']})").alias(c["name"]) if c["type"] != "string" else F.col(f"`{c['name']}`") for c in columns])


def write_csv(df: DataFrame, path: str, header: bool = False) -> None:
    df.write.csv(path, header=header, quote='"', escape='"')
