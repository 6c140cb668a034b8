"""SQL type names and their Spark types."""

from __future__ import annotations

from pyspark.sql import types as T

from braidlake.errors import UNSUPPORTED, SqlError

_NAMES = {
    "boolean": "bool boolean",
    "int": "smallint int2 int int4 integer signed",
    "bigint": "bigint int8 bigserial serial8",
    "double": "real float4 double float8 float decimal numeric",
    "string": "text varchar char string",
    "binary": "bytea blob binary varbinary bytes",
    "date": "date",
    "timestamp_ntz": "timestamp datetime",
}
_SPARK = {name: spark for spark, names in _NAMES.items() for name in names.split()}


def spark_type(name: str) -> str:
    """Spark's name of a SQL type; decimals are doubles, lengths and precisions are ignored."""
    key = name.strip().lower().split("(")[0].replace(" precision", "").strip()
    if key not in _SPARK:
        raise SqlError(UNSUPPORTED, f"type {name}")
    return _SPARK[key]


def struct(columns: list[dict]) -> T.StructType:
    return T.StructType([T.StructField(c["name"], T.StructType.fromDDL(f"x {c['type']}")[0].dataType, True) for c in columns])
