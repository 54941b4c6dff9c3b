"""Read-only SQL of users, a look at the catalog, and encrypted values."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that change something, and row limits.
FORBIDDEN = ("insert", "update", "delete", "drop", "alter", "create", "truncate", "grant", "revoke")
DEFAULT_ROWS, MOST_ROWS = 100, 500


def guarded(sql: str, rows: int = DEFAULT_ROWS) -> str:
    """sql, if it only reads, with a limit if it has none. What is in quotes isn't looked at."""
    bare = re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S).strip().rstrip(";").lower()
    if not re.match(r"(select|with)\b", bare):
        raise ValueError("only SELECT and WITH are allowed")
    if ";" in bare:
        raise ValueError("only one statement is allowed")
    found = [w for w in FORBIDDEN if re.search(rf"\b{w}\b", bare)]
    if found:
        raise ValueError(f"not allowed: {', '.join(found)}")
    text = sql.strip().rstrip(";")
    return text if re.search(r"\blimit\b", bare) else f"{text} LIMIT {min(rows, MOST_ROWS)}"


def query(spark: SparkSession, sql: str, rows: int = DEFAULT_ROWS) -> DataFrame:
    return spark.sql(guarded(sql, rows))


def describe(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, column_name, data_type, nullable."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(name, f.name, f.dataType.simpleString(), f.nullable) for name, df in tables.items() for f in df.schema]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, nullable boolean")


def encrypt(value: Column, key: Column) -> Column:
    """A random nonce and the value under AES-GCM."""
    return F.aes_encrypt(value, key, F.lit("GCM"))


def decrypt(value: Column, key: Column) -> Column:
    return F.aes_decrypt(value, key, F.lit("GCM")).cast("string")


def key_hash(key: Column) -> Column:
    return F.sha2(key, 256)
