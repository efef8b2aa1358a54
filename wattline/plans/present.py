"""Final projection of registered queries: times rendered as ISO text.

Library operators return typed columns.  Registered queries are compared with a
DuckDB oracle through pandas, where DATE/TIMESTAMP convert differently per
engine, so their outputs render dates as 'yyyy-MM-dd' and timestamps as
'yyyy-MM-dd HH:mm:ss.SSSSSS', and integers as BIGINT.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TS_FMT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
DATE_FMT = "yyyy-MM-dd"

# DuckDB spellings of the same formats.
SQL_TS_FMT = "%Y-%m-%d %H:%M:%S.%f"
SQL_DATE_FMT = "%Y-%m-%d"


def present(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, TS_FMT)
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, DATE_FMT)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.FloatType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("int").cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def sql_ts(expr: str) -> str:
    return f"strftime({expr}, '{SQL_TS_FMT}')"


def sql_date(expr: str) -> str:
    return f"strftime(CAST({expr} AS DATE), '{SQL_DATE_FMT}')"
