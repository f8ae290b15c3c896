"""Rows of Spark and DuckDB in one form, in any order."""

import decimal
import math


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if isinstance(value, float):
        return None if math.isnan(value) else repr(round(value, 9))
    if isinstance(value, decimal.Decimal):
        return str(value)
    return None if value is None else str(value)


def rows(found, columns):
    return sorted((tuple(plain(x) for x in r) for r in found), key=str), sorted(columns)


def of_spark(df):
    columns = sorted(df.columns)
    return rows([tuple(r) for r in df.select(*columns).collect()], columns)


def of_duck(con, sql):
    columns = sorted(con.sql(sql).columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    return rows(con.sql(f"SELECT {quoted} FROM ({sql})").fetchall(), columns)
