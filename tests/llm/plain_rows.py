"""Rows of Spark and of DuckDB in one plain form."""

import datetime
import decimal


def plain(v):
    if isinstance(v, (float, decimal.Decimal)) or isinstance(v, int) and not isinstance(v, bool):
        return f"{float(v):.6f}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def table(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)
