"""Comparing a query with its oracle."""

import datetime
import decimal


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return float(f"{float(value):.9g}")
    if hasattr(value, "asDict"):
        return tuple((k, plain(v)) for k, v in sorted(value.asDict().items()))
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def both(query, sql, spark, directory, connection):
    df = query(spark, directory)
    names = sorted(df.columns)
    left = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    result = connection.execute(sql)
    found = [c[0] for c in result.description]
    at = [found.index(n) for n in sorted(found)]
    right = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
    return names, sorted(found), left, right
