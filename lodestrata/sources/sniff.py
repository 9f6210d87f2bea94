"""Resolving the roles of columns by their names: one projection, decided on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _text(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def resolve(df: DataFrame, roles: dict[str, tuple[str, ...]], keep: tuple[str, ...] = (), longest: bool = False) -> DataFrame:
    """``keep`` and one column for each role that some column's name fits.

    A text column has the first role of ``roles`` one of whose parts its
    lower-cased name contains. Of several columns of a role the last
    non-empty value counts, or the longest one. A role without a column is
    null.
    """
    found: dict[str, list[str]] = {role: [] for role in roles}
    for name in _text(df):
        for role, parts in roles.items():
            if any(p in name.lower() for p in parts):
                found[role].append(name)
                break

    def pick(names: list[str]) -> Column:
        if not names:
            return F.lit(None).cast("string")
        values = [F.nullif(F.col(f"`{n}`"), F.lit("")) for n in reversed(names)]
        if not longest:
            return F.coalesce(*values)
        best = F.greatest(*[F.struct(F.coalesce(F.length(v), F.lit(-1)).alias("n"), v.alias("v")) for v in values]) if len(values) > 1 else F.struct(F.lit(0).alias("n"), values[0].alias("v"))
        return best["v"]

    return df.select(*[F.col(f"`{k}`") for k in keep], *[pick(names).alias(role) for role, names in found.items()])


def long_text_columns(df: DataFrame, least: int = 50, take: int = 2) -> Column:
    """Array of the first ``take`` text values of more than ``least`` characters in a row."""
    values = F.array(*[F.col(f"`{n}`") for n in _text(df)]) if _text(df) else F.array().cast("array<string>")
    return F.slice(F.filter(values, lambda v: F.length(v) > least), 1, take)
