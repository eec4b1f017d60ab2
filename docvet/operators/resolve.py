"""A3: resolve logical fields through alias lists against a frame's columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docvet.functions.text import fill_default


class ColumnIndex:
    """A frame's columns by name, and by case-folded name where no column has the exact one.

    Built once per frame; each logical field then ranks its aliases against it.  Of columns that
    fold to one name, the last is taken.
    """

    def __init__(self, columns: Sequence[str]):
        self._folded = {c.lower(): c for c in columns}
        self._named = dict.fromkeys(columns, True)

    def match(self, alias: str) -> str | None:
        return alias if alias in self._named else self._folded.get(alias.lower())

    def first(self, aliases: Sequence[str]) -> str | None:
        ranked = filter(None, map(self.match, aliases))
        return next(ranked, None)


def lookup(
    df: DataFrame, names: Sequence[str], default: str = "Unknown", blank_to_default: bool = True, index: ColumnIndex | None = None
) -> Column:
    """The first alias's column, cleaned by B11; a missing column is the literal default."""
    column = (index or ColumnIndex(df.columns)).first(names)
    return F.lit(default) if column is None else fill_default(F.col(f"`{column}`"), default, blank_to_default)


def resolve(
    df: DataFrame,
    aliases: Mapping[str, Sequence[str]],
    defaults: Mapping[str, str] | None = None,
    blank_to_default: bool = True,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Project every logical field (named by its key) from the first matching alias."""
    index, defaults = ColumnIndex(df.columns), defaults or {}
    fields = [lookup(df, names, defaults.get(field, "Unknown"), blank_to_default, index).alias(field) for field, names in aliases.items()]
    return df.select(*[F.col(f"`{k}`") for k in keep], *fields)
