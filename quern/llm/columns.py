"""Columns by exact name, whatever characters the name holds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def own(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def packed(names: list[str]) -> Column:
    """Columns carried along unseen, so that their names clash with none of an operator's."""
    return F.struct(*[own(c).alias(c) for c in names]) if names else F.struct(F.lit(0).alias("none"))


def unpacked(struct: str, names: list[str]) -> list[Column]:
    return [F.col(struct).getField(c).alias(c) for c in names]
