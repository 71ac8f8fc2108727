"""Columns over a bit mask of failing checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from readloom.operators.checker import FLAGS


def has(mask: Column, name: str) -> Column:
    return mask.bitwiseAND(F.lit(1 << FLAGS.index(name))) != 0


def names(mask: Column) -> Column:
    """The names of the flags that are set, in order, joined by commas."""
    return F.array_join(F.array_compact(F.array(*[F.when(has(mask, n), F.lit(n)) for n in FLAGS])), ",")


def count_failing(mask: Column, reads_before: Column) -> Column:
    """How many checks fail; records before the failing one count as one more."""
    return F.bit_count(mask) + (reads_before > 0).cast("int")


def totals(mask: Column) -> list[Column]:
    """An aggregate for each flag: rows that have it."""
    return [F.coalesce(F.count_if(has(mask, n)), F.lit(0)).alias(n) for n in FLAGS]


def unpivoted(row_of_totals, keys: list[str]):
    """(keys, flag, position, total) from columns named after the flags."""
    pairs = ", ".join(f"'{n}', {i}, {n}" for i, n in enumerate(FLAGS))
    return row_of_totals.select(*keys, F.expr(f"stack({len(FLAGS)}, {pairs}) as (flag, position, total)"))
