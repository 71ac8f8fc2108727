"""Virtual positions: a block's offset in the file and an offset within the block, inflated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RATIO = 3.0  # inflated bytes for a compressed one, as an estimate


def pack(block: Column, offset: Column) -> Column:
    return F.shiftleft(block.cast("bigint"), 16).bitwiseOR(offset.cast("bigint"))


def block_of(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, 16)


def offset_of(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(0xFFFF)).cast("int")


def distance(block: Column, offset: Column, from_block: Column, from_offset: Column, ratio: float = RATIO) -> Column:
    """Compressed bytes from one position to a later one, as an estimate and not below 0; the offsets' share is
    truncated towards zero."""
    return F.greatest(F.lit(0).cast("bigint"), block - from_block + ((offset - from_offset) / F.lit(ratio)).cast("bigint"))


def shown(block: Column, offset: Column) -> Column:
    return F.concat_ws(":", block.cast("string"), offset.cast("string"))


def plain_distance(a: tuple[int, int], b: tuple[int, int], ratio: float = RATIO) -> int:
    """``distance`` from ``a`` to ``b`` for values of the driver."""
    return max(0, b[0] - a[0] + int((b[1] - a[1]) / ratio))
