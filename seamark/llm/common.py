"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..tables import BROADCAST_BYTES, bytes_of, durable, if_small, removed, shared_folder, table, tidy

__all__ = ["BROADCAST_BYTES", "bytes_of", "durable", "held_out", "if_small", "removed", "shared_folder", "table", "tidy"]


def held_out(column: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id never is held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder, F.lit(False))
