"""Bitmaps of slots, built in tasks and sent to all tasks; their size is bounded by the caller."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One chunk of a bitmap is built by one task: 2**CHUNK bits.
CHUNK = 19


def bits_for(slots: int, most: int) -> int:
    """The power of two that gives a bitmap of about ``slots`` slots, CHUNK at least and ``most`` at most."""
    return min(most, max(CHUNK, (max(slots, 1) - 1).bit_length()))


def build(slots: DataFrame, size: int) -> np.ndarray:
    """One bit per value of ``slot``, a bigint from 0 to below ``size``."""

    def chunk(rows: pd.DataFrame) -> pd.DataFrame:
        marks = np.zeros(1 << CHUNK, bool)
        marks[rows["slot"].to_numpy(np.int64) & ((1 << CHUNK) - 1)] = True
        return pd.DataFrame({"chunk": [rows["slot"].iloc[0] >> CHUNK], "marks": [np.packbits(marks, bitorder="little").tobytes()]})

    parts = slots.distinct().groupBy(F.shiftright("slot", CHUNK)).applyInPandas(chunk, "chunk bigint, marks binary")
    out, width = np.zeros(size >> 3, np.uint8), 1 << (CHUNK - 3)
    for row in parts.toLocalIterator():
        out[row["chunk"] * width : (row["chunk"] + 1) * width] = np.frombuffer(row["marks"], np.uint8)
    return out


def marked(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)
