"""Perceptual hashes of decoded grey images, as Arrow functions over pixel arrays (decoding happens elsewhere).

Two different hashes of 64 bits share the name pHash in the wild; they can't be compared, so they
have names of their own here. A difference hash is a third.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def _dct(n: int) -> np.ndarray:
    k = np.arange(n)
    m = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n)) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


def _hex(bits: np.ndarray) -> str:
    return f"{int(''.join('1' if b else '0' for b in bits.ravel()), 2):016x}"


def low_block(grey: np.ndarray) -> np.ndarray:
    """The 8x8 block of lowest frequencies of a square image."""
    m = _dct(len(grey))
    return (m @ grey @ m.T)[:8, :8]


def phash_rows(grey: np.ndarray) -> str:
    """Bits over the median of rows 1..7 of the low block, the whole block included."""
    low = low_block(grey)
    return _hex(low > np.median(low[1:]))


def phash_without_first(grey: np.ndarray) -> str:
    """Bits over the median of the low block without its first value."""
    low = low_block(grey)
    return _hex(low > np.median(low.ravel()[1:]))


def dhash(grey: np.ndarray) -> str:
    """Of an image of 8 rows and 9 columns: whether each pixel is darker than its right neighbour."""
    return _hex(grey[:, 1:] > grey[:, :-1])


def column(hash_of, rows: int, columns: int):
    """``hash_of`` over a column of flat pixel arrays; null for other sizes and null pixels."""

    @F.pandas_udf("string")
    def run(pixels: pd.Series) -> pd.Series:
        return pixels.map(lambda p: hash_of(np.asarray(p, float).reshape(rows, columns)) if p is not None and len(p) == rows * columns and not np.isnan(np.asarray(p, float)).any() else None)

    return run
