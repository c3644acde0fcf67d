"""Arithmetic in GF(2^8) with the polynomial x^8 + x^4 + x^3 + x + 1.

Column form for expressions, and a numpy product table for byte-vector work inside Arrow UDFs.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def _logs() -> tuple[list[int], list[int]]:
    """Powers of the generator 3, and their logarithms (0 has none; its slot is unused)."""
    power, log = [1], [0] * 256
    for i in range(1, 255):
        last = power[-1]
        doubled = (last << 1) ^ (0x11B if last & 0x80 else 0)
        power.append(doubled ^ last)
        log[power[i]] = i
    return power, log


def _power(i: Column) -> Column:
    return F.get(F.lit(_logs()[0]), i % 255)


def _log(a: Column) -> Column:
    return F.get(F.lit(_logs()[1]), a)


def gf_mul(a: Column, b: Column) -> Column:
    """Product of two integer columns in 0..255."""
    return F.when((a == 0) | (b == 0), F.lit(0)).otherwise(_power(_log(a) + _log(b)))


def gf_inverse(a: Column) -> Column:
    """Multiplicative inverse; 0 maps to 0."""
    return F.when(a == 0, F.lit(0)).otherwise(_power(255 - _log(a)))


def gf_div(a: Column, b: Column) -> Column:
    """Quotient, NULL for a zero divisor."""
    return F.when(b != 0, gf_mul(a, gf_inverse(b)))


@cache
def product_table() -> np.ndarray:
    """256 x 256 products, built from the doubling rule."""
    left = np.arange(256, dtype=np.uint16)[:, None]
    right = np.arange(256, dtype=np.uint16)[None, :]
    x = np.broadcast_to(left, (256, 256)).copy()
    product = np.zeros((256, 256), dtype=np.uint16)
    for bit in range(8):
        product ^= np.where((right >> bit) & 1, x, 0).astype(np.uint16)
        x = np.where(x & 0x80, (x << 1) ^ 0x11B, x << 1).astype(np.uint16)
    return product.astype(np.uint8)


@cache
def inverse_table() -> np.ndarray:
    """Inverses of 0..255, with 0 mapped to 0."""
    table = np.zeros(256, dtype=np.uint8)
    rows, cols = np.nonzero(product_table() == 1)
    table[rows] = cols
    return table


def lagrange_at(indexes: list[int], target: int) -> list[int]:
    """Interpolation weights of the given points for the value at ``target``."""
    mul, inv = product_table(), inverse_table()
    weights = []
    for i in indexes:
        w = 1
        for j in indexes:
            if j != i:
                w = int(mul[w, mul[target ^ j, inv[i ^ j]]])
        weights.append(w)
    return weights
