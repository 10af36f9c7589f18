"""Arithmetic of the field of 256 elements (polynomial 0x11B, generator 3), as tables."""

from __future__ import annotations

import numpy as np

POLYNOMIAL, GENERATOR = 0x11B, 3


def _powers() -> list[int]:
    out, x = [], 1
    for _ in range(255):
        out.append(x)
        x ^= x << 1  # times 3
        if x & 0x100:
            x ^= POLYNOMIAL
    return out


EXP = np.array(_powers() * 2, np.uint8)
LOG = np.zeros(256, np.int64)
LOG[EXP[:255]] = np.arange(255)
MUL = np.zeros((256, 256), np.uint8)
MUL[1:, 1:] = EXP[LOG[1:, None] + LOG[None, 1:]]


def inverse(a: int) -> int:
    return int(EXP[-LOG[a] % 255])


def product(p: list[int], q: list[int]) -> list[int]:
    """Product of two polynomials, low degree first."""
    out = [0] * (len(p) + len(q) - 1)
    for i, a in enumerate(p):
        for j, b in enumerate(q):
            out[i + j] ^= int(MUL[a, b])
    return out


def value(p: list[int], x: int) -> int:
    total = 0
    for a in reversed(p):
        total = int(MUL[total, x]) ^ a
    return total
