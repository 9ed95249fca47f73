"""FARM_FINGERPRINT: the public FarmHash Fingerprint64, for hashes that other engines computed with it."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this module

# Fixed values of the public algorithm.
K0, K1, K2 = 0xC3A5C85C97CB3127, 0xB492B66FBE98F273, 0x9AE16A3B2F90404F
FULL = (1 << 64) - 1


def farm_fingerprint64(data: bytes) -> int:
    """Unsigned Fingerprint64 of ``data``."""
    n = len(data)

    def word(i: int, size: int = 8) -> int:
        return int.from_bytes(data[i : i + size], "little")

    def turn(x: int, r: int) -> int:
        x &= FULL
        return (x >> r | x << 64 - r) & FULL

    def shift(x: int) -> int:
        x &= FULL
        return x ^ x >> 47

    def fold(u: int, v: int, mul: int) -> int:
        a = shift((u ^ v) * mul)
        return shift((v ^ a) * mul) * mul & FULL

    def weak(i: int, a: int, b: int) -> tuple[int, int]:
        w, x, y, z = (word(i + 8 * k) for k in range(4))
        a += w
        b = turn(b + a + z, 21)
        c = a
        a += x + y
        return (a + z) & FULL, (b + turn(a, 44) + c) & FULL

    if n <= 16:
        if n >= 8:
            mul = K2 + 2 * n
            a, b = (word(0) + K2) & FULL, word(n - 8)
            return fold((turn(b, 37) * mul + a) & FULL, ((turn(a, 25) + b) * mul) & FULL, mul)
        if n >= 4:
            return fold((n + (word(0, 4) << 3)) & FULL, word(n - 4, 4), K2 + 2 * n)
        if n:
            y, z = data[0] + (data[n >> 1] << 8), n + (data[n - 1] << 2)
            return shift((y * K2 ^ z * K0) & FULL) * K2 & FULL
        return K2
    if n <= 64:
        mul = K2 + 2 * n
        a = word(0) * (K1 if n <= 32 else K2) & FULL
        b, c, d = word(8), word(n - 8) * mul & FULL, word(n - 16) * K2 & FULL
        y, z = (turn(a + b, 43) + turn(c, 30) + d) & FULL, (a + turn(b + K2, 18) + c) & FULL
        if n <= 32:
            return fold(y, z, mul)
        z = fold(y, z, mul)
        e, f = word(16) * mul & FULL, word(24)
        g, h = (y + word(n - 32)) * mul & FULL, (z + word(n - 24)) * mul & FULL
        return fold((turn(e + f, 43) + turn(g, 30) + h) & FULL, (e + turn(f + a, 18) + g) & FULL, mul)
    x, y = 81, (81 * K1 + 113) & FULL
    z = shift(y * K2 + 113) * K2 & FULL
    v, w = (0, 0), (0, 0)
    x = (x * K2 + word(0)) & FULL
    mul, at, last = K1, 0, (n - 1) // 64 * 64

    def mix(at: int, x: int, y: int, z: int, v: tuple, w: tuple, mul: int, times: int):
        x = turn(x + y + v[0] + word(at + 8), 37) * mul & FULL
        y = turn(y + v[1] + word(at + 48), 42) * mul & FULL
        x ^= w[1] * times & FULL
        y = (y + v[0] * times + word(at + 40)) & FULL
        z = turn(z + w[0], 33) * mul & FULL
        v = weak(at, v[1] * mul & FULL, (x + w[0]) & FULL)
        w = weak(at + 32, (z + w[1]) & FULL, (y + word(at + 16)) & FULL)
        return z, y, x, v, w  # x and z change places

    while at != last:
        x, y, z, v, w = mix(at, x, y, z, v, w, mul, 1)
        at += 64
    mul = (K1 + ((z & 0xFF) << 1)) & FULL
    tail = (n - 1) & 63
    w = ((w[0] + tail) & FULL, w[1])
    v = ((v[0] + w[0]) & FULL, v[1])
    w = ((w[0] + v[0]) & FULL, w[1])
    x, y, z, v, w = mix(last + tail - 63, x, y, z, v, w, mul, 9)
    return fold((fold(v[0], w[0], mul) + shift(y) * K0 + z) & FULL, (fold(v[1], w[1], mul) + x) & FULL, mul)


def farm_fingerprint(text: Column) -> Column:
    """Signed Fingerprint64 of a string column; null stays null."""

    @F.arrow_udf("long")
    def fingerprint(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            h = None if not t.is_valid else farm_fingerprint64(t.as_py().encode())
            out.append(h if h is None or h < 1 << 63 else h - (1 << 64))
        return pa.array(out, pa.int64())

    return fingerprint(text.cast("string"))
