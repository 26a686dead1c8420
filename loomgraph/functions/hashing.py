"""Integer mixers as column expressions, wrapped to 32 or 64 bits by hand (the engine's own sums raise on overflow)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

M32 = 0xFFFFFFFF
M31 = 0x7FFFFFFF

#: The steps of the 32-bit mixer (how the constant joins, constant, how the shifted value joins, shift;
#: a positive shift is to the left).
STEPS_32 = (("+", 0x7ED55D16, "+", 12), ("^", 0xC761C23C, "^", -19), ("+", 0x165667B1, "+", 5), ("+", 0xD3A2646C, "^", 9), ("+", 0xFD7046C5, "+", 3), ("^", 0xB55A4F09, "^", -16))
#: The same for 64 bits.
STEPS_64 = (
    ("+", 0x7ED55D166BEF7A1D, "+", 12), ("^", 0xC761C23C510FA2DD, "^", -9), ("+", 0x165667B183A9C0E1, "+", 59),
    ("+", 0xD3A2646CAB3487E3, "^", 49), ("+", 0xFD7046C5EF9AB54C, "+", 3), ("^", 0xB55A4F090DD4A67B, "^", -32),
)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def add64(a: Column, b: Column) -> Column:
    """Sum modulo 2^64, from two halves."""
    low = a.bitwiseAND(F.lit(M32)) + b.bitwiseAND(F.lit(M32))
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftright(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(M32)))


def _mix(a: Column, steps: tuple, bits: int) -> Column:
    """All steps as one fold over the step table, so the expression stays linear in their number."""
    mask = (lambda x: x.bitwiseAND(F.lit(M32))) if bits == 32 else (lambda x: x)
    plus = (lambda x, y: mask(x + y)) if bits == 32 else add64
    table = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(_signed(c)).cast("long").alias("c"), F.lit(q).alias("q"), F.lit(s).alias("s")) for p, c, q, s in steps))

    def shifted(x: Column, s: Column) -> Column:
        by = F.lit(0).cast("long")
        for k in sorted({t[3] for t in steps}):
            by = F.when(s == k, mask(F.shiftleft(x, k)) if k > 0 else F.shiftrightunsigned(x, -k)).otherwise(by)
        return by

    def step(x: Column, t: Column) -> Column:
        first = F.when(t["p"] == "+", plus(x, t["c"])).otherwise(x.bitwiseXOR(t["c"]))
        other = shifted(x, t["s"])
        return F.when(t["q"] == "+", plus(first, other)).otherwise(mask(first.bitwiseXOR(other)))

    return F.aggregate(table, mask(a.cast("long")), step)


def hash32(a: Column) -> Column:
    """Unsigned 32-bit hash of the low 32 bits."""
    return _mix(a, STEPS_32, 32)


def hash31(a: Column) -> Column:
    return hash32(a).bitwiseAND(F.lit(M31))


def hash64(a: Column) -> Column:
    return _mix(a, STEPS_64, 64)


def unit(a: Column) -> Column:
    """A double in [0, 1] by hash."""
    return hash31(a) / F.lit(float(M31))


def linear32(a: Column) -> Column:
    """The linear generator 1103515245 a + 12345 modulo 2^32, then modulo 2^32 - 1."""
    a = a.bitwiseAND(F.lit(M32))
    high, low = F.shiftright(a, 16), a.bitwiseAND(F.lit(0xFFFF))
    product = F.shiftleft((high * 1103515245).bitwiseAND(F.lit(0xFFFF)), 16) + low * 1103515245
    return ((product + 12345).bitwiseAND(F.lit(M32))) % F.lit(M32)


def add_weights(edges, modulus: int | None = 20):
    """Edges with a deterministic weight from their position: hash modulo 20, or the whole 31-bit hash."""
    h = hash31(F.col("pos"))
    return edges.withColumn("weight", h % modulus if modulus else h)
