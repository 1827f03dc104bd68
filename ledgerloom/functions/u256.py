"""Unsigned 256-bit integers held as 32 big-endian bytes, whose byte order is their numeric order.

What the work of large queries consists of (sums, additions, products of two longs, comparisons, hex)
is made of built-in expressions on limbs and keeps partial aggregation and code generation. So does decimal text of what
lies below 2^126, by DECIMAL; larger values are turned into base 10^9 by a fold, which no other value goes through. Full-width
products and the SQL surface's functions, whose operands may be integers or bytes, use Arrow-batched functions.
"""

from __future__ import annotations

from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ZERO = bytes(32)
LIMBS, MASK = 8, 0xFFFFFFFF
SUM_LIMBS = 11
TOP = 1 << 256


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def limbs(x: Column | str) -> list[Column]:
    """Eight longs below 2^32, the lowest first. Operands of fewer bytes count as padded on the left."""
    digits = F.lpad(F.hex(_c(x)), 64, "0")  # once for all of them
    return [F.conv(F.substring(digits, 57 - 8 * i, 8), 16, 10).cast("long") for i in range(LIMBS)]


def _carried(parts: list[Column], what: str) -> Column:
    """Limbs that may exceed 32 bits, lowest first, as 32 bytes; raises if they exceed 256 bits."""
    out, carry = [], None
    for p in parts:
        t = p if carry is None else p + carry
        out.append(F.lpad(F.hex(t.bitwiseAND(F.lit(MASK))), 8, "0"))
        carry = F.shiftrightunsigned(t, 32)
    whole = F.unhex(F.concat(*reversed(out)))
    return F.when(carry > 0, F.raise_error(F.lit(f"{what} exceeds 256 bits")).cast("binary")).otherwise(whole)


def from_long(n: Column | str) -> Column:
    """A non-negative long as 32 bytes; negative raises."""
    n = _c(n)
    return F.when(n < 0, F.raise_error(F.lit("a negative number is no unsigned integer")).cast("binary")).otherwise(F.unhex(F.lpad(F.hex(n), 64, "0")))


def u256_sum(x: Column | str) -> Column:
    """Exact sum of an aggregate's rows: nulls are left out, none gives null, overflow raises.

    It is eleven sums of 24-bit limbs, which are exact longs up to 2^39 rows a group; beyond them ANSI arithmetic raises."""
    digits = F.lpad(F.hex(_c(x)), 6 * SUM_LIMBS, "0")
    return carried_sums([F.sum(F.conv(F.substring(digits, 6 * (SUM_LIMBS - i) - 5, 6), 16, 10).cast("long")) for i in range(SUM_LIMBS)])


def carried_sums(parts: list[Column]) -> Column:
    """Sums of 24-bit limbs, lowest first, as 32 bytes; raises if they exceed 256 bits."""
    # a fold names each sum once, where nested carries would repeat it
    def add(a: Column, v: Column) -> Column:
        t = v + a["carry"]
        return F.struct(F.shiftrightunsigned(t, 24).alias("carry"), F.concat(F.lpad(F.hex(t.bitwiseAND(F.lit(0xFFFFFF))), 6, "0"), a["digits"]).alias("digits"))

    def whole(a: Column) -> Column:
        over = (a["carry"] > 0) | ~F.startswith(a["digits"], F.lit("00"))
        return F.when(over, F.raise_error(F.lit("u256_sum exceeds 256 bits")).cast("binary")).otherwise(F.unhex(F.substring(a["digits"], 3, 64)))

    return F.aggregate(F.array(*parts), F.struct(F.lit(0).cast("long").alias("carry"), F.lit("").alias("digits")), add, whole)


def product_limbs(a: Column, b: Column) -> list[Column]:
    """The product of two non-negative longs as six longs below 2^27, which stand 24 bits apart, the lowest first, without carries."""
    m, top = F.lit(0xFFFFFF), [F.shiftrightunsigned(x, 48) for x in (a, b)]
    x, y = ([v.bitwiseAND(m), F.shiftrightunsigned(v, 24).bitwiseAND(m), t] for v, t in zip((a, b), top, strict=True))
    out: list[list[Column]] = [[] for _ in range(6)]
    for i in range(3):
        for j in range(3):
            out[i + j].append((x[i] * y[j]).bitwiseAND(m))
            out[i + j + 1].append(F.shiftrightunsigned(x[i] * y[j], 24))
    return [sum(p[1:], p[0]) for p in out]


def sum_of_products(a: Column | str, b: Column | str) -> Column:
    """u256_sum(mul_longs(a, b)) in long arithmetic alone: six sums of what the products have at each place, exact to 2^36 rows a group."""
    a, b = _c(a).cast("long"), _c(b).cast("long")
    least = F.when((a < 0) | (b < 0), F.raise_error(F.lit("a negative number is no unsigned integer")).cast("long"))
    parts = product_limbs(a, b)
    return carried_sums([F.sum(least.otherwise(parts[0])), *(F.sum(p) for p in parts[1:]), *[F.lit(0).cast("long")] * (SUM_LIMBS - 6)])


def u256_add(a: Column | str, b: Column | str) -> Column:
    return _carried([x + y for x, y in zip(limbs(a), limbs(b), strict=True)], "u256_add")


def mul_longs(a: Column | str, b: Column | str) -> Column:
    """Exact product of two non-negative longs as 32 bytes: 32-bit by 16-bit parts, no product over 48 bits."""
    a, b = _c(a).cast("long"), _c(b).cast("long")
    halves = [a.bitwiseAND(F.lit(MASK)), F.shiftrightunsigned(a, 32)]
    quarters = [F.shiftrightunsigned(b, 16 * j).bitwiseAND(F.lit(0xFFFF)) for j in range(4)]
    places: list[Column | None] = [None] * 8
    for i, h in enumerate(halves):
        for j, q in enumerate(quarters):
            p = 2 * i + j
            places[p] = h * q if places[p] is None else places[p] + h * q
    digits, carry = [], None
    for p in places:
        t = carry if p is None else p if carry is None else p + carry
        digits.append(F.lpad(F.hex(t.bitwiseAND(F.lit(0xFFFF))), 4, "0"))
        carry = F.shiftrightunsigned(t, 16)
    product = F.unhex(F.concat(F.lit("0" * 32), *reversed(digits)))
    return F.when((a < 0) | (b < 0), F.raise_error(F.lit("a negative number is no unsigned integer")).cast("binary")).otherwise(product)


def to_double(x: Column | str) -> Column:
    parts = limbs(x)
    out = parts[7].cast("double")
    for limb in reversed(parts[:7]):
        out = out * F.lit(4294967296.0) + limb.cast("double")
    return out


def erc20_to_real(x: Column | str, decimals: int | Column) -> Column:
    """x / 10^decimals as a double; decimals outside 0..77 raise."""
    d = F.lit(decimals) if isinstance(decimals, int) else decimals
    return F.when((d < 0) | (d > 77), F.raise_error(F.lit("decimals must be from 0 to 77")).cast("double")).otherwise(to_double(x) / F.pow(F.lit(10.0), d))


def wei_to_eth(text: Column | str) -> Column:
    """Decimal text of wei as a double of ether."""
    return _c(text).cast("double") / F.lit(1e18)


def hex0x(x: Column | str) -> Column:
    """Bytes as 0x and lower-case hex."""
    return F.concat(F.lit("0x"), F.lower(F.hex(_c(x))))


# --- decimal text ---

_DIGITS, _GROUP = 9, 1_000_000_000


def _narrow(x: Column) -> tuple[Column, Column]:
    """Whether 32 bytes hold less than 2^126, and if so their value as DECIMAL(38,0)."""
    digits = F.lpad(F.hex(x), 64, "0")
    half = lambda at: F.conv(F.substring(digits, at, 16), 16, 10).cast("decimal(20,0)")
    return F.substring(digits, 1, 33) < F.lit("0" * 32 + "4"), (half(33) * F.lit(Decimal(1 << 64)) + half(49)).cast("decimal(38,0)")


def _wide(x: Column, more: tuple[int, int] = (0, 0)) -> Column:
    """The value of 32 bytes, and what is added to its two lowest groups of nine digits, as 81 decimal digits."""
    digits = F.lpad(F.hex(x), 64, "0")
    words = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(digits, 8 * i + 1, F.lit(8)), 16, 10).cast("long"))

    def step(groups: Column, word: Column) -> Column:
        """groups * 2^32 + word, each group below 10^9, the lowest first."""
        def carry(a: Column, g: Column) -> Column:
            t = g * F.lit(1 << 32) + a["carry"]
            return F.struct(F.floor(t / F.lit(_GROUP).cast("decimal(10,0)")).cast("long").alias("carry"), F.concat(a["done"], F.array(t % _GROUP)).alias("done"))

        return F.aggregate(groups, F.struct(word.alias("carry"), F.array().cast("array<bigint>").alias("done")), carry, lambda a: a["done"])

    groups = F.aggregate(words, F.array(*[F.lit(0).cast("long")] * _DIGITS), step)

    def text(a: Column, g: Column) -> Column:
        t = g + a["carry"] + F.when(a["at"] == 0, more[0]).when(a["at"] == 1, more[1]).otherwise(0)
        whole = F.when(t >= _GROUP, 1).otherwise(0).cast("long")
        return F.struct(whole.alias("carry"), (a["at"] + 1).alias("at"), F.concat(F.lpad((t % _GROUP).cast("string"), 9, "0"), a["text"]).alias("text"))

    return F.aggregate(groups, F.struct(F.lit(0).cast("long").alias("carry"), F.lit(0).alias("at"), F.lit("").alias("text")), text, lambda a: a["text"])


def u256_to_dec(x: Column | str) -> Column:
    """Bytes as decimal text of up to 78 digits, by built-ins."""
    x = _c(x)
    narrow, value = _narrow(x)
    long = F.ltrim(_wide(x), F.lit("0"))
    return F.when(narrow, value.cast("string")).when(x.isNotNull(), long)


def _fixed_text(x: Column, unit: int, digits: int, name: str) -> Column:
    """Bytes over 10^unit with so many digits after the point, rounded half up, and a name."""
    half = 10 ** (unit - digits) // 2
    narrow, value = _narrow(x)
    text = F.when(narrow, (value + F.lit(half).cast("decimal(20,0)")).cast("decimal(38,0)").cast("string")).when(x.isNotNull(), _wide(x, (half % _GROUP, half // _GROUP)))
    padded = F.lpad(text, 81, "0")
    whole = F.ltrim(F.substring(padded, 1, 80 - unit), F.lit("0"))
    # under no condition, so that the text is made once for its parts
    return F.concat(whole, F.substring(padded, 81 - unit, 1), F.lit("."), F.substring(padded, 82 - unit, digits), F.lit(f" {name}"))


def format_ether(x: Column | str) -> Column:
    """Bytes of wei as `X.XXXXXX ETH`, by built-ins."""
    return _fixed_text(_c(x), 18, 6, "ETH")


def format_gwei(x: Column | str) -> Column:
    """Bytes of wei as `X.XX gwei`, by built-ins."""
    return _fixed_text(_c(x), 9, 2, "gwei")


# --- whole numbers in Python, in Arrow batches ---


def _ints(values: pa.Array) -> list[int | None]:
    out = []
    for v in values.to_pylist():
        if isinstance(v, bytes):
            if len(v) > 32:
                raise ValueError("an operand has more than 32 bytes")
            v = int.from_bytes(v, "big")
        elif v is not None and v < 0:
            raise ValueError("a negative number is no unsigned integer")
        out.append(v)
    return out


def _bytes(values: list[int | None], what: str) -> pa.Array:
    if any(v is not None and v >= TOP for v in values):
        raise OverflowError(f"{what} exceeds 256 bits")
    return pa.array([None if v is None else v.to_bytes(32, "big") for v in values], pa.binary())


def _both(a: pa.Array, b: pa.Array, f) -> list:
    return [None if x is None or y is None else f(x, y) for x, y in zip(_ints(a), _ints(b), strict=True)]


def _fixed(v: int | None, unit: int, digits: int, name: str) -> str | None:
    if v is None:
        return None
    step = 10 ** (unit - digits)
    q = (v + step // 2) // step
    return f"{q // 10**digits}.{q % 10**digits:0{digits}d} {name}"


@F.arrow_udf(T.BinaryType())
def u256_mul(a: pa.Array, b: pa.Array) -> pa.Array:
    """Exact product of two operands of any width; raises past 256 bits. For two longs use mul_longs."""
    return _bytes(_both(a, b, int.__mul__), "u256_mul")


@F.arrow_udf(T.BinaryType())
def add_any(a: pa.Array, b: pa.Array) -> pa.Array:
    return _bytes(_both(a, b, int.__add__), "u256_add")


@F.arrow_udf(T.BinaryType())
def u256(x: pa.Array) -> pa.Array:
    """A non-negative integer or at most 32 bytes as 32 bytes."""
    return _bytes(_ints(x), "u256")


@F.arrow_udf(T.StringType())
def dec_any(x: pa.Array) -> pa.Array:
    return pa.array([None if v is None else str(v) for v in _ints(x)], pa.string())


@F.arrow_udf(T.BinaryType())
def wide_from_dec(text: pa.Array) -> pa.Array:
    """Decimal text of up to 78 digits as 32 bytes; anything else raises."""
    values = []
    for t in text.to_pylist():
        if t is not None and not t.isascii() or t is not None and not t.isdigit():
            raise ValueError(f"{t!r} isn't a decimal number")
        values.append(None if t is None else int(t))
    return _bytes(values, "a number")


@F.arrow_udf(T.StringType())
def ether_any(x: pa.Array) -> pa.Array:
    return pa.array([_fixed(v, 18, 6, "ETH") for v in _ints(x)], pa.string())


@F.arrow_udf(T.StringType())
def gwei_any(x: pa.Array) -> pa.Array:
    return pa.array([_fixed(v, 9, 2, "gwei") for v in _ints(x)], pa.string())


@F.arrow_udf(T.DoubleType())
def real_any(x: pa.Array, decimals: pa.Array) -> pa.Array:
    ds = decimals.to_pylist()
    if any(d is not None and not 0 <= d <= 77 for d in ds):
        raise ValueError("decimals must be from 0 to 77")
    return pa.array([None if v is None or d is None else v / 10**d for v, d in zip(_ints(x), ds, strict=True)], pa.float64())


@F.arrow_udf(T.DoubleType())
def usd_any(x: pa.Array, price: pa.Array) -> pa.Array:
    return pa.array([None if v is None or p is None else v / 10**18 * float(p) for v, p in zip(_ints(x), price.to_pylist(), strict=True)], pa.float64())


def from_dec(text: Column | str) -> Column:
    """Decimal text of up to 38 digits as 32 bytes, by built-ins: nine digits at a time into limbs."""
    t = F.lpad(_c(text), 45, "0")
    parts: list[Column] = [F.lit(0).cast("long")] * 5
    for k in range(5):
        carry = F.substring(t, 9 * k + 1, 9).cast("long")
        new = []
        for p in parts:
            v = p * 1_000_000_000 + carry
            new.append(v.bitwiseAND(F.lit(MASK)))
            carry = F.shiftrightunsigned(v, 32)
        parts = new
    return F.unhex(F.concat(F.lit("0" * 24), *[F.lpad(F.hex(p), 8, "0") for p in reversed(parts)]))
