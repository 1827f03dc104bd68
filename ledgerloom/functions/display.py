"""Amounts as people read them, from built-in functions where the operand is a long or a double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.u256 import _c, to_double


def gwei_of_long(x: Column | str) -> Column:
    """A long of wei as `X.XX gwei`, rounded half up."""
    x = _c(x)
    rounded = x + 5_000_000
    units = F.floor(rounded / F.lit(10_000_000).cast("decimal(20,0)")).cast("long")  # hundredths; exact, as decimals
    return F.concat(((units - units % 100) / 100).cast("long").cast("string"), F.lit("."), F.lpad((units % 100).cast("string"), 2, "0"), F.lit(" gwei"))


def convert_usd(wei: Column | str, price: Column | float | None) -> Column:
    """Ether of an amount times a price; null if either is null."""
    p = F.lit(price).cast("double") if not isinstance(price, Column) else price
    return to_double(wei) / F.lit(1e18) * p


def format_usd(x: Column | str) -> Column:
    """`$X,XXX.XX`, rounded."""
    x = _c(x)
    return F.when(x.isNotNull(), F.concat(F.lit("$"), F.format_string("%,.2f", x)))


def byte_size(n: Column | str) -> Column:
    """A number of bytes in B, KB, MB or GB."""
    n = _c(n)
    over = lambda unit, name: F.format_string(f"%.2f {name}", n.cast("double") / unit)
    return F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, over(1024.0, "KB")).when(n < 1 << 30, over(1048576.0, "MB")).otherwise(over(1073741824.0, "GB"))


def kb_or_mb(n: Column | str) -> Column:
    """A number of bytes in KB below a MB, in MB from there on."""
    n = _c(n)
    return F.when(n < 1 << 20, F.format_string("%.2f KB", n.cast("double") / 1024.0)).otherwise(F.format_string("%.2f MB", n.cast("double") / 1048576.0))


def utc_time(seconds: Column | str) -> Column:
    """Unix seconds as `YYYY-MM-DD HH:MM:SS UTC`; the session's time zone must be UTC."""
    return F.concat(F.date_format(F.timestamp_seconds(_c(seconds)), "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))
