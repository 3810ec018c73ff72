"""Column helpers: rounding, safe numbers, lenient number parsing, day arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rounded(c: Column, places: int) -> Column:
    """Half-up rounding through a decimal, so that floating noise far below
    the last kept digit (summation order, platform) cannot flip a tie."""
    scale = 8 if places <= 2 else 10
    return F.round(c.try_cast(f"decimal(38,{scale})"), places).cast("double")


def money(c: Column) -> Column:
    """Null, NaN and infinities become 0; two decimals."""
    return F.coalesce(rounded(c, 2), F.lit(0.0))


def exact_sum(c: Column) -> Column:
    """Sum through a decimal: the result does not depend on the order of rows."""
    return F.sum(c.cast("decimal(18,6)"))


def clamp(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def ratio(num: Column, den: Column, default=0.0) -> Column:
    """num / den in doubles, ``default`` where the denominator is 0 or null."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(default))


def int_prefix(c: Column) -> Column:
    """Leading integer of a string ("3abc" -> 3, "2.5" -> 2), else null."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*([+-]?\d+)", 1).try_cast("int")


def float_prefix(c: Column) -> Column:
    """Leading decimal number of a string, else null."""
    number = F.regexp_extract(
        F.coalesce(c, F.lit("")), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1
    )
    return number.try_cast("double")


# White space removed around values: tab to carriage return, blank, no-break space, byte-order mark, other spaces.
WHITE_SPACE = "\t\n\x0b\x0c\r \u00a0\ufeff\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.btrim(c, F.lit(WHITE_SPACE)), F.lit(""))


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days, never negative."""
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return F.greatest(F.lit(0.0), micros / F.lit(86400e6))


def grouped_in(c: Column) -> Column:
    """Whole number with Indian digit grouping (12,34,567), rounded half-up."""
    whole = F.round(F.abs(c).cast("decimal(38,4)"), 0).cast("decimal(38,0)").cast("string")
    tail = F.right(whole, F.lit(3))
    front = F.substring(whole, F.lit(1), F.greatest(F.length(whole) - 3, F.lit(0)))
    # A comma before every pair of digits counted from the right end of the front part.
    front = F.regexp_replace(front, r"(?<=\d)(?=(?:\d{2})+$)", ",")
    digits = F.when(F.length(whole) > 3, F.concat(front, F.lit(","), tail)).otherwise(whole)
    return F.when((c < 0) & (whole != "0"), F.concat(F.lit("-"), digits)).otherwise(digits)


def fixed2(c: Column) -> Column:
    """Two fixed decimals, no grouping."""
    return F.round(c.try_cast("decimal(38,8)"), 2).cast("decimal(38,2)").cast("string")


def iso_day(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def order_key(items: DataFrame) -> list[str]:
    """Columns that join lines to their order.

    An order number is unique within a tenant only, so lines that carry their
    tenant join on both. Lines without one come from sources whose order
    numbers are unique over all tenants.
    """
    return ["user_id", "order_id"] if "user_id" in items.columns else ["order_id"]
