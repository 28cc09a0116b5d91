"""Rounding of the exact binary value of a double, ties to even."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# From here on doubles are whole numbers.
_WHOLE = 2.0**53
# Cuts a double into two halves of 26 bits (Veltkamp).
_CUT = 2.0**27 + 1
_MOST_DIGITS = 8


def round_exact(col: Column, digits: int) -> Column:
    """The double nearest to the value with `digits` decimals that is nearest to `col`, ties to even.

    The exact value counts, not its shortest decimal form: 2.675 lies below
    itself in decimal and gives 2.67. Null, NaN and infinities stay.
    """
    if not 0 <= digits <= _MOST_DIGITS:
        raise ValueError(f"0 to {_MOST_DIGITS} digits, not {digits}")
    scale = F.lit(10.0**digits)

    def nearest(x: Column) -> Column:
        product = x * scale
        high = x * _CUT - (x * _CUT - x)
        # What the product lost; both halves times the scale are exact.
        lost = (high * scale - product) + (x - high) * scale
        whole = F.rint(product)
        # Only at an apparent tie can the lost part matter.
        chosen = (F.when(F.abs(product - whole) != 0.5, whole)
                  .when(lost > 0, F.ceil(product).cast("double")).when(lost < 0, F.floor(product).cast("double"))
                  .otherwise(whole))
        return F.when(F.abs(product) >= _WHOLE, x).otherwise(chosen / scale)

    # The array binds the value once, however large the expression behind it.
    return F.transform(F.array(col.cast("double")), nearest)[0]
