"""Text predicates and presentation formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradegrain.functions.numeric import as_double


def is_filled(text: Column) -> Column:
    """Not null and not only blanks; never null itself."""
    return F.coalesce(F.trim(text) != "", F.lit(False))


def title_words(text: Column) -> Column:
    """Underscores to blanks, words capitalized."""
    return F.initcap(F.replace(text, F.lit("_"), F.lit(" ")))


# Powers of two that add up to the scale; multiplying by each is exact.
_SCALE_PARTS = {0: [1.0], 1: [8.0, 2.0], 2: [64.0, 32.0, 4.0]}


def as_printed(value: Column, digits: int) -> Column:
    """Round the exact binary value, as C-style formatting does: 1.25 gives 1.2, 1.15 gives 1.1.

    A scaled value that lands on a tie may have been rounded onto it; the remainder tells which side
    the exact product is on.
    """
    number = as_double(value)
    scaled = number * float(10**digits)
    remainder = scaled
    for part in _SCALE_PARTS[digits]:
        remainder = remainder - number * part
    tie = scaled - F.floor(scaled) == 0.5
    rounded = (
        F.when(tie & (remainder > 0), F.floor(scaled).cast("double"))
        .when(tie & (remainder < 0), F.ceil(scaled).cast("double"))
        .otherwise(F.bround(scaled))
    )
    return rounded / float(10**digits)


def reais(value: Column, digits: int = 2) -> Column:
    return F.concat(F.lit("R$ "), F.format_number(as_printed(value, digits), digits))


def plain_reais(value: Column) -> Column:
    """Currency without thousands separators."""
    return F.format_string("R$ %.2f", as_printed(value, 2))


def thousands(value: Column) -> Column:
    return F.format_number(value, 0)


def fixed_point(value: Column, digits: int, suffix: str) -> Column:
    pattern = "%." + str(digits) + "f" + suffix.replace("%", "%%")
    return F.format_string(pattern, as_printed(value, digits))
