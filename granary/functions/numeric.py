"""Numbers: guarded division, half-even rounding, interpolation, sizes, seeds, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column, empty=0.0) -> Column:
    """top / bottom as double, or ``empty`` where bottom is 0 or null."""
    return F.when(F.coalesce(bottom, F.lit(0)) == 0, F.lit(empty)).otherwise(top.cast("double") / bottom.cast("double"))


def half_even(value: Column, places: int = 0) -> Column:
    """Rounding where halves go to the even neighbour."""
    return F.bround(value.cast("double"), places)


def round_to(value: Column, factor: int) -> Column:
    return (half_even(value / factor) * factor).cast("long")


def ceil_to(value: Column, factor: int) -> Column:
    return (F.ceil(value / factor) * factor).cast("long")


def floor_to(value: Column, factor: int) -> Column:
    return (F.floor(value / factor) * factor).cast("long")


def smart_resize(height: Column, width: Column, factor: int = 32, min_pixels: int = 1024, max_pixels: int = 1 << 20, max_ratio: float = 200.0) -> Column:
    """Target (height, width): multiples of factor, pixels inside the bounds, ratio kept; null if too elongated."""
    long_side, short_side = F.greatest(height, width), F.least(height, width)
    h = F.greatest(F.lit(factor), round_to(height, factor))
    w = F.greatest(F.lit(factor), round_to(width, factor))
    shrink = F.sqrt(height * width / F.lit(float(max_pixels)))
    grow = F.sqrt(F.lit(float(min_pixels)) / (height * width))

    def pick(side: Column, plain: Column) -> Column:
        smaller = F.greatest(F.lit(factor), floor_to(side / shrink, factor))
        larger = ceil_to(side * grow, factor)
        return F.when(h * w > max_pixels, smaller).when(h * w < min_pixels, larger).otherwise(plain).cast("long")

    sized = F.struct(pick(height, h).alias("height"), pick(width, w).alias("width"))
    return F.when((short_side > 0) & (long_side / short_side <= max_ratio), sized)


def lerp(start: Column, end: Column, at: Column) -> Column:
    """start to end as ``at`` goes from 0 to 1, clamped."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), at))
    return start + (end - start) * t


def percent(value: Column, places: int = 2) -> Column:
    return F.format_string(f"%.{places}f%%", value * 100)


def step_of(text: Column) -> Column:
    """The number before the slash of '12/400'; null if there is none."""
    return F.split_part(text, F.lit("/"), F.lit(1)).try_cast("long")


def mix_seed(*parts: Column) -> Column:
    """A non-negative 32-bit number from several."""
    return F.xxhash64(*parts).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def f_beta(precision: Column, recall: Column, beta: float = 1.0) -> Column:
    b = beta * beta
    return ratio((1 + b) * precision * recall, b * precision + recall)


def tversky(hit: Column, false_pos: Column, false_neg: Column, alpha: float, beta: float) -> Column:
    return ratio(hit, hit + alpha * false_pos + beta * false_neg)


def clamp(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def pool_size(total: Column, wanted: Column) -> Column:
    """A count, or below 1 a fraction, of ``total``; between 1 and total."""
    size = F.when(wanted < 1, F.floor(total * wanted)).otherwise(wanted).cast("long")
    return F.least(total.cast("long"), F.greatest(F.lit(1).cast("long"), size))
