"""Column expressions for the numeric rules of the analysis."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphtally import settings as S


def clamp8(x: Column) -> Column:
    """What a byte raster stores: half to even, 0 to 255."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.bround(x))).cast("int")


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def margin(best: Column, second: Column) -> Column:
    """How much the best beats the second, 0 to 1; 1 without a second or where that is 0."""
    return F.when(second.isNull() | (second <= 0), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (second - best) / second)))


def group_band(number: Column, sharpness: Column, gap: Column, count: Column) -> Column:
    (blurred, soft), (close, near) = S.GROUP_BANDS
    return (F.when(number.isNull() | (sharpness < blurred) | (gap < close), "review")
            .when((sharpness < soft) | (gap < near) | (count < S.MIN_MEMBERS), "medium").otherwise("high"))


def match_band(number: Column, distance: Column, gap: Column) -> Column:
    (far, off), (close, near) = S.MATCH_BANDS
    return (F.when(number.isNull() | (distance > far) | (gap < close), "review")
            .when((distance > off) | (gap < near), "medium").otherwise("high"))


def hole_penalty(holes: Column, expected: Column) -> Column:
    """Factor for a glyph whose count of counters (two at most) differs from the template's."""
    delta = F.abs(F.least(F.lit(2), holes) - expected)
    return F.when(delta == 0, S.HOLE_PENALTIES[0]).when(delta == 1, S.HOLE_PENALTIES[1]).otherwise(S.HOLE_PENALTIES[2])


def polarity_rank(score: Column, inverted: Column) -> Column:
    return F.when(inverted, score).otherwise(score * S.SAME_POLARITY_BONUS)


def csv_field(x: Column) -> Column:
    """A text quoted where it holds a quote, comma or line feed; null is empty."""
    quoted = F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(x.rlike('[",\n]'), quoted).otherwise(x), F.lit(""))


def plain_number(x: Column, digits: int) -> Column:
    """A number as text without trailing zeros; null is empty."""
    text = F.format_string(f"%.{digits}f", x.cast("double"))
    return F.when(x.isNull(), F.lit("")).otherwise(F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", ""))
