"""Numeric, mapping and text expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(value: ColumnOrName) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def safe_div(numerator: ColumnOrName, denominator: ColumnOrName, default: float | None = None) -> Column:
    """``numerator / denominator``; a zero or NULL operand gives ``default``."""
    quotient = F.try_divide(col(numerator), col(denominator))
    return quotient if default is None else F.coalesce(quotient, F.lit(float(default)))


def growth(current: ColumnOrName, previous: ColumnOrName, default: float | None = 0.0) -> Column:
    """``(current - previous) / previous`` with the zero rule of :func:`safe_div`."""
    return safe_div(col(current) - col(previous), previous, default)


def finite(value: ColumnOrName, default: float = 0.0) -> Column:
    """NaN, infinities and NULL become ``default``."""
    c = col(value)
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(bad, F.lit(default)).otherwise(c)


def clip(value: ColumnOrName, low: float | None = None, high: float | None = None) -> Column:
    """Bound a value; NULL stays NULL (``greatest``/``least`` alone would skip it)."""
    c = bounded = col(value)
    if low is not None:
        bounded = F.greatest(bounded, F.lit(low))
    if high is not None:
        bounded = F.least(bounded, F.lit(high))
    return F.when(c.isNotNull(), bounded)


def round_to(value: ColumnOrName, step: float) -> Column:
    """Round half up to a multiple of ``step``."""
    return F.floor(col(value) / F.lit(step) + F.lit(0.5)) * F.lit(step)


def bucketize(
    value: ColumnOrName, edges: Sequence[float], labels: Sequence, right: bool = True, include_lowest: bool = True
) -> Column:
    """Fixed-edge buckets, closed on the right by default; values outside the edges give NULL."""
    if len(labels) != len(edges) - 1:
        raise ValueError("need one label per interval")
    c = col(value)
    out = None
    for i, label in enumerate(labels):
        low, high = F.lit(edges[i]), F.lit(edges[i + 1])
        if right:
            inside = (c > low) & (c <= high)
            if include_lowest and i == 0:
                inside = (c >= low) & (c <= high)
        else:
            inside = (c >= low) & (c < high)
        out = F.when(inside, F.lit(label)) if out is None else out.when(inside, F.lit(label))
    return out


def map_values(value: ColumnOrName, mapping: Mapping, default=None) -> Column:
    """Code to name. Unknown codes give ``default`` (a literal or a column)."""
    c = col(value)
    out = None
    for key, name in mapping.items():
        out = F.when(c == F.lit(key), F.lit(name)) if out is None else out.when(c == F.lit(key), F.lit(name))
    return out if default is None else out.otherwise(default if isinstance(default, Column) else F.lit(default))


def label_like(value: ColumnOrName, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """First LIKE pattern that matches gives the label."""
    c = col(value)
    out = None
    for pattern, label in rules:
        out = F.when(c.like(pattern), F.lit(label)) if out is None else out.when(c.like(pattern), F.lit(label))
    return out if default is None else out.otherwise(F.lit(default))


def to_number(value: ColumnOrName) -> Column:
    """Text to double; text that is not a number gives NULL."""
    return F.trim(col(value)).try_cast("double")


def reward_points(spend: ColumnOrName, rate: float, cap: float) -> Column:
    """Points for a spend, rounded to whole points and capped."""
    return F.least(F.round(col(spend) * F.lit(rate)), F.lit(float(cap)))


def whole_multiples(value: ColumnOrName, unit: float) -> Column:
    """The part of ``value`` made of whole ``unit``s; the rest is ``value`` minus it."""
    return F.floor(col(value) / F.lit(unit)) * F.lit(unit)


def private_label_flag(brand: ColumnOrName, own_brand: str, markers: Sequence[str] = ("IMP", "IMPORT")) -> Column:
    """1 when the brand is the house brand or one of its words is an import marker."""
    c = col(brand)
    words = F.split(F.upper(c), " ")
    hit = c == F.lit(own_brand)
    for marker in markers:
        hit = hit | F.array_contains(words, marker)
    return F.coalesce(hit, F.lit(False)).cast("int")


def business_key(*parts: ColumnOrName, sep: str = "|") -> Column:
    """Concatenated key; NULL when any part is NULL, so that it never matches by accident."""
    return F.concat(*[c for p in parts for c in (F.lit(sep), col(p).cast("string"))][1:])


def unit_price(
    amount: ColumnOrName,
    quantity: ColumnOrName,
    content: ColumnOrName = "content",
    conversion: ColumnOrName | None = None,
    item_count: ColumnOrName | None = None,
) -> Column:
    """Price per unit of content (litre, kilo, piece ...)."""
    return safe_div(amount, volume_sold(quantity, content, conversion, item_count))


def volume_sold(
    quantity: ColumnOrName,
    content: ColumnOrName = "content",
    conversion: ColumnOrName | None = None,
    item_count: ColumnOrName | None = None,
) -> Column:
    out = col(quantity) * col(content)
    for factor in (conversion, item_count):
        if factor is not None:
            out = out * col(factor)
    return out


# Grams and millilitres per unit.
UNIT_FACTORS = {"OZ": 28.3495, "LB": 453.592, "KG": 1000.0, "G": 1.0, "L": 1000.0, "ML": 1.0, "CL": 10.0}


def convert_units(value: ColumnOrName, unit: ColumnOrName, factors: Mapping[str, float] = UNIT_FACTORS) -> Column:
    """Value times the factor of its unit; unknown units keep the value."""
    return col(value) * map_values(F.upper(F.trim(col(unit))), factors, 1.0)


def discount_amount(unit: ColumnOrName, regular: ColumnOrName) -> Column:
    """Paid minus regular price; negative for a discount."""
    return col(unit) - col(regular)


def promo_share(price: ColumnOrName, discount: ColumnOrName) -> Column:
    """Discount depth ``1 - p / (p + d)``, kept within [0, 1]."""
    return clip(F.lit(1.0) - safe_div(price, col(price) + col(discount)), 0.0, 1.0)


def pack_count(text: ColumnOrName) -> Column:
    """Pieces of a pack written as ``6x1.5L``; 1 when no multiplier is written."""
    found = F.regexp_extract(col(text), r"(?i)(\d+)\s*x", 1)
    return F.when(found == "", F.lit(1)).otherwise(found.try_cast("int"))


def pack_volume(text: ColumnOrName) -> Column:
    """Content of one piece of a pack text."""
    return F.regexp_extract(col(text), r"(?i)(\d+(?:\.\d+)?)\s*(?:ml|cl|l|kg|g|oz)\b", 1).try_cast("double")


def pack_unit(text: ColumnOrName) -> Column:
    found = F.regexp_extract(col(text), r"(?i)\d\s*(ml|cl|l|kg|g|oz)\b", 1)
    return F.when(found != "", F.upper(found))


def title_case(text: ColumnOrName) -> Column:
    """``still-water`` becomes ``Still Water``."""
    return F.initcap(F.regexp_replace(col(text), "-", " "))


def seeded_order(seed: int, *keys: ColumnOrName) -> Column:
    """A pseudo-random order that any engine or rerun reproduces: the MD5 of seed and key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in keys]))
