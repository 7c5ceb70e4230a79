"""Money: amounts, periods and labels. Decimal throughout, and currencies are never converted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AMOUNT = "decimal(18,4)"


def parse_amount(number: Column, mult: Column | None = None) -> Column:
    """Amount of a written number: separators before groups of three digits are thousands, a comma elsewhere makes it unreadable; k and m multiply."""
    grouped = number.rlike(r"^\d{1,3}(?:[.,]\d{3})+(?:\.\d+)?$")
    value = F.when(grouped, F.regexp_replace(number, r"[.,](?=\d{3}(?!\d))", "")).otherwise(number).try_cast(AMOUNT)
    if mult is None:
        return value
    power = F.coalesce(F.try_element_at(F.create_map(F.lit("k"), F.lit(1_000), F.lit("m"), F.lit(1_000_000)), F.lower(mult)), F.lit(1))
    return (value * power.cast("decimal(7,0)")).try_cast(AMOUNT)


def amounts_in(text: Column) -> Column:
    """Set of all numbers in the text, 175k and 1.2m expanded."""
    # words that begin with a digit, with k or m in them or behind one blank
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(?<![\w.,])\d[\d.,]*\s?(?:[km](?!\w))?(?!\w)"), F.lit(0))
    split = F.transform(words, lambda w: F.struct(F.rtrim(F.translate(w, "km ", ""), F.lit(".,")).alias("n"), F.regexp_extract(w, "[km]", 0).alias("m")))
    return F.array_distinct(F.array_compact(F.transform(split, lambda x: parse_amount(x["n"], x["m"]))))


#: What is written for a unit of time behind "per", "a" or a stroke, and the adverbs.
UNIT_NAMES = {
    "hour": ("hour", "hr", "hourly"), "day": ("day", "diem", "daily"), "week": ("week", "wk", "weekly"), "month": ("month", "mo", "monthly"),
    "year": ("year", "yr", "annum", "annually", "yearly"),
}
_UNIT = r"(?iU)(?:\b(?:per|an?|each)\s+|/\s*|\b(?=\w+ly\b))(" + "|".join(n for names in UNIT_NAMES.values() for n in names) + r")\b"


def unit_of_time(text: Column) -> Column:
    """The unit that the text names first."""
    table = F.create_map(*[F.lit(x) for unit, names in UNIT_NAMES.items() for n in names for x in (n, unit)])
    return F.try_element_at(table, F.lower(F.regexp_extract(text, _UNIT, 1)))


def detect_period(text: Column) -> Column:
    """The unit of time, if pay can be stated in it."""
    return F.nullif(unit_of_time(text), F.lit("week"))


def is_weekly(text: Column) -> Column:
    return F.coalesce(unit_of_time(text) == "week", F.lit(False))


def compared(left: Column, left_currency: Column, right: Column, right_currency: Column) -> Column:
    """left < right, an error across currencies."""
    same = F.upper(left_currency) == F.upper(right_currency)
    return F.when(F.assert_true(same, F.lit("amounts of different currencies")).isNull(), left < right)


def same_pay(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Whether two (low, high, currency, period) say the same; a single figure equals itself written as a range."""
    unit = a[2].eqNullSafe(b[2]) & a[3].eqNullSafe(b[3])
    equal = a[0].eqNullSafe(b[0]) & a[1].eqNullSafe(b[1])

    def single(x: tuple[Column, ...]) -> Column:
        return F.array_distinct(F.array_compact(F.array(x[0], x[1])))

    one = (F.size(single(a)) == 1) & (F.size(single(b)) == 1) & (F.get(single(a), 0) == F.get(single(b), 0))
    spelled = F.coalesce(a[0] == a[1], F.lit(False)) | F.coalesce(b[0] == b[1], F.lit(False))
    return unit & (equal | (one & spelled))


def back_off(base: float, failures: Column, most: float) -> Column:
    """Seconds to wait: doubles with every failure."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), failures - 1), F.lit(most))


def pin_radius(count: Column) -> Column:
    return F.when(count == 1, F.lit(6.0)).otherwise(F.least(F.lit(18.0), F.lit(5.0) + F.lit(0.9) * F.sqrt(count)))


def short_money(amount: Column) -> Column:
    """Whole thousands as k."""
    return F.when(amount % 1000 == 0, F.concat((amount / 1000).cast("bigint").cast("string"), F.lit("k"))).otherwise(amount.cast("bigint").cast("string"))


def money_range(low: Column, high: Column) -> Column:
    both = low.isNotNull() & high.isNotNull() & (low != high)
    return F.when(both, F.concat_ws("–", short_money(low), short_money(high))).otherwise(short_money(F.coalesce(low, high)))
