"""Display formats: money in lakhs, experience bands, labels and bullet lists."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hybridq.functions.strings import look_up, string_map, strip
from hybridq.vocab import EMPLOYMENT_LABELS


def format_lakhs(amount: Column) -> Column:
    """Amount / 100 000 to one decimal, half up, without a trailing zero."""
    magnitude = F.abs(amount.cast("long"))
    tenths = F.floor((magnitude + 5_000) / 10_000).cast("long")
    whole, frac = F.floor(tenths / 10).cast("long"), tenths % 10
    sign = F.when((amount < 0) & (tenths > 0), "-").otherwise("")
    return F.concat(
        sign, whole.cast("string"), F.when(frac > 0, F.concat(F.lit("."), frac.cast("string"))).otherwise("")
    )


def format_salary(low: Column, high: Column, currency: Column) -> Column:
    lo, hi = format_lakhs(low), format_lakhs(high)
    rupees = F.concat(F.lit("₹"), F.when(lo == hi, lo).otherwise(F.concat(lo, F.lit("-"), hi)), F.lit(" LPA"))
    other = F.concat(currency, F.lit(" "), F.format_number(low, 0), F.lit("-"), F.format_number(high, 0))
    return F.when(currency.isNull() | (F.upper(currency) == "INR"), rupees).otherwise(other)


def format_experience(low: Column, high: Column) -> Column:
    single = F.concat(low.cast("string"), F.when(low == 1, " year").otherwise(" years"))
    return F.when(low == high, single).otherwise(
        F.concat(low.cast("string"), F.lit("-"), high.cast("string"), F.lit(" years"))
    )


def employment_label(code: Column) -> Column:
    return F.coalesce(look_up(string_map(EMPLOYMENT_LABELS), F.upper(code)), code, F.lit("Not specified"))


def bullet_list(items: Column, empty: str = "- Not specified") -> Column:
    lines = F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, F.lit(empty)).otherwise(strip(lines))


def yes_no(flag: Column) -> Column:
    return F.when(flag, "Yes").otherwise("No")


def date_text(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("null"))
