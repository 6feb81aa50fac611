"""Small string helpers shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


BLANKS = "".join(map(chr, range(0x21)))


def let(value: Column, body) -> Column:
    """body(value) with `value` evaluated once; inside a lambda it would be evaluated per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Drop control characters and blanks (code points up to 0x20) from both ends."""
    return F.btrim(c, F.lit(BLANKS))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def strings(values) -> Column:
    """A literal array<string>; unlike F.array() it keeps its type when empty."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def string_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def look_up(mapping: Column, key: Column) -> Column:
    """Value for `key`, or NULL when it is unknown (also under ANSI mode)."""
    return F.try_element_at(mapping, key)


def round_half_up(c: Column, digits: int) -> Column:
    """floor(v*10^n + 0.5) / 10^n; `round` goes through decimal text and differs."""
    scale = float(10**digits)
    return F.floor(c * scale + F.lit(0.5)).cast("double") / F.lit(scale)


def cut(c: Column, limit: int) -> Column:
    """Display cut: at most `limit` characters, then three dots."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)


def join_human(items: Column) -> Column:
    """a / a and b / a, b and c"""
    n = F.size(items)
    return F.when(n <= 1, F.array_join(items, "")).otherwise(
        F.concat(
            F.array_join(F.slice(items, F.lit(1), n - 1), ", "),
            F.lit(" and "),
            F.try_element_at(items, F.lit(-1)),
        )
    )


def first_n(items: Column, n: int | None) -> Column:
    """The first n elements; all of them where n is None."""
    return items if n is None else F.slice(items, 1, n)
