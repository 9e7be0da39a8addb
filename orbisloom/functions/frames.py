"""The frame-list language, as expressions over a string column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def listed(spec: Column) -> Column:
    """Sorted distinct numbers of `0,3,10-12`. Blanks are ignored, an empty part too; another part fails the query."""
    parts = F.filter(F.transform(F.split(F.coalesce(spec, F.lit("")), ","), lambda p: F.regexp_replace(p, r"\s", "")), lambda p: p != "")

    def numbers(p: Column) -> Column:
        a, b = F.regexp_extract(p, r"^(\d+)", 1).try_cast("int"), F.regexp_extract(p, r"^\d+-(\d+)$", 1).try_cast("int")
        ranged = F.when(F.coalesce(b, a) >= a, F.sequence(a, F.coalesce(b, a))).otherwise(F.array().cast("array<int>"))
        return F.when(p.rlike(r"^\d+(-\d+)?$"), ranged).otherwise(F.raise_error(F.concat(F.lit("not a frame list: "), p)).cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, numbers))))


def spanned(spec: Column, total: Column) -> Column:
    """Sorted distinct frames below total of `all`, `7`, `A-B`, `A-`, `-B`, each also with a step `/S`, joined by commas.

    `/S` alone steps through all. Ends are clamped to the frames there are; a part that lies outside adds none. A step
    below 1 or another part fails the query."""
    parts = F.filter(F.transform(F.split(F.lower(F.coalesce(spec, F.lit(""))), ","), lambda p: F.regexp_replace(p, r"\s", "")), lambda p: p != "")
    none = F.array().cast("array<int>")

    def numbers(p: Column) -> Column:
        body = F.regexp_extract(p, r"^([^/]*)", 1)
        step = F.coalesce(F.regexp_extract(p, r"/(\d+)$", 1).try_cast("int"), F.lit(1))
        one = body.rlike(r"^\d+$")
        low = F.when(body.isin("", "all"), F.lit(0)).otherwise(F.coalesce(F.regexp_extract(body, r"^(\d+)", 1).try_cast("int"), F.lit(0)))
        high = F.when(one, low).otherwise(F.coalesce(F.regexp_extract(body, r"-(\d+)$", 1).try_cast("int"), total - 1))
        low, high = F.greatest(low, F.lit(0)), F.least(high, total - 1)
        fine = p.rlike(r"^(all|\d+|\d+-\d*|-\d+)?(/0*[1-9]\d*)?$") & (p != "-")
        return F.when(~fine, F.raise_error(F.concat(F.lit("not a frame range: "), p)).cast("array<int>")).when(low <= high, F.sequence(low, high, step)).otherwise(none)

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, numbers))))


def largest_divisor_4n1(n: Column, cap: Column) -> Column:
    """The largest divisor of n that leaves 1 when divided by 4 and is at most cap; 1 where there is no other."""
    top = F.least(n, cap)
    return F.when(top < 1, F.lit(1)).otherwise(F.array_max(F.filter(F.sequence(F.lit(1), F.greatest(top, F.lit(1))), lambda d: (n % d == 0) & (d % 4 == 1))))


def batch_size(n: Column, cap: Column) -> Column:
    """That divisor if it is above 1, else the largest number 4k + 1 within both n and cap."""
    divisor, most = largest_divisor_4n1(n, cap), F.greatest(F.least(n, cap), F.lit(1))
    return F.when(divisor > 1, divisor).otherwise((most - F.pmod(most - 1, F.lit(4))).cast("int"))
