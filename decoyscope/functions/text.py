"""Column helpers on strings, lists and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def any_in(text: Column, needles: list[str]) -> Column:
    """Whether `text` contains one of `needles`; false for null."""
    return F.coalesce(F.exists(strings(needles), lambda n: F.contains(text, n)), F.lit(False)) if needles else F.lit(False)


def first_in(text: Column, needles: list[str]) -> Column:
    """The first of `needles`, in their order, that `text` contains, else null."""
    return F.get(F.filter(strings(needles), lambda n: F.contains(text, n)), F.lit(0))


def first_non_empty(*cols: Column) -> Column:
    """The first value that isn't blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols])


def entropy(s: Column) -> Column:
    """Shannon entropy in bits of the characters of `s`, rounded to 4 places; 0 for null or empty.

    One pass over the sorted characters: `sum` adds up n * log2(n) of each run of equal ones.
    """
    chars = F.array_sort(F.filter(F.split(s, ""), lambda c: c != ""))
    n = F.length(s).cast("double")
    weight = lambda k: k * F.log2(k)
    start = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("k"), F.lit(0.0).alias("sum"))
    step = lambda a, c: F.when(a["c"] == c, F.struct(c.alias("c"), (a["k"] + 1.0).alias("k"), a["sum"].alias("sum"))).otherwise(
        F.struct(c.alias("c"), F.lit(1.0).alias("k"), (a["sum"] + F.when(a["k"] > 0, weight(a["k"])).otherwise(0.0)).alias("sum")))
    bits = F.log2(n) - F.aggregate(chars, start, step, lambda a: a["sum"] + F.when(a["k"] > 0, weight(a["k"])).otherwise(0.0)) / n
    return F.when(F.length(s) > 0, F.round(bits, 4)).otherwise(0.0)


def count_of(s: Column, chars: str) -> Column:
    """How many characters of `s` are among `chars`."""
    return F.length(s) - F.length(F.translate(s, chars, ""))


def epoch_to_iso(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days, rounded down; parts of a second count."""
    gap = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return F.floor((gap - F.pmod(gap, F.lit(86_400_000_000))) / 86_400_000_000)


def exif_time(s: Column) -> Column:
    return F.try_to_timestamp(s, F.lit("yyyy:MM:dd HH:mm:ss"))


def csv_list(s: Column) -> Column:
    """The non-blank items of a comma-separated string."""
    return F.filter(F.transform(F.split(s, ","), lambda x: F.trim(x)), lambda x: x != "")
